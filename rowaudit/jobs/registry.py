"""Where jobs register their queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import fixture, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of the fixtures that ``needs`` names, in that order; ``sql`` may use them by name."""
    names = needs.split()

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: dict[str, DataFrame] = {}
            return f(*(fixture(spark, sf_dir, n, made) for n in names))

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_fixtures(sql, *names) if names else sql
        return f

    return register
