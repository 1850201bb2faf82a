"""Tables in and out."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Folders that the functions now running have written, innermost last; each thread has its own.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("_OPEN", default=())
#: The folder that takes new ones in, if any.
_IN: ContextVar[str | None] = ContextVar("_IN", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pair(spark: SparkSession, source: dict, target: dict) -> tuple[DataFrame, DataFrame]:
    """Both sides of a comparison: for each, ``format`` (parquet, csv, orc, json, jdbc ...), ``path`` (none for jdbc) and ``options``."""
    def one(side: dict) -> DataFrame:
        reader = spark.read.format(side.get("format", "parquet")).options(**side.get("options", {}))
        return reader.load(side["path"]) if "path" in side else reader.load()

    return one(source), one(target)


def write_hashes(hashes: DataFrame, path: str) -> None:
    """``Row_ID, Hash_Value, Hash_Length`` as CSV with a header, a file for each partition."""
    hashes.write.option("header", True).csv(path)


def write_results(results: DataFrame, path: str, *, by: str = "schema_name") -> None:
    """Result or issue rows as Parquet, a folder for each schema."""
    results.write.partitionBy(by).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where that is unset and all run on one machine, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="rowaudit-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; it goes with its ``tidy`` function, if there is one."""
    path = f"{_IN.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN.get() and not _IN.get():
        _OPEN.get()[-1].append(path)
    return path


@contextlib.contextmanager
def gathered(spark: SparkSession, name: str) -> Iterator[None]:
    """New folders within lie in one folder of this name, and go with it."""
    before = _IN.set(new_folder(spark, name))
    try:
        yield
    finally:
        _IN.reset(before)


def written(df: DataFrame, name: str, *, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read again: what it holds is fixed and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def attempt(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """The folders written within go at its end, unless the function that it gives is called: then the surroundings have them."""
    mine: list[str] = []
    kept = []
    before = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield lambda: kept.append(True)
    finally:
        _OPEN.reset(before)
        if not kept:
            _delete(spark, mine)
        elif _OPEN.get():
            _OPEN.get()[-1].extend(mine)


def tidy(f: Callable) -> Callable:
    """The folders that ``f`` writes go when it returns or fails; a DataFrame that it returns, alone or in a tuple, is
    written first, and stays until the shared folder is cleared or the ``tidy`` function around it returns."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        spark = args[0] if isinstance(args[0], SparkSession) else args[0].sparkSession
        mine: list[str] = []
        before = _OPEN.set((*_OPEN.get(), mine))
        open_ = True
        try:
            out = f(*args, **kwargs)
            _OPEN.reset(before)
            open_ = False
            keep = lambda x: written(x, f.__name__) if isinstance(x, DataFrame) else x
            return tuple(keep(x) for x in out) if isinstance(out, tuple) else keep(out)
        finally:
            if open_:
                _OPEN.reset(before)
            _delete(spark, mine)

    return run
