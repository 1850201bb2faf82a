"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: The tables that the operators now running have written, innermost last; each thread has its own.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("_OPEN", default=())
#: Folders of catalog tables, by the tables' names.
_NAMED = "table:"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset and master and executors are one machine, a temporary folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="rowaudit-")
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _mine().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str, buckets: int, *, apart: str) -> DataFrame:
    """``df`` written in ``buckets`` by a column: what is grouped by it is later read without a shuffle. ``apart`` gets folders of its own."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{table}"
    _mine().extend([path, _NAMED + table])
    df.write.option("compression", "zstd").option("path", path).partitionBy(apart).bucketBy(buckets, by).saveAsTable(table)
    return spark.table(table)


def _mine() -> list[str]:
    return _OPEN.get()[-1] if _OPEN.get() else []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        if p.startswith(_NAMED):
            spark.sql(f"drop table if exists {p[len(_NAMED) :]}")
            continue
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(f: Callable) -> Callable:
    """The tables that ``f`` writes go when it returns or fails; a DataFrame it returns is written first."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        mine: list[str] = []
        before = _OPEN.set((*_OPEN.get(), mine))
        try:
            out = f(*args, **kwargs)
            if isinstance(out, DataFrame):
                _OPEN.reset(before)
                before = None
                out = written(out, f.__name__)
            return out
        finally:
            if before is not None:
                _OPEN.reset(before)
            _delete(args[0].sparkSession, mine)

    return run


#: Slots of the bitmap below: 4 MB, whatever the corpus holds.
BITMAP_SLOTS = 1 << 25
_PAGE = 8 * 4096


def slot_of(*cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BITMAP_SLOTS))


def bitmap_of(df: DataFrame, slot: F.Column) -> bytes:
    """A bitmap of fixed size with the slots that occur. It only thins rows out before an exact join:
    a slot that two keys share lets a row through that the join then drops."""
    at = slot + 1
    pages = df.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = bytearray(BITMAP_SLOTS // 8)
    for page, bits in pages:
        start = (page - 1) * _PAGE // 8
        out[start : start + len(bits)] = bits
    return bytes(out)


def bitmap_has(bits, slots):
    """For a numpy array of slots: which are set."""
    import numpy as np

    b = np.frombuffer(bits, np.uint8)
    return (b[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
