"""Row fingerprints: which columns, in which form, hashed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import row_text

#: Types of large objects, by exact name and by what the name holds (fixed values).
LOB_TYPES = ("BLOB", "CLOB", "NCLOB", "BFILE", "LONG RAW", "RAW", "LONG", "XMLTYPE", "BYTEA", "OID", "TEXT", "BYTE[]")
LOB_PARTS = ("CLOB", "BLOB", "BFILE", "XMLTYPE", "BYTEA", "LONG RAW", "BYTE[]")
#: Parts of the names of types that can't be ordered by (fixed values).
UNORDERED = ("BLOB", "CLOB", "NCLOB", "BFILE", "BYTEA", "TEXT", "JSON", "XML", "GEOGRAPHY", "GEOMETRY", "HSTORE", "TSVECTOR", "TSQUERY", "ARRAY", "BYTE[]")
#: How much of a large object is read if no limit is given: bytes, characters.
LOB_BYTES, LOB_CHARS, LOB_MOST = 2000, 4000, 4000


def skip_columns(df: DataFrame, skip: Iterable[str] = (), *, target: bool = False) -> DataFrame:
    """Without the columns named, in any case; a target side never shows the key column that migrations add."""
    gone = {c.lower() for c in skip} | ({"rowid"} if target else set())
    return df.drop(*(c for c in df.columns if c.lower() in gone))


def lob_prefix(df: DataFrame, columns: Iterable[str], limit: int = 0) -> DataFrame:
    """Large objects cut to ``limit`` characters or bytes; 0 stands for the defaults."""
    if not 0 <= limit <= LOB_MOST:
        raise ValueError(f"a large-object limit lies between 0 and {LOB_MOST}")
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.substring(c, 1, limit or (LOB_BYTES if kinds[c] == "binary" else LOB_CHARS)) for c in columns})


def is_lob(name: Column, kind: Column) -> Column:
    """Whether a catalog's column is a large object, by its type, or by its name unless it is typed as characters of some length."""
    kind, name = F.upper(kind), F.upper(name)
    by_type = kind.isin(*LOB_TYPES)
    for part in LOB_PARTS:
        by_type |= kind.contains(part)
    sized = kind.contains("VARCHAR2(") | kind.contains("VARCHAR(") | kind.contains("CHAR(") | kind.contains("NVARCHAR")
    return by_type | (name.rlike("XML|CLOB|BLOB") & ~sized)


def is_orderable(kind: Column) -> Column:
    kind = F.upper(kind)
    out = F.lit(True)
    for part in UNORDERED:
        out &= ~kind.contains(part)
    return out


def is_numeric_or_time(kind: Column) -> Column:
    kind = F.upper(kind)
    return kind.contains("TIMESTAMP") | (kind == "DATE") | kind.contains("INT") | kind.startswith("NUMBER") | kind.contains("SERIAL") | kind.rlike(r"^(NUMERIC|DECIMAL|FLOAT|BINARY_FLOAT|BINARY_DOUBLE)(\(|$)") | kind.isin("REAL", "DOUBLE", "SINGLE", "DOUBLE PRECISION")


def hash_of(text: Column, algorithm: str = "SHA256") -> Column:
    """Lower-case hexadecimal digest; names that aren't known mean SHA-256."""
    return F.md5(text) if algorithm.upper() == "MD5" else F.sha2(text, 256)


def packed(row_hash: Column | str) -> Column:
    """A hexadecimal digest as its bytes: half as long, and in the same order."""
    return F.unhex(row_hash)


def unpacked(row_hash: Column | str) -> Column:
    return F.lower(F.hex(row_hash))


def fingerprint(df: DataFrame, keys: list[str] | None = None, *, algorithm: str = "SHA256", columns: list[str] | None = None, also: dict[str, Column] | None = None, **options) -> DataFrame:
    """The key columns, those of ``also``, and ``row_hash``. The projection sits right on the scan: wide rows go no further."""
    return df.select(*(keys or []), *(c.alias(n) for n, c in (also or {}).items()), hash_of(row_text(df, columns, **options), algorithm).alias("row_hash"))


def key_columns(df: DataFrame, declared: Iterable[str] = ()) -> list[str]:
    """Declared key columns; else those whose name ends in ID; else all that can be ordered by; else the first."""
    there = {c.lower(): c for c in df.columns}
    if found := [there[c.lower()] for c in declared if c.lower() in there]:
        return found
    if found := [c for c in df.columns if c.lower().endswith("id")]:
        return found
    return [n for n, k in df.dtypes if not k.startswith(("binary", "array", "map", "struct", "variant"))] or df.columns[:1]
