"""Canonical text of values: equal values of two systems get equal text, whatever their types' default print."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text of a null, and of a large object that is left out (fixed values).
NULL, SKIPPED = "NULL", "BLOB_SKIPPED"
#: Formats of timestamps that arrive as text (fixed values).
CLOCK_STYLE = tuple(f"d-MMM-{y} h.mm.ss{f} a" for y in ("yy", "yyyy") for f in (".SSSSSS", ".SSSSS", ".SSSS", ".SSS", ".SS", ".S", ""))
ISO_STYLE = tuple(f"yyyy-MM-dd{t}" for t in (" HH:mm:ss.SSSSSS", " HH:mm:ss.SSSSS", " HH:mm:ss.SSSS", " HH:mm:ss.SSS", " HH:mm:ss.SS", " HH:mm:ss.S", " HH:mm:ss", " HH:mm", ""))


def rtrim_unicode(c: Column) -> Column:
    """Without white space of any kind at the right end; ``rtrim`` alone takes blanks only. Text that ends in a printable
    ASCII character, as nearly all does, needs no pattern."""
    return F.when(F.ascii(F.right(c, F.lit(1))).between(33, 126), c).otherwise(F.regexp_replace(c, r"(?U)\s+$", ""))


def looks_like_guid(c: Column) -> Column:
    """Eight characters or more, hexadecimal digits and hyphens only, and with a hyphen or 32 long."""
    return (F.length(c) >= 8) & c.rlike("^[0-9A-Fa-f-]+$") & (c.contains("-") | (F.length(c) == 32))


def collapse_xml(c: Column) -> Column:
    """Without declaration and white space between tags, trimmed: what is done to XML that can't be parsed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<\?xml[^>]*\?>", ""), r">\s+<", "><"), r"(?U)^\s+|\s+$", "")


def _xml_text(s: str | None, sort_attributes: bool) -> str | None:
    import html
    import re
    import xml.etree.ElementTree as ET

    if s is None:
        return None
    plain = re.sub(r">\s+<", "><", re.sub(r"<\?xml[^>]*\?>", "", s)).strip()
    body = None
    for attempt in (plain, html.unescape(plain)):
        try:
            body = ET.fromstring(attempt)
            break
        except ET.ParseError:
            continue
    if body is None:
        return plain

    def split(tag: str) -> tuple[str, str]:
        return tuple(tag[1:].split("}", 1)) if tag.startswith("{") else ("", tag)

    def shown(e) -> str:
        name = split(e.tag)[1]
        attributes = e.attrib.items()
        attributes = sorted(attributes, key=lambda kv: split(kv[0])) if sort_attributes else attributes
        head = name + "".join(f' {split(k)[1]}="{html.escape(v.strip())}"' for k, v in attributes)
        text = html.escape((e.text or "").strip(), quote=False) + "".join(html.escape((c.tail or "").strip(), quote=False) for c in e)
        below = "".join(shown(c) for c in sorted(e, key=lambda c: split(c.tag)))
        return f"<{head}>{text}{below}</{name}>" if text or below else f"<{head} />"

    return shown(body)


@F.pandas_udf(T.StringType())
def _xml_for_hash(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _xml_text(x, True), na_action="ignore")


@F.pandas_udf(T.StringType())
def _xml_as_read(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _xml_text(x, False), na_action="ignore")


def normalise_xml(c: Column, *, for_hash: bool = True) -> Column:
    """XML in one form: no declaration, children sorted by name, blank text dropped, leaf text trimmed and, for hashing,
    attributes sorted and trimmed; what can't be parsed is collapsed. Only text that starts with ``<`` goes to Python."""
    helper = _xml_for_hash if for_hash else _xml_as_read
    return F.when(F.ltrim(c).startswith("<"), helper(F.when(F.ltrim(c).startswith("<"), c)))


def decimal_text(c: Column, scale: int) -> Column:
    """Integral values without a point, others without trailing zeros; below 1e-5 with an exponent."""
    text = c.cast("string")
    if scale <= 0:
        return c.cast("decimal(38,0)").cast("string")
    if scale <= 5:  # never an exponent, always a point
        return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    plain = F.when(text.contains("E"), F.format_number(c, scale)).otherwise(text)
    plain = F.regexp_replace(plain, ",", "")
    whole = F.regexp_replace(plain, r"\.?0+$", "")
    digits = F.regexp_extract(whole, r"^-?0\.(0*)([1-9]\d*)$", 2)
    power = F.length(F.regexp_extract(whole, r"^-?0\.(0*)([1-9]\d*)$", 1)) + 1
    mantissa = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 64))).otherwise(F.lit("")))
    tiny = F.concat(mantissa, F.lit("E-"), F.lpad(power.cast("string"), 2, "0"))
    return F.when((F.abs(c) < F.lit("0.00001").cast("decimal(38,18)")) & (c != 0), tiny).when(c == F.floor(c), F.regexp_replace(plain, r"\..*$", "")).otherwise(whole)


@F.pandas_udf(T.StringType())
def g17(x: pd.Series) -> pd.Series:
    """A double with up to 17 significant digits, as other platforms print it round-trip."""
    return x.map(_g17, na_action="ignore")


def _g17(v: float) -> str:
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "Infinity" if v > 0 else "-Infinity"
    s = format(v, ".17g").replace("e", "E")
    if "E" in s:
        head, power = s.split("E")
        s = f"{head}E{power[0]}{power[1:].lstrip('0').rjust(2, '0')}"
    return s


def double_text(c: Column) -> Column:
    """A double as ``decimal_text`` prints the same number: without a point if integral, without an exponent from 1e-5 on.

    Integers that a long can hold are exact; all others have the digits of the double's shortest text, with the zeros
    that its exponent stands for."""
    text = c.cast("string")
    part = lambda k: F.regexp_extract(text, r"^-?(\d)\.(\d+)E(-?\d+)$", k)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    digits, power = F.concat(part(1), F.rtrim(part(2), F.lit("0"))), part(3).cast("int")
    large = F.when(F.length(digits) > power + 1, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(99)))).otherwise(F.rpad(digits, power + 1, "0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    tiny = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 99))).otherwise(F.lit("")), F.lit("E-"), F.lpad((-power).cast("string"), F.greatest(F.lit(2), F.length((-power).cast("string"))), "0"))
    scaled = F.concat(sign, F.when(power >= 0, large).when(power >= -5, small).otherwise(tiny))
    plain = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    whole = (c == F.floor(c)) & (F.abs(c) < 9.2e18)
    return F.when(F.isnan(c), F.lit("NaN")).when(whole, c.cast("bigint").cast("string")).when(text.contains("E"), scaled).when(text.contains("."), plain).otherwise(text)


def interval_text(c: Column) -> Column:
    """A day-time interval as ``[-][d.]hh:mm:ss[.fffffff]``."""
    part = lambda field, scale: (F.extract(F.lit(field), c).cast("decimal(20,6)") * scale).cast("bigint")
    micros = part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000) + part("SECOND", 1_000_000)
    size = F.abs(micros)
    days, rest = F.floor(size / 86_400_000_000), size % 86_400_000_000
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3_600_000_000), F.floor(rest / 60_000_000) % 60, F.floor(rest / 1_000_000) % 60)
    parts = [F.when(micros < 0, F.lit("-")).otherwise(F.lit("")), F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(F.lit("")), clock]
    return F.concat(*parts, F.when(rest % 1_000_000 > 0, F.format_string(".%06d0", rest % 1_000_000)).otherwise(F.lit("")))


def text_of(name: str, kind: T.DataType, *, skip_binary: bool = False, xml: bool = False, parity: bool = False, empty_as_null: bool = False) -> Column:
    """The canonical text of a column, by its type. An instant (timestamp with zone) prints in the session's zone, as a local
    time there, so set ``spark.sql.session.timeZone`` to that of the side without zones. ``xml`` sends text that looks like XML through the XML form; ``parity``
    prints floats with 17 digits in Python; else a float has the text of its shortest decimal form, so equal numbers have
    one text whether they are integers, decimals or floats."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        out = F.lit(SKIPPED) if skip_binary else F.lower(F.hex(c))
    elif isinstance(kind, T.DecimalType):
        out = decimal_text(c, kind.scale)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = F.when(F.isnan(c), F.lit("NaN")).otherwise(g17(c.cast("double"))) if parity else double_text(c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c)
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        out = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.DayTimeIntervalType):
        out = interval_text(c)
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        plain = F.when(looks_like_guid(c), F.lower(c))
        if xml:
            plain = plain.when(F.ltrim(c).startswith("<"), normalise_xml(c))
        out = plain.otherwise(rtrim_unicode(c))
        if empty_as_null:
            out = F.when(F.length(out) > 0, out)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(NULL))


_TIMES, _FLOATS = (T.DateType, T.TimestampType, T.TimestampNTZType), (T.FloatType, T.DoubleType)


def shared_kind(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type as which columns of two types can be compared without their text: equal values there just if the texts of
    ``text_of`` are equal. None where only the texts tell."""
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType) and a.scale == b.scale:
        return a if a.precision >= b.precision else b
    if isinstance(a, _TIMES) and isinstance(b, _TIMES):
        return a if a == b == T.DateType() else T.TimestampNTZType()
    return a if a == b and isinstance(a, (*_FLOATS, T.BooleanType, T.BinaryType)) else None


def values_of(name: str, kind: T.DataType, shared: T.DataType | None) -> list[Column]:
    """What to hash of a column of this type, so that equal hashes mean equal texts: its value as ``shared``, which costs far less
    than its text, and whether it is null, which a hash passes over; where there is no such type, its text."""
    if shared is None:
        return [text_of(name, kind)]
    c = F.col(f"`{name}`") if kind == shared else F.col(f"`{name}`").cast(shared)
    return [F.when(c == 0, F.lit(0).cast(shared)).otherwise(c) if isinstance(shared, _FLOATS) else c, c.isNull()]


def comparable(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides, with exact numbers as doubles where the other side's column of that name, in any case, is a float: so
    numbers match that are equal as far as the float goes, whatever their size. Columns of one kind on both sides stay exact."""
    floats, exact = (T.FloatType, T.DoubleType), (T.DecimalType, T.IntegralType)
    kinds = [{f.name.lower(): f.dataType for f in df.schema.fields} for df in (source, target)]

    def side(df: DataFrame, own: dict, other: dict) -> DataFrame:
        names = [c for c in df.columns if isinstance(own[c.lower()], exact) and isinstance(other.get(c.lower()), floats)]
        return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in names}) if names else df

    return side(source, *kinds), side(target, *kinds[::-1])


def row_text(df: DataFrame, columns: list[str] | None = None, *, safe: bool = False, **options) -> Column:
    """All values of a row, by lower-cased column name, joined by ``|``.

    The separator is only added behind text that isn't empty, so leading empty values leave no trace. ``safe`` puts each
    value's length before it instead, which tells every two rows apart."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns or df.columns, key=str.lower)
    texts = [text_of(n, kinds[n], **options) for n in names]
    if safe:
        return F.concat(*(F.concat(F.length(t).cast("string"), F.lit(":"), t, F.lit("|")) for t in texts))
    leading = F.lit(len(texts))
    for k in reversed(range(len(texts))):
        leading = F.when(texts[k] != "", F.lit(k)).otherwise(leading)
    return F.substring(F.concat_ws("|", *texts), leading + 1, F.lit(2**31 - 1))


def parse_timestamp(c: Column) -> Column:
    """A timestamp from text in one of the known formats, or null.

    A format that fails costs far more than one that fits, so each is tried only on text of its outline: white space, points,
    colons and digits of the fraction are where it has them."""
    clock, iso = F.rtrim(c).rlike(r"^\S+-\S+-\S+\s+\S+\.\S+\s+\S+$"), c.rlike(r"^\s*\S+-\S+-\S+(\s+\S+)?\s*$")
    cased = _month_case(c)
    long_year = c.rlike(r"^\s*\S+-\S+-\S{3,}\s")
    fraction = F.length(F.regexp_extract(c, r"\S[.:]\S+[.:]\S+\.(\d+)(\s|$)", 1))
    colons = F.length(F.regexp_replace(c, "[^:]", ""))

    def tried(text: Column, form: str) -> Column:
        digits = form.count("S")
        return F.when(fraction == digits if digits else fraction == 0, F.try_to_timestamp(text, F.lit(form)))

    by_clock = [F.when(long_year if "yyyy" in f else ~long_year, tried(cased, f)) for f in CLOCK_STYLE]
    by_iso = [F.when(colons == f.count(":"), tried(c, f)) for f in ISO_STYLE]
    return F.when(clock, F.coalesce(*by_clock)).when(iso, F.coalesce(*by_iso)).cast("timestamp_ntz")


def _month_case(c: Column) -> Column:
    """``05-MAR-24 1.02.03 pm`` as ``5-Mar-24 1.02.03 PM``."""
    pattern = r"^(\d{1,2})-([A-Za-z])([A-Za-z]{2})-(\d{2}|\d{4}) (\d{1,2})\.(\d{2})\.(\d{2})(\.\d{1,6})? ([AaPp][Mm])$"
    g = lambda k: F.regexp_extract(c, pattern, k)
    return F.when(c.rlike(pattern), F.concat(g(1).cast("int").cast("string"), F.lit("-"), F.upper(g(2)), F.lower(g(3)), F.lit("-"), g(4), F.lit(" "), g(5).cast("int").cast("string"), F.lit("."), g(6), F.lit("."), g(7), g(8), F.lit(" "), F.upper(g(9))))


def local_to_utc(c: Column, zone: str = "America/New_York") -> Column:
    """Local time to UTC, whatever the session's zone: a time that the clocks skip stays as it is, one that they show twice counts as standard time."""
    local = c.cast("timestamp_ntz")
    plain = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    there = F.convert_timezone(F.lit("UTC"), F.lit(zone), plain)
    later = plain + F.expr("interval 1 hour")
    twice = F.convert_timezone(F.lit("UTC"), F.lit(zone), later) == local
    return F.when(there != local, local).when(twice, later).otherwise(plain)
