"""Is every row the same? Fingerprints of orders and line items against their derived targets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import alignment, audit, causes, checksums, diff, fingerprint, kept_hashes, key_search, numbering, refining, sketches, summary, tolerance, value_fit
from ..sources import tables
from .registry import query

#: Canonical row text of the two fixtures, for the other engine.
_DEC = "case when {c} = trunc({c}) then cast(cast({c} as bigint) as varchar) else rtrim(cast({c} as varchar), '0') end"
_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
_TXT = "rtrim({c})"


def _fold(*parts: str) -> str:
    return " || '|' || ".join(parts)


ORDER_TEXT = _fold("cast(o_custkey as varchar)", _TS.format(c="o_orderdate"), "cast(o_orderkey as varchar)", _TXT.format(c="o_orderpriority"), _TXT.format(c="o_orderstatus"), _DEC.format(c="o_totalprice"))
ORDER_TEXT_NO_PRICE = _fold("cast(o_custkey as varchar)", _TS.format(c="o_orderdate"), "cast(o_orderkey as varchar)", _TXT.format(c="o_orderpriority"), _TXT.format(c="o_orderstatus"))
LINE_TEXT = _fold(
    _DEC.format(c="l_extendedprice"), "cast(l_linenumber as varchar)", _TXT.format(c="l_linestatus"), "cast(l_orderkey as varchar)", "cast(l_partkey as varchar)", _DEC.format(c="l_quantity"), _TXT.format(c="l_returnflag"), _TS.format(c="l_shipdate"), "cast(l_suppkey as varchar)"
)
_KEYED = f"""
    s as (select o_orderkey as k, sha256({ORDER_TEXT}) as h from orders_src), t as (select o_orderkey as k, sha256({ORDER_TEXT}) as h from orders_tgt),
    d as (select coalesce(s.k, t.k) as o_orderkey, case when t.k is null then 'missing' when s.k is null then 'extra' when s.h = t.h then 'matching' else 'mismatched' end as category,
                 s.h as source_hash, t.h as target_hash from s full outer join t on s.k = t.k)"""
KEYS = ["o_orderkey"]


@query("row_fingerprint", "orders_src", f"select o_orderkey, sha256({ORDER_TEXT}) as row_hash from orders_src")
def row_fingerprint(orders: DataFrame) -> DataFrame:
    return fingerprint.fingerprint(orders, KEYS)


@query("row_fingerprint_md5", "orders_src", f"select o_orderkey, md5({ORDER_TEXT}) as row_hash from orders_src")
def row_fingerprint_md5(orders: DataFrame) -> DataFrame:
    return fingerprint.fingerprint(orders, KEYS, algorithm="MD5")


@query("hash_export", "orders_src", f"""select cast(o_orderkey as bigint) as "Row_ID", sha256({ORDER_TEXT}) as "Hash_Value", cast(64 as int) as "Hash_Length" from orders_src""")
def hash_export(orders: DataFrame) -> DataFrame:
    """The rows that ``sources.tables.write_hashes`` writes as CSV."""
    return fingerprint.fingerprint(orders, KEYS).select(F.col("o_orderkey").cast("long").alias("Row_ID"), F.col("row_hash").alias("Hash_Value"), F.length("row_hash").alias("Hash_Length"))


@query("row_text_parity", "orders_src", f"select o_orderkey, {ORDER_TEXT} as row_text, '' || ltrim('|' || o_orderstatus, '|') || '|' || o_orderpriority as empty_first from orders_src")
def row_text_parity(orders: DataFrame) -> DataFrame:
    """Whole row text, and one whose first values are empty: no separator is left of them."""
    led = orders.select("o_orderkey", canonical.row_text(orders).alias("row_text"), F.lit("").alias("a"), F.lit("  ").alias("b"), F.col("o_orderstatus").alias("c"), F.col("o_orderpriority").alias("d"))
    return led.select("o_orderkey", "row_text", canonical.row_text(led, ["a", "b", "c", "d"]).alias("empty_first"))


@query(
    "canonical_values", "orders_src lineitem_src",
    f"""select 'orders' as table_name, o_orderkey as key, 0 as line, {_TS.format(c="o_orderdate")} as time_text, {_DEC.format(c="o_totalprice")} as number_text, rtrim(o_orderpriority) as plain_text, lower(hex(o_orderstatus)) as binary_text from orders_src
        union all
        select 'lineitem', l_orderkey, l_linenumber, {_TS.format(c="l_shipdate")}, {_DEC.format(c="l_quantity")}, rtrim(l_returnflag), lower(hex(l_linestatus)) from lineitem_src""",
)
def canonical_values(orders: DataFrame, lines: DataFrame) -> DataFrame:
    def texts(df: DataFrame, name: str, key: str, line, time: str, number: str, plain: str, raw: str) -> DataFrame:
        df = df.withColumn("_raw", F.encode(raw, "UTF-8"))
        kinds = {f.name: f.dataType for f in df.schema.fields}
        t = lambda c: canonical.text_of(c, kinds[c])
        return df.select(F.lit(name).alias("table_name"), F.col(key).alias("key"), line.alias("line"), t(time).alias("time_text"), t(number).alias("number_text"), t(plain).alias("plain_text"), t("_raw").alias("binary_text"))

    return texts(orders, "orders", "o_orderkey", F.lit(0), "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus").union(
        texts(lines, "lineitem", "l_orderkey", F.col("l_linenumber"), "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    )


@query(
    "guid_normalise", "orders_src",
    """select o_orderkey, case when o_orderkey % 3 = 0 then lower(g) when o_orderkey % 3 = 1 then lower(g2) else rtrim(p) end as guid_text
       from (select o_orderkey, upper(md5(cast(o_orderkey as varchar))) as g, upper(substring(md5(cast(o_orderkey as varchar)), 1, 8)) || '-' || upper(substring(md5(cast(o_orderkey as varchar)), 9, 4)) as g2, 'K-' || o_orderpriority || ' ' as p from orders_src) as x""",
)
def guid_normalise(orders: DataFrame) -> DataFrame:
    m = F.upper(F.md5(F.col("o_orderkey").cast("string")))
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, m).when(k == 1, F.concat(F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4))).otherwise(F.concat(F.lit("K-"), F.col("o_orderpriority"), F.lit(" ")))
    df = orders.select("o_orderkey", text.alias("g"))
    return df.select("o_orderkey", canonical.text_of("g", df.schema["g"].dataType).alias("guid_text"))


@query(
    "xml_collapse", "orders_src",
    """select o_orderkey, '<o><k>' || cast(o_orderkey as varchar) || '</k><p>' || o_orderpriority || ' </p></o>' as xml_text from orders_src""",
)
def xml_collapse(orders: DataFrame) -> DataFrame:
    raw = F.concat(F.lit('<?xml version="1.0"?>\n <o>\n  <k>'), F.col("o_orderkey").cast("string"), F.lit("</k>\n\t<p>"), F.col("o_orderpriority"), F.lit(" </p> </o>\n"))
    return orders.select("o_orderkey", canonical.collapse_xml(raw).alias("xml_text"))


@query("xml_normalise", "orders_src")
def xml_normalise(orders: DataFrame) -> DataFrame:
    """No SQL for a parser: tests compare with values."""
    raw = F.concat(F.lit("<o b='2' a=' 1 '><z>"), F.col("o_orderkey").cast("string"), F.lit("</z> <p> "), F.col("o_orderpriority"), F.lit(" </p></o>"))
    return orders.select("o_orderkey", raw.alias("raw")).select("o_orderkey", canonical.normalise_xml(F.col("raw")).alias("for_hash"), canonical.normalise_xml(F.col("raw"), for_hash=False).alias("as_read"))


@query("parse_timestamps", "orders_src", "select o_orderkey, case when o_orderkey % 5 = 4 then null when o_orderkey % 5 in (1, 3) then date_trunc('day', o_orderdate) + interval 13 hour + interval 5 minute + interval 9 second else date_trunc('day', o_orderdate) end as parsed from orders_src")
def parse_timestamps(orders: DataFrame) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 13:05:09.000000")))
        .when(k == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00"))).when(k == 3, F.concat(F.upper(F.date_format(day, "dd-MMM-yyyy")), F.lit(" 01.05.09.000 PM"))).otherwise("not a time")
    )
    return orders.select("o_orderkey", text.alias("x")).select("o_orderkey", canonical.parse_timestamp(F.col("x")).alias("parsed"))


def _sunday(month: int, day: int) -> str:
    """The first Sunday from a day of the year of ``local_time`` on, in SQL."""
    d = f"make_date(year(local_time), {month}, {day})"
    return f"({d} + cast((7 - dayofweek({d})) % 7 as integer))"


_UTC = f"""select o_orderkey, local_time,
               case when cast(local_time as date) >= case when year(local_time) < 2007 then {_sunday(4, 1)} else {_sunday(3, 8)} end
                         and cast(local_time as date) < case when year(local_time) < 2007 then {_sunday(10, 25)} else {_sunday(11, 1)} end
                    then local_time + interval 4 hour else local_time + interval 5 hour end as utc_time
        from (select o_orderkey, o_orderdate + interval 12 hour as local_time from orders_src) as x"""


@query("tz_to_utc", "orders_src", _UTC)
def tz_to_utc(orders: DataFrame) -> DataFrame:
    """All orders at noon, the days of the changeovers too; the SQL has the rules from 1987 on."""
    local = orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 12 hours")).alias("local_time"))
    return local.select("o_orderkey", "local_time", canonical.local_to_utc(F.col("local_time")).alias("utc_time"))


_SPRING = f"(case when year(local_time) < 2007 then {_sunday(4, 1)} else {_sunday(3, 8)} end)"
_AUTUMN = f"(case when year(local_time) < 2007 then {_sunday(10, 25)} else {_sunday(11, 1)} end)"


@query(
    "tz_to_utc_all", "orders_src",
    f"""select o_orderkey, local_time,
               case when local_time >= {_SPRING} + interval 2 hour and local_time < {_SPRING} + interval 3 hour then local_time
                    when local_time >= {_SPRING} + interval 3 hour and local_time < {_AUTUMN} + interval 1 hour then local_time + interval 4 hour else local_time + interval 5 hour end as utc_time
        from (select o_orderkey, date_trunc('day', o_orderdate) + to_minutes(cast((o_orderkey % 8) * 30 as integer)) as local_time from orders_src) as x""",
)
def tz_to_utc_all(orders: DataFrame) -> DataFrame:
    """All orders at half hours from midnight to 3:30, so the skipped hour and the doubled one occur on the days of the changeovers."""
    half = F.expr("make_dt_interval(0, 0, cast((o_orderkey % 8) * 30 as int), 0)")
    local = orders.select("o_orderkey", (F.date_trunc("day", "o_orderdate").cast("timestamp_ntz") + half).alias("local_time"))
    return local.select("o_orderkey", "local_time", canonical.local_to_utc(F.col("local_time")).alias("utc_time"))


@query("fingerprint_skip_columns", "orders_tgt", f"select o_orderkey, sha256({ORDER_TEXT_NO_PRICE}) as row_hash from orders_tgt")
def fingerprint_skip_columns(orders: DataFrame) -> DataFrame:
    seen = fingerprint.skip_columns(orders.withColumn("ROWID", F.lit(1)), ["O_TOTALPRICE"], target=True)
    return fingerprint.fingerprint(seen, KEYS)


@query("fingerprint_lob_prefix", "orders_src", "select o_orderkey, sha256(cast(o_orderkey as varchar) || '|' || rtrim(substring(o_orderpriority, 1, 3))) as row_hash from orders_src")
def fingerprint_lob_prefix(orders: DataFrame) -> DataFrame:
    cut = fingerprint.lob_prefix(orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], 3)
    return fingerprint.fingerprint(cut, KEYS)


@query("fingerprint_limited", "orders_src", f"select o_orderkey, sha256({ORDER_TEXT}) as row_hash from orders_src order by o_orderkey limit 1000")
def fingerprint_limited(orders: DataFrame) -> DataFrame:
    """The limit is the feature: the first rows of the canonical order."""
    return fingerprint.fingerprint(orders.orderBy(F.asc_nulls_first("o_orderkey")).limit(1000), KEYS)


@query("fingerprint_diff_keyed", "orders_src orders_tgt", f"with {_KEYED} select * from d")
def fingerprint_diff_keyed(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff.keyed_diff(source, target, KEYS)


_SUMMARY = f"""with {_KEYED}, n as (select count(*) filter (category = 'matching') as matching, count(*) filter (category = 'mismatched') as mismatched, count(*) filter (category = 'missing') as missing, count(*) filter (category = 'extra') as extra from d)
        select *, matching + mismatched + missing as source_rows, matching + mismatched + extra as target_rows,
               case when matching + mismatched + missing > 0 then cast(matching as double) * 100.0 / (matching + mismatched + missing) else 0.0 end as match_percent, mismatched + missing + extra = 0 as is_match from n"""


@query("fingerprint_summary", "orders_src orders_tgt", _SUMMARY)
def fingerprint_summary(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff.diff_totals(diff.keyed_diff(source, target, KEYS))


@query("checksum_diff", "orders_src orders_tgt", f"with {_KEYED} select * from d")
def checksum_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """The keyed difference by way of sums over ranges of keys."""
    return checksums.checksum_diff(source, target, KEYS, by="range")


@query("checksum_totals", "orders_src orders_tgt", _SUMMARY)
def checksum_totals(source: DataFrame, target: DataFrame) -> DataFrame:
    return checksums.checksum_totals(source, target, KEYS)


@query(
    "differing_ranges", "orders_src orders_tgt",
    f"""with {_KEYED}, e as (select min(o_orderkey) as low, max(o_orderkey) as high from d),
        n as (select least(cast(1048575 as double), floor((cast(o_orderkey as double) - low) / (high - low) * 1048576)) as node, category from d, e)
        select cast(node as bigint) as node, count(*) filter (category <> 'extra') as n_source, count(*) filter (category <> 'missing') as n_target from n group by node having count(*) filter (category <> 'matching') > 0""",
)
def differing_ranges(source: DataFrame, target: DataFrame) -> DataFrame:
    """Which ranges of the keys differ at all, with the rows of both sides there."""
    return checksums.differing_ranges(source, target, KEYS)


@query("missing_keys", "orders_src orders_tgt", "select o_orderkey, cast(o_orderkey as varchar) as key_text from orders_src s where not exists (select 1 from orders_tgt t where t.o_orderkey = s.o_orderkey)")
def missing_keys(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff.missing_keys(source, target, KEYS)


@query("extra_keys", "orders_src orders_tgt", "select o_orderkey, cast(o_orderkey as varchar) as key_text from orders_tgt t where not exists (select 1 from orders_src s where t.o_orderkey = s.o_orderkey)")
def extra_keys(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff.missing_keys(target, source, KEYS)


@query("keys_exist", "lineitem_src lineitem_tgt", "select distinct l_orderkey, l_linenumber from lineitem_src s where exists (select 1 from lineitem_tgt t where t.l_orderkey = s.l_orderkey and t.l_linenumber = s.l_linenumber)")
def keys_exist(source: DataFrame, target: DataFrame) -> DataFrame:
    """Which composite keys of the source the target holds."""
    return diff.keys_exist(target, source, ["l_orderkey", "l_linenumber"])


@query("keys_exist_all", "lineitem_src lineitem_tgt", "select distinct l_orderkey, l_linenumber from lineitem_tgt s where exists (select 1 from lineitem_src t where t.l_orderkey = s.l_orderkey and t.l_linenumber = s.l_linenumber)")
def keys_exist_all(source: DataFrame, target: DataFrame) -> DataFrame:
    """The other direction: which composite keys of the target the source holds."""
    return diff.keys_exist(source, target, ["l_orderkey", "l_linenumber"])


@query("duplicate_keys", "lineitem_src", "select l_orderkey, l_linenumber, count(*) as n_rows from lineitem_src group by 1, 2 having count(*) > 1")
def duplicate_keys(lines: DataFrame) -> DataFrame:
    return diff.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


_MULTI = f"""
    u as (select sha256({LINE_TEXT}) as h, 1 as s, 0 as t from lineitem_src union all select sha256({LINE_TEXT}), 0, 1 from lineitem_tgt),
    m as (select h as row_hash, cast(sum(s) as bigint) as n_source, cast(sum(t) as bigint) as n_target from u group by h)"""


@query("fingerprint_diff_multiset", "lineitem_src lineitem_tgt", f"with {_MULTI} select *, least(n_source, n_target) as matching, greatest(n_source - n_target, 0) as missing, greatest(n_target - n_source, 0) as extra from m")
def fingerprint_diff_multiset(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff.multiset_diff(source, target)


@query("query_pair_parity", "lineitem_src lineitem_tgt", f"with {_MULTI} select cast(sum(n_source) as bigint) as source_rows, cast(sum(n_target) as bigint) as target_rows, cast(sum(greatest(n_source - n_target, 0)) as bigint) as missing, cast(sum(greatest(n_target - n_source, 0)) as bigint) as extra, sum(abs(n_source - n_target)) = 0 as same from m")
def query_pair_parity(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff.query_parity(source, target)


#: Prices drift within the tolerance, or beyond it; sorted copies of both sides are walked in step, the smaller one moves on.
_DRIFT = "o_totalprice + case o_orderkey % 5 when 1 then 0.5 when 2 then -0.75 when 3 then 40 else 0 end"
_NEAR = "greatest(1.0::double, 1e-5::double * greatest(abs({a}), abs({b})))"
_TOLERANT = f"""
    u as (select rtrim(o_orderpriority) || '|' || rtrim(o_orderstatus) as text, cast(o_totalprice as double) as v, 1 as s, 0 as t from orders_src
          union all select rtrim(o_orderpriority) || '|' || rtrim(o_orderstatus), cast({_DRIFT} as double), 0, 1 from orders_tgt),
    f as (select sha256(text) as h, v, cast(sum(s) as bigint) as n_source, cast(sum(t) as bigint) as n_target from u group by 1, 2),
    l as (select h, v, n_source > n_target as s, row_number() over (partition by h, n_source > n_target order by v) as nth
          from (select h, v, n_source, n_target, unnest(range(abs(n_source - n_target))) as copy from f) as x),
    w as (select h, cast(1 as bigint) as i, cast(1 as bigint) as j, cast(null as double) as a, cast(null as double) as b from (select distinct h from l) as x
          union all
          select w.h, case when p.v <= q.v or {_NEAR.format(a="p.v", b="q.v")} >= abs(p.v - q.v) then i + 1 else i end, case when q.v < p.v or {_NEAR.format(a="p.v", b="q.v")} >= abs(p.v - q.v) then j + 1 else j end,
                 case when {_NEAR.format(a="p.v", b="q.v")} >= abs(p.v - q.v) then p.v end, case when {_NEAR.format(a="p.v", b="q.v")} >= abs(p.v - q.v) then q.v end
          from w join l as p on p.h = w.h and p.s and p.nth = i join l as q on q.h = w.h and not q.s and q.nth = j),
    m as (select h, v, cast(count(*) as bigint) as within from (select h, a as v from w where a is not null union all select h, b from w where b is not null) as x group by h, v),
    d as (select f.h as row_hash, f.v as value, n_source, n_target, least(n_source, n_target) as exact, coalesce(within, 0) as within,
                 greatest(n_source - n_target - coalesce(within, 0), 0) as missing, greatest(n_target - n_source - coalesce(within, 0), 0) as extra
          from f left join m on f.h = m.h and f.v = m.v)"""


def _drifted(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    columns = ["o_orderpriority", "o_orderstatus", "o_totalprice"]
    return source.select(columns), target.withColumn("o_totalprice", F.expr(_DRIFT)).select(columns)


@query("tolerant_diff", "orders_src orders_tgt", f"select * from (with recursive {_TOLERANT} select * from d) as x")
def tolerant_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Orders as a table without a key, whose prices may be off by 1 or a hundred-thousandth."""
    return tolerance.tolerant_diff(*_drifted(source, target), "o_totalprice", absolute=1.0, relative=1e-5)


@query(
    "tolerant_parity", "orders_src orders_tgt",
    f"""select * from (with recursive {_TOLERANT} select cast(sum(n_source) as bigint) as source_rows, cast(sum(n_target) as bigint) as target_rows, cast(sum(exact) as bigint) as exact,
        cast(coalesce(sum(within) filter (n_source > n_target), 0) as bigint) as within, cast(sum(missing) as bigint) as missing, cast(sum(extra) as bigint) as extra, sum(missing) + sum(extra) = 0 as same from d) as x""",
)
def tolerant_parity(source: DataFrame, target: DataFrame) -> DataFrame:
    return tolerance.tolerant_parity(*_drifted(source, target), "o_totalprice", absolute=1.0, relative=1e-5)


_ORDERED = "order by l_orderkey nulls first, l_linenumber nulls first, l_partkey nulls first, h"


@query("canonical_row_number", "lineitem_src", f"select row_number() over ({_ORDERED}) as row_id, l_orderkey, l_linenumber, l_partkey, h as row_hash from (select *, sha256({LINE_TEXT}) as h from lineitem_src) as x")
def canonical_row_number(lines: DataFrame) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    hashed = fingerprint.fingerprint(lines, order).withColumn("row_hash", fingerprint.packed("row_hash"))
    return numbering.numbered(hashed, [*order, "row_hash"]).withColumn("row_hash", fingerprint.unpacked("row_hash"))


def _positional(src: str, tgt: str, text: str, by: str) -> str:
    side = "select row_number() over (order by {by}, h) as row_id, h from (select *, sha256({text}) as h from {t}) as x"
    return f"""s as ({side.format(by=by, text=text, t=src)}), t as ({side.format(by=by, text=text, t=tgt)}),
    d as (select coalesce(s.row_id, t.row_id) as row_id, case when t.row_id is null then 'missing' when s.row_id is null then 'extra' when s.h = t.h then 'matching' else 'mismatched' end as category, s.h as source_hash, t.h as target_hash
          from s full outer join t on s.row_id = t.row_id)"""


@query("fingerprint_diff_positional", "lineitem_src lineitem_tgt", f"with {_positional('lineitem_src', 'lineitem_tgt', LINE_TEXT, 'l_orderkey nulls first, l_linenumber nulls first, l_partkey nulls first')} select * from d")
def fingerprint_diff_positional(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff.positional_diff(source, target, ["l_orderkey", "l_linenumber", "l_partkey"])


_ORDER_BODY = _fold("cast(o_custkey as varchar)", _TS.format(c="o_orderdate"), "cast(o_orderkey as varchar)", _TXT.format(c="o_orderpriority"), _TXT.format(c="o_orderstatus"), _DEC.format(c="o_totalprice"))
_MOVES = "o_orderkey % 211 = 7"


@query(
    "aligned_diff", "orders_src orders_tgt",
    f"""with s as (select o_orderkey as k, sha256({_ORDER_BODY}) as h, row_number() over (order by o_orderkey) as r from orders_src),
        t as (select o_orderkey as k, sha256({_ORDER_BODY}) as h, row_number() over (order by case when {_MOVES} then o_orderkey - 1000000000 else o_orderkey end) as r, {_MOVES} as m from orders_tgt),
        e as (select s.r as sr, t.r as tr, m from s join t on s.h = t.h),
        sg as (select s.r, e.tr, e.m, count(e.tr) filter (not e.m) over (order by s.r) as gap from s left join e on e.sr = s.r),
        tg as (select t.r, e.sr, e.m, count(e.sr) filter (not e.m) over (order by t.r) as gap from t left join e on e.tr = t.r),
        sl as (select r, gap, row_number() over (partition by gap order by r) as nth from sg where tr is null), tl as (select r, gap, row_number() over (partition by gap order by r) as nth from tg where sr is null)
        select sr as source_row, tr as target_row, case when m then 'moved' else 'matching' end as category from e
        union all select sl.r, tl.r, case when tl.r is null then 'missing' when sl.r is null then 'extra' else 'mismatched' end from sl full outer join tl on sl.gap = tl.gap and sl.nth = tl.nth""",
)
def aligned_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Orders as a table without a key: rows are lost, changed and added, and some stand at the front on the other side."""
    key = F.col("o_orderkey")
    place = F.when(key % 211 == 7, key - 1_000_000_000).otherwise(key)
    return alignment.aligned_diff(source.withColumn("place", key), target.withColumn("place", place), ["place"], columns=source.columns)


@query(
    "fingerprint_diff_retry", "orders_src",
    f"""with o_t as (select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 89 = 3 then cast(o_totalprice + 1 as decimal(18,2)) else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders_src),
        {_positional('orders_src', 'o_t', ORDER_TEXT, "upper(trim(o_orderstatus)) nulls first, o_custkey nulls first, o_orderdate nulls first, upper(trim(o_orderpriority)) nulls first, o_orderkey nulls first, o_totalprice nulls first")}
        select category, count(*) as n, 6 as extra_columns from d group by category""",
)
def fingerprint_diff_retry(source: DataFrame) -> DataFrame:
    """Both sides have as many rows, so all four passes run; the last one orders by all columns."""
    changed = source.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,2)"))
    d, used = diff.diff_with_retry(source, changed, ["o_orderstatus"], ["o_custkey", "o_orderdate", "o_orderpriority", "o_orderkey", "o_totalprice"])
    return d.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("extra_columns", F.lit(used))


_RETRIED = f"""with o_t as (select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 89 = 3 then cast(o_totalprice + 1 as decimal(18,2)) else o_totalprice end as o_totalprice, o_orderdate, o_orderpriority from orders_src),
    {_positional('orders_src', 'o_t', ORDER_TEXT, "upper(trim(o_orderstatus)) nulls first, o_custkey nulls first, o_orderdate nulls first, upper(trim(o_orderpriority)) nulls first, o_orderkey nulls first, o_totalprice nulls first")}"""


@query("fingerprint_diff_refined", "orders_src", f"{_RETRIED} select *, 6 as extra_columns from d")
def fingerprint_diff_refined(source: DataFrame) -> DataFrame:
    """The rows of the last of four passes, each of which sorts only what the one before left tied."""
    changed = source.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,2)"))
    d, used = refining.diff_refined(source, changed, ["o_orderstatus"], ["o_custkey", "o_orderdate", "o_orderpriority", "o_orderkey", "o_totalprice"])
    return d.withColumn("extra_columns", F.lit(used))


_DIFFER = "case when {a} <> {b} then 1 else 0 end"


@query(
    "column_level_diff", "orders_src orders_tgt",
    f"""select s.o_orderkey, 1 as n_differing, 'o_totalprice' as differing, 0 as source_nulls, 0 as target_nulls, false as ordering_problem, '' as absent
        from orders_src s join orders_tgt t on s.o_orderkey = t.o_orderkey where s.o_totalprice <> t.o_totalprice""",
)
def column_level_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff.column_diff(source, target, KEYS)


@query(
    "column_diff_of_types", "orders_src",
    """select case when o_orderkey % 50 = 0 then null else o_orderkey end as k, 1 as n_differing, case when o_orderkey % 3 = 0 then 'n' else 'x' end as differing,
              0 as source_nulls, case when o_orderkey % 3 = 0 then 0 else 1 end as target_nulls, false as ordering_problem, 'only_here,only_there' as absent
       from orders_src where (o_orderkey % 50 <> 0 or o_orderkey = (select min(o_orderkey) from orders_src where o_orderkey % 50 = 0)) and (o_orderkey % 3 = 0 or o_orderkey % 7 = 0 and o_orderkey % 3 = 1)""",
)
def column_diff_of_types(orders: DataFrame) -> DataFrame:
    """Decimals and integers against doubles, a null key on both sides, a column that each side lacks."""
    key = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")).alias("k")
    one = orders.agg(F.min(F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey"))).alias("one"))
    rows = orders.join(F.broadcast(one), (F.col("o_orderkey") % 50 != 0) | (F.col("o_orderkey") == F.col("one")))
    source = rows.select(key, F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("long").alias("n"), F.lit(1).alias("only_here"))
    n, x = F.col("o_custkey").cast("double"), F.col("o_totalprice").cast("double")
    target = rows.select(
        key, F.when(~((F.col("o_orderkey") % 7 == 0) & (F.col("o_orderkey") % 3 == 1)), x).alias("x"), F.when(F.col("o_orderkey") % 3 == 0, n + 0.5).otherwise(n).alias("N"), F.lit(2).alias("only_there")
    )
    return diff.column_diff(source, target, ["k"])


@query(
    "numbers_of_types", "orders_src",
    f"""select o_orderkey, {_DEC.format(c="o_totalprice")} as as_decimal, {_DEC.format(c="o_totalprice")} as as_double, cast(o_custkey as varchar) as as_long, cast(o_custkey as varchar) as as_float,
               case when o_orderkey % 4 = 0 then 'NULL' when o_orderkey % 4 = 1 then 'NaN' when o_orderkey % 4 = 2 then '0' else '0.5' end as odd,
               case when o_custkey >= 1440 then cast(o_custkey // 1440 as varchar) || '.' else '' end || lpad(cast((o_custkey // 60) % 24 as varchar), 2, '0') || ':' || lpad(cast(o_custkey % 60 as varchar), 2, '0') || ':00' as span from orders_src""",
)
def numbers_of_types(orders: DataFrame) -> DataFrame:
    """The same numbers as decimals, integers and floats, nulls, not-a-number, negative zero, and intervals of minutes."""
    k = F.col("o_orderkey") % 4
    odd = F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(-0.0)).when(k == 3, F.lit(0.5))
    df = orders.select(
        "o_orderkey", F.col("o_totalprice").alias("as_decimal"), F.col("o_totalprice").cast("double").alias("as_double"), F.col("o_custkey").cast("long").alias("as_long"), F.col("o_custkey").cast("float").alias("as_float"),
        odd.alias("odd"), F.expr("make_dt_interval(0, 0, cast(o_custkey as int), 0)").alias("span"),
    )
    return df.select("o_orderkey", *(canonical.text_of(f.name, f.dataType).alias(f.name) for f in df.schema.fields[1:]))


@query(
    "positional_column_diff", "orders_src",
    """select row_number() over (order by o_orderkey) as row_id, 1 as n_differing, 'o_totalprice' as differing, 0 as source_nulls, 0 as target_nulls, false as ordering_problem, '' as absent, o_orderkey % 89 = 3 as changed from orders_src qualify changed""",
)
def positional_column_diff(orders: DataFrame) -> DataFrame:
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,2)"))
    return diff.positional_column_diff(orders, changed, KEYS).withColumn("changed", F.lit(True))


@query(
    "diff_samples", "orders_src orders_tgt",
    f"""with {_KEYED}, r as (select o_orderkey, category, source_hash, target_hash, cast(row_number() over (partition by category order by o_orderkey) as int) as rank from d where category <> 'matching')
        select *, 'o_orderkey=' || cast(o_orderkey as varchar) as shown from r where rank <= 5""",
)
def diff_samples(source: DataFrame, target: DataFrame) -> DataFrame:
    return diff.samples(diff.keyed_diff(source, target, KEYS), ["category"], KEYS).withColumn("shown", diff.key_display(KEYS))


_BY_PRIORITY = f"""
    s as (select o_orderkey as k, rtrim(o_orderpriority) as p, sha256({ORDER_TEXT}) as h from orders_src), t as (select o_orderkey as k, rtrim(o_orderpriority) as p, sha256({ORDER_TEXT}) as h from orders_tgt),
    d as (select coalesce(s.p, t.p) as table_name, case when t.k is null then 'missing' when s.k is null then 'extra' when s.h = t.h then 'matching' else 'mismatched' end as category from s full outer join t on s.k = t.k),
    n as (select 'S' || substring(table_name, 1, 1) as schema_name, table_name, count(*) filter (category = 'matching') as matching, count(*) filter (category = 'mismatched') as mismatched, count(*) filter (category = 'missing') as missing, count(*) filter (category = 'extra') as extra from d group by table_name)"""


def _per_table(source: DataFrame, target: DataFrame) -> DataFrame:
    """Differences of many tables at once: here each order priority plays a table of its own."""
    s, t = (df.withColumn("o_orderpriority", F.rtrim("o_orderpriority")) for df in (source, target))
    d = diff.keyed_diff(s, t, [*KEYS, "o_orderpriority"])
    return diff.diff_totals(d.withColumnRenamed("o_orderpriority", "table_name"), "table_name").withColumn("schema_name", F.concat(F.lit("S"), F.substring("table_name", 1, 1))).withColumn("error", F.lit(None).cast("string")).withColumn("object_type", F.lit("Table"))


_TOTALS = "cast(sum(matching + mismatched + missing) as bigint) as source_rows, cast(sum(matching + mismatched + extra) as bigint) as target_rows, cast(sum(matching) as bigint) as matching, cast(sum(mismatched) as bigint) as mismatched, cast(sum(missing) as bigint) as missing, cast(sum(extra) as bigint) as extra"
_STATE = "count(*) as objects, count(*) filter (mismatched + missing + extra = 0) as passed, count(*) filter (mismatched + missing + extra > 0) as failed, cast(0 as bigint) as errors"
_SHARE = "case when sum(matching + mismatched + missing) > 0 then cast(sum(matching) as double) * 100.0 / cast(sum(matching + mismatched + missing) as double) else 0.0 end as match_percent"


@query("audit_executive_summary", "orders_src orders_tgt", f"with {_BY_PRIORITY} select count(*) as tables, cast(0 as bigint) as views, {_STATE}, {_TOTALS}, {_SHARE} from n")
def audit_executive_summary(source: DataFrame, target: DataFrame) -> DataFrame:
    return summary.executive_summary(_per_table(source, target))


@query("audit_schema_rollup", "orders_src orders_tgt", f"with {_BY_PRIORITY} select coalesce(schema_name, 'TOTAL') as schema_name, {_STATE}, {_TOTALS}, {_SHARE} from n group by rollup(schema_name)")
def audit_schema_rollup(source: DataFrame, target: DataFrame) -> DataFrame:
    return summary.schema_rollup(_per_table(source, target))


@query("top_data_mismatches", "orders_src orders_tgt", f"with {_BY_PRIORITY} select schema_name, table_name, mismatched + missing + extra as differences from n where mismatched + missing + extra > 0 order by differences desc, table_name limit 10")
def top_data_mismatches(source: DataFrame, target: DataFrame) -> DataFrame:
    return summary.top_mismatches(_per_table(source, target))


@query("audit_status", "orders_src orders_tgt", f"with {_BY_PRIORITY} select schema_name, max(case when missing > 0 then 2 when mismatched + extra > 0 then 1 else 0 end) as exit_code, case max(case when missing > 0 then 2 when mismatched + extra > 0 then 1 else 0 end) when 2 then 'FAILED' when 1 then 'WARNING' else 'PASSED' end as status from n group by schema_name")
def audit_status(source: DataFrame, target: DataFrame) -> DataFrame:
    rows = _per_table(source, target)
    severity = F.when(F.col("missing") > 0, "Critical").when(F.col("mismatched") + F.col("extra") > 0, "Warning").otherwise("Info")
    return summary.status(rows.withColumn("severity", severity), "schema_name")


@query(
    "view_fingerprint_diff", "orders_src orders_tgt",
    """with s as (select o_orderstatus, count(*) as n, sum(o_totalprice) as total from orders_src group by 1), t as (select o_orderstatus, count(*) as n, sum(o_totalprice) as total from orders_tgt group by 1)
       select 'View' as object_type, coalesce(s.o_orderstatus, t.o_orderstatus) as o_orderstatus, case when t.n is null then 'missing' when s.n is null then 'extra' when s.n = t.n and s.total = t.total then 'matching' else 'mismatched' end as category
       from s full outer join t on s.o_orderstatus = t.o_orderstatus""",
)
def view_fingerprint_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    view = lambda df: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return diff.keyed_diff(view(source), view(target), ["o_orderstatus"]).select(F.lit("View").alias("object_type"), "o_orderstatus", "category")


@query(
    "column_stats", "orders_src",
    " union all ".join(f"select '{c}' as column_name, count(distinct {c}) as n_distinct, count(*) - count({c}) as n_null from orders_src" for c in ("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")),
)
def column_stats(orders: DataFrame) -> DataFrame:
    return summary.column_stats(orders)


@query("probe_key_lookup", "orders", "select * from orders where o_orderkey = 71")
def probe_key_lookup(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("o_orderkey") == 71)


@query("probe_ordered", "orders", "select * from orders order by o_orderkey limit 100")
def probe_ordered(orders: DataFrame) -> DataFrame:
    return orders.orderBy("o_orderkey").limit(100)


@query("probe_sample", "orders")
def probe_sample(orders: DataFrame) -> DataFrame:
    """Any rows: which ones isn't fixed, so only their number is checked."""
    return orders.limit(100)


def _pairs(source: DataFrame, target: DataFrame, lines: DataFrame, lines_target: DataFrame) -> list[audit.Pair]:
    """Tables with and without a key, one whose key repeats, one whose sides have other keys, a view, names with dots, and all that can
    fail: no file, a file that is no Parquet, no driver, no such key, other columns, and a callback that raises."""
    spark = source.sparkSession
    view = lambda df: lambda: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    broken = tables.new_folder(spark, "broken")
    source.limit(1).select(F.lit("no Parquet")).write.text(broken)

    def fails() -> DataFrame:
        raise ValueError("a callback that raises")

    key, whole = ("o_orderkey",), lambda: source
    return [
        audit.Pair("S1", "ORDERS", whole, lambda: target, key), audit.Pair("S1", "SAME", whole, whole, key), audit.Pair("S2", "LINES", lambda: lines, lambda: lines_target),
        audit.Pair("S2", "BY_STATUS", view(source), view(source), ("o_orderstatus",), "View"), audit.Pair("S.3", "A.B", whole, lambda: target, key), audit.Pair("S.3", "A.C", whole, whole, key),
        audit.Pair("S3", "LINES_BY_KEY", lambda: lines, lambda: lines_target, ("l_orderkey", "l_linenumber")), audit.Pair("S3", "OTHER_KEY", whole, lambda: target, key, target_keys=("o_custkey", "o_orderkey")),
        audit.Pair("S4", "GONE", whole, lambda: spark.read.parquet("/nowhere/at/all.parquet"), key), audit.Pair("S4", "BROKEN", whole, lambda: spark.read.schema(source.schema).parquet(broken), key),
        audit.Pair("S4", "NO_DRIVER", whole, lambda: spark.read.format("jdbc").option("url", "jdbc:nowhere:x").option("dbtable", "t").load(), key), audit.Pair("S4", "NO_KEY", whole, whole, ("nowhere",)),
        audit.Pair("S4", "OTHER_COLUMNS", whole, lambda: target.drop("o_custkey"), key), audit.Pair("S4", "RAISES", fails, whole, key),
    ]


_BY_KEY = "count(*) filter (category <> 'extra'), count(*) filter (category <> 'missing'), count(*) filter (category = 'matching'), count(*) filter (category = 'mismatched'), count(*) filter (category = 'missing'), count(*) filter (category = 'extra'), 0, null from d"
_AS_ROWS = "sum(n_source), sum(n_target), sum(least(n_source, n_target)), 0, sum(greatest(n_source - n_target, 0)), sum(greatest(n_target - n_source, 0))"
_LINE_KEYS = """lk as (select l_orderkey, l_linenumber, count(*) filter (side = 1) as s, count(*) filter (side = 0) as t
        from (select l_orderkey, l_linenumber, 1 as side from lineitem_src union all select l_orderkey, l_linenumber, 0 from lineitem_tgt) as x group by 1, 2)"""
_ERRORS = {"GONE": "PATH_NOT_FOUND", "BROKEN": "RuntimeException", "NO_DRIVER": "SQLException", "NO_KEY": "KEY_NOT_FOUND", "OTHER_COLUMNS": "COLUMNS_DIFFER", "RAISES": "ValueError"}
_MANY = f"""{_KEYED}, {_MULTI.strip()}, {_LINE_KEYS},
    om as (select h as row_hash, sum(s) as n_source, sum(t) as n_target from (select sha256({ORDER_TEXT}) as h, 1 as s, 0 as t from orders_src union all select sha256({ORDER_TEXT}), 0, 1 from orders_tgt) as x group by h), many as (
    select 'S1' as schema_name, 'ORDERS' as table_name, 'Table' as object_type, 'keys' as compared_by, count(*) filter (category <> 'extra') as source_rows, count(*) filter (category <> 'missing') as target_rows, count(*) filter (category = 'matching') as matching,
           count(*) filter (category = 'mismatched') as mismatched, count(*) filter (category = 'missing') as missing, count(*) filter (category = 'extra') as extra, 0 as duplicate_keys, cast(null as varchar) as error from d
    union all select 'S.3', 'A.B', 'Table', 'keys', {_BY_KEY}
    union all select 'S1', 'SAME', 'Table', 'keys', count(*), count(*), count(*), 0, 0, 0, 0, null from orders_src
    union all select 'S.3', 'A.C', 'Table', 'keys', count(*), count(*), count(*), 0, 0, 0, 0, null from orders_src
    union all select 'S2', 'LINES', 'Table', 'rows', {_AS_ROWS}, 0, null from m
    union all select 'S3', 'OTHER_KEY', 'Table', 'rows', {_AS_ROWS}, 0, null from om
    union all select 'S3', 'LINES_BY_KEY', 'Table', (select case when count(*) filter (greatest(s, t) > 1) > 0 then 'rows' else 'keys' end from lk), {_AS_ROWS}, (select count(*) filter (greatest(s, t) > 1) from lk), null from m
    union all select 'S2', 'BY_STATUS', 'View', 'keys', count(distinct o_orderstatus), count(distinct o_orderstatus), count(distinct o_orderstatus), 0, 0, 0, 0, null from orders_src
    {" ".join(f"union all select 'S4', '{t}', 'Table', null, 0, 0, 0, 0, 0, 0, 0, '{e}'" for t, e in _ERRORS.items())})"""
_LONGS = ", ".join(f"cast({c} as bigint) as {c}" for c in (*audit.TOTALS, "duplicate_keys"))
_FOUR = "orders_src orders_tgt lineitem_src lineitem_tgt"


@query("audit_pairs", _FOUR, f"with {_MANY} select schema_name, table_name, object_type, compared_by, {_LONGS}, error from many")
@tables.tidy
def audit_pairs(*sides: DataFrame) -> DataFrame:
    return audit.audit_pairs(sides[0].sparkSession, _pairs(*sides))


@query(
    "audit_pairs_summary", _FOUR,
    f"""with {_MANY} select count(*) filter (object_type = 'Table') as tables, count(*) filter (object_type = 'View') as views, count(*) as objects, count(*) filter (error is null and mismatched + missing + extra = 0) as passed,
            count(*) filter (error is null and mismatched + missing + extra > 0) as failed, count(error) as errors, {", ".join(f"cast(sum({c}) as bigint) as {c}" for c in audit.TOTALS)}, cast(sum(matching) as double) * 100.0 / cast(sum(source_rows) as double) as match_percent from many""",
)
@tables.tidy
def audit_pairs_summary(*sides: DataFrame) -> DataFrame:
    return summary.executive_summary(audit.audit_pairs(sides[0].sparkSession, _pairs(*sides)))


def _drilled(schema: str, table: str) -> str:
    return f"""select '{schema}' as schema_name, '{table}' as table_name, case category when 'missing' then 'missing' else 'extra' end as side, cast(o_orderkey as varchar) as key_text from d
               where category in ('missing', 'extra') and (select count(*) from orders_src) <> (select count(*) from orders_tgt)"""


@query(
    "count_drill_down", _FOUR,
    f"""with {_KEYED}, {_LINE_KEYS}, sides as (select unnest(['missing', 'extra', 'duplicate']) as side)
        {_drilled('S1', 'ORDERS')} union all {_drilled('S.3', 'A.B')}
        union all select 'S3', 'LINES_BY_KEY', side, cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar) from lk, sides
        where (side = 'missing' and t = 0 or side = 'extra' and s = 0 or side = 'duplicate' and greatest(s, t) > 1) and (select count(*) from lineitem_src) <> (select count(*) from lineitem_tgt)""",
)
@tables.tidy
def count_drill_down(*sides: DataFrame) -> DataFrame:
    """From counts that differ to the keys behind them; equal counts, other key lists and tables that can't be counted are left alone."""
    return audit.count_drill_down(sides[0].sparkSession, _pairs(*sides))[1]


@query(
    "pair_samples", _FOUR,
    f"""with {_KEYED}, {_LINE_KEYS},
        lh as (select s.l_orderkey, s.l_linenumber, s.h <> t.h as differs from (select *, sha256({LINE_TEXT}) as h from lineitem_src) as s join (select *, sha256({LINE_TEXT}) as h from lineitem_tgt) as t on s.l_orderkey = t.l_orderkey and s.l_linenumber = t.l_linenumber),
        e as (
            select schema_name, table_name, category, cast(o_orderkey as varchar) as key_text from d, (select 'S1' as schema_name, 'ORDERS' as table_name union all select 'S.3', 'A.B') as n where category <> 'matching'
            union all select 'S3', 'LINES_BY_KEY', case when t = 0 then 'missing' when s = 0 then 'extra' else 'mismatched' end, cast(l_orderkey as varchar) || '|' || cast(l_linenumber as varchar)
            from lk where s <= 1 and t <= 1 and (s <> t or exists (select 1 from lh where lh.differs and lh.l_orderkey = lk.l_orderkey and lh.l_linenumber = lk.l_linenumber))
        ),
        r as (select *, cast(row_number() over (partition by schema_name, table_name, category order by key_text) as int) as rank from e)
        select schema_name, table_name, category, rank, key_text from r where rank <= 5""",
)
@tables.tidy
def pair_samples(*sides: DataFrame) -> DataFrame:
    """The first differences of every pair that has keys; those that can't be read are left out."""
    return audit.pair_samples(sides[0].sparkSession, _pairs(*sides))


_TABLES = 200


def _estate(source: DataFrame, target: DataFrame) -> list[audit.Pair]:
    """All orders of both sides dealt over 200 tables by their keys, each a folder that is read on its own."""
    spark, schema, number = source.sparkSession, source.schema, F.pmod(F.col("o_orderkey"), F.lit(_TABLES))

    def folder(df: DataFrame, name: str) -> str:
        path = tables.new_folder(spark, name)
        df.withColumn("n", number).repartition("n").write.partitionBy("n").parquet(path)
        return path

    sides = folder(source, "estate-source"), folder(target, "estate-target")
    one = lambda path, k: lambda: spark.read.schema(schema).parquet(f"{path}/n={k}")
    return [audit.Pair(f"S{k % 7}", f"T{k}", one(sides[0], k), one(sides[1], k), ("o_orderkey",)) for k in range(_TABLES)]


@query(
    "audit_estate", "orders_src orders_tgt",
    f"""with {_KEYED}, n as (select cast(o_orderkey % {_TABLES} as integer) as k, category from d), g as (select unnest(generate_series(0, {_TABLES - 1})) as k),
        c as (select g.k, count(*) filter (category in ('matching', 'mismatched', 'missing')) as source_rows, count(*) filter (category in ('matching', 'mismatched', 'extra')) as target_rows, count(*) filter (category = 'matching') as matching, count(*) filter (category = 'mismatched') as mismatched,
                     count(*) filter (category = 'missing') as missing, count(*) filter (category = 'extra') as extra from g left join n on n.k = g.k group by g.k),
        e as (select *, source_rows = 0 or target_rows = 0 as gone from c)
        select 'S' || cast(k % 7 as varchar) as schema_name, 'T' || cast(k as varchar) as table_name, 'Table' as object_type, case when not gone then 'keys' end as compared_by,
               {", ".join(f"cast(case when gone then 0 else {c} end as bigint) as {c}" for c in audit.TOTALS)}, cast(0 as bigint) as duplicate_keys, case when gone then 'PATH_NOT_FOUND' end as error from e""",
)
@tables.tidy
def audit_estate(source: DataFrame, target: DataFrame) -> DataFrame:
    """Two hundred pairs in one job; a table that one side lacks is a row with its error."""
    return audit.audit_pairs(source.sparkSession, _estate(source, target))


@query("read_pair_diff", "orders_src orders_tgt", f"with {_KEYED} select category, count(*) as n from d group by 1")
@tables.tidy
def read_pair_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Both sides as files of two formats, read as a pair and compared by key."""
    paths = [tables.new_folder(source.sparkSession, "pair") for _ in range(2)]
    source.write.parquet(paths[0])
    target.write.orc(paths[1])
    pair = tables.read_pair(source.sparkSession, {"path": paths[0]}, {"format": "orc", "path": paths[1]})
    return diff.keyed_diff(*pair, KEYS).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fallback_keys", "orders_src",
    f"""select 'declared' as rule, cast(o_orderkey as varchar) as key_text from orders_src
        union all select 'ends in id', cast(o_custkey as varchar) || '|' || cast(o_orderkey as varchar) from orders_src
        union all select 'orderable', {ORDER_TEXT} from orders_src""",
)
def fallback_keys(orders: DataFrame) -> DataFrame:
    """The text of each row's key where it is declared, where only names tell it, and where nothing does."""

    def keyed(rule: str, df: DataFrame, declared: tuple[str, ...] = ()) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), canonical.row_text(df, fingerprint.key_columns(df, declared)).alias("key_text"))

    named = orders.withColumnsRenamed({"o_custkey": "cust_id", "o_orderkey": "order_id"})
    return keyed("declared", orders, ("O_ORDERKEY",)).union(keyed("ends in id", named)).union(keyed("orderable", orders))


#: Columns of the target's catalog: name, type, precision, scale, length.
ORDER_TYPES = (
    ("o_orderkey", "smallint", None, None, None), ("o_custkey", "int4", None, None, None), ("o_orderstatus", "char", None, None, 1), ("o_totalprice", "numeric", 7, 1, None), ("o_orderdate", "date", None, None, None),
    ("o_orderpriority", "varchar", None, None, 8), ("nowhere", "text", None, None, None),
)
LINE_TYPES = (
    ("l_orderkey", "bigint", None, None, None), ("l_partkey", "character varying", None, None, 3), ("l_quantity", "numeric", 3, 2, None), ("l_extendedprice", "int8", None, None, None), ("l_returnflag", "text", None, None, None),
    ("l_shipdate", "timestamp", 0, None, None), ("l_linenumber", "real", None, None, None),
)


def _fit(table: str, column: str, declared: str, risk: bool = True, **faults: str) -> str:
    n = lambda f: f"count(*) filter ({faults[f]})" if f in faults else "cast(0 as bigint)"
    unfit = f"count(*) filter ({' or '.join(f'({x})' for x in faults.values())})" if faults else "count(*) filter (false)"
    verdict = f"case when {unfit} > 0 then 'proven' else 'ruled out' end" if risk else "'safe'"
    return f"select '{column}' as column_name, '{declared}' as target_type, {str(risk).lower()} as at_risk, {', '.join(f'{n(f)} as n_{f}' for f in value_fit.FAULTS)}, {unfit} as n_unfit, {verdict} as verdict from {table}"


_PRICE, _QUANTITY = "o_totalprice", "l_quantity"


@query(
    "value_fit", "orders_src lineitem_src",
    " union all ".join([
        _fit("orders_src", "o_orderkey", "smallint", overflow="o_orderkey > 32767", rounded="false"), _fit("orders_src", "o_custkey", "int4", overflow="false", rounded="false"), _fit("orders_src", "o_orderstatus", "char(1)", truncated="length(o_orderstatus) > 1"),
        _fit("orders_src", "o_totalprice", "numeric(7,1)", overflow="abs(o_totalprice) >= 1000000", rounded="o_totalprice * 10 <> trunc(o_totalprice * 10)"), _fit("orders_src", "o_orderdate", "date", time_lost="date_trunc('day', o_orderdate) <> o_orderdate"),
        _fit("orders_src", "o_orderpriority", "varchar(8)", truncated="length(o_orderpriority) > 8"), _fit("lineitem_src", "l_orderkey", "bigint", overflow="false", rounded="false"), _fit("lineitem_src", "l_partkey", "character varying(3)", truncated="length(cast(l_partkey as varchar)) > 3"),
        _fit("lineitem_src", "l_quantity", "numeric(3,2)", overflow="abs(l_quantity) >= 10", rounded="false"), _fit("lineitem_src", "l_extendedprice", "int8", overflow="false", rounded="l_extendedprice <> trunc(l_extendedprice)"),
        _fit("lineitem_src", "l_returnflag", "text", risk=False), _fit("lineitem_src", "l_shipdate", "timestamp(0)", rounded="date_trunc('second', l_shipdate) <> l_shipdate"), _fit("lineitem_src", "l_linenumber", "real", rounded="l_linenumber > 999999"),
    ]),
)
def fits(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Which values of orders and line items wouldn't fit the target's types, by column."""
    return value_fit.value_fit(orders, ORDER_TYPES).union(value_fit.value_fit(lines, LINE_TYPES))


@query(
    "value_profile", "orders_src",
    """select column_name, count(*) as n_rows, count(*) - count(v) as n_null, cast(max(w) as bigint) as whole_digits, cast(max(s) as bigint) as scale, max(c) as chars, max(b) as bytes, cast(sum(na) as bigint) as n_not_ascii, cast(sum(p) as bigint) as n_padded,
              cast(sum(tm) as bigint) as n_with_time, cast(max(fd) as bigint) as fraction_digits from (
           select 'o_totalprice' as column_name, cast(o_totalprice as varchar) as v, case when abs(o_totalprice) < 1 then 0 else length(cast(cast(trunc(abs(o_totalprice)) as bigint) as varchar)) end as w, length(rtrim(split_part(cast(o_totalprice as varchar), '.', 2), '0')) as s, null as c, null as b, null as na, null as p, null as tm, null as fd from orders_src
           union all select 'o_custkey', cast(o_custkey as varchar), case when o_custkey = 0 then 0 else length(cast(abs(o_custkey) as varchar)) end, 0, null, null, null, null, null, null from orders_src
           union all select 'o_orderpriority', o_orderpriority, null, null, length(o_orderpriority), strlen(o_orderpriority), cast(length(o_orderpriority) <> strlen(o_orderpriority) as integer), cast(rtrim(o_orderpriority) <> o_orderpriority as integer), null, null from orders_src
           union all select 'o_orderdate', cast(o_orderdate as varchar), null, null, null, null, null, null, cast(date_trunc('day', o_orderdate) <> o_orderdate as integer), length(rtrim(strftime(o_orderdate, '%f'), '0')) from orders_src) as x group by column_name""",
)
def value_profile(orders: DataFrame) -> DataFrame:
    """What the columns' values need, from the states of five parts of the table."""
    names = ["o_totalprice", "o_custkey", "o_orderpriority", "o_orderdate"]
    states = [value_fit.profile(orders.filter(F.pmod(F.hash("o_orderkey"), F.lit(5)) == k), names) for k in range(5)]
    whole = states[0]
    for s in states[1:]:
        whole = whole.union(s)
    return value_fit.merged(whole)


_COLUMNS = {
    "region": ("r_name", "r_regionkey"), "nation": ("n_name", "n_nationkey", "n_regionkey"), "orders_src": ("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"), "lineitem_src": ("l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_suppkey"),
}


def _minimal_sql() -> str:
    sets = [(t, s) for t, names in _COLUMNS.items() for size in (1, 2, 3) for s in combinations(names, size)]
    one = lambda t, s: f"select '{t}' as table_name, '{','.join(s)}' as columns, {len(s)} as size, [{', '.join(repr(c) for c in s)}] as parts, (select count(*) from (select distinct {', '.join(s)} from {t}) as d) = (select count(*) from {t}) as unique_ from (select 1) as one"
    return f"with u as materialized ({' union all '.join(one(*x) for x in sets)}) select table_name, columns, size from u where unique_ and not exists (select 1 from u v where v.table_name = u.table_name and v.unique_ and v.size < u.size and list_has_all(u.parts, v.parts))"


@query("minimal_keys", "region nation orders_src lineitem_src", _minimal_sql())
def minimal_keys(*tables_: DataFrame) -> DataFrame:
    """The smallest sets of up to three columns that are keys, by the data alone."""
    each = [key_search.minimal_keys(df, columns=list(_COLUMNS[t])).select(F.lit(t).alias("table_name"), "columns", "size") for t, df in zip(_COLUMNS, tables_, strict=True)]
    whole = each[0]
    for e in each[1:]:
        whole = whole.union(e)
    return whole


def _cause(column: str, cause: str, detail: str, k: int, differs: str) -> str:
    return f"select '{column}' as column_name, '{cause}' as cause, {detail} as detail, count(*) as n from timed where o_orderkey % 16 = {k} and {differs} group by 3"


@query(
    "column_causes", "orders_src",
    "with timed as (select *, o_orderdate + interval 37815 second + interval 250 millisecond as d from orders_src) " + " union all ".join([
        _cause("p", "case", "''", 0, "lower(o_orderpriority) <> o_orderpriority"), _cause("p", "padding", "''", 1, "true"), _cause("p", "truncated", "'4'", 2, "length(o_orderpriority) > 4"), _cause("x", "rounded", "'1'", 3, "round(o_totalprice, 1) <> o_totalprice and round(o_totalprice, 0) <> round(o_totalprice, 1)"),
        _cause("x", "rounded", "'0'", 3, "round(o_totalprice, 1) <> o_totalprice and round(o_totalprice, 0) = round(o_totalprice, 1)"), _cause("d", "shifted", "'300 minutes'", 4, "true"), _cause("d", "time lost", "''", 5, "true"), _cause("p", "swapped", "'q'", 6, "true"), _cause("q", "swapped", "'p'", 6, "true"),
        _cause("x", "nulled", "''", 7, "true"), _cause("x", "scaled", "'times 10^2'", 8, "o_totalprice <> 0"), _cause("x", "unexplained", "''", 9, "true"), _cause("d", "fraction lost", "''", 10, "true"), _cause("q", "encoding", "'replaced by ?'", 11, "true"), _cause("q", "encoding", "'UTF-8 read as ISO-8859-1'", 12, "true"),
        _cause("x", "sign", "''", 13, "o_totalprice <> 0"), _cause("p", "filled", "''", 14, "true"),
    ]),
)
def column_causes(orders: DataFrame) -> DataFrame:
    """Orders against a target where each sixteenth of the keys was changed in a way of its own."""
    k = F.col("o_orderkey") % 16
    base = orders.select(
        "o_orderkey", F.when(k != 14, F.col("o_orderpriority")).alias("p"), F.concat(F.lit("Zoë Ärger "), F.col("o_orderstatus")).alias("q"), F.col("o_totalprice").cast("decimal(22,2)").alias("x"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 37815.25 seconds")).alias("d"),
    )
    p, q, x, d = (F.col(c) for c in "pqxd")
    target = base.select(
        "o_orderkey",
        F.when(k == 0, F.lower(p)).when(k == 1, F.concat(F.lit("  "), p)).when(k == 2, F.left(p, F.lit(4))).when(k == 6, q).when(k == 14, "new").otherwise(p).alias("p"),
        F.when(k == 6, p).when(k == 11, F.regexp_replace(q, "[^\\x00-\\x7F]", "?")).when(k == 12, F.decode(F.encode(q, "UTF-8"), "ISO-8859-1")).otherwise(q).alias("q"),
        F.when(k == 3, F.round(x, 1)).when(k == 7, F.lit(None)).when(k == 8, x * 100).when(k == 9, x * 3 + 7).when(k == 13, -x).otherwise(x).cast("decimal(22,2)").alias("x"),
        F.when(k == 4, d + F.expr("interval 5 hours")).when(k == 5, F.date_trunc("day", d).cast("timestamp_ntz")).when(k == 10, F.date_trunc("second", d).cast("timestamp_ntz")).otherwise(d).alias("d"),
    )
    return causes.column_causes(base, target, KEYS)


@query(
    "repeated_audit", "orders_src orders_tgt",
    f"""with now as (select * replace (case when o_orderkey % 8 = 5 then cast(o_totalprice + 2 as decimal(18,2)) else o_totalprice end as o_totalprice) from orders_src where o_orderkey % 8 <> 3
                     union all select * replace (o_orderkey + 20000000 as o_orderkey) from orders_src where o_orderkey % 8 = 1),
        {_KEYED.replace("from orders_src)", "from now)", 1)} select category, count(*) as n from d group by category""",
)
@tables.tidy
def repeated_audit(source: DataFrame, target: DataFrame) -> DataFrame:
    """Hashes kept from a first run, then a part of the files is gone, one part changed and one added; the difference after the second run."""
    spark, schema = source.sparkSession, source.schema
    path, state, part = tables.new_folder(spark, "files"), tables.new_folder(spark, "kept"), F.pmod(F.col("o_orderkey"), F.lit(8))
    for k in range(8):
        source.filter(part == k).write.parquet(f"{path}/p{k}")
    kept_hashes.refreshed(spark, path, state, KEYS, schema=schema)
    source.filter(part == 5).withColumn("o_totalprice", (F.col("o_totalprice") + 2).cast("decimal(18,2)")).write.mode("overwrite").parquet(f"{path}/p5")
    source.filter(part == 1).withColumn("o_orderkey", F.col("o_orderkey") + 20_000_000).write.parquet(f"{path}/p8")
    source.limit(0).write.mode("overwrite").parquet(f"{path}/p3")
    kept = kept_hashes.refreshed(spark, path, state, KEYS, schema=schema)
    return diff.paired_hashes(kept, fingerprint.fingerprint(target, KEYS), KEYS).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def _parts_sketched(orders: DataFrame) -> DataFrame:
    """Sketches of five parts of a table, merged."""
    parts = [sketches.column_sketches(orders.filter(F.pmod(F.hash("o_orderkey"), F.lit(5)) == k)) for k in range(5)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return sketches.merged(whole)


@query(
    "column_sketches", "orders_src",
    " union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null, true as distinct_close, {m} as median_close from orders_src" for c, m in {"o_custkey": "true", "o_orderdate": "true", "o_orderkey": "true", "o_orderpriority": "null", "o_orderstatus": "null", "o_totalprice": "true"}.items()),
)
@tables.tidy
def column_sketches(orders: DataFrame) -> DataFrame:
    """Merged sketches of all columns against exact counts and ranks: 5 % of the distinct values, 5 % of the rows around the middle."""
    told = tables.written(sketches.estimates(_parts_sketched(orders)).select("column_name", "n_rows", "n_null", "n_distinct", F.col("values_at")[2].alias("median")), "sketched")
    exact = summary.column_stats(orders).select("column_name", F.col("n_distinct").alias("exact"))
    middle = {r["column_name"]: r["median"] for r in told.collect()}  # a row for each column
    line = {c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000 if c == "o_orderdate" else F.col(c).cast("double") for c, m in middle.items() if m is not None}
    ranks = orders.agg(F.array(*(F.struct(F.lit(c).alias("column_name"), ((F.count_if(x < middle[c]) <= 0.55 * F.count(x)) & (F.count_if(x <= middle[c]) >= 0.45 * F.count(x))).alias("median_close")) for c, x in line.items())).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return told.join(exact, "column_name").join(ranks, "column_name", "left").select("column_name", "n_rows", "n_null", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_close"), "median_close")


@query("order_keys_by_sketches", "orders_src", "select column_name, cast(row_number() over (order by place) as int) as place from (values ('o_orderdate', 1), ('o_orderkey', 2), ('o_totalprice', 3), ('o_custkey', 4)) as t(column_name, place) where exists (select 1 from orders_src)")
def order_keys_by_sketches(orders: DataFrame) -> DataFrame:
    """The columns to order a table by, ranked from its sketches."""
    return summary.order_keys_by_stats(sketches.as_statistics(_parts_sketched(orders), "S", "ORDERS", KEYS), target=4).select("column_name", "place")
