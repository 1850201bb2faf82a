"""Are columns' types mapped safely? Rules over the paired column catalogs of two systems, for all schemas in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Target types by source type (fixed values); NUMBER has rules of its own below.
EXPECTED = {
    "INTEGER": "integer", "INT": "integer", "SMALLINT": "smallint", "FLOAT": "double precision", "BINARY_FLOAT": "real", "BINARY_DOUBLE": "double precision",
    "VARCHAR2": "character varying", "VARCHAR": "character varying", "NVARCHAR2": "character varying", "CHAR": "character", "NCHAR": "character",
    "CLOB": "text", "NCLOB": "text", "LONG": "text", "BFILE": "text", "DATE": "timestamp", "TIMESTAMP": "timestamp",
    "TIMESTAMP WITH TIME ZONE": "timestamp with time zone", "TIMESTAMP WITH TIMEZONE": "timestamp with time zone", "TIMESTAMP WITH LOCAL TIME ZONE": "timestamp with time zone",
    "INTERVAL YEAR TO MONTH": "interval", "INTERVAL DAY TO SECOND": "interval", "BLOB": "bytea", "RAW": "bytea", "LONG RAW": "bytea", "XMLTYPE": "xml", "ROWID": "character varying", "UROWID": "character varying",
}
#: Other names of target types (fixed values).
ALIASES = {
    "varchar": "character varying", "char": "character", "bpchar": "character", "int": "integer", "int2": "smallint", "int4": "integer", "int8": "bigint", "float8": "double precision",
    "float4": "real", "double": "double precision", "bool": "boolean", "timestamptz": "timestamp with time zone", "decimal": "numeric",
}
WITH_LENGTH = ("VARCHAR2", "VARCHAR", "CHAR", "NCHAR", "NVARCHAR2")
SEVERITY_RANK = {"Critical": 0, "Error": 1, "Warning": 2, "Info": 3}


def _among(c: Column, table: dict[str, str], otherwise: Column) -> Column:
    """A literal map: as one look-up, not a chain as long as the table."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), otherwise)


def base_type(c: Column) -> Column:
    return F.trim(F.substring_index(c, "(", 1))


def normal_type(c: Column) -> Column:
    """A target type's base name under its canonical alias."""
    base = base_type(F.lower(F.trim(c)))
    return _among(base, ALIASES, base)


def pair_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns of both sides by schema, table and name in any case; of repeated names the first by column id. ``s_`` and ``t_`` columns."""

    def side(df: DataFrame, p: str) -> DataFrame:
        keys = {f"_{c}": F.upper(c) for c in ("schema_name", "table_name", "column_name")}
        first = F.row_number().over(W.partitionBy(*keys).orderBy("column_id", "column_name", "data_type"))
        named = df.withColumns(keys).withColumn("_n", first).filter("_n = 1").drop("_n")
        return named.select(*keys, *(F.col(c).alias(p + c) for c in df.columns))

    return side(source, "s_").join(side(target, "t_"), ["_schema_name", "_table_name", "_column_name"])


def expected(kind: Column, precision: Column, scale: Column, length: Column) -> dict[str, Column]:
    """The target type a source column should have, and which precision, scale and length go with it."""
    kind = F.upper(kind)
    number = (
        F.when((scale == 0) & precision.between(1, 4), "smallint").when((scale == 0) & precision.between(5, 9), "integer").when((scale == 0) & ((precision >= 10) | precision.isNull()), "bigint")
        .when(scale > 0, "numeric").when(scale.isNull() & precision.isNull(), "numeric")
    )
    name = F.when(kind == "NUMBER", number).otherwise(_among(kind, EXPECTED, F.lit(None).cast("string")))
    scaled = (kind == "NUMBER") & (scale > 0)
    long = F.when(kind.isin(*WITH_LENGTH), length).when(kind.isin("ROWID", "UROWID"), 18)
    return {"expected_type": name, "expected_precision": F.when(scaled, precision), "expected_scale": F.when(scaled, scale), "expected_length": long}


def with_expected(paired: DataFrame) -> DataFrame:
    return paired.withColumns(expected(F.col("s_data_type"), F.col("s_data_precision"), F.col("s_data_scale"), F.col("s_char_length")))


def with_compat(paired: DataFrame) -> DataFrame:
    """Adds ``compatible`` and ``reason``: type, then precision, scale and length; a longer target is fine, a shorter one truncates."""
    df = with_expected(paired)
    want, have = normal_type(F.col("expected_type")), normal_type(F.col("t_data_type"))
    integral = want.isin("bigint", "integer", "smallint")
    same = (want == have) | (integral & (have == "numeric")) | ((want == "timestamp") & have.startswith("timestamp")) | ((want == "timestamp with time zone") & have.startswith("timestamp with"))
    p, s, n = F.col("expected_precision"), F.col("expected_scale"), F.col("expected_length")
    numbers = (p.isNotNull() | s.isNotNull()) & ~(integral & (have == "numeric"))
    shorter = want.startswith("character") & n.isNotNull() & ~n.eqNullSafe(F.col("t_char_length")) & (F.coalesce("t_char_length", F.lit(0)) < F.coalesce("s_char_length", n))
    reason = (
        F.when(F.col("expected_type").isNull(), "unknown type").when(~same, F.concat(F.lit("type: expected "), F.col("expected_type"), F.lit(", got "), F.lower("t_data_type")))
        .when(numbers & ~p.eqNullSafe(F.col("t_data_precision")), "precision").when(numbers & s.isNotNull() & ~s.eqNullSafe(F.col("t_data_scale")), "scale").when(shorter, "length: truncation risk")
    )
    return df.withColumn("reason", reason).withColumn("compatible", F.col("reason").isNull())


def _rules() -> list[tuple[str, str, Column]]:
    """``(category, severity, condition)`` of every rule; several may hold for one column, and two may tell the same fact."""
    src, tgt = F.upper("s_data_type"), F.lower("t_data_type")
    base = F.when(tgt.contains("("), F.substring_index(tgt, "(", 1)).otherwise(tgt)
    precision, scale = F.col("s_data_precision"), F.col("s_data_scale")
    whole, fraction = (src == "NUMBER") & (scale == 0), (src == "NUMBER") & precision.isNotNull() & (scale > 0)
    digits = F.coalesce(precision, F.lit(38))
    overflow, roomy = (digits > 9) & (base == "integer"), (digits <= 9) & (base == "bigint")
    double = base.isin("double precision", "double")
    given = F.coalesce(F.col("s_default_value"), F.lit(""))
    identity = given.contains("GENERATED") | given.contains("IDENTITY")
    counted = tgt.contains("serial") | tgt.contains("generated") | F.coalesce(F.col("t_default_value").contains("nextval"), F.lit(False))
    varying = base.startswith("character varying") | (base == "varchar")
    plain_time, zone = base.isin("timestamp", "timestamp without time zone"), tgt.isin("timestamp with time zone", "timestamptz")
    is_ = lambda *kinds: src.isin(*kinds)
    spatial = is_("SDO_GEOMETRY") | src.contains("MDSYS.SDO_GEOMETRY")
    json = src.contains("JSON")
    return [
        ("Type Mapping Mismatch", "Error", ~F.col("compatible") & F.col("expected_type").isNotNull()),
        ("Valid Mapping", "Info", F.col("compatible")),
        ("Numeric Overflow Risk", "Critical", whole & overflow),
        ("Storage Optimization", "Info", whole & ~overflow & roomy),
        ("Invalid Mapping", "Error", whole & ~overflow & ~roomy & ~base.isin("integer", "bigint", "numeric", "smallint")),
        ("Precision/Scale Mismatch", "Error", fraction & ~base.startswith("numeric")),
        ("Precision/Scale Mismatch", "Critical", fraction & base.startswith("numeric") & ~(precision.eqNullSafe(F.col("t_data_precision")) & scale.eqNullSafe(F.col("t_data_scale")))),
        ("Float Type Mismatch", "Error", is_("FLOAT", "BINARY_DOUBLE") & ~double),
        ("Valid Float Mapping", "Info", is_("FLOAT", "BINARY_DOUBLE") & double),
        ("Auto-Increment Missing", "Error", identity & ~counted),
        ("Auto-Increment OK", "Info", identity & counted),
        ("String Type Mismatch", "Error", is_("VARCHAR2") & ~varying & (base != "text")),
        ("Padding Behavior", "Warning", is_("CHAR") & varying),
        ("Fixed-Length Type Mismatch", "Error", is_("CHAR") & ~varying & ~base.startswith("character") & ~base.isin("char", "bpchar")),
        ("Large Text Type Mismatch", "Error", is_("CLOB") & (base != "text")),
        ("Text Truncation Risk", "Critical", is_("CLOB") & (F.col("t_char_length") < 4000)),
        ("Time Data Loss", "Warning", is_("DATE") & (base == "date")),
        ("Date Mapping OK", "Info", is_("DATE") & plain_time),
        ("Timestamp Type Mismatch", "Error", is_("TIMESTAMP") & ~plain_time),
        ("Timezone Type Mismatch", "Error", is_("TIMESTAMP WITH TIME ZONE") & ~zone),
        ("UTC Conversion", "Warning", is_("TIMESTAMP WITH TIME ZONE") & zone),
        ("Binary Type Mismatch", "Error", is_("BLOB", "RAW") & (base != "bytea")),
        ("Valid Binary Mapping", "Info", is_("BLOB", "RAW") & (base == "bytea")),
        ("Boolean Conversion", "Warning", ((is_("NUMBER") & (precision == 1)) | (is_("CHAR") & (F.col("s_char_length") == 1))) & (tgt == "boolean")),
        ("Legacy LONG Type", "Error", is_("LONG") & (tgt != "text")),
        ("Deprecated Type", "Warning", is_("LONG") & (tgt == "text")),
        ("Legacy LONG RAW Type", "Error", is_("LONG RAW") & (tgt != "bytea")),
        ("Deprecated Binary Type", "Warning", is_("LONG RAW") & (tgt == "bytea")),
        ("Fixed Binary Type", "Error", src.startswith("RAW") & (base != "bytea")),
        ("Valid Binary Mapping", "Info", src.startswith("RAW") & (base == "bytea")),
        ("XML Type Mismatch", "Error", is_("XMLTYPE") & ~tgt.isin("xml", "text")),
        ("XML Features Lost", "Warning", is_("XMLTYPE") & (tgt == "text")),
        ("JSON Type Mismatch", "Error", json & ~tgt.isin("json", "jsonb")),
        ("JSONB Recommended", "Info", json & (tgt == "json")),
        ("National String Type", "Error", is_("NVARCHAR2") & ~varying & (base != "text")),
        ("Unicode Support", "Info", is_("NVARCHAR2") & (varying | (base == "text"))),
        ("National Fixed String", "Error", is_("NCHAR") & ~tgt.startswith("char") & ~tgt.startswith("bpchar")),
        ("National Large Text", "Error", is_("NCLOB") & (tgt != "text")),
        ("Single Precision Float", "Error", is_("BINARY_FLOAT") & (tgt != "real")),
        ("Float Precision", "Warning", is_("BINARY_FLOAT") & (tgt == "real")),
        ("Double Precision Float", "Error", is_("BINARY_DOUBLE") & ~double),
        ("Valid Binary Double Mapping", "Info", is_("BINARY_DOUBLE") & double),
        ("Interval Type", "Error", (src.startswith("INTERVAL YEAR") | src.startswith("INTERVAL DAY")) & (tgt != "interval")),
        ("Row Identifier Type", "Error", is_("ROWID", "UROWID") & ~tgt.isin("varchar", "character varying", "text")),
        ("ROWID Behavior Lost", "Warning", is_("ROWID", "UROWID") & tgt.isin("varchar", "character varying", "text")),
        ("External File Pointer", "Critical", is_("BFILE")),
        ("Spatial Type Missing", "Critical", spatial & ~tgt.isin("geometry", "geography")),
        ("Spatial Type OK", "Info", spatial & tgt.isin("geometry", "geography")),
        ("User-Defined Type", "Critical", src.contains(".") | src.contains("OBJECT")),
    ]


def format_source(kind: Column, precision: Column, scale: Column, length: Column) -> Column:
    both = F.concat(kind, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")"))
    one = lambda x: F.concat(kind, F.lit("("), x.cast("string"), F.lit(")"))
    return F.coalesce(both, one(precision), one(length), kind)


def format_target(kind: Column, precision: Column, scale: Column, length: Column) -> Column:
    numeric = (kind == "numeric") & precision.isNotNull() & scale.isNotNull()
    text = kind.isin("character varying", "character", "varchar", "char") & length.isNotNull()
    return (
        F.when(kind.contains("("), kind).when(numeric, F.concat(kind, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")))
        .when(text, F.concat(kind, F.lit("("), length.cast("string"), F.lit(")"))).otherwise(kind)
    )


def type_issues(source: DataFrame, target: DataFrame) -> DataFrame:
    """A row for each finding: one pass over the paired columns, in which every rule is a nullable struct of one array."""
    paired = with_compat(pair_columns(source, target))
    found = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("category"), F.lit(s).alias("severity"))) for k, s, c in _rules()))
    grown = (F.col("t_char_length") - F.col("s_char_length")).cast("double") / F.col("s_char_length") * 100
    out = paired.select(
        F.col("s_schema_name").alias("schema_name"), F.col("s_table_name").alias("table_name"), F.col("s_column_name").alias("column_name"),
        format_source(*(F.col(f"s_{c}") for c in ("data_type", "data_precision", "data_scale", "char_length"))).alias("source_type"), format_target(*(F.col(f"t_{c}") for c in ("data_type", "data_precision", "data_scale", "char_length"))).alias("target_type"),
        "reason", F.when(F.upper("s_data_type").contains("CHAR") & (F.col("t_char_length") > F.col("s_char_length")) & (F.col("s_char_length") > 0), grown).alias("growth"),
        F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"),
    )
    valid = F.col("x.category") == "Valid Mapping"
    return out.select("schema_name", "table_name", "column_name", "source_type", "target_type", "x.category", "x.severity", F.when(F.col("x.category") == "Type Mapping Mismatch", F.col("reason")).alias("reason"), F.when(valid, F.col("growth")).alias("length_growth"))


def type_rollup(issues: DataFrame) -> DataFrame:
    """A row for each schema and one for all: columns with findings, findings by severity, status."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    out = issues.rollup("schema_name").agg(F.count_distinct("schema_name", "table_name", "column_name").alias("columns"), F.count(F.lit(1)).alias("issues"), *(n(s) for s in SEVERITY_RANK))
    state = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("error") > 0, "FAILED").when(F.col("warning") > 0, "WARNING").otherwise("PASSED")
    return out.withColumns({"schema_name": F.coalesce("schema_name", F.lit("TOTAL")), "status": state})


def top_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    """The mappings that most schemas share, the graver first: schemas affected and their names."""
    rank = reduce(lambda c, kv: c.when(F.col("severity") == kv[0], kv[1]), SEVERITY_RANK.items(), F.when(F.lit(False), 9))
    grouped = issues.filter("severity <> 'Info'").groupBy("category", "severity", "source_type", "target_type").agg(F.count_distinct("schema_name").alias("schemas"), F.count(F.lit(1)).alias("columns"), F.array_join(F.sort_array(F.collect_set("schema_name")), ",").alias("schema_names"))
    return grouped.orderBy(F.desc("schemas"), rank, F.desc("columns"), "category", "source_type", "target_type").limit(n)
