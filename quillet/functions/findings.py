"""The finding record: schema, validation, severity order and JSON decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severities in ascending order, and categories.
SEVERITIES = ("info", "suggestion", "warning", "critical")
CATEGORIES = ("bug", "security", "performance", "readability", "design", "test_coverage", "style")
MESSAGE_CHARS = 1000

FINDING = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line_start", T.LongType()),
        T.StructField("line_end", T.LongType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("suggested_fix", T.StringType()),
        T.StructField("code_snippet", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
FIELDS = tuple(FINDING.names)


def severity_rank(severity: Column) -> Column:
    """1 for info to 4 for critical; 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)).cast("long")


def at_least(severity: Column, least: str) -> Column:
    return severity_rank(severity) >= F.lit(SEVERITIES.index(least) + 1)


def violations(row: str | None = None) -> Column:
    """Names of the fields that break a rule, in field order; ``row`` is a struct column, else the fields are columns."""
    c = lambda name: F.col(f"{row}.{name}" if row else name)
    good = {
        "file": c("file").isNotNull(),
        "line_start": c("line_start") >= 1,
        "line_end": c("line_end") >= F.greatest(F.lit(1), c("line_start")),
        "severity": c("severity").isin(*SEVERITIES),
        "category": c("category").isin(*CATEGORIES),
        "message": F.length(c("message")).between(1, MESSAGE_CHARS),
        "code_snippet": c("code_snippet").isNotNull(),
        "confidence": ~F.isnan(c("confidence")) & c("confidence").between(0.0, 1.0),
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in good.items()]), lambda x: x.isNotNull())


def validate(findings: DataFrame) -> DataFrame:
    """Add ``violations`` (empty for a valid finding)."""
    return findings.withColumn("violations", violations())


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _lax_long(v: Column, path: str) -> Column:
    """Whole numbers, whole fractions, booleans and numerals as strings; null otherwise."""
    kind, number = _kind(_get(v, path, "variant")), _get(v, path, "decimal(38,10)")
    text = F.trim(_get(v, path, "string"))
    from_text = F.when(text.rlike(r"^[+-]?\d+(\.0+)?$"), text.try_cast("decimal(38,10)"))
    whole = F.when(kind == "STRING", from_text).when(kind == "BOOLEAN", _get(v, path, "boolean").cast("int").cast("decimal(38,10)")).otherwise(number)
    return F.when(whole == F.floor(whole), whole.try_cast("bigint"))


def _lax_double(v: Column, path: str) -> Column:
    kind = _kind(_get(v, path, "variant"))
    return F.when(kind == "STRING", F.trim(_get(v, path, "string")).try_cast("double")).when(kind == "BOOLEAN", _get(v, path, "boolean").cast("int").cast("double")).otherwise(_get(v, path, "double"))


def _strict_string(v: Column, path: str) -> Column:
    return F.when(_kind(_get(v, path, "variant")) == "STRING", _get(v, path, "string"))


def finding_of(v: Column) -> Column:
    """A finding from a VARIANT object: numbers are read leniently, strings strictly, unknown keys ignored.

    A field that can't be read is null; an unreadable ``suggested_fix`` is shown by
    ``fix_readable`` since null is allowed there.
    """
    fix = _get(v, "$.suggested_fix", "variant")
    return F.struct(
        _strict_string(v, "$.file").alias("file"),
        _lax_long(v, "$.line_start").alias("line_start"),
        _lax_long(v, "$.line_end").alias("line_end"),
        _strict_string(v, "$.severity").alias("severity"),
        _strict_string(v, "$.category").alias("category"),
        _strict_string(v, "$.message").alias("message"),
        _strict_string(v, "$.suggested_fix").alias("suggested_fix"),
        _strict_string(v, "$.code_snippet").alias("code_snippet"),
        _lax_double(v, "$.confidence").alias("confidence"),
        F.coalesce(fix.isNull() | F.is_variant_null(fix) | (_kind(fix) == "STRING"), F.lit(True)).alias("fix_readable"),
    )


def decode_findings(rows: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """``keys``, ``readable`` and ``findings`` of a JSON array per row: all of them, or none if one is invalid."""
    v = F.try_parse_json(F.col(json_col))
    items = rows.select(*keys, v.alias("_v")).withColumn("_a", F.try_variant_get("_v", "$", "array<variant>"))
    one = items.select(*keys, F.posexplode_outer("_a").alias("_pos", "_item"), F.col("_a").isNotNull().alias("_array"))
    one = one.withColumn("_f", finding_of(F.col("_item"))).withColumn("_ok", F.col("_item").isNull() | ((F.size(violations("_f")) == 0) & F.col("_f.fix_readable")))
    plain = F.struct(*[F.col(f"_f.{n}").alias(n) for n in FIELDS])
    grouped = one.groupBy(*keys).agg(
        F.bool_and(F.col("_array") & F.col("_ok")).alias("readable"),
        F.array_sort(F.collect_list(F.when(F.col("_item").isNotNull(), F.struct(F.col("_pos"), plain.alias("f"))))).alias("_all"),
    )
    found = F.transform("_all", lambda x: x["f"])
    return grouped.select(*keys, "readable", F.when(F.col("readable"), found).otherwise(F.array().cast(T.ArrayType(FINDING))).alias("findings"))
