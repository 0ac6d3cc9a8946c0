"""Host-level quality rules, in DataFrame functions only.

Every document is measured in one pass over its whole text. Rule failures are
summed by host, each rule's failure rate is shrunk towards an empirical beta
prior fitted over all hosts, and a host whose shrunk rate is above the rule's
limit loses all its documents.

Defined cases: a null text counts as an empty one; a null host is a host of its
own; null ids are carried along; repeated rows count as often as they occur; an
empty table gives an empty result; other columns of the input are ignored, so
their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.runtime import materialize

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Rule name -> (condition over the measures, highest shrunk failure rate of a host).
RULES: dict[str, tuple[str, float]] = {
    "short": ("n_words < 10", 0.8),
    "repetitive": ("100 * n_repeat_words > 20 * n_words", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "dup_lines": ("10 * n_dup_lines > 3 * n_lines", 0.5),
    "word_length": ("n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)", 0.5),
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"

#: Up to so many hosts the verdicts are broadcast (about 10 MB); beyond it the join is salted.
BROADCAST_HOSTS = 100_000
SALTS = 32


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of ``text`` (which must not be null) to ``df``.

    Repeated five-word windows are found by sorting their 64-bit hashes within
    the row, and only in rows where the distinct hashes are fewer than the windows.
    """
    df = df.withColumn("_w", words_of(F.col(text)))
    df = df.withColumn("_l", F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(
        "_h",
        F.expr(f"CASE WHEN size(_w) > {WINDOW} THEN transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({', '.join(f'_w[i + {k}]' for k in range(WINDOW))})) END"),
    )
    df = df.withColumn("_r", F.expr("size(array_distinct(_h)) < size(_h)"))
    df = df.withColumn("_s", F.expr("CASE WHEN _r THEN sort_array(transform(_h, (h, i) -> struct(h, i))) END"))
    df = df.withColumn(
        "_p",
        F.expr("CASE WHEN _r THEN sort_array(transform(filter(_s, (x, j) -> coalesce(get(_s, j - 1).h = x.h, false) OR coalesce(get(_s, j + 1).h = x.h, false)), x -> x.i)) END"),
    )
    return df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.expr(f"CASE WHEN _r THEN aggregate(transform(_p, (p, j) -> least({WINDOW}, coalesce(get(_p, j + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x) ELSE 0L END"),
        }
    ).drop("_w", "_l", "_h", "_r", "_s", "_p")


def with_failures(measured: DataFrame) -> DataFrame:
    """Add ``base_failed`` and one boolean ``fail_<rule>`` for each rule."""
    return measured.withColumns({"base_failed": F.expr(BASE_FAILED)} | {f"fail_{k}": F.expr(cond) for k, (cond, _) in RULES.items()})


def host_verdicts(failures: DataFrame) -> DataFrame:
    """One row per host: documents, shrunk failure rate of each rule, ``host_ok``.

    The prior of a rule is a beta distribution whose mean is the rate over all
    documents and whose concentration comes from the variance between hosts in
    excess of binomial noise (method of moments). Only that single row of sums
    comes to the driver.
    """
    hosts = materialize(
        failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fail_{k}").cast("long")).alias(f"k_{k}") for k in RULES]),
        "host-failures",
    )
    sums = hosts.agg(
        F.count(F.lit(1)).alias("h"),
        F.sum("n_docs").alias("n"),
        *[F.sum(f"k_{k}").alias(f"s_{k}") for k in RULES],
        *[F.sum(F.col(f"k_{k}") * F.col(f"k_{k}") / F.col("n_docs")).alias(f"q_{k}") for k in RULES],
    ).first()
    ok = F.lit(True)
    for k, (_, limit) in RULES.items():
        mean, weight = beta_prior(sums["h"], sums["n"] or 0, sums[f"s_{k}"] or 0, sums[f"q_{k}"] or 0.0)
        hosts = hosts.withColumn(f"rate_{k}", (F.col(f"k_{k}") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight)))
        ok = ok & (F.col(f"rate_{k}") <= F.lit(limit))
    return hosts.withColumn("host_ok", ok)


def beta_prior(hosts: int, docs: int, failed: int, squares: float) -> tuple[float, float]:
    """Mean and concentration of the prior; ``squares`` is the sum of failed^2 / docs over hosts."""
    if not docs:
        return 0.0, 1.0
    mean = failed / docs
    noise = mean * (1.0 - mean)
    if hosts < 2 or noise <= 0.0 or docs <= hosts:
        return mean, 100.0
    spread = squares / docs - mean * mean
    share = (spread - noise * hosts / docs) / (noise * (1.0 - hosts / docs))
    share = min(max(share, 1e-4), 0.5)
    return mean, (1.0 - share) / share


def join_verdicts(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Bring ``host_ok`` to the rows of ``docs``; a hot host never meets in one task."""
    few = verdicts.select(F.col("host").alias("_host"), "host_ok")
    if verdicts.count() <= BROADCAST_HOSTS:
        return docs.join(F.broadcast(few), F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = docs.withColumn("_in", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    return salted.join(few, F.col("host").eqNullSafe(F.col("_host")) & (F.col("_in") == F.col("_salt")), "left").drop("_host", "_salt", "_in")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures, failed rules and the verdict ``kept`` of every row of ``df``."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    failures = materialize(with_failures(measure(docs, "_text").drop("_text")), "quality")
    judged = join_verdicts(failures, host_verdicts(failures))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True)))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with the columns they had."""
    plain = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("_text"))
    failures = materialize(with_failures(measure(plain, "_text").drop("_text")), "quality-docs")
    judged = join_verdicts(failures.filter(~F.col("base_failed")), host_verdicts(failures))
    return judged.filter(F.coalesce(F.col("host_ok"), F.lit(True))).select("_row.*")
