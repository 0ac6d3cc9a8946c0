"""One query per operator over the derived fixtures, and the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions.findings import FIELDS, FINDING, at_least, decode_findings, violations
from quillet.functions.text import split_lines, token_estimate
from quillet.operators import blocks, boundaries, carry, chunk, diff, ground, ledger, report, review, summary
from quillet.plans import code_fixtures as code
from quillet.plans import fixtures as fx
from quillet.plans.review import review_changes
from quillet.runtime import materialize, scratch_path
from quillet.sources import comments
from quillet.sources.files import read_results

Query = Callable[[SparkSession, str], DataFrame]
_KEYS = ["review_id", "conv_id", "turn"]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"chunk_ord": "conv_id", "finding_ord": "turn"})


def split_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with rarer line breaks put in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit(", "), F.lit("\r\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.replace(F.col("text"), F.lit(". "), F.lit("\u2028")), F.lit("\n"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.posexplode(split_lines(text)).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def diff_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changed_lines(diff.diff_lines(fx.diffs(spark, sf_dir))).select("review_id", "file_seq", "path", "line_no")


def diff_changed_lines_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of 37 lines, which cut files and hunks anywhere."""
    lines = diff.diff_lines(fx.diffs(spark, sf_dir))
    return diff.changed_lines_in_slices(lines, F.floor(F.col("ord") / 37))


def diff_file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.file_groups(diff_changed_lines(spark, sf_dir))


def resolve_from_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.reviews(spark, sf_dir)
    since = F.when(F.col("review_id") % 3 == 0, F.lit(None)).when(F.col("review_id") % 3 == 1, "").otherwise(F.concat(F.lit("since"), "review_id"))
    return rows.select("review_id", diff.resolve_from_sha(since, F.col("commit_sha")).alias("from_sha"))


def language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.documents(spark, sf_dir)
    path = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("src/."), F.lit("py"))).when(F.col("doc_id") % 11 == 1, F.concat("path", F.lit(".tsx"))).otherwise(F.col("path"))
    return rows.select("doc_id", path.alias("path"), boundaries.language(path).alias("language"))


def _heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.heuristic_ranges(fx.changed(spark, sf_dir), chunk.file_lines(fx.files(spark, sf_dir)))


def heuristic_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heuristic(spark, sf_dir)


def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.merge_ranges(_heuristic(spark, sf_dir))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.build_chunks(merge_ranges(spark, sf_dir), fx.files(spark, sf_dir), fx.BUDGET)


def build_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


def _sized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chunk.file_lines(fx.files(spark, sf_dir)).select("review_id", "path", "line_no", "n_lines", F.length("line").cast("long").alias("n_chars"))
    return fx.changed(spark, sf_dir).join(lines, ["review_id", "path", "line_no"])


def _enclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.enclosing_boundary(_sized_lines(spark, sf_dir), fx.boundaries(spark, sf_dir))


def module_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = boundaries.module_window(F.col("line_no"), F.col("n_lines"))
    return _enclosed(spark, sf_dir).filter("node_id IS NULL").select("review_id", "path", "line_no", low.alias("start_line"), high.alias("end_line"))


def enclosing_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enclosed(spark, sf_dir).select("review_id", "path", "line_no", "node_id", "start_line", "end_line")


def split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _enclosed(spark, sf_dir).filter("node_id IS NOT NULL").select("review_id", "path", "node_id", "start_line", "end_line").distinct()
    part = F.slice("lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    sized = placed.join(fx.files(spark, sf_dir), ["review_id", "path"]).withColumn("n_chars", F.aggregate(part, F.lit(-1).cast("long"), lambda a, x: a + F.length(x) + 1)).drop("lines", "is_readable")
    return boundaries.split_oversized(sized, fx.boundaries(spark, sf_dir), fx.changed(spark, sf_dir), fx.BUDGET)


def _for_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).withColumnRenamed("path", "file").withColumn("chunk_ord", F.col("file_seq") * 100000 + F.col("start_line"))


def dry_run_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = review.dry_run(_for_review(spark, sf_dir))
    return review.flatten(results).join(results.select("review_id", "chunk_ord", "chunk_id"), ["review_id", "chunk_ord"]).select("review_id", "chunk_id", "file", "line_start", "line_end", "severity", "category", "message", "code_snippet", "confidence")


def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _for_review(spark, sf_dir).select("review_id", "chunk_id", review.review_prompt().alias("prompt"))


def build_verify_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    looked = ground.with_context(fx.findings(spark, sf_dir), fx.files(spark, sf_dir)).filter("context IS NOT NULL")
    return _named(looked.withColumn("prompt", review.verify_prompt())).select(*_KEYS, "prompt")


def _damaged(found: DataFrame) -> DataFrame:
    """Some findings get values that break a rule."""
    k = (F.col("chunk_ord") * 13 + F.col("finding_ord") * 7) % 17
    return found.withColumns(
        {
            "line_start": F.when(k == 0, 0).otherwise(F.col("line_start")).cast("long"),
            "line_end": F.when(k == 1, 0).when(k == 2, F.lit(None)).otherwise(F.col("line_end")).cast("long"),
            "severity": F.when(k == 3, "fatal").otherwise(F.col("severity")),
            "category": F.when(k == 4, F.lit(None)).otherwise(F.col("category")),
            "message": F.when(k == 5, "").when(k == 6, F.repeat(F.lit("x"), 1001)).otherwise(F.col("message")),
            "code_snippet": F.when(k == 7, F.lit(None)).otherwise(F.col("code_snippet")),
            "confidence": F.when(k == 8, 1.5).when(k == 9, F.lit(float("nan"))).when(k == 10, -0.1).otherwise(F.col("confidence")),
        }
    )


def validate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _damaged(fx.findings(spark, sf_dir)).withColumn("v", violations())
    return _named(rows).select(*_KEYS, (F.size("v") == 0).alias("is_valid"), F.array_join("v", ",").alias("violations"))


def severity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(fx.findings(spark, sf_dir).filter(at_least(F.col("severity"), "warning"))).select(*_KEYS, "severity")


def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.ground(fx.findings(spark, sf_dir), fx.files(spark, sf_dir), fx.verdict)


def lines_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines around every changed line, through blocks of seven lines."""
    lines = fx.changed(spark, sf_dir).join(fx.files(spark, sf_dir).select("review_id", "path", F.size("lines").alias("n")), ["review_id", "path"])
    asked = lines.select("review_id", "path", F.greatest(F.lit(1), F.col("line_no") - 9).cast("long").alias("low"), F.least("n", F.col("line_no") + 9).cast("long").alias("high")).distinct()
    found = ground.lines_between(materialize(asked, "asked"), ground.file_blocks(fx.files(spark, sf_dir), 7), 7)
    return found.select("review_id", "path", "low", "high", F.array_join("lines", "\n").alias("context"))


def ground_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_grounded(spark, sf_dir)).select(*_KEYS, "file", "line_start", "confidence", "outcome", "reason")


def grounding_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.outcome_counts(_grounded(spark, sf_dir))


def _all_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, files = materialize(fx.findings(spark, sf_dir), "found"), fx.files(spark, sf_dir)  # each use would shuffle all texts
    new = ground.kept(ground.ground(fx.new_findings(found), files, fx.verdict))
    return carry.carry_forward(new, fx.prior_findings(found), files, fx.verdict)


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_all_found(spark, sf_dir)).select("review_id", F.col("origin").cast("long").alias("origin"), "conv_id", "turn", "file", "line_start", "confidence")


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = _for_review(spark, sf_dir).filter(F.col("review_id") % 7 != 6)
    failed = (F.col("chunk_ord") % 5 == 0).alias("is_failed")
    return chunks, review.dry_run(chunks).select("review_id", "chunk_ord", "chunk_id", "findings", failed)


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.review_counters(fx.reviews(spark, sf_dir), *_results(spark, sf_dir))


def review_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir)


def severity_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.severity_sections(_all_found(spark, sf_dir))


def render_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.render(_counted(spark, sf_dir), _all_found(spark, sf_dir))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _all_found(spark, sf_dir).withColumn("message", F.concat("message", F.lit(" --> é")))
    return summary.build_bodies(_counted(spark, sf_dir), found)


def state_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and commit that a rendered body gives back; bodies of every fifth review are damaged."""
    bodies = materialize(_bodies(spark, sf_dir), "bodies")
    damaged = bodies.withColumn("body", F.when(F.col("review_id") % 5 == 4, F.regexp_replace("body", r"findings:(.)", "findings:=$1")).otherwise(F.col("body")))
    back = summary.prior_findings(damaged).select("review_id", F.posexplode("findings").alias("position", "f"))
    shas = damaged.select("review_id", summary.last_reviewed_sha(F.col("body")).alias("commit_sha"))
    return back.join(shas, "review_id").select("review_id", "commit_sha", F.col("position").cast("long").alias("position"), *[F.col(f"f.{n}").alias(n) for n in FIELDS])


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three comments per review; the second and third are summaries, except in every fourth review."""
    rows = fx.reviews(spark, sf_dir).select("review_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("ord"))
    marked = F.concat(F.lit(f"text {summary.MARKER} no "), "ord")
    return rows.withColumn("body", F.when((F.col("ord") > 1) & (F.col("review_id") % 4 != 3), marked).otherwise("plain"))


def first_summary_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.first_summary_comment(_comments(spark, sf_dir))


def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = summary.first_summary_comment(_comments(spark, sf_dir))
    return summary.upsert_plan(current, summary.render(_counted(spark, sf_dir), _all_found(spark, sf_dir)).withColumnRenamed("text", "body")).select("review_id", "action", "ord", F.length("body").cast("long").alias("n_chars"))


def review_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the dry review: the first posts, the second sees an empty diff in every other review."""
    files = fx.files(spark, sf_dir)
    base = fx.reviews(spark, sf_dir).select("review_id", "pr_number", F.lit("base").alias("base_sha"), F.col("commit_sha").alias("head_sha"))
    diffs = fx.diffs(spark, sf_dir).withColumn("from_sha", F.lit("base"))
    first = review_changes(base, spark.createDataFrame([], "review_id long, ord long, body string"), diffs, files, min_severity="info", token_budget=fx.BUDGET)
    comments = materialize(summary.apply_upserts(spark.createDataFrame([], "review_id long, ord long, body string"), first.plan), "comments")
    again = base.withColumn("head_sha", F.md5(F.col("head_sha").cast("binary")))
    later = fx.diffs(spark, sf_dir).join(fx.reviews(spark, sf_dir), "review_id").select("review_id", F.col("commit_sha").alias("from_sha"), F.when(F.col("review_id") % 2 == 0, F.col("diff_text")).otherwise(" \n").alias("diff_text"))
    second = review_changes(again, comments, later, files, min_severity="info", token_budget=fx.BUDGET)
    n = second.findings.groupBy("review_id").agg(F.count(F.lit(1)).alias("n_findings"), F.sum("origin").cast("long").alias("n_carried"))
    out = second.results.join(n, "review_id", "left").join(second.plan.select("review_id", "action"), "review_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("review_id", "pr_number", "commit_sha", "chunks_reviewed", "chunks_skipped", zero("n_findings"), zero("n_carried"), "action")


def syntax_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of files in six languages that hold the driver's texts."""
    nodes = blocks.BlockSyntax().nodes(materialize(code.code_files(spark, sf_dir), "code")).filter("node_id > 0")
    return nodes.select("review_id", "path", "node_type", "start_line", "start_col", "end_line", (F.col("parent_id") > 0).alias("nested"))


def review_with_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry review of those files by their blocks, with a verifier."""
    files = materialize(code.code_files(spark, sf_dir), "code")
    reviews = files.select("review_id").distinct().select("review_id", F.lit(1).cast("long").alias("pr_number"), F.lit("base").alias("base_sha"), F.lit("head").alias("head_sha"))
    comments = spark.createDataFrame([], "review_id long, ord long, body string")
    diffs = code.code_diffs(files).withColumn("from_sha", F.lit("base"))
    made = review_changes(reviews, comments, diffs, files.drop("doc_id"), verifier=fx.verdict, provider=blocks.BlockSyntax(), min_severity="info", token_budget=fx.BUDGET)
    outcome = made.grounded.select("review_id", "chunk_ord", F.coalesce("reason", "outcome").alias("outcome"))
    chunks = made.chunks.join(outcome, ["review_id", "chunk_ord"])
    return chunks.select("review_id", "path", "start_line", "end_line", "is_partial", F.length("content").cast("long").alias("n_chars"), "outcome")


def python_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax nodes of generated Python files."""
    docs = fx.documents(spark, sf_dir)
    code = F.array(F.concat(F.lit("class A"), "doc_id", F.lit(":")), F.lit("    def f(self):"), F.lit("        return 1"), F.lit(""), F.lit("x = 1"))
    return boundaries.PythonSyntax().nodes(docs.filter("path LIKE '%.py'").select("review_id", "path", code.alias("lines"))).filter("node_type LIKE '%definition'")


def live_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live reviewer and verifier over a scripted transport that refuses some chunks."""
    results = materialize(review.live_review(_for_review(spark, sf_dir), fx.ScriptedTransport, sleep=_no_wait), "live-results")
    found = ground.ground(review.flatten(results), fx.files(spark, sf_dir), lambda df: review.live_verify(df, fx.ScriptedTransport, sleep=_no_wait))
    n = found.groupBy("review_id", "chunk_ord").agg(F.count_if(F.col("outcome") == "grounded").alias("n_grounded"), F.count_if(F.col("reason") == "verifier_rejected").alias("n_rejected"))
    joined = results.join(n, ["review_id", "chunk_ord"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("review_id", "chunk_id", "is_failed", F.size("findings").cast("long").alias("n_findings"), zero("n_grounded"), zero("n_rejected"))


def _no_wait(seconds: float) -> None:
    """The scripted transport needs no delay between attempts."""


class _Closed:
    """A transport that answers nothing."""

    def complete(self, *_: object) -> str:
        raise review.RateLimited


def review_from_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live review again, from the replies that a first run left: half of them folded into a table, half in files."""
    kept, chunks = ledger.Ledger(scratch_path(spark, "ledger"), "scripted"), _for_review(spark, sf_dir)
    for half in (0, 1):
        materialize(review.live_review(chunks.filter(F.col("chunk_ord") % 2 == half), fx.ScriptedTransport, sleep=_no_wait, ledger=kept), "first-run")
        if half == 0:
            kept.compact(spark)
    again = review.live_review(chunks, _Closed, sleep=_no_wait, ledger=kept)
    return again.select("review_id", "chunk_id", "is_failed", F.size("findings").cast("long").alias("n_findings"))


def posted_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments of a folder after two writes of the same summaries."""
    path = scratch_path(spark, "comments")
    summaries = materialize(summary.render(_counted(spark, sf_dir), _all_found(spark, sf_dir)).withColumnRenamed("text", "body"), "summaries")
    for rows in (_comments(spark, sf_dir).filter("ord < 3"), summaries, summaries):
        comments.write_comments(rows, "quillet.sources.comments:FolderComments", path=path)
    return comments.read_folder(spark, path)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each review's findings as a stored result, one file each; some lack their number, some have no findings."""
    path = scratch_path(spark, "results")
    found = fx.findings(spark, sf_dir).withColumn("confidence", ((F.col("chunk_ord") * 37 + F.col("finding_ord") * 11) % 1001).cast("double") / F.lit(1000.0))
    rows = fx.reviews(spark, sf_dir).join(summary.finding_arrays(found.filter("review_id % 7 <> 5")), "review_id", "left")
    number = F.when(F.col("review_id") % 7 != 3, F.col("pr_number"))
    text = F.to_json(F.struct(number.alias("pr_number"), "commit_sha", F.coalesce("findings", F.array().cast(T.ArrayType(FINDING))).alias("findings")))
    rows.select(F.col("review_id").alias("of"), text.alias("value")).repartition("of").write.partitionBy("of").text(path)
    return read_results(spark, path).withColumn("review_id", F.regexp_extract("path", r"/of=(\d+)/", 1).cast("long"))


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).select("review_id", "pr_number", "commit_sha", "chunks_reviewed", "chunks_skipped", F.size("findings").cast("long").alias("n"), "is_valid")


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _stored(spark, sf_dir)
    return report.stored_reports(results, "warning").join(results.select("path", "review_id"), "path").drop("path")


def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_reports(_counted(spark, sf_dir), _all_found(spark, sf_dir))


def dry_run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files through the dry run."""
    source = materialize(review.dry_run_source(fx.files(spark, sf_dir)), "sources")
    made = review.dry_run(source).select("review_id", "chunk_id", F.explode("findings").alias("f"))
    found = made.select("review_id", "chunk_id", F.col("f.file").alias("file"), F.col("f.line_start").alias("line_start"), F.col("f.message").alias("message"), F.col("f.code_snippet").alias("code_snippet"))
    return found.join(source.select("review_id", "file", "end_line", F.length("content").cast("long").alias("n_chars")), ["review_id", "file"])


def lax_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as JSON arrays of two, with values that are read leniently and values that aren't."""
    found = fx.findings(spark, sf_dir)
    k = (F.col("chunk_ord") * 13 + F.col("finding_ord") * 7) % 11
    start = F.when(k == 0, F.concat(F.lit('"'), "line_start", F.lit('"'))).when(k == 1, F.concat("line_start", F.lit(".0"))).when(k == 2, F.concat("line_start", F.lit(".5"))).when(k == 3, "true").otherwise(F.col("line_start").cast("string"))
    file = F.when(k == 4, "7").otherwise(F.to_json(F.struct("file")).substr(F.lit(9), F.length(F.to_json(F.struct("file"))) - 9))
    confidence = F.when(k == 5, '"0.25"').when(k == 6, '"much"').otherwise("0.5")
    fix = F.when(k == 7, ', "suggested_fix": null').when(k == 8, ', "suggested_fix": 3').otherwise("")
    one = F.concat(F.lit('{"file": '), file, F.lit(', "line_start": '), start, F.lit(', "line_end": 99, "severity": "info", "category": "bug", "message": "m", "code_snippet": "", "confidence": '), confidence, fix, F.lit("}"))
    text = F.when(k == 9, F.concat(F.lit("["), one)).otherwise(F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]")))
    keys = ["review_id", "chunk_ord", "finding_ord"]
    back = decode_findings(found.select(*keys, text.alias("j")), "j", keys)
    first = F.get("findings", F.lit(0))
    return _named(back).select(*_KEYS, "readable", F.size("findings").cast("long").alias("n"), first["line_start"].alias("line_start"), first["confidence"].alias("confidence"))


QUERIES: dict[str, Query] = {
    "split_lines": split_lines_query,
    "diff_changed_lines": diff_changed_lines,
    "diff_changed_lines_sliced": diff_changed_lines_sliced,
    "diff_file_groups": diff_file_groups,
    "resolve_from_sha": resolve_from_sha,
    "language_lookup": language_lookup,
    "heuristic_ranges": heuristic_ranges,
    "merge_ranges": merge_ranges,
    "token_estimate": token_estimates,
    "build_chunks": build_chunks,
    "module_window": module_window,
    "enclosing_boundary": enclosing_boundary,
    "split_oversized": split_oversized,
    "dry_run_review": dry_run_review,
    "build_prompt": build_prompt,
    "build_verify_prompt": build_verify_prompt,
    "validate_findings": validate_findings,
    "severity_filter": severity_filter,
    "lines_by_block": lines_by_block,
    "ground_findings": ground_findings,
    "grounding_outcome_counts": grounding_outcome_counts,
    "carry_forward": carry_forward,
    "review_counters": review_counters,
    "severity_sections": severity_sections,
    "render_summary": render_summary,
    "state_roundtrip": state_roundtrip,
    "first_summary_comment": first_summary_comment,
    "upsert_plan": upsert_plan,
    "review_end_to_end": review_end_to_end,
    "live_review": live_review,
    "review_from_ledger": review_from_ledger,
    "posted_comments": posted_comments,
    "stored_results": stored_results,
    "stored_reports": stored_reports,
    "run_reports": run_reports,
    "dry_run_files": dry_run_files,
    "lax_decode": lax_decode,
    "python_boundaries": python_boundaries,
    "syntax_nodes": syntax_nodes,
    "review_with_syntax": review_with_syntax,
}
