"""Review inputs derived from the driver's tables by integer rules.

Every rule stands twice: as DataFrame expressions here, and as SQL in CTES for
the checks against another engine.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions.findings import CATEGORIES, SEVERITIES
from quillet.operators.review import RateLimited

BUDGET = 100
DOCS_PER_REVIEW = 50

PATH = """concat('src/', source, '/f', doc_id, CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.txt' WHEN 3 THEN '.go' WHEN 4 THEN '.PY' ELSE '.md' END)"""
CHANGED = "(doc_id * 17 + line_no) % 7 < 3"

CTES = f"""
d AS (SELECT doc_id, doc_id // {DOCS_PER_REVIEW} AS review_id, doc_id % {DOCS_PER_REVIEW} + 1 AS file_seq, {PATH} AS path, string_split(text, chr(10)) AS arr FROM documents),
l AS (
  SELECT doc_id, review_id, file_seq, path, i AS line_no, CASE WHEN (doc_id * 31 + i * i * 7) % 5 = 0 THEN '' ELSE arr[i] END AS line, CAST(len(arr) AS BIGINT) AS n_lines
  FROM (SELECT *, unnest(range(1, CAST(len(arr) + 1 AS BIGINT))) AS i FROM d)
),
c AS (SELECT * FROM l WHERE {CHANGED}),
dl AS (
  SELECT review_id, (doc_id * 100000 + 0) * 4 + 0 AS ord, '--- a/' || path AS line FROM d
  UNION ALL SELECT review_id, (doc_id * 100000) * 4 + 1, CASE WHEN doc_id % 13 = 0 THEN '+++ /dev/null' ELSE '+++ b/' || path END FROM d
  UNION ALL SELECT review_id, (doc_id * 100000) * 4 + 2, '@@ -1,9 +1,9 @@ ctx' FROM d
  UNION ALL SELECT review_id, (doc_id * 100000 + line_no) * 4, '-removed' FROM l WHERE (doc_id * 5 + line_no * 3) % 7 = 0
  UNION ALL SELECT review_id, (doc_id * 100000 + line_no) * 4 + 1, (CASE WHEN {CHANGED} THEN '+' ELSE ' ' END) || line FROM l
),
around AS (
  SELECT *, coalesce(max(CASE WHEN trim(line) = '' THEN line_no END) OVER (PARTITION BY review_id, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start_line,
    coalesce(min(CASE WHEN trim(line) = '' THEN line_no END) OVER (PARTITION BY review_id, path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_lines + 1) - 1 AS end_line
  FROM l
),
h AS (SELECT review_id, file_seq, path, line_no, start_line, end_line FROM around WHERE {CHANGED}),
m0 AS (SELECT *, max(end_line) OVER (PARTITION BY review_id, file_seq, path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY review_id, file_seq, path ORDER BY start_line, end_line) AS island FROM m0),
merged AS (SELECT review_id, file_seq, path, min(start_line) AS start_line, max(end_line) AS end_line FROM m1 GROUP BY review_id, file_seq, path, island),
body AS (
  SELECT r.review_id, r.file_seq, r.path, r.start_line, r.end_line, l.line_no, l.line,
    sum(length(l.line) + 1) OVER (PARTITION BY r.review_id, r.file_seq, r.path, r.start_line ORDER BY l.line_no ROWS UNBOUNDED PRECEDING) AS upto,
    sum(length(l.line) + 1) OVER (PARTITION BY r.review_id, r.file_seq, r.path, r.start_line) - 1 AS chars
  FROM merged r JOIN l ON r.review_id = l.review_id AND r.path = l.path AND l.line_no BETWEEN r.start_line AND r.end_line
),
chunks AS (
  SELECT review_id, file_seq, path, path || ':' || start_line || '-' || end_line AS chunk_id, start_line, end_line,
    coalesce(string_agg(CASE WHEN greatest(1, chars // 4) <= {BUDGET} OR upto <= {BUDGET * 4} THEN line END, chr(10) ORDER BY line_no), '') AS content,
    bool_or(greatest(1, chars // 4) > {BUDGET}) AS is_partial
  FROM body GROUP BY review_id, file_seq, path, start_line, end_line
),
top AS (SELECT max(doc_id) AS m FROM documents),
f0 AS (
  SELECT conv_id, turn, (conv_id * 5 + turn * 3) % 10 = 3 AS gone, (conv_id * 7 + turn * 3) % (m + 1) AS doc_id,
    1 + (conv_id * 5 + turn) % 12 AS line_start, 1 + (conv_id * 5 + turn) % 12 + turn % 3 AS line_end, 1 + (conv_id + 2 * turn) % 4 AS sev, 1 + (conv_id * 3 + turn) % 7 AS cat,
    CAST((conv_id * 37 + turn * 11) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, text AS said
  FROM conversations, top
),
f AS (
  SELECT f0.*, d.review_id, CASE WHEN gone THEN 'src/gone/f' || f0.doc_id || '.py' ELSE d.path END AS file,
    list_extract(['info', 'suggestion', 'warning', 'critical'], sev) AS severity,
    list_extract(['bug', 'security', 'performance', 'readability', 'design', 'test_coverage', 'style'], cat) AS category,
    CASE WHEN (conv_id + turn) % 3 = 0 THEN coalesce((SELECT substr(l.line, 1, 40) FROM l WHERE l.doc_id = f0.doc_id AND l.line_no = f0.line_start), '') WHEN (conv_id + turn) % 3 = 1 THEN 'text that is absent' ELSE '' END AS code_snippet,
    substr(said, 1, 80) AS message, CASE WHEN turn % 2 = 0 THEN 'change line ' || line_start END AS suggested_fix
  FROM f0 JOIN d ON d.doc_id = f0.doc_id
),
g0 AS (
  SELECT f.*, x.path IS NOT NULL AS found, f.doc_id % 29 <> 7 AS is_readable, x.n_lines,
    (SELECT string_agg(l.line, chr(10) ORDER BY l.line_no) FROM l WHERE l.doc_id = f.doc_id AND l.line_no BETWEEN f.line_start - 2 AND greatest(f.line_start, f.line_end) + 2) AS context
  FROM f LEFT JOIN (SELECT DISTINCT review_id, path, n_lines FROM l) x ON x.review_id = f.review_id AND x.path = f.file
),
g1 AS (
  SELECT *, CASE WHEN NOT found THEN 'file_not_found' WHEN NOT is_readable THEN 'file_unreadable' WHEN line_start > n_lines THEN 'line_out_of_range'
    WHEN NOT contains(trim(regexp_replace(context, '\\s+', ' ', 'g')), trim(regexp_replace(code_snippet, '\\s+', ' ', 'g'))) THEN 'snippet_mismatch'
    WHEN (conv_id + turn) % 7 = 0 THEN 'verifier_rejected' ELSE 'matched' END AS state FROM g0
),
g AS (
  SELECT review_id, conv_id, turn, file, line_start, line_end, severity, category, message, suggested_fix, code_snippet,
    CASE WHEN state = 'snippet_mismatch' THEN confidence * 0.5 ELSE confidence END AS confidence,
    CASE state WHEN 'matched' THEN 'grounded' WHEN 'snippet_mismatch' THEN 'downweighted' ELSE 'dropped' END AS outcome,
    CASE WHEN state NOT IN ('matched', 'snippet_mismatch') THEN state END AS reason
  FROM g1
),
newer AS (SELECT * FROM g WHERE outcome <> 'dropped' AND (conv_id * 3 + turn) % 4 <> 0),
older AS (SELECT * FROM g WHERE outcome <> 'dropped' AND (conv_id * 3 + turn) % 4 < 2 AND review_id % 3 <> 2),
all_found AS (
  SELECT 0 AS origin, * FROM newer
  UNION ALL SELECT 1, * FROM older o WHERE NOT EXISTS (SELECT 1 FROM newer n WHERE n.review_id = o.review_id AND n.file = o.file AND n.line_start = o.line_start)
),
reviews AS (SELECT DISTINCT review_id, 1000 + review_id AS pr_number, md5(CAST(review_id AS VARCHAR)) AS commit_sha FROM d)
"""


def sql(select: str) -> str:
    return f"WITH {CTES.strip()}\n{select}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    arr = F.split("text", "\n")
    lines = F.transform(arr, lambda x, i: F.when((F.col("doc_id") * 31 + (i + 1) * (i + 1) * 7) % 5 == 0, "").otherwise(x))
    return docs.select("doc_id", F.expr(f"doc_id div {DOCS_PER_REVIEW}").alias("review_id"), (F.col("doc_id") % DOCS_PER_REVIEW + 1).alias("file_seq"), F.expr(PATH).alias("path"), lines.alias("lines"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("review_id", "path", "lines", (F.col("doc_id") % 29 != 7).alias("is_readable"))


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "review_id", "file_seq", "path", F.size("lines").cast("long").alias("n_lines"), F.posexplode("lines").alias("p", "line"))
    return rows.withColumn("line_no", (F.col("p") + 1).cast("long")).drop("p")


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``review_id, file_seq, path, line_no`` by rule, as a parsed diff would have them."""
    return _line_rows(spark, sf_dir).filter(CHANGED).select("review_id", "file_seq", "path", "line_no")


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``review_id, diff_text``: one diff of the files of a review."""
    docs = documents(spark, sf_dir)
    body = F.flatten(
        F.transform(
            "lines",
            lambda x, i: F.concat(
                F.when((F.col("doc_id") * 5 + (i + 1) * 3) % 7 == 0, F.array(F.lit("-removed"))).otherwise(F.array().cast("array<string>")),
                F.array(F.concat(F.when((F.col("doc_id") * 17 + i + 1) % 7 < 3, "+").otherwise(" "), x)),
            ),
        )
    )
    target = F.when(F.col("doc_id") % 13 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), "path"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("--- a/"), "path"), target, F.lit("@@ -1,9 +1,9 @@ ctx")), body), "\n")
    parts = docs.select("review_id", F.struct("doc_id", text.alias("t")).alias("x")).groupBy("review_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # DOCS_PER_REVIEW files at most
    return parts.select("review_id", F.array_join(F.transform("xs", lambda x: x["t"]), "\n").alias("diff_text"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = documents(spark, sf_dir).select("review_id").distinct()
    return ids.select("review_id", (F.col("review_id") + 1000).alias("pr_number"), F.md5(F.col("review_id").cast("string").cast("binary")).alias("commit_sha"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their keys, the verdict of a stand-in verifier and the fields."""
    docs = documents(spark, sf_dir)
    top = docs.agg(F.max("doc_id")).first()[0]
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    c, t = F.col("conv_id"), F.col("turn")
    rows = conv.select(
        "conv_id", "turn", ((c * 5 + t * 3) % 10 == 3).alias("gone"), ((c * 7 + t * 3) % (top + 1)).alias("doc_id"), (1 + (c * 5 + t) % 12).cast("long").alias("line_start"),
        (1 + (c * 5 + t) % 12 + t % 3).cast("long").alias("line_end"), (1 + (c + 2 * t) % 4).cast("int").alias("sev"), (1 + (c * 3 + t) % 7).cast("int").alias("cat"),
        (((c * 37 + t * 11) % 101).cast("double") / F.lit(100.0)).alias("confidence"), F.substring("text", 1, 80).alias("message"),
    )
    joined = rows.join(docs.select("doc_id", "review_id", "path", "lines"), "doc_id")
    stated = F.coalesce(F.substring(F.get("lines", (F.col("line_start") - 1).cast("int")), 1, 40), F.lit(""))
    snippet = F.when((c + t) % 3 == 0, stated).when((c + t) % 3 == 1, "text that is absent").otherwise("")
    return joined.select(
        "review_id", F.lit(0).alias("origin"), c.alias("chunk_ord"), t.cast("long").alias("finding_ord"),
        F.when(F.col("gone"), F.concat(F.lit("src/gone/f"), "doc_id", F.lit(".py"))).otherwise(F.col("path")).alias("file"), "line_start", "line_end",
        F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("sev")).alias("severity"), F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("cat")).alias("category"), "message",
        F.when(t % 2 == 0, F.concat(F.lit("change line "), "line_start")).alias("suggested_fix"), snippet.alias("code_snippet"), "confidence",
    )


def verdict(matched: DataFrame) -> DataFrame:
    """A stand-in verifier."""
    return matched.withColumn("is_valid", (F.col("chunk_ord") + F.col("finding_ord")) % 7 != 0)


def new_findings(found: DataFrame) -> DataFrame:
    return found.filter((F.col("chunk_ord") * 3 + F.col("finding_ord")) % 4 != 0)


def prior_findings(found: DataFrame) -> DataFrame:
    """Findings of an earlier run; every third review has no reviewed commit."""
    rows = found.filter((F.col("chunk_ord") * 3 + F.col("finding_ord")) % 4 < 2)
    return rows.withColumn("since_sha", F.when(F.col("review_id") % 3 != 2, F.md5(F.col("review_id").cast("string").cast("binary"))))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested nodes: a class over the whole file (3 of 4 files), functions of four lines in each five, blocks that are no boundary."""
    docs = documents(spark, sf_dir).select("doc_id", "review_id", "path", F.size("lines").cast("long").alias("n"))
    lit = lambda x: F.lit(x).cast("long")
    node = lambda i, parent, kind, a, b: F.struct(i.alias("node_id"), parent.alias("parent_id"), kind.alias("node_type"), a.alias("start_line"), lit(0).alias("start_col"), b.alias("end_line"), lit(1_000_000).alias("end_col"))
    top = node(lit(1), F.lit(None).cast("long"), F.when(F.col("doc_id") % 4 != 3, "class_definition").otherwise("module"), lit(1), F.col("n"))
    each = F.transform(F.sequence(lit(0), F.expr("n div 5")), lambda k: node(10 + 2 * k, lit(1), F.when((F.col("doc_id") + k) % 3 != 0, "function_definition").otherwise("block"), 5 * k + 1, F.least(5 * k + 4, F.col("n"))))
    return docs.select("review_id", "path", F.explode(F.filter(F.concat(F.array(top), each), lambda x: x["start_line"] <= x["end_line"])).alias("x")).select("review_id", "path", "x.*")


BOUNDARY_CTES = """
, b AS (
  SELECT doc_id, review_id, path, CAST(1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, CASE WHEN doc_id % 4 <> 3 THEN 'class_definition' ELSE 'module' END AS node_type, CAST(1 AS BIGINT) AS start_line, CAST(len(arr) AS BIGINT) AS end_line FROM d
  UNION ALL
  SELECT doc_id, review_id, path, 10 + 2 * k, 1, CASE WHEN (doc_id + k) % 3 <> 0 THEN 'function_definition' ELSE 'block' END, 5 * k + 1, least(5 * k + 4, n)
  FROM (SELECT *, CAST(len(arr) AS BIGINT) AS n, unnest(range(0, CAST(len(arr) // 5 + 1 AS BIGINT))) AS k FROM d) WHERE 5 * k + 1 <= n
),
lang AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 3 THEN 'go' END AS language FROM b),
units AS (SELECT * FROM lang WHERE (language = 'python' AND node_type IN ('function_definition', 'class_definition')) OR (language IS NULL AND node_type IN ('function_definition', 'class_definition'))),
enclosed AS (
  SELECT c.doc_id, c.review_id, c.file_seq, c.path, c.line_no, c.n_lines, u.node_id, u.start_line, u.end_line FROM c LEFT JOIN units u ON u.doc_id = c.doc_id AND c.line_no BETWEEN u.start_line AND u.end_line
  QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.line_no ORDER BY u.end_line - u.start_line, u.start_line DESC, u.node_id DESC) = 1
)
"""


class ScriptedTransport:
    """A reviewer without a model: one finding per chunk, except for chunks it always refuses."""

    def complete(self, system: str, prompt: str, max_tokens: int, schema: dict | None, timeout: float) -> str:
        file, lines = (x.split(": ", 1)[-1].removeprefix("Lines ") for x in prompt.split("\n")[:2])
        start = int(lines.split("-")[0])
        if schema is None:
            return json.dumps({"is_valid": start % 3 != 0})
        if start % 5 == 0:
            raise RateLimited
        found = {"file": file, "line_start": str(start), "line_end": float(start), "severity": "warning", "category": "bug", "message": f"line {start}", "code_snippet": "", "confidence": "0.5", "extra": 1}
        return json.dumps({"chunk_id": "", "findings": [found] * (start % 2 + 1)})
