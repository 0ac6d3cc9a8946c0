"""Source files in six languages around the lines of the driver's texts, and the SQL of the same rule.

Every line of a text makes a function of four lines: its header, the text in a
comment, the text in a string, and its end. Comments and strings hold the signs
that begin and end blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.plans.fixtures import DOCS_PER_REVIEW


@dataclass(frozen=True)
class Shape:
    """How a language's file looks; ``{i}`` is the function's number, ``{t}`` the text."""

    suffix: str
    top: str
    head: str
    comment: str
    string: str
    end: str
    bottom: str
    node_type: str


SHAPES = (
    Shape("py", "# top", "def f{i}(a):", "    # def {t}", '    s("class A: {t}")', "", "# bottom", "function_definition"),
    Shape("js", "// top", "function f{i}(a) {", "  // { {t}", '  s("} {t}");', "}", "// bottom", "function_declaration"),
    Shape("go", "// top", "func f{i}(a int) {", "\t// } {t}", '\ts("{ {t}")', "}", "// bottom", "function_declaration"),
    Shape("rs", "// top", "fn f{i}(a: i32) {", "    /* } {t} */", '    s("{{ {t}");', "}", "// bottom", "function_item"),
    Shape("java", "class A {", "  int f{i}(int a) {", "    // } {t}", '    s("{ {t}");', "  }", "}", "method_declaration"),
    Shape("rb", "# top", "def f{i}(a)", "  # end {t}", '  s("end {t}")', "end", "# bottom", "method"),
)
CHANGED = "(doc_id * 17 + line_no) % 7 < 2"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, review_id, path, lines, is_readable``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n").alias("arr"))
    k = (F.col("doc_id") % len(SHAPES)).cast("int")
    pick = lambda name: F.get(F.array(*[F.lit(getattr(s, name)) for s in SHAPES]), k)
    plain = lambda t: F.replace(F.replace(F.replace(t, F.lit("*/"), F.lit("")), F.lit('"'), F.lit("")), F.lit("\\"), F.lit(""))
    put = lambda name, t, i: F.replace(F.replace(pick(name), F.lit("{t}"), plain(t)), F.lit("{i}"), (i + 1).cast("string"))
    body = F.flatten(F.transform("arr", lambda t, i: F.array(put("head", F.lit(""), i), F.replace(pick("comment"), F.lit("{t}"), plain(t)), F.replace(pick("string"), F.lit("{t}"), plain(t)), pick("end"))))
    path = F.concat(F.lit("src/c"), "doc_id", F.lit("."), pick("suffix"))
    lines = F.concat(F.array(pick("top")), body, F.array(pick("bottom")))
    return docs.select("doc_id", F.expr(f"doc_id div {DOCS_PER_REVIEW}").alias("review_id"), path.alias("path"), lines.alias("lines"), F.lit(True).alias("is_readable"))


def code_diffs(files: DataFrame) -> DataFrame:
    """``review_id, diff_text``: the files of a review with the lines that changed by rule."""
    body = F.transform("lines", lambda x, i: F.concat(F.when((F.col("doc_id") * 17 + i + 1) % 7 < 2, "+").otherwise(" "), x))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path"), F.lit("@@ -1,9 +1,9 @@")), body), "\n")
    parts = files.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", text.alias("t")))).alias("xs"))  # DOCS_PER_REVIEW files at most
    return parts.select("review_id", F.array_join(F.transform("xs", lambda x: x["t"]), "\n").alias("diff_text"))


def _case(name: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{getattr(s, name)}'" for i, s in enumerate(SHAPES))
    return f"CASE doc_id % {len(SHAPES)} {whens} END"


CODE_CTES = f"""
cd AS (SELECT doc_id, doc_id // {DOCS_PER_REVIEW} AS review_id, doc_id % {DOCS_PER_REVIEW} + 1 AS file_seq, 'src/c' || doc_id || '.' || {_case('suffix')} AS path, doc_id % {len(SHAPES)} AS k, string_split(text, chr(10)) AS arr, CAST(4 * len(arr) + 2 AS BIGINT) AS n_lines FROM documents),
cf AS (SELECT *, translate(replace(arr[i], '*/', ''), '"\\', '') AS t FROM (SELECT *, unnest(range(1, CAST(len(arr) + 1 AS BIGINT))) AS i FROM cd)),
cl AS (
  SELECT doc_id, review_id, file_seq, path, k, n_lines, CAST(1 AS BIGINT) AS line_no, {_case('top')} AS line FROM cd
  UNION ALL SELECT doc_id, review_id, file_seq, path, k, n_lines, 4 * i - 2, replace({_case('head')}, '{{i}}', CAST(i AS VARCHAR)) FROM cf
  UNION ALL SELECT doc_id, review_id, file_seq, path, k, n_lines, 4 * i - 1, replace({_case('comment')}, '{{t}}', t) FROM cf
  UNION ALL SELECT doc_id, review_id, file_seq, path, k, n_lines, 4 * i, replace({_case('string')}, '{{t}}', t) FROM cf
  UNION ALL SELECT doc_id, review_id, file_seq, path, k, n_lines, 4 * i + 1, {_case('end')} FROM cf
  UNION ALL SELECT doc_id, review_id, file_seq, path, k, n_lines, n_lines, {_case('bottom')} FROM cd
),
cn AS (
  SELECT doc_id, review_id, file_seq, path, k, {_case('node_type')} AS node_type, 4 * i - 2 AS start_line, CASE k WHEN 4 THEN 2 ELSE 0 END AS start_col, CASE k WHEN 0 THEN 4 * i ELSE 4 * i + 1 END AS end_line, k = 4 AS nested FROM cf
  UNION ALL SELECT doc_id, review_id, file_seq, path, k, 'class_declaration', 1, 0, n_lines, false FROM cd WHERE k = 4
)
"""

SYNTAX_NODES = f"WITH {CODE_CTES.strip()}\nSELECT review_id, path, node_type, start_line, CAST(start_col AS BIGINT) AS start_col, end_line, nested FROM cn"


def with_syntax_sql(budget: int) -> str:
    """Chunks by syntax and what becomes of the dry run's finding of each."""
    return f"""WITH {CODE_CTES.strip()},
ch AS (SELECT * FROM cl WHERE {CHANGED}),
size AS (SELECT doc_id, sum(length(line) + 1) - 1 AS chars FROM cl GROUP BY doc_id),
placed AS (
  SELECT ch.*, CASE WHEN k = 4 AND (line_no IN (1, ch.n_lines) OR line_no % 4 = 2) THEN 'class' WHEN line_no IN (1, ch.n_lines) OR (k = 0 AND line_no % 4 = 1) THEN 'loose' ELSE 'own' END AS how, (line_no + 2) // 4 AS i FROM ch
),
big AS (SELECT DISTINCT p.doc_id FROM placed p JOIN size ON size.doc_id = p.doc_id WHERE how = 'class' AND chars // 4 > {budget}),
methods AS (SELECT DISTINCT ch.doc_id, (line_no + 2) // 4 AS i FROM ch JOIN big ON big.doc_id = ch.doc_id WHERE line_no NOT IN (1, ch.n_lines)),
ranges AS (
  SELECT doc_id, review_id, file_seq, path, 4 * i - 2 AS a, CASE k WHEN 0 THEN 4 * i ELSE 4 * i + 1 END AS b FROM placed WHERE how = 'own'
  UNION ALL SELECT doc_id, review_id, file_seq, path, greatest(1, line_no - 10), least(n_lines, line_no + 10) FROM placed WHERE how = 'loose'
  UNION ALL SELECT DISTINCT doc_id, review_id, file_seq, path, 1, n_lines FROM placed WHERE how = 'class' AND doc_id NOT IN (SELECT doc_id FROM methods)
  UNION ALL SELECT m.doc_id, review_id, file_seq, path, 4 * i - 2, 4 * i + 1 FROM methods m JOIN cd ON cd.doc_id = m.doc_id
),
r0 AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges),
r1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b) AS island FROM r0),
islands AS (SELECT doc_id, review_id, file_seq, path, min(a) AS start_line, max(b) AS end_line FROM r1 GROUP BY doc_id, review_id, file_seq, path, island),
bodies AS (
  SELECT x.*, length(line) + 1 AS n, sum(length(line) + 1) OVER (PARTITION BY x.doc_id, x.start_line ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS upto
  FROM islands x JOIN cl ON cl.doc_id = x.doc_id AND cl.line_no BETWEEN x.start_line AND x.end_line
),
made AS (
  SELECT review_id, file_seq, path, start_line, end_line, (sum(n) - 1) // 4 > {budget} AS is_partial,
    CASE WHEN (sum(n) - 1) // 4 > {budget} THEN greatest(0, coalesce(sum(CASE WHEN upto <= {budget * 4} THEN n END), 0) - 1) ELSE sum(n) - 1 END AS n_chars
  FROM bodies GROUP BY review_id, file_seq, path, start_line, end_line
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY file_seq, start_line) AS chunk_ord FROM made)
SELECT review_id, path, start_line, end_line, is_partial, CAST(n_chars AS BIGINT) AS n_chars, CASE WHEN chunk_ord % 7 = 0 THEN 'verifier_rejected' ELSE 'grounded' END AS outcome FROM numbered"""
