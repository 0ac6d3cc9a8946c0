"""SQL for the review queries, over the same derived fixtures."""

from __future__ import annotations

from quillet.operators.report import BROKEN
from quillet.operators.review import DRY_RUN_MESSAGE, PARTIAL_NOTE, REVIEW_REQUEST, VERIFY_REQUEST
from quillet.operators.summary import HEADING, MARKER, NOTHING
from quillet.plans.code_fixtures import SYNTAX_NODES, with_syntax_sql
from quillet.plans.fixtures import BOUNDARY_CTES, BUDGET, CTES, sql

_NL = "chr(10)"


def _q(text: str) -> str:
    """A text as an SQL expression."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def _with(more: str, select: str) -> str:
    return f"WITH {CTES.strip()}\n{more.strip()}\n{select}"


_COUNTED = """
, tried AS (SELECT * FROM chunks WHERE review_id % 7 <> 6),
counted AS (
  SELECT r.review_id, r.pr_number, r.commit_sha, coalesce(n, 0) AS chunks_reviewed, coalesce(s, 0) AS chunks_skipped FROM reviews r
  LEFT JOIN (SELECT review_id, count(*) AS n, CAST(sum(CAST(is_partial AS INT) + CAST((file_seq * 100000 + start_line) % 5 = 0 AS INT)) AS BIGINT) AS s FROM tried GROUP BY review_id) x ON x.review_id = r.review_id
)"""
_TITLES = "upper(substr(severity, 1, 1)) || substr(severity, 2)"
_BULLET = f"""'- **' || file || ':' || line_start || '** — ' || message || CASE WHEN coalesce(suggested_fix, '') <> '' THEN {_NL} || '  - suggested fix: `' || suggested_fix || '`' ELSE '' END"""
_SECTIONS = f"""
, sections AS (
  SELECT review_id, severity, count(*) AS n, '### ' || {_TITLES} || ' (' || count(*) || ')' || {_NL} || string_agg({_BULLET}, {_NL} ORDER BY origin, conv_id, turn) || {_NL} AS section
  FROM all_found GROUP BY review_id, severity
)"""
_RENDERED = f"""
, rendered AS (
  SELECT c.review_id, {_q(MARKER)} || {_NL} || {_NL} || {_q(HEADING)} || {_NL} || {_NL} || coalesce(s, {_q(NOTHING)}) || {_NL}
    || 'Findings: ' || coalesce(n, 0) || '; regions looked at: ' || chunks_reviewed || CASE WHEN chunks_skipped > 0 THEN '; cut short or failed: ' || chunks_skipped ELSE '' END AS text
  FROM counted c LEFT JOIN (
    SELECT review_id, sum(n) AS n, string_agg(section, {_NL} ORDER BY list_position(['critical', 'warning', 'suggestion', 'info'], severity)) AS s FROM sections GROUP BY review_id
  ) x ON x.review_id = c.review_id
)"""

_DAMAGED = """
, k AS (SELECT *, (conv_id * 13 + turn * 7) % 17 AS k FROM f),
damaged AS (
  SELECT review_id, conv_id, turn, file, CASE WHEN k = 0 THEN 0 ELSE line_start END AS line_start, CASE WHEN k = 1 THEN 0 WHEN k = 2 THEN NULL ELSE line_end END AS line_end,
    CASE WHEN k = 3 THEN 'fatal' ELSE severity END AS severity, CASE WHEN k = 4 THEN NULL ELSE category END AS category,
    CASE WHEN k = 5 THEN '' WHEN k = 6 THEN repeat('x', 1001) ELSE message END AS message, CASE WHEN k = 7 THEN NULL ELSE code_snippet END AS code_snippet,
    CASE WHEN k = 8 THEN 1.5 WHEN k = 9 THEN CAST('nan' AS DOUBLE) WHEN k = 10 THEN -0.1 ELSE confidence END AS confidence FROM k
),
broken AS (
  SELECT review_id, conv_id, turn, list_filter([
    CASE WHEN file IS NULL THEN 'file' END, CASE WHEN NOT coalesce(line_start >= 1, false) THEN 'line_start' END, CASE WHEN NOT coalesce(line_end >= greatest(1, line_start), false) THEN 'line_end' END,
    CASE WHEN NOT coalesce(severity IN ('info', 'suggestion', 'warning', 'critical'), false) THEN 'severity' END,
    CASE WHEN NOT coalesce(category IN ('bug', 'security', 'performance', 'readability', 'design', 'test_coverage', 'style'), false) THEN 'category' END,
    CASE WHEN NOT coalesce(length(message) BETWEEN 1 AND 1000, false) THEN 'message' END, CASE WHEN code_snippet IS NULL THEN 'code_snippet' END,
    CASE WHEN NOT coalesce(NOT isnan(confidence) AND confidence BETWEEN 0 AND 1, false) THEN 'confidence' END], lambda x: x IS NOT NULL) AS v FROM damaged
)"""

_END_TO_END = """
, live AS (SELECT r.*, d.doc_id FROM chunks r JOIN d ON d.review_id = r.review_id AND d.path = r.path WHERE d.doc_id % 13 <> 0 AND d.doc_id % 29 <> 7),
own AS (
  SELECT review_id, count(*) AS n, sum(CAST(is_partial AS INT)) AS s FROM live GROUP BY review_id
)
SELECT r.review_id, r.pr_number, md5(r.commit_sha) AS commit_sha, CASE WHEN r.review_id % 2 = 0 THEN coalesce(n, 0) ELSE 0 END AS chunks_reviewed,
  CAST(CASE WHEN r.review_id % 2 = 0 THEN coalesce(s, 0) ELSE 0 END AS BIGINT) AS chunks_skipped, coalesce(n, 0) AS n_findings, CASE WHEN r.review_id % 2 = 0 THEN 0 ELSE coalesce(n, 0) END AS n_carried, 'edit' AS action
FROM reviews r LEFT JOIN own ON own.review_id = r.review_id"""

ORACLE_SQL: dict[str, str] = {
    "split_lines": r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, ', ', chr(13) || chr(10)) WHEN 1 THEN replace(text, '. ', chr(8232)) || chr(10) ELSE text END AS text FROM documents),
a AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS a FROM t),
b AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM a)
SELECT doc_id, i AS line_no, a[i] AS line FROM (SELECT *, unnest(range(1, CAST(len(a) + 1 AS BIGINT))) AS i FROM b)""",
    "diff_changed_lines": r"""WITH """ + CTES.strip() + r""",
p AS (SELECT *, regexp_matches(line, '^\+\+\+ (.+)$') AS is_file, regexp_matches(line, '^@@ -\d+(,\d+)? \+(\d+)(,\d+)? @@') AS is_hunk FROM dl),
q AS (SELECT *, sum(CAST(is_file AS INT)) OVER w AS file_seq, sum(CAST(is_hunk AND NOT is_file AS INT)) OVER w AS hunk_seq FROM p WINDOW w AS (PARTITION BY review_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, max(CASE WHEN is_file THEN substr(line, 5) END) OVER (PARTITION BY review_id, file_seq) AS raw, coalesce(max(CASE WHEN is_hunk AND NOT is_file THEN CAST(regexp_extract(line, '\+(\d+)', 1) AS BIGINT) END) OVER (PARTITION BY review_id, hunk_seq), 0) AS base FROM q),
s AS (SELECT *, CASE WHEN raw = '/dev/null' THEN NULL WHEN starts_with(raw, 'a/') OR starts_with(raw, 'b/') THEN substr(raw, 3) ELSE raw END AS path FROM r),
t AS (SELECT *, CASE WHEN path IS NOT NULL AND NOT is_file AND NOT is_hunk AND NOT starts_with(line, '+++') AND NOT starts_with(line, '---') AND (starts_with(line, '+') OR starts_with(line, ' ') OR line = '') THEN 1 ELSE 0 END AS step FROM s),
u AS (SELECT *, base + coalesce(sum(step) OVER (PARTITION BY review_id, hunk_seq ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM t)
SELECT DISTINCT review_id, CAST(file_seq AS BIGINT) AS file_seq, path, CAST(line_no AS BIGINT) AS line_no FROM u WHERE step = 1 AND starts_with(line, '+')""",
    "diff_file_groups": sql("SELECT review_id, file_seq, path, count(*) AS n_changed FROM c WHERE doc_id % 13 <> 0 GROUP BY review_id, file_seq, path"),
    "resolve_from_sha": sql("SELECT review_id, coalesce(nullif(CASE review_id % 3 WHEN 1 THEN '' WHEN 2 THEN 'since' || review_id END, ''), commit_sha) AS from_sha FROM reviews"),
    "language_lookup": sql("""SELECT doc_id, p AS path, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN 'tsx' WHEN doc_id % 6 = 0 THEN 'python' WHEN doc_id % 6 = 1 THEN 'javascript' WHEN doc_id % 6 = 3 THEN 'go' END AS language
FROM (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'src/.py' WHEN 1 THEN path || '.tsx' ELSE path END AS p FROM d)"""),
    "heuristic_ranges": sql("SELECT * FROM h"),
    "merge_ranges": sql("SELECT * FROM merged"),
    "token_estimate": "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents",
    "build_chunks": sql("SELECT * FROM chunks"),
    "module_window": _with(BOUNDARY_CTES, "SELECT review_id, path, line_no, greatest(1, line_no - 10) AS start_line, least(n_lines, line_no + 10) AS end_line FROM enclosed WHERE node_id IS NULL"),
    "enclosing_boundary": _with(BOUNDARY_CTES, "SELECT review_id, path, line_no, node_id, start_line, end_line FROM enclosed"),
    "split_oversized": _with(
        BOUNDARY_CTES
        + f""", hit AS (SELECT DISTINCT doc_id, review_id, path, node_id, start_line, end_line FROM enclosed WHERE node_id IS NOT NULL),
sized AS (SELECT hit.*, (SELECT sum(length(line) + 1) - 1 FROM l WHERE l.doc_id = hit.doc_id AND l.line_no BETWEEN hit.start_line AND hit.end_line) // 4 > {BUDGET} AS over FROM hit),
kids AS (SELECT s.doc_id, s.node_id, u.start_line AS a, u.end_line AS b FROM sized s JOIN units u ON u.doc_id = s.doc_id AND u.parent_id = s.node_id WHERE over AND EXISTS (SELECT 1 FROM c WHERE c.doc_id = u.doc_id AND c.line_no BETWEEN u.start_line AND u.end_line))""",
        "SELECT DISTINCT s.review_id, s.path, s.node_id, coalesce(k.a, s.start_line) AS start_line, coalesce(k.b, s.end_line) AS end_line FROM sized s LEFT JOIN kids k ON k.doc_id = s.doc_id AND k.node_id = s.node_id",
    ),
    "dry_run_review": sql(f"SELECT review_id, chunk_id, path AS file, start_line AS line_start, start_line AS line_end, 'info' AS severity, 'style' AS category, {_q(DRY_RUN_MESSAGE)} AS message, string_split(content, chr(10))[1] AS code_snippet, CAST(1 AS DOUBLE) AS confidence FROM chunks"),
    "build_prompt": sql(f"SELECT review_id, chunk_id, 'File: ' || path || {_NL} || 'Lines ' || start_line || '-' || end_line || CASE WHEN is_partial THEN {_q(PARTIAL_NOTE)} ELSE '' END || {_q(chr(10) * 2 + '<code>' + chr(10))} || content || {_q(chr(10) + '</code>' + chr(10) * 2 + REVIEW_REQUEST)} AS prompt FROM chunks"),
    "build_verify_prompt": sql(
        f"SELECT review_id, conv_id, turn, 'File: ' || file || {_NL} || 'Lines ' || line_start || '-' || line_end || {_q(chr(10) * 2 + '<code>' + chr(10))} || context || {_q(chr(10) + '</code>' + chr(10) * 2 + 'A reviewer says (')} || severity || ', ' || category || '): ' || message"
        f" || {_q(chr(10) * 2 + 'It quotes:' + chr(10) + '```' + chr(10))} || code_snippet || {_q(chr(10) + '```' + chr(10) * 2 + VERIFY_REQUEST)} AS prompt FROM g0 WHERE found AND line_start <= n_lines"
    ),
    "validate_findings": _with(_DAMAGED, "SELECT review_id, conv_id, turn, len(v) = 0 AS is_valid, array_to_string(v, ',') AS violations FROM broken"),
    "severity_filter": sql("SELECT review_id, conv_id, turn, severity FROM f WHERE sev >= 3"),
    "ground_findings": sql("SELECT review_id, conv_id, turn, file, line_start, confidence, outcome, reason FROM g"),
    "grounding_outcome_counts": sql("SELECT outcome, coalesce(reason, '') AS reason, count(*) AS n FROM g GROUP BY 1, 2"),
    "carry_forward": sql("SELECT review_id, CAST(origin AS BIGINT) AS origin, conv_id, turn, file, line_start, confidence FROM all_found"),
    "review_counters": _with(_COUNTED, "SELECT * FROM counted"),
    "severity_sections": _with(_SECTIONS, "SELECT * FROM sections"),
    "render_summary": _with(_COUNTED + _SECTIONS + _RENDERED, "SELECT * FROM rendered"),
    "state_roundtrip": sql("""SELECT a.review_id, r.commit_sha, row_number() OVER (PARTITION BY a.review_id ORDER BY origin, conv_id, turn) - 1 AS position, file, line_start, line_end, severity, category, message || ' --> é' AS message, suggested_fix, code_snippet, confidence
FROM all_found a JOIN reviews r ON r.review_id = a.review_id WHERE a.review_id % 5 <> 4"""),
    "first_summary_comment": sql(f"SELECT review_id, CAST(2 AS BIGINT) AS ord, 'text ' || {_q(MARKER)} || ' no 2' AS body FROM reviews WHERE review_id % 4 <> 3"),
    "upsert_plan": _with(_COUNTED + _SECTIONS + _RENDERED, "SELECT review_id, CASE WHEN review_id % 4 <> 3 THEN 'edit' ELSE 'create' END AS action, CASE WHEN review_id % 4 <> 3 THEN CAST(2 AS BIGINT) END AS ord, length(text) AS n_chars FROM rendered"),
    "review_end_to_end": _with("", f"{_END_TO_END.strip()}").replace("\n\n,", "\n,"),
    "live_review": sql("""SELECT review_id, chunk_id, start_line % 5 = 0 AS is_failed, n AS n_findings, CASE WHEN ok AND start_line % 3 <> 0 THEN n ELSE 0 END AS n_grounded, CASE WHEN ok AND start_line % 3 = 0 THEN n ELSE 0 END AS n_rejected
FROM (SELECT chunks.*, CASE WHEN start_line % 5 = 0 THEN 0 ELSE start_line % 2 + 1 END AS n, doc_id % 29 <> 7 AS ok FROM chunks JOIN d ON d.review_id = chunks.review_id AND d.path = chunks.path)"""),
    "lax_decode": sql("""SELECT review_id, conv_id, turn, ok AS readable, CAST(CASE WHEN ok THEN 2 ELSE 0 END AS BIGINT) AS n, CASE WHEN ok AND k = 3 THEN 1 WHEN ok THEN line_start END AS line_start, CASE WHEN ok AND k = 5 THEN CAST(0.25 AS DOUBLE) WHEN ok THEN CAST(0.5 AS DOUBLE) END AS confidence
FROM (SELECT *, (conv_id * 13 + turn * 7) % 11 AS k, (conv_id * 13 + turn * 7) % 11 NOT IN (2, 4, 6, 8, 9) AS ok FROM f)"""),
}
ORACLE_SQL["diff_changed_lines_sliced"] = ORACLE_SQL["diff_changed_lines"]
ORACLE_SQL |= {"syntax_nodes": SYNTAX_NODES, "review_with_syntax": with_syntax_sql(BUDGET)}
ORACLE_SQL["lines_by_block"] = sql("""SELECT a.review_id, a.path, low, high, string_agg(line, chr(10) ORDER BY line_no) AS context
FROM (SELECT DISTINCT review_id, path, greatest(1, line_no - 9) AS low, least(n_lines, line_no + 9) AS high FROM c) a
JOIN l ON l.review_id = a.review_id AND l.path = a.path AND l.line_no BETWEEN low AND high GROUP BY a.review_id, a.path, low, high""")

ORACLE_SQL["review_from_ledger"] = sql("SELECT review_id, chunk_id, start_line % 5 = 0 AS is_failed, CASE WHEN start_line % 5 = 0 THEN 0 ELSE start_line % 2 + 1 END AS n_findings FROM chunks")
ORACLE_SQL["posted_comments"] = _with(
    _COUNTED + _SECTIONS + _RENDERED,
    """SELECT review_id, CAST(1 AS BIGINT) AS ord, 'plain' AS body FROM reviews
UNION ALL SELECT review_id, CAST(2 AS BIGINT), text FROM rendered""",
)
_STORED = f"""
, sf AS (SELECT *, CAST((conv_id * 37 + turn * 11) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS conf FROM f WHERE review_id % 7 <> 5),
sr AS (
  SELECT review_id, count(*) AS n, count(*) FILTER (sev >= 3) AS shown,
    string_agg('[' || upper(severity) || '] ' || file || ':' || line_start || {_NL} || '  ' || message || {_NL} || CASE WHEN coalesce(suggested_fix, '') <> '' THEN '  suggested fix: ' || suggested_fix || {_NL} ELSE '' END
      || '  confidence: ' || format('{{:.2f}}', conf) || {_NL}, {_NL} ORDER BY conv_id, turn) FILTER (sev >= 3) AS listed
  FROM sf GROUP BY review_id
),
st AS (SELECT r.review_id, CASE WHEN r.review_id % 7 <> 3 THEN pr_number END AS pr_number, commit_sha, coalesce(n, 0) AS n, coalesce(shown, 0) AS shown, listed FROM reviews r LEFT JOIN sr ON sr.review_id = r.review_id)"""
ORACLE_SQL["stored_results"] = _with(_STORED, "SELECT review_id, pr_number, commit_sha, CAST(0 AS BIGINT) AS chunks_reviewed, CAST(0 AS BIGINT) AS chunks_skipped, n, pr_number IS NOT NULL AS is_valid FROM st")
ORACLE_SQL["stored_reports"] = _with(
    _STORED,
    f"""SELECT review_id, CAST(CASE WHEN pr_number IS NULL THEN 1 ELSE 0 END AS BIGINT) AS code, CASE WHEN pr_number IS NULL THEN {_q(BROKEN)} WHEN shown = 0 THEN 'Nothing of severity warning or more.'
  ELSE listed || {_NL} || 'Listed ' || shown || ' of ' || n || '.' END AS text FROM st""",
)
ORACLE_SQL["run_reports"] = _with(
    _COUNTED,
    f"""SELECT c.review_id, 'Reviewed ' || chunks_reviewed || ' chunk(s) of ' || substr(commit_sha, 1, 8) || ', ' || chunks_skipped || ' skipped.' || coalesce({_NL} || x.t, '') AS text FROM counted c
LEFT JOIN (SELECT review_id, string_agg('[' || upper(severity) || '] ' || file || ':' || line_start || ' ' || message, {_NL} ORDER BY origin, conv_id, turn) AS t FROM all_found GROUP BY review_id) x ON x.review_id = c.review_id""",
)
ORACLE_SQL["dry_run_files"] = sql(f"""SELECT review_id, path AS file, 'dry-run-0' AS chunk_id, CAST(1 AS BIGINT) AS line_start, {_q(DRY_RUN_MESSAGE)} AS message, max(CASE WHEN line_no = 1 THEN line END) AS code_snippet, max(n_lines) AS end_line,
  CAST(sum(length(line) + 1) - 1 AS BIGINT) AS n_chars FROM l GROUP BY review_id, path""")
