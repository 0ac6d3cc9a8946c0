"""SQL of the queries here that SQL can express."""

from __future__ import annotations

from quillet.llm.quality_rules import BASE_FAILED, RULES


def _rate(rule: str) -> str:
    """A host's shrunk failure rate of a rule, over the host's counts and the sums ``t``."""
    mean, noise = f"(s_{rule} / n_all)", f"((s_{rule} / n_all) * (1 - s_{rule} / n_all))"
    excess = f"(q_{rule} / n_all - {mean} * {mean} - {noise} * hosts / n_all) / ({noise} * (1 - hosts / n_all))"
    share = f"least(greatest({excess}, 0.0001), 0.5)"
    weight = f"(CASE WHEN hosts < 2 OR {noise} <= 0 OR n_all <= hosts THEN CAST(100 AS DOUBLE) ELSE (1 - {share}) / {share} END)"
    return f"(k_{rule} + {mean} * {weight}) / (n + {weight})"


QUALITY = f"""WITH w AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
p AS (SELECT doc_id, i, array_to_string(a[i:i + 4], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 3)) AS i FROM w WHERE len(a) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM (SELECT doc_id, i, unnest([0, 1, 2, 3, 4]) AS k FROM r) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS c, count(*) - count(DISTINCT x) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, host, len(a) AS n_words, length(array_to_string(a, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.c, 0) AS n_lines, coalesce(dups, 0) AS n_dup_lines, coalesce(rep.c, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id
),
f AS (SELECT *, {BASE_FAILED} AS base_failed, {', '.join(f'CAST({cond} AS BIGINT) AS f_{k}' for k, (cond, _) in RULES.items())} FROM m),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'CAST(sum(f_{k}) AS DOUBLE) AS k_{k}' for k in RULES)} FROM f GROUP BY host),
t AS (SELECT CAST(count(*) AS DOUBLE) AS hosts, sum(n) AS n_all, {', '.join(f'sum(k_{k}) AS s_{k}, sum(k_{k} * k_{k} / n) AS q_{k}' for k in RULES)} FROM h),
v AS (SELECT host, {' AND '.join(f'{_rate(k)} <= {limit}' for k, (_, limit) in RULES.items())} AS ok FROM h, t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN v ON v.host IS NOT DISTINCT FROM f.host"""

ORACLE_SQL = {"op1_quality_rules": QUALITY}
