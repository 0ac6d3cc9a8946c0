from __future__ import annotations

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillet.operators import review
from quillet.operators.ledger import Ledger

CHUNK = "review_id long, chunk_ord long, chunk_id string, file string, start_line long, end_line long, content string, is_partial boolean"
FOUND = {"file": "a", "line_start": 1, "line_end": 1, "severity": "info", "category": "bug", "message": "m", "code_snippet": "", "confidence": 0.5}


def counting(log: str, deadly: str = ""):
    """A transport that notes each call in a file; ``garbled`` chunks get an unreadable reply first, one chunk kills its worker once."""

    class Counting:
        def complete(self, system, prompt, max_tokens, schema, timeout):
            word = prompt.split("<code>\n")[1].split("\n")[0]
            seen = open(log).read().split() if os.path.exists(log) else []
            if word == deadly and not os.path.exists(log + ".dead"):
                open(log + ".dead", "w").close()
                os._exit(1)
            with open(log, "a") as f:
                f.write(word + "\n")
            if word.startswith("never") or (word.startswith("garbled") and word not in seen):
                return "{"
            return json.dumps({"chunk_id": "c", "findings": [FOUND]} if schema else {"is_valid": True})

    return Counting


def chunks(spark, words):
    return spark.createDataFrame([(1, i, f"c{i}", "a.py", 1, 1, w, False) for i, w in enumerate(words)], CHUNK).coalesce(1).sortWithinPartitions("chunk_ord")


def calls(log):
    return Counter(open(log).read().split())


def outcome(df):
    return [(r.chunk_ord, r.is_failed, len(r.findings)) for r in df.orderBy("chunk_ord").collect()]


def test_a_killed_task_repeats_no_call(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), Ledger((tmp_path / "ledger").as_uri(), "m")
    words = [f"w{i}" for i in range(12)] + ["garbled", "never"]
    made = review.live_review(chunks(spark, words), counting(log, "w7"), ledger=ledger)
    with pytest.raises(Exception, match="(?i)worker|crash|abort"):
        made.collect()
    before = calls(log)
    assert 0 < sum(before.values()) < len(words)
    expected = [(i, False, 1) for i in range(13)] + [(13, True, 0)]
    assert outcome(made) == expected
    once = Counter({w: 1 for w in words}) + Counter({"garbled": 1, "never": 2})
    assert calls(log) == once
    assert outcome(made) == expected and calls(log) == once  # a second run calls nobody, for failed chunks neither


def test_compaction_keeps_every_reply(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), Ledger((tmp_path / "ledger").as_uri(), "m")
    first = outcome(review.live_review(chunks(spark, ["a", "garbled", "never"]), counting(log), ledger=ledger))
    kept = {tuple(r) for r in ledger.replies(spark).collect()}
    ledger.compact(spark)
    ledger.compact(spark)  # nothing new
    assert {tuple(r) for r in ledger.replies(spark).collect()} == kept and len(kept) == 1 + 2 + 3
    before = calls(log)
    more = outcome(review.live_review(chunks(spark, ["a", "garbled", "never", "b"]), counting(log), ledger=ledger))
    assert more == [*first, (3, False, 1)] and calls(log) == before + Counter(["b"])
    ledger.compact(spark)
    assert ledger.replies(spark).count() == 7
    assert outcome(review.live_review(chunks(spark, ["b"]), counting(log), ledger=Ledger(ledger.root, "another"))) == [(0, False, 1)]
    assert calls(log)["b"] == 2  # another model is another request


def test_equal_requests_share_a_reply_and_verifiers_remember(spark, tmp_path):
    log, ledger = str(tmp_path / "log"), Ledger((tmp_path / "ledger").as_uri())
    assert outcome(review.live_review(chunks(spark, ["a", "a", "garbled", "garbled"]), counting(log), ledger=ledger)) == [(i, False, 1) for i in range(4)]
    assert calls(log) == Counter({"a": 1, "garbled": 2})
    found = spark.createDataFrame([("a.py", 1, 1, "info", "bug", "m", "", "one"), ("a.py", 1, 1, "info", "bug", "m", "", "never")], "file string, line_start long, line_end long, severity string, category string, message string, code_snippet string, context string")
    for _ in range(2):
        assert {r.context: r.is_valid for r in review.live_verify(found, counting(log), ledger=ledger).collect()} == {"one": True, "never": False}
    assert calls(log)["one"] == 1 and calls(log)["never"] == 3
    assert ledger.replies(spark).filter(F.col("reply") == "{").count() == 4
