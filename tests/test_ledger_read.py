"""Kept replies are read by folder: the number of tasks doesn't grow with the replies."""

from __future__ import annotations

from quillet.operators.ledger import Ledger


def test_tasks_do_not_grow_with_replies(spark, tmp_path):
    kept = Ledger(f"file://{tmp_path}/ledger", "m")
    for i in range(300):
        kept.keep(f"{i % 256:02x}{i:062x}", i % 3, f"reply\n{i}")
    (tmp_path / "ledger" / "calls" / "00" / "_draft-0.json").write_text("half")
    found = kept.replies(spark)
    assert "Scan json" not in found._jdf.queryExecution().executedPlan().toString()
    assert "json" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((f"{i % 256:02x}{i:062x}", i % 3, f"reply\n{i}") for i in range(300))
    assert sorted(tuple(r) for r in found.collect()) == want
    kept.compact(spark)
    assert sorted(tuple(r) for r in kept.replies(spark).collect()) == want
