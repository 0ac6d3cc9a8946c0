"""Keys of lines travel as rows of arrays: few rows however many keys, and none lost, whatever is held."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quillet.llm import line_dedup


def _batches(entries, each):
    for i in range(0, len(entries), each):
        yield line_dedup._entry_batch([np.array(c, t) for c, t in zip(zip(*entries[i : i + each], strict=True), (np.int64, np.int64, np.int32), strict=True)])


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_dealt_keys_lose_no_line(most):
    rng = random.Random(4)
    entries = [(rng.choice([-(1 << 62), -5, 1 << 40, *range(1 << 30, (1 << 62), 1 << 55)]), rng.randrange(-9, 9), rng.choice([-1, -2, 3, 3, 4])) for _ in range(900)]
    entries += [(7 << 50, line, 2) for line in range(400)]  # a very common key
    rng.shuffle(entries)
    dealt = [r for half in (entries[:700], entries[700:]) for b in line_dedup._dealt(_batches(half, 90), 5, 300) for r in b.to_pylist()]
    assert len(dealt) <= 5 * 6 and sum(len(r["key"]) for r in dealt) == len(entries)
    rows = pa.Table.from_pylist(sorted(dealt, key=lambda r: r["bucket"]), pa.schema([("bucket", pa.int32()), ("key", pa.list_(pa.int64())), ("line", pa.list_(pa.int64())), ("place", pa.list_(pa.int32()))]))
    got = [tuple(r.values()) for b in line_dedup._shared(rows.to_batches(max_chunksize=3), most) for r in b.to_pylist()]
    lines, places = {}, {}
    for key, line, place in entries:
        lines.setdefault(key, set()).add(line)
        places.setdefault((key, line), set()).add(place)
    want = {(k, x) for k, every in lines.items() if len(every) > 1 for x in every}
    assert {g[:2] for g in got} == want
    if most == 10**6:
        assert len(got) == len(want)
        assert all(g[2] == (min(p) if len(p := places[g[:2]]) == 1 or min(p) < 0 else line_dedup._ANYWHERE) for g in got)


def test_shuffled_rows_do_not_grow_with_keys(docs, prose):
    s, plain = line_dedup.Lines(), docs(prose(400, 60, seed=5, vocabulary=4000), partitions=2).select("doc_id", "text")
    keys = plain.mapInArrow(lambda it: line_dedup._entries(it, s), line_dedup._ENTRY).count()
    dealt = plain.mapInArrow(lambda it: line_dedup._dealt(line_dedup._entries(it, s), 8), line_dedup._DEALT).count()
    assert keys > 2000 and dealt <= 2 * 8
