"""What is sorted by file: places and signs, without the texts they were found in."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.operators import blocks


def _sorted_columns(df):
    """What the lowest window of a plan without joins reads."""
    node, lowest = df._jdf.queryExecution().optimizedPlan(), None
    while node.children().size():
        lowest = node if node.nodeName() == "Window" else lowest
        node = node.children().head()
    return lowest.children().head().output().mkString(" ")


def test_brace_events_sort_no_text(spark):
    rows = [(1, "a.go", "go", "func f() {\n  x()\n}\n", 3, 0)]
    files = spark.createDataFrame(rows, "review_id long, path string, lang string, code string, n_lines int, last_col int")
    events = blocks._brace_events(files)
    assert "_len" in _sorted_columns(events)
    assert "piece" not in _sorted_columns(events)
    assert [tuple(r) for r in events.select("step", "node_type", "start_line", "end_line").orderBy("i").collect()] == [(1, "function_declaration", 1, 1), (-1, None, None, 3)]


def test_python_blocks_read_each_text_once(spark):
    files = spark.createDataFrame([(1, "a.py", "python", "def f():\n    x\n\ny", 4, 1)], "review_id long, path string, lang string, code string, n_lines int, last_col int")
    found = blocks._indented(files)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
    assert [tuple(r) for r in found.select("node_type", "start_line", "end_line").collect()] == [("function_definition", 1, 2)]


def test_blank_context_windows_grow_only(spark):
    """A frame that reaches to a file's end from each line costs the square of its lines."""
    from quillet.operators import chunk

    lines = spark.createDataFrame([(1, "a", i, "" if i in (2, 5) else "x", 6) for i in range(1, 7)], "review_id long, path string, line_no long, line string, n_lines long")
    changed = spark.createDataFrame([(1, 1, "a", i) for i in (0, 1, 3, 5, 6, 7)], "review_id long, file_seq long, path string, line_no long")
    ranges = chunk.heuristic_ranges(changed, lines)
    assert "UnboundedFollowing" not in ranges._jdf.queryExecution().optimizedPlan().toString().replace("unboundedfollowing", "UnboundedFollowing")
    got = {r.line_no: (r.start_line, r.end_line) for r in ranges.collect()}
    assert got == {1: (1, 1), 3: (3, 4), 5: (3, 6), 6: (6, 6)}


def test_ground_looks_up_once(spark):
    """Without a verifier the lookup stands once in the plan."""
    from quillet.operators import ground

    columns = "review_id long, origin int, chunk_ord long, finding_ord long, file string, line_start long, line_end long, code_snippet string, confidence double"
    found = spark.createDataFrame([(1, 0, 1, 1, "a", 1, 1, "x", 0.5), (1, 0, 1, 2, "a", 1, 1, "z", 0.5), (1, 0, 1, 3, "b", 1, 1, "x", 0.5)], columns)
    files = spark.createDataFrame([(1, "a", ["x  y"])], "review_id long, path string, lines array<string>")
    grounded = ground.ground(found, files)
    assert grounded._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    got = {r.finding_ord: (r.outcome, r.reason, r.confidence) for r in grounded.withColumn("c", F.lit(1)).collect()}
    assert got == {1: ("grounded", None, 0.5), 2: ("downweighted", None, 0.25), 3: ("dropped", "file_not_found", 0.5)}


def test_overlapping_ranges_share_their_blocks(spark):
    """Blocks are gathered per block in which ranges begin, not per range."""
    from quillet.operators import ground

    files = spark.createDataFrame([(1, "a", [str(i) for i in range(1, 41)])], "review_id long, path string, lines array<string>")
    asked = spark.createDataFrame([(1, "a", low, low + 12) for low in range(1, 28)], "review_id long, path string, low long, high long")
    found = ground.lines_between(asked, ground.file_blocks(files, 7), 7)
    gathered = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in x]
    assert gathered
    assert all("_from#" in x.split("]")[0] and "low#" not in x.split("]")[0] for x in gathered)
    for r in found.collect():
        assert r.lines == [str(i) for i in range(r.low, r.high + 1)]
