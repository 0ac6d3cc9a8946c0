"""Posting is dealt to tasks by its calls, comments are read by folder, and findings are made once."""

from __future__ import annotations

import os

from pyspark import TaskContext

from quillet.operators import ground
from quillet.plans import queries
from quillet.sources.comments import FolderComments, read_folder, write_comments


class Told(FolderComments):
    """Leaves a file for each task that creates a comment; workers find it in this module."""

    def create(self, review_id, body, key):
        super().create(review_id, body, key)
        open(os.path.join(self.root, f"task-{TaskContext.get().partitionId()}"), "w").close()


def test_few_bytes_are_posted_by_many_tasks(spark, tmp_path):
    spark.sparkContext.addPyFile(__file__)
    rows = [(r, 1, f"text {r} é\n") for r in range(-3, 300)]
    for tasks, least in ((None, 4), (16, 12)):
        path = tmp_path / f"c{tasks}"
        write_comments(spark.createDataFrame(rows, "review_id long, ord long, body string"), f"{os.path.basename(__file__)[:-3]}:Told", tasks=tasks, path=path.as_uri())
        assert len([n for n in os.listdir(path) if n.startswith("task-")]) >= least
        back = read_folder(spark, path.as_uri())
        assert "Scan text" not in back._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in back.collect()) == rows
    assert read_folder(spark, (tmp_path / "nothing").as_uri()).count() == 0


def test_an_edit_to_the_same_text_replaces_no_file(tmp_path):
    service = FolderComments({"path": tmp_path.as_uri()})
    service.create(5, "é", "k")
    (file,) = tmp_path.glob("05/5/*.txt")
    before = file.stat().st_ino
    service.edit(5, 1, "é")
    assert file.stat().st_ino == before and list(service.comments(5)) == [(1, "é")]
    service.edit(5, 1, "é2")
    assert list(service.comments(5)) == [(1, "é2")]


def test_findings_are_made_once(spark, monkeypatch):
    plans, real = {}, ground.materialize

    def told(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(ground, "materialize", told)
    queries._all_found(spark, "/root/testdata/sf0.001")
    assert len(plans["judged"]) == 2 and all("conversations" not in p for every in plans.values() for p in every)
    assert all("documents" not in p for p in plans["asked-lines"])
