from __future__ import annotations

import os

import pytest

from quillet.operators.summary import MARKER, apply_upserts, first_summary_comment, upsert_plan
from quillet.sources.comments import FolderComments, ReviewCommentsSink, post_key, read_folder, write_comments

FOLDER = "quillet.sources.comments:FolderComments"
COMMENT = "review_id long, ord long, body string"


class Fragile(FolderComments):
    """Fails right after it has created the comment of review 3, once; workers find it in this module."""

    def create(self, review_id, body, key):
        super().create(review_id, body, key)
        mark = os.path.join(self.root, "failed")
        if review_id == 3 and not os.path.exists(mark):
            open(mark, "w").close()
            raise ConnectionError("the answer got lost")


def rows(df):
    return sorted(tuple(r) for r in df.select("review_id", "ord", "body").collect())


def test_writes_are_what_the_plan_says(spark, tmp_path):
    start = [(1, 1, "plain"), (1, 2, f"{MARKER} old"), (1, 3, "later"), (2, 1, "plain é\nsecond line")]
    comments = spark.createDataFrame(start, COMMENT)
    write_comments(comments, FOLDER, path=tmp_path.as_uri())
    assert rows(read_folder(spark, tmp_path.as_uri())) == sorted(start)
    plan = upsert_plan(first_summary_comment(comments).select("review_id", "ord"), spark.createDataFrame([(r, f"{MARKER} new {r}") for r in (1, 2, 3)], "review_id long, body string"))
    expected = rows(apply_upserts(comments, plan))
    for _ in range(2):
        write_comments(plan, FOLDER, path=tmp_path.as_uri())
        assert rows(read_folder(spark, tmp_path.as_uri())) == expected


def test_a_failed_task_leaves_no_second_comment(spark, tmp_path):
    sys_path = os.path.dirname(__file__)
    plan = spark.createDataFrame([(r, f"{MARKER} {r}") for r in range(1, 6)], "review_id long, body string")
    service = f"{os.path.basename(__file__)[:-3]}:Fragile"
    spark.sparkContext.addPyFile(os.path.join(sys_path, os.path.basename(__file__)))
    with pytest.raises(Exception, match="the answer got lost|tasks failed"):
        write_comments(plan, service, path=tmp_path.as_uri())
    assert (3, 1, f"{MARKER} 3") in rows(read_folder(spark, tmp_path.as_uri()))
    write_comments(plan, service, path=tmp_path.as_uri())
    assert rows(read_folder(spark, tmp_path.as_uri())) == [(r, 1, f"{MARKER} {r}") for r in range(1, 6)]


def test_two_summaries_in_one_write_and_odd_rows(spark, tmp_path):
    twice = spark.createDataFrame([(7, 1, f"{MARKER} a"), (7, 2, f"{MARKER} b"), (7, 3, "x"), (7, 4, "x")], COMMENT)
    write_comments(twice, FOLDER, path=tmp_path.as_uri())
    assert rows(read_folder(spark, tmp_path.as_uri())) == [(7, 1, f"{MARKER} b"), (7, 2, "x")]
    write_comments(twice.limit(0), FOLDER, path=tmp_path.as_uri())
    with pytest.raises(Exception, match="needs a review and a body"):
        write_comments(spark.createDataFrame([(1, None)], "review_id long, body string"), FOLDER, path=tmp_path.as_uri())
    spark.dataSource.register(ReviewCommentsSink)
    with pytest.raises(Exception, match="use mode append"):
        twice.write.format("review_comments").option("service", FOLDER).mode("overwrite").save()
    assert post_key(f"a {MARKER}") == "summary" != post_key("a")
