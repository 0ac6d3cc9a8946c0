"""Reviews driven by a stream of pushes, one incremental run per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillet.operators.boundaries import first_of
from quillet.plans.review import Review, review_changes

Lookup = Callable[[DataFrame], DataFrame]


def review_pushes(pushes: DataFrame, comments: Lookup, diffs: Lookup, files: Lookup, post: Callable[[Review], None], checkpoint: str, **options: object) -> StreamingQuery:
    """Review each change that was pushed to, as often as a batch brings it.

    ``pushes(review_id, pr_number, base_sha, head_sha, pushed_at)`` is a stream; of
    several pushes to a change in a batch the last one counts, since its diff holds
    the others. The lookups get the changes of the batch and return what is there
    for them; the state of earlier runs is in the comments, so a batch that is
    repeated after a failure edits the same comment again.
    """

    def batch(frame: DataFrame, _: int) -> None:
        last = first_of(frame, ["review_id"], [F.desc("pushed_at")]).drop("pushed_at")
        if not last.isEmpty():
            post(review_changes(last, comments(last), diffs(last), files(last), **options))

    return pushes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
