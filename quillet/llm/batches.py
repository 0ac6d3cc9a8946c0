"""Texts of Arrow batches in groups of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch, about, where the session sets no bound: rows of long texts must not add up.
BATCH_BYTES = 8 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"

GROUP_CHARS = 2_000_000


def text_groups(batches: Iterator[pa.RecordBatch], most: int = GROUP_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Values of column 0 and texts of column 1 (null: empty), about ``most`` characters at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            texts.append(text.as_py() or "")
            ids.append(key)
            size += len(texts[-1])
            if size > most:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on bounds its Arrow batches by bytes."""
    conf = df.sparkSession.conf
    if _BOUND not in conf.getAll:
        conf.set(_BOUND, str(BATCH_BYTES))
    return df
