"""Arrow batches in small parts, so that what Python makes of them stays small whatever the batches' size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python strings at a time.
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch, text: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with at most ``limit`` bytes of the string column ``text``, or one longer row each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
