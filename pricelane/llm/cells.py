"""Groups of rows that lie side by side in a sorted stream of record batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 4096


def starts(rows: pa.RecordBatch, keys: int) -> np.ndarray:
    """The places, but 0, where one of the first `keys` columns changes."""
    new = np.zeros(max(0, len(rows) - 1), bool)
    for column in rows.columns[:keys]:
        new |= pc.not_equal(column.slice(1), column.slice(0, max(0, len(rows) - 1))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each value of the first `keys` columns, which hold no nulls, one group at a time.
    Groups should be bounded: a group is gathered before it is handed out."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, len(batch), STEP):
            part, done = batch.slice(at, STEP), 0
            # the first row decides whether what waits is complete
            if waiting and any(waiting[-1].column(k)[-1] != part.column(k)[0] for k in range(keys)):
                yield _joined(waiting)
                waiting = []
            for cut in starts(part, keys).tolist():
                yield _joined([*waiting, part.slice(done, cut - done)])
                waiting, done = [], cut
            waiting.append(part.slice(done))
    if waiting:
        yield _joined(waiting)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)
