"""Reading vector columns in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row numbers, vectors as doubles) of the vectors that are not null or empty and hold finite numbers only."""
    rows, out = [], []
    column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
    for i in range(len(column)):
        if valid[i] and offsets[i + 1] > offsets[i]:
            v = flat[offsets[i] : offsets[i + 1]]
            if np.isfinite(v).all():
                rows.append(i)
                out.append(v)
    return np.array(rows, np.int64), out


def runs(batches, keys: list[str]):
    """Tables of consecutive rows with equal keys, across batch borders. The rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for v in values:
            a = v.to_numpy(zero_copy_only=False)
            change[1:] |= a[1:] != a[:-1]
        first = tuple(v[0].as_py() for v in values)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cut = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cut[:-2], cut[1:-1], strict=True):
            held.append(batch.slice(a, b - a))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut[-2]))
        last = tuple(v[batch.num_rows - 1].as_py() for v in values)
    if held:
        yield pa.Table.from_batches(held)
