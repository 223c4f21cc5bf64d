"""Reading rows group by group from sorted Arrow batches, without a Python call per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group starts, from batches that are sorted by the long column ``key``.

    A group that goes over the end of a batch is joined with what follows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last group may go on
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield _starts(held, key)
            held = []
        if cut:
            yield _starts([*held, batch.slice(0, cut)], key)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _starts(held, key)


def _starts(parts: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    keys = table.column(key).to_numpy()
    return table, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    for shift, mul in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    return x ^ (x >> np.uint64(33))
