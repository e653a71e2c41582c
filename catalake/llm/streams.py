"""Runs of equal keys in sorted Arrow batches, so that a task needs no whole group in memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc


def segments(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[Any, pa.RecordBatch, bool]]:
    """(key value, rows, whether the key is new) for each run within a batch; a run over several batches comes in parts."""
    last, begun = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(batch.schema.get_field_index(key)))
        start = 0
        for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            yield value, batch.slice(start, end - start), not begun or value != last
            last, begun, start = value, True, end


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[Any, list[pa.RecordBatch]]]:
    """(key value, its rows) for keys whose rows are known to be few."""
    held: list[pa.RecordBatch] = []
    last = None
    for value, rows, new in segments(batches, key):
        if new and held:
            yield last, held
            held = []
        last = value
        held.append(rows)
    if held:
        yield last, held
