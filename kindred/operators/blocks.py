"""A block of rows held in a task while other blocks' rows pass by it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa

X = TypeVar("X")


def against(batches: Iterator[pa.RecordBatch], build: Callable[[pa.Table], X], meet: Callable[[X, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What `meet` tells of the rows that pass, with what `build` makes of those that are held.

    The first two columns are a slot's number, by which rows are sorted, and whether a row is held; in each slot these come first.
    """
    slot, own, index = None, [], None
    for b in batches:
        at, held = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((at[1:] != at[:-1]) | (held[1:] != held[:-1])) + 1
        for low, high in zip([0, *edges], [*edges, len(at)]) if len(at) else ():
            if at[low] != slot:
                slot, own, index = at[low], [], None
            if held[low]:
                own.append(b.slice(low, high - low))
                continue
            if own:
                index, own = build(pa.Table.from_batches(own).combine_chunks()), []
            if index is not None:
                yield from meet(index, b.slice(low, high - low))
