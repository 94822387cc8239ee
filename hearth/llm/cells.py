"""Counts of all hashes of a corpus in a table of fixed size.

Each task counts into ``counters`` cells and gives out its table in compressed
rows; rows of a cell range are added up in one task that streams them. What
comes back is a byte a cell: it orders hashes from rare to frequent and tells
hot ones. Its size is a parameter and does not grow with the data; two hashes in
one cell only look more frequent than they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Batches = Iterator[pa.RecordBatch]
_CELLS_PER_ROW = 1 << 14
_HELD = 1 << 19


def cells(hashes: np.ndarray, counters: int) -> np.ndarray:
    """The cell of each hash; ``counters`` is a power of two."""
    return (hashes & np.uint64(counters - 1)).astype(np.int64)


class CellCounts:
    """One task's counts, in 32 bits (a task has fewer than 2^32 hashes)."""

    def __init__(self, counters: int):
        self.table, self.held, self.size = np.zeros(counters, dtype=np.uint32), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size > _HELD:
            self._flush()

    def _flush(self) -> None:
        if self.size:
            at, n = np.unique((np.concatenate(self.held) & np.uint64(len(self.table) - 1)).astype(np.uint32), return_counts=True)
            self.table[at] += n.astype(np.uint32)
        self.held, self.size = [], 0

    def rows(self) -> list[bytes]:
        """The table in compressed rows of equal size, first cells first; none if nothing was counted."""
        self._flush()
        if not self.table.any():
            return []
        return [zlib.compress(self.table[k:k + _CELLS_PER_ROW].tobytes(), 1) for k in range(0, len(self.table), _CELLS_PER_ROW)]


def _add_up(batches: Batches) -> Batches:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, raw in zip(batch.column("cell").to_pylist(), batch.column("counts")):
            part = np.frombuffer(zlib.decompress(raw.as_py()), dtype=np.uint32)
            total[cell] = total[cell] + part if cell in total else part.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())],
                                     names=["cell", "counts"])


def magnitudes(counts: DataFrame, counters: int) -> tuple[np.ndarray, int]:
    """(magnitude of every cell, the magnitude from which a cell is hot); ``counters`` bytes."""
    table = np.zeros(counters, dtype=np.int64)
    step = min(_CELLS_PER_ROW, counters)
    for row in counts.repartition("cell").mapInArrow(_add_up, "cell int, counts binary").toLocalIterator():
        table[row.cell * step:(row.cell + 1) * step] = np.frombuffer(zlib.decompress(row.counts), dtype=np.int64)
    hot = int(np.ceil(np.log2(32 + 8 * table.mean())))
    return np.log2(np.maximum(table, 1)).astype(np.uint8), hot
