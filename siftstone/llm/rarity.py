"""A sketch of how common run hashes are: one counter per range of hashes, its size chosen by the data.

Any order of the hashes loses no pair in prefix filtering; the sketch makes the order put rare ones first. Where there are more
hashes than counters it still tells the common from the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftstone.llm.shingles import flat_list

#: Counters are 2^16 at least, and 2^24 at most: 16 MB to be sent, 64 MB in a worker that counts.
LEAST_BITS, MOST_BITS = 16, 24
_CHUNK_BITS = 10


def bits_for(counters: float) -> int:
    """The power of two next to ``counters``, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, round(np.log2(max(1.0, counters)))))


def slots(h: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The level of each hash: 0 if it does not occur, more for more common ones."""
    return sketch[(h >> np.uint64(65 - len(sketch).bit_length())).astype(np.int64)]


def rarity_sketch(runs: DataFrame, bits: int) -> np.ndarray:
    """Levels (0 to 255, on a logarithmic scale) of 2^bits hash ranges, from the list column that is ``runs``' only one."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            h, _ = flat_list(batch.column(0))
            np.add.at(counts, (h >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        used = np.flatnonzero(counts)
        chunk = used >> _CHUNK_BITS
        edges = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(used) else np.zeros(0, np.int64)
        ends = np.append(edges[1:], len(used))
        within = (used & ((1 << _CHUNK_BITS) - 1)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(chunk[edges].astype(np.int32)),
                pa.array([within[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary()),
                pa.array([counts[used[a:b]].tobytes() for a, b in zip(edges, ends)], pa.binary()),
            ],
            ["chunk", "places", "counts"],
        )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                into = held.setdefault(k, np.zeros(1 << _CHUNK_BITS, np.uint64))
                into[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)
        for k, total in held.items():
            level = np.ceil(8 * np.log2(total.astype(np.float64) + 1)).clip(0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["chunk", "level"])

    summed = runs.mapInArrow(parts, "chunk int, places binary, counts binary").repartition("chunk").mapInArrow(sums, "chunk int, level binary")
    levels = np.zeros((1 << (bits - _CHUNK_BITS), 1 << _CHUNK_BITS), np.uint8)
    for r in summed.toLocalIterator():
        levels[r["chunk"]] = np.frombuffer(r["level"], np.uint8)
    return levels.ravel()
