"""Bitmaps of hash slots that occur twice: a first sieve of bounded size for things that repeat.

The bitmap is sized for the hashes expected (``slot_bits``), up to
``2**MAX_SLOT_BITS`` bits, so it may be sent to every executor. A hash that
occurs twice always passes; one that does not may pass by chance and is found
out later, by the exact step behind the sieve. Chance costs work and changes
no result. More hashes than the largest bitmap tells apart would take several
``ranges`` of them, and the input would be read for each; ``packs`` is for these.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bits of the largest bitmap (32 MB), as a power of two, and of the least.
MAX_SLOT_BITS, LEAST_SLOT_BITS = 28, 20
#: Bytes of text that a task works on at a time; its arrays take some ten times as much.
PART_BYTES = 8 << 20
#: Slots are gathered in ``2**CHUNKS`` chunks, so that rows grow with the texts alone; inside one a slot takes two bytes at most.
CHUNKS = 12


def slot_bits(hashes: int) -> int:
    """Size of the bitmap for so many hashes: four slots each, within the bounds."""
    return min(MAX_SLOT_BITS, max(LEAST_SLOT_BITS, (4 * hashes).bit_length()))


def ranges(hashes: int) -> int:
    """Ranges of hashes that it takes, so that each has two slots of the largest bitmap.

    Of n hashes in 2n slots, chance puts two into one slot for at most 9 % of the slots.
    """
    return max(1, -(-2 * hashes >> MAX_SLOT_BITS))


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def parts(batch: pa.RecordBatch, column: int):
    """Slices of a batch whose texts in ``column`` have about PART_BYTES (one row at least)."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < batch.num_rows:
        begin = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, begin + PART_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


#: Spark removes the shuffle files of a query that ran with this setting when it ends, not when the driver next collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries made and run inside leave no shuffle files behind; for results that are collected once."""
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


class Bitmap:
    """One bit a slot. It travels compressed (few bits are set as a rule) and is unpacked once in each worker."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @property
    def slot_bits(self) -> int:
        return (8 * len(self.bits)).bit_length() - 1

    def share_set(self) -> float:
        return int(np.bitwise_count(self.bits).sum(dtype=np.int64)) / (8 * len(self.bits))

    def __getstate__(self):
        import zstandard
        return zstandard.ZstdCompressor(level=1).compress(self.bits.tobytes())

    def __setstate__(self, state):
        import zstandard
        self.bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(state), np.uint8)

    def passes(self, h: np.ndarray) -> np.ndarray:
        slot = slots(h, self.slot_bits)
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def slot_bitmap(rows: DataFrame, hashes, bits: int, tagged: bool = False, many: int = 0):
    """Bitmap of the slots met twice, or if ``tagged`` met with two different tags.

    With ``many`` (only if ``tagged``) also the sorted slots of the bitmap whose tags came in more than
    so many rows, one for each tag and batch: at most one slot for every ``many`` rows.

    ``rows`` has one column, a text; ``hashes(batch)`` gives the hashes of a batch and their tags (or None).
    """
    inner = bits - CHUNKS
    per = 1 << inner

    def count(batches):
        for batch in (p for whole in batches for p in parts(whole, 0)):
            h, tag = hashes(batch)
            slot = slots(h, bits)
            if tagged:  # equal tags do not mark a slot
                order = np.lexsort((tag, slot))
                slot, tag = slot[order], tag[order].astype("<u8")
                new = np.concatenate(([True], (slot[1:] != slot[:-1]) | (tag[1:] != tag[:-1])))[:len(slot)]
                slot, tag = slot[new], tag[new]
            else:
                slot, n = np.unique(slot, return_counts=True)
            chunk, inside = (slot >> np.uint64(inner)).astype(np.int32), (slot & np.uint64(per - 1)).astype("<u2")
            edge = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1], [True]))) if len(slot) else np.zeros(1, np.int64)
            spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk[edge[:-1]]), pa.array([inside[x:y].tobytes() for x, y in spans], pa.binary()),
                 pa.array([(tag[x:y] if tagged else inside[x:y][n[x:y] > 1]).tobytes() for x, y in spans], pa.binary())],
                ["chunk", "met", "more"])

    def merge(batches):
        now, seen, twice, tags, n = None, None, None, None, None
        for batch in batches:
            for chunk, met, more in zip(*(x.to_pylist() for x in batch.columns)):
                if chunk != now:
                    if now is not None:
                        yield chunk_row(now, twice, n)
                    now, seen, twice, tags, n = chunk, np.zeros(per, bool), np.zeros(per, bool), np.zeros(per, np.uint64), np.zeros(per, np.int64)
                met, more = np.frombuffer(met, "<u2"), np.frombuffer(more, "<u8" if tagged else "<u2")
                if tagged:
                    twice[met[seen[met] & (tags[met] != more)]] = True
                    twice[met[1:][met[1:] == met[:-1]]] = True  # two classes in one batch
                    tags[met] = more
                    np.add.at(n, met, 1)
                else:
                    twice[met[seen[met]]] = True
                    twice[more] = True
                seen[met] = True
        if now is not None:
            yield chunk_row(now, twice, n)

    def chunk_row(c, twice, n):
        crowd = np.flatnonzero(twice & (n > many)).astype("<u2") if many else np.zeros(0, "<u2")
        return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()]), pa.array([crowd.tobytes()])],
                                          ["chunk", "bits", "crowd"])

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = rows.mapInArrow(count, "chunk int, met binary, more binary").repartition(n, "chunk").sortWithinPartitions("chunk")
    out, crowded = np.zeros(1 << bits - 3, np.uint8), [np.zeros(0, np.uint64)]
    with shuffles_removed(rows.sparkSession):
        chunks = met.mapInArrow(merge, "chunk int, bits binary, crowd binary").collect()  # 2**bits bits at most
    for c, part, crowd in chunks:
        out[c * per // 8:(c + 1) * per // 8] = np.frombuffer(part, np.uint8)
        crowded.append(np.frombuffer(crowd, "<u2").astype(np.uint64) + np.uint64(c * per))
    return (Bitmap(out), np.sort(np.concatenate(crowded))) if many else Bitmap(out)
