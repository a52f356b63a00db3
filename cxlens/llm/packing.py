"""Packing documents into training sequences by vector best fit.

A piece takes three resources of a sequence: tokens, one document slot and an
attention cost (the square of its length). Pieces of one length are alike, so
the fit runs over the histogram of lengths, at most ``max_tokens`` rows
whatever the corpus: the lengths fall, and each goes to the open bins that fit
under every capacity and score best, many equal bins at a time. The result is a
list of runs ("the pieces of length 312 from rank 40 on fill sequences 900 to
950, two in each, from place 1400"). Ranks of pieces within their length come
from a window that is salted, so that a length which many pieces share is
ranked in many tasks, and each piece then looks its place up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cxlens.llm.bpe import bpe
from cxlens.llm.common import bounded_batches, written

#: Pieces of one length that one task ranks, about.
RANK_ROWS = 1_000


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence, and the weight of each resource in the score."""
    tokens: int
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    score: str = "norm"  # "norm": least weighted residual norm; "dot": greatest weighted dot product

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.tokens if self.documents is None else self.documents,
                         self.tokens ** 2 if self.attention is None else self.attention], np.int64)


def best_fit(lengths: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces per sequence, offset) that place every piece.

    ``lengths``: pieces by length. Lengths go from long to short; ties between
    bins go to the oldest sequence.
    """
    full, weight = cap.vector(), np.array(cap.weights)
    free = np.zeros((0, 3), np.int64)   # residual of each group of equal bins
    bins = np.zeros((0, 2), np.int64)   # first sequence and number of bins of each group
    runs, n_sequences = [], 0
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens does not fit any sequence")
        while left:
            fits = np.flatnonzero((free >= need).all(axis=1))
            if len(fits):
                after = (free[fits] - need) / full
                if cap.score == "norm":
                    value = (weight * after ** 2).sum(axis=1)
                else:
                    value = -(weight * (free[fits] / full) * (need / full)).sum(axis=1)
                best = fits[np.lexsort((bins[fits, 0], value))[0]]
            else:
                best = len(free)
                most = int((full // need).min())
                free, bins = np.vstack((free, full)), np.vstack((bins, (n_sequences, -(-left // (most if cap.score == "norm" else 1)))))
                n_sequences += int(bins[best, 1])
            # With the norm a bin that has just taken a piece stays the best one until it is full.
            each = int((free[best] // need).min()) if cap.score == "norm" else 1
            first, many = map(int, bins[best])
            used = cap.tokens - int(free[best, 0])
            whole = min(many, left // each)
            rest = left - whole * each if whole < many else 0
            parts = []
            if whole:
                runs.append((length, rank, whole * each, first, each, used))
                parts.append((free[best] - each * need, (first, whole)))
            if rest:
                runs.append((length, rank + whole * each, rest, first + whole, rest, used))
                parts.append((free[best] - rest * need, (first + whole, 1)))
            if whole + bool(rest) < many:
                parts.append((free[best], (first + whole + bool(rest), many - whole - bool(rest))))
            rank, left = rank + whole * each + rest, left - whole * each - rest
            free = np.vstack((np.delete(free, best, 0), *[p for p, _ in parts]))
            bins = np.vstack((np.delete(bins, best, 0), *[b for _, b in parts]))
    return runs


def pieces_of(docs: DataFrame, tokenizer: str, max_tokens: int, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece.

    The ids of a whole text and ``end_id`` after them; only what is longer
    than ``max_tokens`` is cut, and then its first piece is the shorter one.
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def cut(batches):
        tok = bpe(tokenizer)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(a, 1024), []
                for i, t in enumerate(part.column(1).to_pylist()):
                    ids = np.append(tok.encode(t), end_id).astype("<u4")
                    begin, end = 0, (len(ids) - 1) % max_tokens + 1
                    for n in range(-(-len(ids) // max_tokens)):
                        rows.append((i, n, begin, end - begin, zlib.crc32(ids[begin:end])))
                        begin, end = end, end + max_tokens
                at, *cols = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 3)))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return d.mapInArrow(cut, f"doc_id {dict(d.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, cap: Capacity) -> DataFrame:
    """The pieces (any columns, among them ``length``) with sequence_id and offset."""
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}  # at most max_tokens rows
    runs = sorted(best_fit(histogram, cap))
    column = [np.array([r[k] for r in runs], np.int64) for k in range(6)]
    salts = max(1, -(-max(histogram.values(), default=0) // RANK_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)))
    w = Window.partitionBy("length", "_salt").orderBy(*[c for c in pieces.columns if c != "length"])
    ahead = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ahead"))
    ranked = (salted.withColumn("_row", F.row_number().over(w) - 1).join(ahead, ["length", "_salt"])
              .select(*pieces.columns, (F.col("_row") + F.col("_ahead")).cast("long").alias("_rank")))
    at, names = pieces.columns.index("length"), pieces.columns

    def look_up(batches):
        key = column[0] << 40 | column[1]
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            run = np.searchsorted(key, length << 40 | rank, "right") - 1
            nth = rank - column[1][run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(column[3][run] + nth // column[4][run]),
                 pa.array(column[5][run] + nth % column[4][run] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, cap: Capacity, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end token alone; repeated rows are packed as
    often as they occur; equal lengths are told apart by doc_id, then piece;
    an empty table gives an empty result; further columns are not read.
    """
    return place(written(pieces_of(docs, tokenizer, cap.tokens, end_id), "pieces"), cap)
