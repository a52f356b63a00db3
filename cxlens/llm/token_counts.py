"""Token counts by a finite-state tokenizer.

Two transducers read the bytes of a text. The first marks where pre-tokens
begin (a window over neighbouring code points, ``bpe.pretoken_starts``). The
second is the byte-pair encoder compiled to a deterministic transducer: its
state after a prefix of a pre-token holds the longest suffix that can still
grow into a vocabulary token, and the last token of the encoding (with its
count) at each place inside that suffix. Reading a byte changes the count of
the encoding by a fixed amount that stands on the transition; the amounts of a
text add up to its token count. States are compiled when first reached and
kept in a dense table.

Texts run in chunks of ``CHUNK`` bytes, all in lock step. What a chunk does
from its first pre-token start on does not depend on the state before it; only
its head does. A chunk without any start has a state map, from the state that
enters it to the one that leaves it. Maps are made for the states that can
enter: the one that leaves the chunk before, where that is known, else those
that the chunk before leaves when entered from the start or from states found
so far; a token reaches back a few bytes only, so after a round or two no new
state turns up. The maps of a run of such chunks compose through a prefix scan by
pointer doubling, which gives every chunk its entry state; one more pass in
lock step counts all heads.

Encoding with merges is determined byte by byte: exactly one token can end the
encoding of a prefix, the one whose predecessor token it does not merge with
(checked once for each pair with the tokenizer itself).
"""

from __future__ import annotations

import functools
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cxlens.llm.bpe import ByteBpe, bpe, pretoken_starts

CHUNK = 256
#: The table is dropped and compiled anew beyond this many states, which bounds memory.
MAX_STATES = 300_000
START, UNKNOWN = 0, 1
#: Rounds in which the maps may find new entry states; a run that needs more is resolved from left to right.
MAP_ROUNDS = 8
SHIFT, BIAS = 6, 32


NONE = -1


def _packed(suffix: bytes, ends, counts) -> bytes:
    """A state as bytes: the suffix, and at each place in it the last token and its count relative to now."""
    return bytes((len(suffix),)) + suffix + array("i", ends).tobytes() + array("b", counts).tobytes()


def _unpacked(state: bytes) -> tuple[bytes, array, array]:
    n, ends, counts = state[0], array("i"), array("b")
    ends.frombytes(state[n + 1:5 * n + 5])
    counts.frombytes(state[5 * n + 5:])
    return state[1:n + 1], ends, counts


class CountTransducer:
    def __init__(self, tok: ByteBpe, max_states: int = MAX_STATES):
        self.tok, self.max_states = tok, max_states
        self.growable = {t[:i] for t in tok.ranks for i in range(1, len(t))}  # proper prefixes
        self.pairs: dict[tuple[int, int], bool] = {}
        self.column = np.full(256, -1, np.int32)  # bytes get a table column when first met
        self.reset()

    def reset(self) -> None:
        self.ids: dict = {}
        self.states: list = []
        self.column[:] = -1
        self.table = np.full((4096, 32), -1, np.int32)
        self.used = 0
        assert self._state(_packed(b"", (NONE,), (0,))) == START
        self.states.append(b"")  # UNKNOWN: stays, counts nothing
        self.table[UNKNOWN] = UNKNOWN << SHIFT | BIAS

    def _state(self, key) -> int:
        i = self.ids.get(key)
        if i is None:
            i = self.ids[key] = len(self.states)
            self.states.append(key)
            if i >= len(self.table):
                self.table = np.concatenate((self.table, np.full((max(4096, i // 4), self.table.shape[1]), -1, np.int32)))
                self.table[UNKNOWN] = UNKNOWN << SHIFT | BIAS
        return i

    def _apart(self, u: int, t: int) -> bool:
        """Whether token t can follow token u: their bytes do not encode otherwise."""
        if u == NONE:
            return True
        ok = self.pairs.get((u, t))
        if ok is None:
            ok = self.pairs[u, t] = self.tok.piece(self.tok.bytes_of[u] + self.tok.bytes_of[t]) == [u, t]
        return ok

    def compile(self, state: int, byte: int) -> None:
        suffix, ends, counts = _unpacked(self.states[state])
        x = suffix + bytes((byte,))
        for size in range(len(x), 0, -1):
            t = self.tok.ranks.get(x[-size:])
            if t is not None and self._apart(ends[len(x) - size], t):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        delta = counts[len(x) - size] + 1
        keep = next((n for n in range(len(x), 0, -1) if x[-n:] in self.growable), 0)
        ends, counts = (*ends, t)[len(x) - keep:], (*(c - delta for c in counts), 0)[len(x) - keep:]
        if not -BIAS < delta < BIAS:
            raise ValueError("count change out of range")
        new = self._state(_packed(x[len(x) - keep:], ends, counts))
        self.table[state, self.column[byte]] = new << SHIFT | delta + BIAS

    def step(self, state: np.ndarray, column: np.ndarray, byte: np.ndarray) -> np.ndarray:
        entry = self.table[state, column]
        if (entry < 0).any():
            at = np.flatnonzero(entry < 0)
            for pair in np.unique(state[at].astype(np.int64) << 8 | byte[at]).tolist():
                self.compile(pair >> 8, pair & 255)
            entry = self.table[state, column]
        return entry

    def _scan(self, whole: np.ndarray, state: np.ndarray, column: np.ndarray, byte: np.ndarray) -> None:
        """Sets the state that leaves each of the chunks ``whole``, which have no start, by composing their maps.

        A map is a set of rows (chunk, entry, exit); a row leads to the row of the next chunk that its exit enters.
        """
        if not len(whole):
            return
        is_whole = np.zeros(len(state) + 1, bool)
        is_whole[whole] = True
        first = ~is_whole[whole - 1]  # chunk 0 has a start
        new = whole.astype(np.int64) << 32 | np.where(first, state[whole - 1], START)
        begin, keys, exits = new[first], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _ in range(MAP_ROUNDS):
            lane, now = new >> 32, (new & 0xFFFFFFFF).astype(np.int32)
            for k in range(CHUNK):
                now = self.step(now, column[k, lane], byte[k, lane]) >> SHIFT
            order = np.argsort(np.concatenate((keys, new)), kind="stable")
            keys, exits = np.concatenate((keys, new))[order], np.concatenate((exits, now))[order]
            into = ((keys >> 32) + 1 << 32) | exits  # the row that each one leads to
            inner = is_whole[(into >> 32)]
            new = np.setdiff1d(into[inner], keys)
            if not len(new):
                break
        at = np.searchsorted(keys, into)
        there = inner & (np.append(keys, -1)[at] == into)
        jump = np.append(np.where(there, at, len(keys)), len(keys))  # the last row is the end of a run
        met = np.zeros(len(keys) + 1, bool)
        met[np.searchsorted(keys, begin)] = True
        reach = 1
        while reach <= len(whole):
            met[jump[np.flatnonzero(met)]] = True
            jump, reach = jump[jump], 2 * reach
        met = met[:-1]
        state[keys[met] >> 32] = exits[met]

    def deltas(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Change of the token count at each byte."""
        if len(self.states) > self.max_states:
            self.reset()
        met = np.flatnonzero(np.bincount(data, minlength=256))
        for b in met[self.column[met] < 0].tolist():
            if self.used == self.table.shape[1]:
                more = np.full((len(self.table), min(256, self.used + 16) - self.used), -1, np.int32)
                more[UNKNOWN] = UNKNOWN << SHIFT | BIAS
                self.table = np.concatenate((self.table, more), axis=1)
            self.column[b], self.used = self.used, self.used + 1
        n = -(-len(data) // CHUNK)
        padded = np.full(n * CHUNK, data[-1], np.uint8)
        padded[:len(data)] = data
        flags = np.ones(n * CHUNK, bool)
        flags[:len(data)] = starts
        byte = np.ascontiguousarray(padded.reshape(n, CHUNK).T)
        column = self.column[byte]
        fresh = np.ascontiguousarray(flags.reshape(n, CHUNK).T)
        out = np.zeros((CHUNK, n), np.int8)
        state = np.full(n, UNKNOWN, np.int32)
        for k in range(CHUNK):
            state[fresh[k]] = START
            entry = self.step(state, column[k], byte[k])
            state = entry >> SHIFT
            out[k] = (entry & (1 << SHIFT) - 1) - BIAS
        # Heads: bytes of a chunk before its first start, entered in the state its predecessor left.
        head = np.where(fresh.any(axis=0), fresh.argmax(axis=0), CHUNK)
        self._scan(np.flatnonzero(head == CHUNK), state, column, byte)
        todo = np.flatnonzero(head > 0)
        while len(todo):  # one round, but for runs whose maps did not close
            ready = state[todo - 1] != UNKNOWN
            lanes, todo = todo[ready], todo[~ready]
            now = state[lanes - 1].copy()
            for k in range(int(head[lanes].max())):
                on = head[lanes] > k
                at = lanes[on]
                entry = self.step(now[on], column[k, at], byte[k, at])
                now[on] = entry >> SHIFT
                out[k, at] = (entry & (1 << SHIFT) - 1) - BIAS
            whole = head[lanes] == CHUNK
            state[lanes[whole]] = now[whole]
        return out.T.reshape(-1)[:len(data)]


@functools.cache
def transducer(path: str) -> CountTransducer:
    return CountTransducer(bpe(path))


def count_batch(machine: CountTransducer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Token counts of texts given as one UTF-8 array and their offsets."""
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    n = np.zeros(len(offsets) - 1, np.int64)
    if not len(data):
        return n
    cuts, blob = [], data.tobytes()
    for s in machine.tok.special:  # special strings count one token each and part the text
        at = blob.find(s)
        while at >= 0:
            doc = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(s) <= offsets[doc + 1]:
                cuts.append((at, at + len(s)))
                n[doc] += 1
                at = blob.find(s, at + len(s))
            else:
                at = blob.find(s, at + 1)
    begins = offsets[:-1]
    if cuts:
        begins = np.unique(np.concatenate((begins, np.array(cuts).ravel())))
    delta = machine.deltas(data, pretoken_starts(data, begins)).astype(np.int64)
    for a, b in cuts:
        delta[a:b] = 0
    total = np.concatenate(([0], np.cumsum(delta)))
    return n + total[offsets[1:]] - total[offsets[:-1]]


def token_counts(docs: DataFrame, tokenizer: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), a row for each input row.

    Null and empty texts have 0 tokens; repeated rows repeat; an empty table
    gives an empty result; only the two named columns are read, so extra
    columns with any names do not matter. ``tokenizer`` is the path of a
    byte-level BPE file that every executor can read. Nothing is shuffled.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = dict(d.dtypes)["doc_id"]

    def count(batches):
        machine = transducer(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for a in range(0, len(texts), 1024):
                part = texts.slice(a, 1024).cast(pa.large_string())
                _, offsets, data = part.buffers()
                offsets = np.frombuffer(offsets, np.int64)[part.offset:part.offset + len(part) + 1]
                raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, 1024), pa.array(np.diff(offsets), pa.int64()),
                     pa.array(count_batch(machine, raw, offsets), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = d.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
