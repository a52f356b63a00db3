"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last bytes says so, so passages that
documents share are cut alike wherever they stand. A chunk that several
documents hold is encoded once, in the task of its hash, and its ids go to all
of them (if a batch of rows holds it often, once for that batch); what stands between such chunks is encoded where it is read.

Encoding pieces on their own can differ from encoding the whole near the
joins. At a certain place (a blank between two ASCII letters or digits and a
letter, ``certain``) the pre-tokenizer parts a text whatever stands around it,
so the ids on both sides of it are the same in any encoding. Each join is
repaired by encoding anew what lies between the last certain place before it
and the first one behind it; if a piece has none, the stretch grows over the
next pieces until it meets one. There the new ids and the kept ones agree, and
the result is that of the whole text.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cxlens.llm.bpe import ByteBpe, bpe
from cxlens.llm.slots import slot_bitmap, slot_bits

#: A chunk used more often than this in one batch is encoded for the batch, apart from its other uses.
OFTEN = 8
#: Bytes of a chunk: least, expected beyond the least, most. Rolling window.
LEAST, MASK, MOST, ROLL = 64, 255, 2048, 16

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WORD = _LETTER.copy()
_WORD[48:58] = True


def rolling_cuts(data: np.ndarray) -> np.ndarray:
    """Places in an array of bytes where the hash of the ROLL bytes before them has the cutting pattern."""
    if len(data) <= ROLL:
        return np.zeros(0, np.int64)
    word = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    h = word[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[8:]
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + ROLL


def chunk_ends(data: np.ndarray, candidates: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; they fall between code points."""
    ends, at, n = [], 0, len(data)
    while n - at > LEAST:
        k = int(np.searchsorted(candidates, at + LEAST))
        end = min(int(candidates[k]) if k < len(candidates) else n, at + MOST, n)
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        ends.append(end)
        at = end
    if at < n or not ends:
        ends.append(n)
    return ends


def certain(data: np.ndarray) -> np.ndarray:
    """Places of blanks at which every encoding of a text with these bytes begins a pre-token."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[1:-1] == 32) & _WORD[data[:-2]] & _LETTER[data[2:]]) + 1


def join_parts(tok: ByteBpe, parts: list[np.ndarray]) -> np.ndarray:
    """Ids of the whole text from the ids of its consecutive pieces."""
    if len(parts) == 1:
        return parts[0]
    out, open_bytes = [], b""
    for ids in parts:
        raw = tok.decode_bytes(ids)
        places = certain(np.frombuffer(raw, np.uint8))
        if not len(places):
            open_bytes += raw
            continue
        first, last = int(places[0]), int(places[-1])
        ends = np.cumsum(tok.lengths[ids])
        i, j = int(np.searchsorted(ends, first)) + 1, int(np.searchsorted(ends, last)) + 1
        if ends[i - 1] != first or ends[j - 1] != last:
            raise AssertionError("an encoding does not part at a certain place")
        out += [tok.encode((open_bytes + raw[:first]).decode()), ids[i:j]]
        open_bytes = raw[last:]
    out.append(tok.encode(open_bytes.decode()))
    return np.concatenate(out).astype(tok.dtype)


def digests(tok: ByteBpe, ids: np.ndarray) -> tuple[int, str, str]:
    text = tok.decode_bytes(ids).decode("utf-8", "replace")
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _chunks(column, tok: ByteBpe):
    """(row, text in bytes, chunk ends) of each text; texts with special strings are one chunk."""
    for i, value in enumerate(column):
        raw = value.as_py().encode()
        data = np.frombuffer(raw, np.uint8)
        whole = any(s in raw for s in tok.special)
        yield i, raw, None if whole else chunk_ends(data, rolling_cuts(data))


def _hash(chunk: bytes) -> int:
    from xxhash import xxh3_128_intdigest
    return xxh3_128_intdigest(chunk)


def _halves(h: int) -> tuple[int, int]:
    a, b = h >> 64, h & (1 << 64) - 1
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and ids (binary, little-endian, 2 bytes an id, or 4 for large vocabularies), a row for each input row.

    Cases are as in ``codec_report``.
    """
    return _assembled(docs, tokenizer, text, key, lambda tok, ids: (ids.tobytes(),), "ids binary", [pa.binary()])


def codec_report(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each input row.

    Null and empty texts have no ids; repeated rows repeat; a text that holds a
    special string is encoded whole; texts without any certain place are
    encoded whole in the end; an empty table gives an empty result; other
    columns are not read.
    """
    return _assembled(docs, tokenizer, text, key, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                      [pa.int64(), pa.string(), pa.string()])


def _assembled(docs: DataFrame, tokenizer: str, text: str, key: str, result, schema: str, kinds: list) -> DataFrame:
    """``result(tokenizer, ids)`` of every text, as the columns of ``schema``."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    d = d.select("doc", F.xxhash64("doc", "text").alias("row"), "text")
    kind = dict(d.dtypes)["doc"]
    names = [x.split()[0] for x in schema.split(", ")]

    def hashes(batch):
        tok, out = bpe(tokenizer), []
        for _, raw, ends in _chunks(batch.column(0), tok):
            if ends:
                out += [_hash(raw[a:b]) >> 64 for a, b in zip([0, *ends], ends)]
        return np.array(out, np.uint64), None

    n_bytes = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shared = spark.sparkContext.broadcast(slot_bitmap(d.select("text"), hashes, slot_bits(n_bytes // (LEAST + MASK))))

    def flagged(batch, at: int):
        """(row, text, [(a, b, hash)] of all chunks, whether each may be shared)."""
        tok = bpe(tokenizer)
        for i, raw, ends in _chunks(batch.column(at), tok):
            spans = [] if ends is None else list(zip([0, *ends], ends))
            hs = [_hash(raw[a:b]) for a, b in spans]
            on = shared.value.passes(np.array([h >> 64 for h in hs], np.uint64)) if hs else []
            yield i, raw, spans, hs, on

    def own(batches):
        """Runs of chunks that nobody shares, encoded here; a text without shared chunks is done (seq -1)."""
        tok = bpe(tokenizer)
        for batch in batches:
            rows = []
            for i, raw, spans, _, on in flagged(batch, 2):
                if not any(on):
                    rows.append((i, -1, None, *result(tok, tok.encode(raw.decode()))))
                    continue
                k = 0
                while k < len(spans):
                    if on[k]:
                        k += 1
                        continue
                    begin = k
                    while k < len(spans) and not on[k]:
                        k += 1
                    ids = tok.encode(raw[spans[begin][0]:spans[k - 1][1]].decode())
                    rows.append((i, begin, ids.tobytes(), *[None] * len(names)))
            cols = list(zip(*rows)) or [[] for _ in range(3 + len(names))]
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cols[1], pa.int32()),
                                              pa.array(cols[2], pa.binary()), *(pa.array(c, t) for c, t in zip(cols[3:], kinds))],
                                             ["doc", "row", "seq", "part", *names])

    def uses(batches):
        """The chunks that may be shared; the first of a kind in a batch brings its text.

        ``apart`` is 0, and for a chunk used often in the batch the batch's own number: however many
        documents hold a chunk, its uses then lie in many tasks.
        """
        for batch in batches:
            rows, met = [], Counter()
            for i, raw, spans, hs, on in flagged(batch, 2):
                for k, h in enumerate(hs):
                    if on[k]:
                        rows.append((i, k, h, None if h in met else raw[slice(*spans[k])]))
                        met[h] += 1
            apart = batch.column(1)[0].as_py() if batch.num_rows else 0
            cols = list(zip(*((i, k, *_halves(h), apart if met[h] > OFTEN else 0, chunk) for i, k, h, chunk in rows))) or [[]] * 6
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cols[1], pa.int32()),
                                              pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()),
                                              pa.array(cols[5], pa.binary())], ["doc", "row", "seq", "h0", "h1", "apart", "chunk"])

    def encode_once(batches):
        """The ids of each chunk for all its uses, which come together, one with the text first."""
        tok, last, ids = bpe(tokenizer), None, None
        for batch in batches:
            parts = []
            for *group, chunk in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6))):
                if group != last:
                    last, ids = group, tok.encode(chunk.decode()).tobytes()
                parts.append(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(parts, pa.binary())], ["doc", "row", "seq", "part"])

    def assemble(batches):
        tok, doc, parts, copies = bpe(tokenizer), None, [], 0
        out = []

        def close():
            if doc is not None:
                ids = join_parts(tok, parts)
                out.extend([(doc[0], *result(tok, ids))] * copies)

        def rows():
            cols = list(zip(*out)) or [[] for _ in range(1 + len(names))]
            batch = pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], ["doc_id", *names])
            out.clear()
            return batch

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for d_, r, seq, part, *final in zip(*(c.to_pylist() for c in batch.columns)):
                if seq < 0:
                    out.append((d_, *final))
                    continue
                if doc != (d_, r):
                    close()
                    doc, parts, copies, first, last_seq = (d_, r), [], 0, seq, None
                if seq == first:
                    copies += 1  # repeated rows bring every piece as often
                if seq != last_seq:
                    parts.append(np.frombuffer(part, tok.dtype))
                    last_seq = seq
            yield rows()
        if id_type is not None:
            close()
            yield rows()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    used = (d.mapInArrow(uses, f"doc {kind}, row long, seq int, h0 long, h1 long, apart long, chunk binary").repartition(n, "h0", "h1", "apart")
            .sortWithinPartitions("h0", "h1", "apart", F.col("chunk").isNull()).mapInArrow(encode_once, f"doc {kind}, row long, seq int, part binary"))
    void = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in schema.split(", ")]
    parts = d.mapInArrow(own, f"doc {kind}, row long, seq int, part binary, {schema}").unionByName(
        used.select("doc", "row", "seq", "part", *void))
    return parts.repartition(n, "doc", "row").sortWithinPartitions("doc", "row", "seq").mapInArrow(assemble, f"doc_id {kind}, {schema}")
