"""SimHash near-duplicates with pigeonring filtering.

Documents become 64-bit fingerprints; documents with equal fingerprints are
one class. Two fingerprints that differ in at most ``distance`` bits are
linked. Candidates come from the pigeonring principle: cut the bits into
``SEGMENTS`` segments on a ring. If all differences sum to at most
``distance``, some chain of consecutive segments has every prefix of length l
within its share ``l * distance / SEGMENTS``. With seven segments and four
bits that means, for chains of three: the first segment is equal and the two
next differ in one bit together at most. So each fingerprint is filed under
its seven exact chains (27 or 28 bits each) and looked up under each chain
with at most one bit flipped. A candidate must then pass the whole chain,
prefix by prefix, before its full Hamming distance is taken.

Equal keys meet in one task, sorted. Of the links found for a key only a
spanning forest is passed on, so a large group of near copies costs as many
rows as it has fingerprints, not pairs. The filed rows of each key are counted:
what is looked up under a key is filed under its flips, so the largest count
bounds the rows of any key. If some key may have more than ``TILE``, all rows
are counted, and such a key is dealt into parts of a tile of filed and a tile
of looked-up fingerprints, compared in several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cxlens.llm.common import bounded_batches, components, written

BITS, SEGMENTS, CHAIN = 64, 7, 3
#: Rows under one key that one task compares with one another.
TILE = 4096
SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority bit of the XXH64 of all word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only ASCII letters and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) < shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip(np.concatenate(([0], ends[:-1] + 1))[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        part = h[a:a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long), one row for each input row."""
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def hashed(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return d.mapInArrow(hashed, f"doc_id {dict(d.dtypes)['doc_id']}, fp long")


def _segments() -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [BITS * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _share(length: int, distance: int) -> int:
    """Differences that a chain prefix of this length may hold."""
    return length * distance // SEGMENTS


def _chains(fp: np.ndarray) -> list[np.ndarray]:
    """For each start on the ring the bits of ``CHAIN`` consecutive segments, the first lowest."""
    seg = _segments()
    value = [(fp >> np.uint64(a)) & np.uint64((1 << w) - 1) for a, w in seg]
    out = []
    for i in range(SEGMENTS):
        at, x = 0, np.zeros_like(fp)
        for k in range(CHAIN):
            j = (i + k) % SEGMENTS
            x |= value[j] << np.uint64(at)
            at += seg[j][1]
        out.append(x)
    return out


def _keyed(distance: int):
    """Flips of a chain that its first CHAIN shares allow, for each start."""
    seg = _segments()
    shares = [_share(k + 1, distance) for k in range(CHAIN)]
    if shares != [0, 1, 1] and shares != [0, 0, 1] and shares != [0, 0, 0]:
        raise ValueError("chains here are probed with one flipped bit at most")
    flips = []
    for i in range(SEGMENTS):
        widths = [seg[(i + k) % SEGMENTS][1] for k in range(CHAIN)]
        free = range(sum(widths[:shares.index(1)]), sum(widths)) if 1 in shares else ()
        flips.append([0, *(1 << b for b in free)])
    return flips


def filed_keys(fp: np.ndarray) -> np.ndarray:
    """The keys under which fingerprints are filed, for each start after the other."""
    return np.concatenate([c * np.uint64(SEGMENTS) + np.uint64(i) for i, c in enumerate(_chains(fp))])


def keys_of(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, filed) rows: exact chains are filed, flipped ones are looked up."""
    keys, owners, filed = [], [], []
    for i, (chain, flips) in enumerate(zip(_chains(fp), _keyed(distance))):
        for f in flips:
            keys.append((chain ^ np.uint64(f)) * np.uint64(SEGMENTS) + np.uint64(i))
            owners.append(fp)
            filed.append(np.full(len(fp), f == 0))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(filed)


def ring_distance(a: np.ndarray, b: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs pass every prefix of the whole chain from ``start``, and so the full distance."""
    diff = a ^ b
    ok, total = np.ones(len(diff), bool), np.zeros(len(diff), np.int64)
    per = np.stack([np.bitwise_count((diff >> np.uint64(lo)) & np.uint64((1 << w) - 1)) for lo, w in _segments()])
    rows = np.arange(len(diff))
    for k in range(SEGMENTS):
        total += per[(start + k) % SEGMENTS, rows]
        ok &= total <= _share(k + 1, distance)
    return ok


def spanning_forest(links: np.ndarray) -> np.ndarray:
    """A spanning forest of the linked pairs (n, 2)."""
    links = links[links[:, 0] != links[:, 1]]
    ids, at = np.unique(links, return_inverse=True)
    ends, parent, keep = at.reshape(-1, 2), np.arange(len(ids)), []
    rows = np.arange(len(links))
    while len(rows):
        # Each root that has smaller ones beside it moves to the smallest, by one link.
        root = parent[ends[rows]]
        low, high = root.min(axis=1), root.max(axis=1)
        live = low != high
        rows, low, high = rows[live], low[live], high[live]
        order = np.lexsort((low, high))
        high = high[order]
        first = order[np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1]))[:len(high)])]
        keep.append(rows[first])
        parent[root.max(axis=1)[live][first]] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return links[np.concatenate(keep)] if keep else links


def linked_pairs(key: np.ndarray, fp: np.ndarray, filed: np.ndarray, distance: int, part: np.ndarray | None = None) -> np.ndarray:
    """Links among rows sorted by key (and part), reduced to a spanning forest for each."""
    part = np.zeros(len(key), np.int64) if part is None else part
    edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True])))
    n_filed = np.add.reduceat(filed.astype(np.int64), edge[:-1]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(edge)
    out, small = [], (n_filed > 0) & (size > 1) & (size <= 8)
    # Small groups all at once: compare rows k places apart.
    row_ok = np.repeat(small, size)
    group = np.repeat(np.arange(len(size)), size)
    for k in range(1, 8):
        i = np.flatnonzero(row_ok[:-k] & (group[:-k] == group[k:])) if len(key) > k else np.zeros(0, np.int64)
        i = i[(filed[i] | filed[i + k]) & (fp[i] != fp[i + k])]
        i = i[ring_distance(fp[i], fp[i + k], (key[i] % np.uint64(SEGMENTS)).astype(np.int64), distance)]
        out.append(np.stack((fp[i], fp[i + k]), axis=1))
    for g in np.flatnonzero((n_filed > 0) & (size > 8)).tolist():
        x, y = np.unique(fp[edge[g]:edge[g + 1]][filed[edge[g]:edge[g + 1]]]), np.unique(fp[edge[g]:edge[g + 1]])
        start, found = int(key[edge[g]] % np.uint64(SEGMENTS)), []
        for a in range(0, len(x), 256):
            block = np.bitwise_count(x[a:a + 256, None] ^ y[None, :]) <= distance
            i, j = np.nonzero(block)
            i, j = x[a + i], y[j]
            ok = (i != j)
            i, j = i[ok], j[ok]
            ok = ring_distance(i, j, np.full(len(i), start), distance)
            found = [spanning_forest(np.concatenate((*found, np.stack((i[ok], j[ok]), axis=1))))]
        out += found
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, fp, filed) with their ``part``: 0, or for keys of more than TILE rows each pair of tiles.

    There a filed row also is a looked-up one: it comes once for each tile of looked-up rows as filed,
    and like every row once for each tile of filed ones as looked up.
    """
    sizes = rows.groupBy("key").agg(F.sum(F.col("filed").cast("long")).alias("x"), F.count("*").alias("y"))
    sizes = written(sizes.where((F.col("x") > 0) & (F.col("y") > TILE)), "simhash-sizes")
    if sizes.isEmpty():
        return rows.select("key", "fp", "filed", F.lit(0).cast("long").alias("part"))
    tiles = sizes.select("key", F.ceil(F.col("x") / TILE).alias("nx"), F.ceil(F.col("y") / TILE).alias("ny"))
    of_x, of_y = (F.pmod(F.xxhash64("fp"), F.col(c)) for c in ("nx", "ny"))
    as_x = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1), lambda j: F.struct(F.lit(True).alias("filed"), (of_x * F.col("ny") + j).alias("part")))
    as_y = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1), lambda i: F.struct(F.lit(False).alias("filed"), (i * F.col("ny") + of_y).alias("part")))
    once = F.array(F.struct(F.col("filed"), F.lit(0).cast("long").alias("part")))
    placed = F.when(F.col("nx").isNull(), once).when(F.col("filed"), F.concat(as_x, as_y)).otherwise(as_y)
    return rows.join(tiles, "key", "left").select("key", "fp", F.explode(placed).alias("p")).select("key", "fp", "p.filed", "p.part")


def link_fingerprints(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (long column fp), a spanning forest of them at least."""
    def file(batches):
        for batch in batches:
            all_fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(all_fp), 4096):
                key, fp, filed = keys_of(all_fp[at:at + 4096], distance)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(filed)], ["key", "fp", "filed"])

    def compare(batches):
        rest = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            # The last part of the last key may go on in the next batch.
            cut = int(np.searchsorted(now[0], now[0][-1]))
            cut += int(np.searchsorted(now[3][cut:], now[3][-1]))
            rest = [x[cut:] for x in now]
            if cut:
                yield _links([x[:cut] for x in now])
        if rest is not None and len(rest[0]):
            yield _links(rest)

    def _links(cols):
        pairs = linked_pairs(cols[0].view(np.uint64), cols[1].view(np.uint64), cols[2], distance, cols[3]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def exact(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(filed_keys(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["key"])

    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fps = written(fps.select("fp"), "simhash-classes").repartition(n, "fp")  # few bytes, but 126 rows each: spread over all tasks
    rows = fps.mapInArrow(file, "key long, fp long, filed boolean")
    most = fps.mapInArrow(exact, "key long").groupBy("key").count().agg(F.max("count")).first()[0] or 0
    if most * max(map(len, _keyed(distance))) > TILE:
        rows = dealt(rows)
    else:
        rows = rows.select("key", "fp", "filed", F.lit(0).cast("long").alias("part"))
    links = rows.repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(compare, "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links. Null, empty and
    blank texts have fingerprint zero and are linked like any other; repeated
    rows repeat; a null doc_id belongs to its component but never names it
    unless all ids there are null; an empty table gives an empty result; other
    columns are not read.
    """
    fps = written(fingerprints(docs, shingle, text, key), "simhash-fp")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    joined = components(link_fingerprints(classes, distance), "simhash")
    label = classes.join(joined, classes.fp == joined.id, "left").select("fp", "low", F.coalesce("component", "fp").alias("comp"))
    label = written(label, "simhash-label")
    smallest = label.groupBy("comp").agg(F.min("low").alias("component_id"))
    label = label.join(smallest, "comp").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
