"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors go to the shards of their ``OVERLAP`` nearest centroids (fitted on a
bounded sample). Within a shard each vector keeps the neighbours that robust
pruning leaves of its nearest ones; the adjacency lists of all shards are
united into one flat graph. Every vector is then a query in each of its
shards: a greedy search with a beam, started at medoids of the shard (and at
the vector itself), walks the part of the united graph whose ends lie in that
shard, edges that other shards found included; once the beam holds a vector
within range, the search expands through everything in range until nothing new
turns up. What it finds is verified by the cosine in double precision.

Verified links join vectors to components. The links of a vector are then
counted within its component, all of it, in tiles: a link counts at both ends
and once, whichever shards or directions found it, and one that the search
reached only by a detour counts as well. An audit compares a sample of queries with
brute force over all vectors; while the mean recall of those that have a link is under the target, the overlap and the beam are
widened and the search is run again, at last over all shards.

A shard or a component with more than ``BLOCK`` vectors (a large group of near
copies, say) is split into blocks; queries meet each block in a tile of their
own, so no task holds more than two blocks. Each tile passes on a spanning
forest of its links, not the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cxlens.llm.common import components, written
from cxlens.llm.simhash import spanning_forest

SAMPLE, AUDIT = 8192, 1024
SHARD, BLOCK = 1500, 4000
OVERLAP, BEAM = 4, 32
DEGREE, POOL, ALPHA = 16, 48, 1.2
MEDOIDS = 8
MIN_RECALL = 0.99


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, by their greatest component first."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit rows; the first centroids are spread evenly over the sample."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(sample[a:a + 1024] @ c.T).argmax(axis=1) for a in range(0, len(sample), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.sqrt((total ** 2).sum(axis=1))
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], c)
    return c


def robust_prune(x: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the pruned neighbour lists of unit rows, all rows in lock step."""
    n = len(x)
    pool = min(POOL, n - 1)
    if pool < 1:
        return []
    out = []
    for a in range(0, n, 512):
        rows = np.arange(a, min(n, a + 512))
        sim = x[rows] @ x.T
        sim[rows - a, rows] = -np.inf
        near = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
        dist = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sim, near, axis=1)))
        order = np.argsort(dist, axis=1, kind="stable")
        near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
        between = x[near]
        between = np.sqrt(np.maximum(0, 2 - 2 * (between @ between.transpose(0, 2, 1))))
        alive = np.ones(near.shape, bool)
        for _ in range(min(DEGREE, pool)):
            on = np.flatnonzero(alive.any(axis=1))
            if not len(on):
                break
            pick = alive[on].argmax(axis=1)  # the nearest that is left
            out.append(np.stack((rows[on], near[on, pick]), axis=1))
            alive[on] &= ALPHA * between[on, pick] > dist[on]
            alive[on, pick] = False
    return np.concatenate(out).tolist() if out else []


def range_search(x: np.ndarray, adjacent: np.ndarray, queries: np.ndarray, own: np.ndarray, limit: float, beam: int):
    """(query, row) pairs within ``limit``, by greedy search and range expansion over padded adjacency (-1: none)."""
    n, q = len(x), len(queries)
    if not n or not q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    beam = min(beam, n)
    middle = x.mean(axis=0)
    first = int((x @ middle).argmax())
    entry = [first]  # the medoid, then rows far from the entries so far
    far = x @ x[first]
    for _ in range(min(MEDOIDS, n) - 1):
        entry.append(int(far.argmin()))
        far = np.maximum(far, x @ x[entry[-1]])
    seen = np.zeros((q, n), bool)
    hold = np.full((q, beam), -1, np.int64)
    value = np.full((q, beam), -np.inf)
    done = np.ones((q, beam), bool)
    hits: list[tuple[np.ndarray, np.ndarray]] = []

    def visit(i: np.ndarray, r: np.ndarray):
        """Unseen pairs with their cosines; those in range are kept."""
        fresh = (r >= 0) & ~seen[i, r]
        i, r = i[fresh], r[fresh]
        if len(i):
            pair = np.unique(i * n + r)
            i, r = pair // n, pair % n
        seen[i, r] = True
        s = np.einsum("ij,ij->i", queries[i], x[r]) if len(i) else np.zeros(0)
        near = s >= limit
        hits.append((i[near], r[near]))
        return i, r, s

    def absorb(i, r, s):
        """Into the beams: for each query its best new ones join the old."""
        order = np.lexsort((-s, i))
        i, r, s = i[order], r[order], s[order]
        start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        ok = place < beam
        rows = np.unique(i)
        at = np.searchsorted(rows, i[ok])
        r2, s2 = np.full((len(rows), beam), -1, np.int64), np.full((len(rows), beam), -np.inf)
        r2[at, place[ok]], s2[at, place[ok]] = r[ok], s[ok]
        all_r, all_s = np.hstack((hold[rows], r2)), np.hstack((value[rows], s2))
        all_d = np.hstack((done[rows], r2 < 0))
        best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        hold[rows], value[rows], done[rows] = (np.take_along_axis(m, best, axis=1) for m in (all_r, all_s, all_d))

    start_i, start_r = np.repeat(np.arange(q), len(entry)), np.tile(entry, q)
    inside = np.flatnonzero(own >= 0)
    absorb(*visit(np.concatenate((start_i, inside)), np.concatenate((start_r, own[inside]))))
    while True:
        on = np.flatnonzero(~done.all(axis=1))
        if not len(on):
            break
        pick = (~done[on]).argmax(axis=1)  # beams are sorted: the best that is not expanded yet
        done[on, pick] = True
        next_r = adjacent[hold[on, pick]]
        new = visit(np.repeat(on, next_r.shape[1]), next_r.ravel())
        if len(new[0]):
            absorb(*new)
    found = [np.concatenate(z) for z in zip(*hits)]
    edge_i, edge_r = found
    while len(edge_i):  # range expansion
        hits = []
        for a in range(0, len(edge_i), 1 << 16):
            r = adjacent[edge_r[a:a + (1 << 16)]]
            visit(np.repeat(edge_i[a:a + (1 << 16)], r.shape[1]), r.ravel())
        edge_i, edge_r = (np.concatenate(z) for z in zip(*hits))
        found = [np.concatenate((f, e)) for f, e in zip(found, (edge_i, edge_r))]
    return found[0], found[1]


def _by_group(batches, key: int):
    """Tables of rows with equal values in the leading ``key`` columns, from sorted batches."""
    rest = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(key)]
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in k])) + 1 if batch.num_rows > 1 else []
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            part = batch.slice(a, b - a)
            if rest and any(rest[-1].column(c)[0].as_py() != part.column(c)[0].as_py() for c in range(key)):
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pa.Table.from_batches(rest)


def _lists(table: pa.Table, k: int) -> np.ndarray:
    return _matrix(pa.concat_arrays(table.column(k).chunks))


def in_blocks(members: DataFrame, group: str) -> DataFrame:
    """Members with ``block``, one of the ``blocks`` of at most about BLOCK members that their group is dealt into."""
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))


def in_tiles(members: DataFrame, group: str, columns: list[str], of_index: dict[str, str]) -> DataFrame:
    """(group, block, tile, role, vec, columns): in each pair of a group's blocks the index rows (role 0) of one and the queries (role 1) of the other.

    ``of_index``: further columns with their types that only index rows carry.
    """
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    index = members.select(group, "block", every.alias("tile"), F.lit(0).alias("role"), "vec", *columns, *of_index)
    query = members.select(group, every.alias("block"), F.col("block").alias("tile"), F.lit(1).alias("role"), "vec", *columns,
                           *[F.lit(None).cast(k).alias(c) for c, k in of_index.items()])
    return index.union(query)


def cosines(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """(a, b) cosines of unit rows. The last bits of a matrix product depend on its shape, so pairs next to the limit are summed again as ``range_search`` does."""
    s = a @ b.T
    i, j = np.nonzero(np.abs(s - limit) < 1e-12)
    if len(i):
        s[i, j] = np.einsum("ij,ij->i", a[i], b[j])
    return s


class Search:
    """The graph search over distinct vectors: vec (a long id), e (array of double) and copies (their number)."""

    def __init__(self, vectors: DataFrame, limit: float, overlap: int, beam: int):
        self.vectors, self.limit, self.beam = vectors, limit, beam
        self.spark = vectors.sparkSession
        self.n = vectors.count()
        rows = vectors.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
        sample = unit(np.array([r["e"] for r in rows], np.float64))
        self.centres = centroids(sample, max(1, min(-(-self.n // SHARD), len(sample))))
        self.overlap = min(overlap, len(self.centres))
        self.parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def assigned(self) -> DataFrame:
        """vec, e, copies, shards (the nearest ones), a row per vector."""
        centres, m = self.spark.sparkContext.broadcast(self.centres), self.overlap

        def near(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit(_matrix(batch.column(1)))
                s = x @ centres.value.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :m].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(best), pa.list_(pa.int32()))], ["vec", "e", "copies", "shards"])

        return self.vectors.select("vec", "e", "copies").mapInArrow(near, "vec long, e array<double>, copies long, shards array<int>")

    def run(self) -> DataFrame:
        """(a, b) verified links over distinct vectors that span what the search connects."""
        limit, beam = self.limit, self.beam
        placed = written(self.assigned(), "ann-assigned")
        members = in_blocks(placed.select(F.explode("shards").alias("shard"), "vec", "e"), "shard")

        def build(batches):
            for t in _by_group(batches, 2):
                vec = t.column(2).to_numpy()
                e = np.array(robust_prune(unit(_lists(t, 3))), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(vec[e[:, 0]]), pa.array(vec[e[:, 1]])], ["a", "b"])

        edges = (members.select("shard", "block", "vec", "e").repartition(self.parts, "shard", "block")
                 .sortWithinPartitions("shard", "block", "vec").mapInArrow(build, "a long, b long"))
        both = edges.union(edges.select("b", "a")).toDF("a", "b").distinct()
        lists = both.groupBy("a").agg(F.collect_list("b").alias("adjacent"))
        indexed = members.join(lists, members.vec == lists.a, "left")
        tiles = in_tiles(indexed.select("shard", "block", "blocks", "vec", "e", "adjacent"), "shard", ["e"], {"adjacent": "array<bigint>"})

        def search(batches):
            for t in _by_group(batches, 3):
                role, vec, x = t.column(3).to_numpy(), t.column(4).to_numpy(), unit(_lists(t, 5))
                ix, qx = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
                order = ix[np.argsort(vec[ix], kind="stable")]
                ids = vec[order]
                lists = pa.concat_arrays(t.column(6).chunks).take(pa.array(order))
                sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                at = np.searchsorted(ids, flat)
                at = np.where((at < len(ids)) & (ids[np.minimum(at, max(0, len(ids) - 1))] == flat), at, -1) if len(ids) else flat
                row = np.repeat(np.arange(len(ids)), sizes)
                row, at = row[at >= 0], at[at >= 0]
                degree = np.bincount(row, minlength=len(ids))
                adjacent = np.full((len(ids), max(1, int(degree.max(initial=0)))), -1, np.int64)
                adjacent[row, np.arange(len(row)) - np.repeat(np.cumsum(degree) - degree, degree)] = at
                links = np.zeros((0, 2), np.int64)
                for a in range(0, len(qx), 1024):
                    part = qx[a:a + 1024]
                    own = np.searchsorted(ids, vec[part])
                    own = np.where((own < len(ids)) & (ids[np.minimum(own, max(0, len(ids) - 1))] == vec[part]), own, -1)
                    i, r = range_search(x[order], adjacent, x[part], own, limit, beam)
                    links = spanning_forest(np.concatenate((links, np.stack((vec[part][i], ids[r]), axis=1))))
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        return written(tiles.repartition(self.parts, "shard", "block", "tile").sortWithinPartitions("shard", "block", "tile", "role", "vec")
                       .mapInArrow(search, "a long, b long"), "ann-links")

    def link_counts(self, label: DataFrame) -> DataFrame:
        """(vec, n): the vectors within range of each one in its component, copies counted; ``label``: vec and comp of linked vectors."""
        limit = self.limit
        members = in_blocks(self.vectors.join(label, "vec").select("comp", "vec", "e", "copies"), "comp")
        tiles = in_tiles(members, "comp", ["e", "copies"], {})

        def count(batches):
            for t in _by_group(batches, 3):
                role, vec, x, copies = t.column(3).to_numpy(), t.column(4).to_numpy(), unit(_lists(t, 5)), t.column(6).to_numpy()
                ix, qx, n = np.flatnonzero(role == 0), np.flatnonzero(role == 1), []
                for a in range(0, len(qx), 1024):
                    part = qx[a:a + 1024]
                    # Sums in one order whatever the place, as the search has them: both ends of a link see one cosine.
                    near = np.concatenate([cosines(x[part], x[ix[c:c + 1024]], limit) >= limit for c in range(0, len(ix), 1024)], axis=1)
                    n.append((near & (vec[part][:, None] != vec[ix])) @ copies[ix])
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(vec[qx]), pa.array(np.concatenate(n))], ["vec", "n"])

        rows = (tiles.repartition(self.parts, "comp", "block", "tile").sortWithinPartitions("comp", "block", "tile", "role", "vec")
                .mapInArrow(count, "vec long, n long"))
        return written(rows.groupBy("vec").agg(F.sum("n").alias("n")), "ann-counts")

    def recall(self, counts: DataFrame) -> float:
        """Mean share of its links that a query has, over those of a sample that have any by brute force; 1 if none has."""
        rows = self.vectors.orderBy(F.xxhash64("vec", F.lit(1)), "vec").limit(AUDIT).collect()
        ids, q = np.array([r["vec"] for r in rows], np.int64), unit(np.array([r["e"] for r in rows], np.float64))
        limit = self.limit

        def brute(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                vec, x, copies = batch.column(0).to_numpy(), unit(_matrix(batch.column(1))), batch.column(2).to_numpy()
                n = np.zeros(len(ids), np.int64)
                for a in range(0, len(x), 4096):
                    near = (cosines(q, x[a:a + 4096], limit) >= limit) & (ids[:, None] != vec[None, a:a + 4096])
                    n += near @ copies[a:a + 4096]
                on = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(n[on])], ["vec", "n"])

        true = self.vectors.select("vec", "e", "copies").mapInArrow(brute, "vec long, n long").groupBy("vec").agg(F.sum("n").alias("true"))
        share = F.least("true", F.coalesce("n", F.lit(0))) / F.col("true")
        mean = true.join(counts, "vec", "left").agg(F.avg(share)).first()[0]
        return 1.0 if mean is None else mean


def _of_one_size(good: DataFrame, limit: float) -> DataFrame:
    """vec_id, n_links, component_id of valid vectors (vec_id, e) of one length."""
    classes = good.groupBy("e").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("vec", F.monotonically_increasing_id()), "ann-classes")
    overlap, beam = OVERLAP, BEAM
    while True:
        search = Search(classes, limit, overlap, beam)
        joined = written(components(search.run(), "ann").toDF("vec", "comp"), "ann-joined")
        counts = search.link_counts(joined)
        if search.recall(counts) >= MIN_RECALL or search.overlap == len(search.centres) and beam >= search.n:
            break
        overlap, beam = 2 * overlap, 4 * beam
    label = classes.join(joined, "vec", "left").select("vec", "low", F.coalesce("comp", "vec").alias("comp"))
    low = label.groupBy("comp").agg(F.min("low").alias("component_id"))
    label = written(label.join(low, "comp").select("vec", "component_id"), "ann-label")
    keyed = (classes.join(label, "vec").join(counts, "vec", "left")
             .select("e", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return good.join(keyed, "e").select("vec_id", "n_links", "component_id")


def near_duplicates(vectors: DataFrame, limit: float = 0.95, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing (n_links 0, component_id
    the own id). Vectors of different lengths have no cosine; each length is searched on its own, one after the other. Equal vectors are one while searching
    and count as many. Repeated ids are rows of their own; a null id is its own component unless linked. An
    empty table gives an empty result; other columns are not read.
    """
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = F.coalesce(~bad & F.exists("e", lambda x: x != 0), F.lit(False))
    v = written(v.select("vec_id", F.when(valid, F.col("e")).alias("e"), F.when(valid, F.size("e")).alias("size")), "ann-vectors")
    out = v.where("size is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for size in sorted(r["size"] for r in v.where("size is not null").select("size").distinct().collect()):  # the lengths there are
        out = out.union(_of_one_size(v.where(F.col("size") == size).select("vec_id", "e"), limit))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
