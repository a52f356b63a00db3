"""Ranked lexical search: accumulator-limited, term at a time, over blocks of documents.

Per block of query items (``ITEM_TERMS`` of their terms, broadcast) one pass
over the texts leaves a forward table, each document's length and the counts
of the query's terms in it; N, L and every df are sums over that table. The
table is then read in blocks of documents. A block inverts its rows and takes
the terms of an item one after the other, the rarest first. Each posting adds
to its document's accumulator; a term's greatest share in the block, times its
weight, bounds what it can still add. Once the bounds of all terms to come sum
to less than the kth partial score, no document without an accumulator can
reach the top k, and none is created any more; those that exist go on being
updated exactly. Each block passes on its best k, and the best k of those are
the answer, so nothing is cut off.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cxlens.llm.common import written

#: Terms of the query items that one pass carries, in expectation: the bound of its broadcast.
ITEM_TERMS = 1 << 18
#: Postings that a block of documents holds at least, before it is searched.
BLOCK_POSTINGS = 1 << 20
#: Bytes of a text split into terms at a time.
SEGMENT = 1 << 20
#: Blocks whose best documents meet in one task at first.
GROUP = 64
NO_ID = (1 << 63) - 1

_TERM, _BREAK = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: str | None):
    """Lists of the terms of a text, segment by segment; only A-Z are lower-cased."""
    data = (text or "").encode().translate(_LOWER)
    at = 0
    while at < len(data):
        cut = _BREAK.search(data, at + SEGMENT)
        end = cut.start() if cut else len(data)
        yield _TERM.findall(data, at, end)
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _measures(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document."""
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 75 + 25 * n * n_docs // max(1, n_terms)


class Block:
    """Inverted lists of a block of documents."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, terms: list[bytes], counts: list[bytes], n_docs: int, n_terms: int, vocabulary: int):
        term = np.frombuffer(b"".join(terms), "<u4")
        tf = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
        of = np.repeat(np.arange(len(doc)), [len(x) // 4 for x in terms])
        order = np.argsort(term, kind="stable")
        self.doc, self.of, tf = doc, of[order], tf[order]
        self.share = 1_000_000_000 * tf // (1000 * tf + 12 * _measures(n, n_docs, n_terms)[self.of])
        self.begin = np.searchsorted(term[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        held = np.flatnonzero(np.diff(self.begin))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.share, self.begin[held])

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, scores) of the best ``k`` by score and doc_id; ``terms`` come rarest first."""
        held = (self.most[terms] > 0) & (weights > 0)
        terms, weights = terms[held], weights[held]
        bounds = self.most[terms] * weights
        to_come = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        score, has = np.zeros(len(self.doc), np.int64), np.zeros(len(self.doc), bool)
        survivors = None  # documents with an accumulator, once no more are created
        for j, (t, w) in enumerate(zip(terms.tolist(), weights.tolist())):
            a, b = self.begin[t], self.begin[t + 1]
            of, gain = self.of[a:b], self.share[a:b]
            if survivors is None:
                score[of] += w * gain
                has[of] = True
                if to_come[j + 1] < score.max():
                    held = np.flatnonzero(has)
                    if len(held) >= k and to_come[j + 1] < np.partition(score[held], len(held) - k)[len(held) - k]:
                        survivors = held
            elif 16 * len(survivors) < len(of):
                at = np.minimum(np.searchsorted(of, survivors), len(of) - 1)
                met = of[at] == survivors
                score[survivors[met]] += w * gain[at[met]]
            else:
                met = has[of]
                score[of[met]] += w * gain[met]
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((self.doc[found], -score[found]))][:k]
        return found, score[found]


def forward_table(docs: DataFrame, vocabulary, text: str, key: str) -> DataFrame:
    """doc_id, n, and the query terms of each document with at least one term (ids and counts, 4 bytes each); written.

    ``vocabulary``: broadcast map of terms to ids.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def counted(batches):
        get = vocabulary.value.get
        for batch in batches:
            keep, n, terms, counts = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                total, met = 0, []
                for part in terms_of(value.as_py()):
                    total += len(part)
                    met += [t for t in map(get, part) if t is not None]
                if total:
                    ids, c = np.unique(np.array(met, "<u4"), return_counts=True)
                    keep.append(i)
                    n.append(total)
                    terms.append(ids.tobytes())
                    counts.append(c.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.binary()),
                                              pa.array(counts, pa.binary())], ["doc_id", "n", "terms", "counts"])

    return written(d.mapInArrow(counted, "doc_id long, n long, terms binary, counts binary"), "lexical-forward")


def document_frequencies(forward: DataFrame, vocabulary: int) -> np.ndarray:
    """df of every term id; each task adds up its own documents first."""
    def count(batches):
        df = np.zeros(vocabulary, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=vocabulary)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    out = np.zeros(vocabulary, np.int64)
    for t, df in forward.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # the vocabulary at most
        out[t] = df
    return out


def _best(rows: DataFrame, keys: list[str], k: int, out: str) -> DataFrame:
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.repartition(n, *keys).withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def _search(docs: DataFrame, items: list, k: int, text: str, key: str) -> DataFrame:
    """Results of one block of items, (item_id, text) rows."""
    spark, ids, queries = docs.sparkSession, {}, []
    for _, query in items:
        counts: dict[int, int] = {}
        for part in terms_of(query):
            for t in part:
                t = ids.setdefault(t, len(ids))
                counts[t] = counts.get(t, 0) + 1
        queries.append(counts)
    vocabulary = spark.sparkContext.broadcast(ids)
    forward = forward_table(docs, vocabulary, text, key)
    n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
    df = document_frequencies(forward, len(ids))
    weights = np.array([weight(n_docs, x) for x in df.tolist()], np.int64)
    plans = []
    for (item_id, _), counts in zip(items, queries):
        terms = np.array(sorted(counts, key=lambda t: (df[t], t)), np.int64)
        plans.append((item_id, terms, weights[terms] * np.array([counts[t] for t in terms.tolist()], np.int64)))
    plans, size = spark.sparkContext.broadcast(plans), len(ids)

    def search(batches):
        from pyspark import TaskContext

        group, rest, held = TaskContext.get().partitionId() // GROUP, [], 0
        for batch in batches:
            for part in (batch.slice(a, 128) for a in range(0, batch.num_rows, 128)):
                rest.append(part)
                held += sum(map(len, part.column(2).to_pylist())) // 4
                if held >= BLOCK_POSTINGS:
                    yield from best(rest, group)
                    rest, held = [], 0
        if rest:
            yield from best(rest, group)

    def best(rows, group):
        table = pa.Table.from_batches(rows)
        doc = table.column(0).fill_null(NO_ID).to_numpy()
        block = Block(doc, table.column(1).to_numpy(), table.column(2).to_pylist(), table.column(3).to_pylist(), n_docs, n_terms, size)
        for no, (item_id, terms, w) in enumerate(plans.value):
            found, scores = block.search(terms, w, k)
            if len(found):
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([no] * n, pa.int32()), pa.array([group] * n, pa.int32()), pa.array([item_id] * n, pa.int64()),
                     pa.array(doc[found], mask=doc[found] == NO_ID), pa.array(scores)], ["item", "part", "item_id", "doc_id", "score"])

    rows = forward.mapInArrow(search, "item int, part int, item_id long, doc_id long, score long")
    rows = _best(_best(rows, ["item", "part"], k, "_place").drop("_place"), ["item"], k, "rank")
    return written(rows.select("item_id", "rank", "doc_id", "score"), "lexical-ranked")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank (from 1), doc_id, score.

    Null and empty texts have no terms: such items find nothing, such documents are not counted. Texts of any length count
    whole. Equal scores rank by doc_id, null ids last; rows that repeat a document rank one after the other, and rows that share an item_id are searched each on its own. No
    items or no documents give an empty result; other columns are not read. Keys must be integers.
    """
    spark = docs.sparkSession
    # One row for each item, dealt into blocks by its fixed row number; the sizes of its texts bound its terms.
    rows = written(items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "lexical-items")
    size = F.size(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))
    blocks = max(1, -(-(rows.agg(F.sum(size)).first()[0] or 0) // ITEM_TERMS))
    out = None
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("item_id", "text").collect()
        found = _search(docs, [tuple(r) for r in block], k, text, key) if block else None
        out = found if out is None else out if found is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
