"""Merkle manifest against a brute-force tree."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cxlens.llm import merkle
from tests.llm import odd


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(digests, fanout):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def steps(tree, k, fanout):
    out = []
    for nodes in tree[:-1]:
        a = k - k % fanout
        out.append(("".join(nodes[a:k]), "".join(nodes[k + 1:a + fanout])))
        k //= fanout
    return out


def forest(rows, fanout=16):
    """(row, leaf, subroot, root, steps) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    groups = {g: sorted(groups[g], key=lambda x: x[:3]) for g in order}
    trees = {g: levels([x[2] for x in groups[g]], fanout) for g in order}
    top = levels([trees[g][-1][0] for g in order], fanout)
    for n, g in enumerate(order):
        for k, (*_, digest, r) in enumerate(groups[g]):
            yield r, digest, trees[g][-1][0], top[-1][0], steps(trees[g], k, fanout) + steps(top, n, fanout)


def brute(rows):
    out = Counter()
    for r, digest, subroot, root, path in forest(rows):
        found = digest
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            found = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
        for a, b in path:
            found = sha(a + found + b)
        out[r[0], digest, subroot, root, sha("".join(a + b for a, b in path)), found, found == root] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx string, grp int")


def rows(n, sources, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None]), rng.choice([None, "", "Text É A", f"Some Text {i}"])) for i in range(n)]


def test_odd_documents(spark):
    df = odd.frame(spark)
    data = [tuple(r) for r in df.select(*merkle.FIELDS).collect()]
    assert Counter(map(tuple, merkle.tamper_report(df).collect())) == brute(data)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [257], [1, 1], [300, 1, 16, 17, 2], [1] * 40])
def test_trees_of_many_shapes(spark, sizes):
    data, k = [], 0
    for s, n in enumerate(sizes):
        for _ in range(n):
            data.append((k, f"s{s}" if s else None, "en", k, f"Text {k}"))
            k += 1
    random.Random(2).shuffle(data)
    assert Counter(map(tuple, merkle.tamper_report(table(spark, data)).collect())) == brute(data)


def test_sources_in_the_order_of_their_bytes(spark):
    data = rows(80, [None, "", "b", "B", "é", "z", "😀", "￮"])
    assert Counter(map(tuple, merkle.tamper_report(table(spark, data)).collect())) == brute(data)


def test_repeated_rows_and_keys(spark):
    data = rows(20, ["a", None]) + [(5, "a", None, None, "Same Text")] * 40 + [(5, "a", None, None, "Other")] * 3 + [(None, "a", None, None, "No Id")] * 2
    assert Counter(map(tuple, merkle.tamper_report(table(spark, data)).collect())) == brute(data)


def test_other_fanout_and_fields(spark):
    data = rows(50, ["a", "b"])
    got = merkle.manifest(table(spark, data), fanout=3).select("doc_id", "leaf", "subroot", "root", "steps").collect()
    want = {r[0]: (d, s, t, p) for r, d, s, t, p in forest(data, 3)}
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["steps"]]) for r in got} == want


def test_empty_table(spark):
    assert merkle.tamper_report(table(spark, [])).count() == 0


def test_numbers_of_a_hot_group(spark):
    """A group over many ranges is numbered without a gap."""
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), (F.col("id") * 7919 % 5000).alias("k"))
    got = merkle.numbered(df, "g", ["k"]).collect()
    for g in ("hot", "cold"):
        mine = sorted((r["k"], r["idx"], r["size"]) for r in got if r["g"] == g)
        assert [x[1] for x in mine] == list(range(len(mine))) and {x[2] for x in mine} == {len(mine)}


def test_a_change_anywhere_shows(spark):
    data = rows(40, ["a", "b"])
    roots = {merkle.manifest(table(spark, d)).first()["root"] for d in (data, data[:-1], [*data[:-1], (*data[-1][:4], "changed")])}
    assert len(roots) == 3


def test_no_level_is_broadcast(spark, monkeypatch):
    """Files of paths are far smaller than the paths in memory, so their size must not choose a broadcast to the driver."""
    plans, real = {}, merkle.written

    def watched(df, name):
        plans[name] = plans.get(name, "") + df._jdf.queryExecution().sparkPlan().toString()
        return real(df, name)

    monkeypatch.setattr(merkle, "written", watched)
    data = rows(600, ["a", "b", None]) + [(1000, "alone", "en", 1, "Text")]
    out = merkle.tamper_report(table(spark, data))
    plans["result"] = out._jdf.queryExecution().sparkPlan().toString()
    joined = [n for n, p in plans.items() if "Join" in p and n != "merkle-numbered"]
    assert {"merkle-paths", "merkle-groups", "result"} <= set(joined)
    assert not [n for n in joined if "Broadcast" in plans[n]]
    assert Counter(map(tuple, out.collect())) == brute(data)
