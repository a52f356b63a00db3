"""Near-duplicate and repeated-passage operators against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from cxlens.llm import embedding_dedup, simhash, slots, suffix_dedup
from cxlens.llm.common import components
from tests.llm import brute, odd


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = brute.roots(1100, edges)
    assert got == {i: want[i] for e in edges for i in e if e[0] != e[1] or i in {x for y in edges if y[0] != y[1] for x in y}}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_fingerprint_equals_definition():
    for _, t in odd.texts():
        for shingle in (1, 4):
            assert simhash.fingerprint(t, shingle) == brute.fingerprint(t, shingle)


def test_simhash(spark):
    rows = odd.texts() + [(100 + i, odd.PROSE.replace("river", f"river{i}")) for i in range(30)]
    got = Counter(map(tuple, simhash.near_duplicates(odd.frame(spark, rows)).collect()))
    assert got == brute.simhash(rows)


@pytest.mark.parametrize("distance", [0, 2, 4])
def test_pigeonring_finds_every_pair(distance):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = [base]
    for _ in range(12):
        flip = np.zeros(30, np.uint64)
        for _ in range(distance + 1):
            flip ^= np.where(rng.random(30) < 0.7, np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64), np.uint64(0))
        fps.append(base ^ flip)
    fp = np.unique(np.concatenate(fps))
    key, owner, filed = simhash.keys_of(fp, distance)
    order = np.lexsort((filed, owner, key))
    pairs = simhash.linked_pairs(key[order], owner[order], filed[order], distance)
    at = {int(x): i for i, x in enumerate(fp)}
    got = brute.roots(len(fp), [(at[int(a)], at[int(b)]) for a, b in pairs])
    near = np.bitwise_count(fp[:, None] ^ fp) <= distance
    assert got == brute.roots(len(fp), [(i, j) for i, j in zip(*np.nonzero(near)) if j < i])
    assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= distance).all()


def test_large_keys_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 50)
    rng = np.random.default_rng(9)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 63, 200, dtype=np.uint64), np.uint64(5 << 60) + rng.integers(0, 1 << 12, 900, dtype=np.uint64)]))
    links = simhash.link_fingerprints(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), 4)
    links = [(int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))) for a, b in links.collect()]
    at = {int(x): i for i, x in enumerate(fp)}
    near = np.bitwise_count(fp[:, None] ^ fp) <= 4
    assert all(near[at[a], at[b]] for a, b in links)
    assert brute.roots(len(fp), [(at[a], at[b]) for a, b in links]) == brute.roots(len(fp), [(i, j) for i, j in zip(*np.nonzero(near)) if j < i])


def test_parts_of_a_large_key_hold_a_tile_of_each_side(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 50)
    rows = [(1, i, i % 4 == 0) for i in range(1000)] + [(2, i, True) for i in range(5)]
    got = simhash.dealt(spark.createDataFrame(rows, "key long, fp long, filed boolean")).collect()
    parts = Counter((r["key"], r["part"], r["filed"]) for r in got)
    assert max(parts.values()) <= 2 * 50 and parts[2, 0, True] == 5
    x, y = ({(r["fp"], r["part"]) for r in got if r["key"] == 1 and r["filed"] == side} for side in (True, False))
    met = {(a, b) for p in {q for _, q in x} for a in [f for f, q in x if q == p] for b in [f for f, q in y if q == p]}
    assert met == {(a, b) for a in range(0, 1000, 4) for b in range(1000)}


def test_forest_of_dense_links():
    rng = np.random.default_rng(6)
    for n, m in ((50, 2000), (400, 300), (1, 0), (30, 5)):
        links = rng.integers(0, n, (m, 2)).astype(np.uint64)
        kept = simhash.spanning_forest(links)
        assert brute.roots(n, kept.astype(int).tolist()) == (want := brute.roots(n, links.astype(int).tolist())) and len(kept) == n - len(set(want))


def repeats():
    rng = random.Random(11)
    word = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta"]
    shared = [" ".join(rng.choice(word) for _ in range(rng.randint(8, 40))) for _ in range(6)]
    out = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(f"{rng.choice(word)}{rng.randint(0, 999)}" for _ in range(rng.randint(1, 30))) for _ in range(6)]
        out.append((200 + rng.randint(0, 50), rng.choice([" ", "", "|"]).join(parts)))
    return out + [(300, "a" * 49), (301, "a" * 50), (302, "a" * 51), (303, "ab" * 40)]


@pytest.mark.parametrize("depth", [50, 67])
def test_removal_equals_brute_force(spark, depth):
    rows = [r for r in odd.texts() if r[0] != 8] + repeats()
    got = Counter(map(tuple, suffix_dedup.removal_report(odd.frame(spark, rows), depth).collect()))
    assert got == brute.removal(rows, depth)


def test_no_task_holds_a_crowded_anchor(spark, monkeypatch):
    real, most = suffix_dedup._classes, 40

    def watched(depth):
        inner = real(depth)

        def run(batches):
            met = Counter()

            def seen():
                for batch in batches:
                    met.update(batch.column(0).to_pylist())
                    assert max(met.values(), default=0) <= most
                    yield batch
            yield from inner(seen())
        return run

    monkeypatch.setattr(suffix_dedup, "CROWD", most, raising=False)
    monkeypatch.setattr(suffix_dedup, "_classes", watched)
    rng = random.Random(8)
    rows = [(i, f"{rng.getrandbits(200):x} {odd.PASSAGE} {rng.getrandbits(200):x}") for i in range(300)] + repeats()
    got = Counter(map(tuple, suffix_dedup.removal_report(odd.frame(spark, rows)).collect()))
    assert got == brute.removal(rows)


def test_owner_runs_of_crowded_anchors(spark):
    rows = [(1, 5, 9, "abcde"), (2, 3, 4, "xabcd"), (2, 6, 6, "xabcd"), (3, 5, 5, "zzz"), (4, 1, 1, "bcdy")]
    df = spark.createDataFrame([(*r, w.encode()) for *r, w in rows], "cls long, lo long, hi long, span binary")
    got = sorted(map(tuple, suffix_dedup.crowded_owners(df, 3).collect()))
    assert got == [(1, 0, 0, 3), (1, 1, 1, 1), (1, 2, 2, 5), (2, 0, 1, 3), (2, 2, 2, 1), (4, 0, 0, 1)]


def test_removal_of_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    raw = [t.encode() for _, t in repeats()] + [(" ".join(t for _, t in repeats())).encode()]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    h, p, a, b, t = suffix_dedup.batch_anchors(data, offsets, 50)
    covered = Counter((int(x), int(s)) for x, lo, hi in zip(t, a, b) for s in range(lo, hi + 1))
    assert covered == Counter((i, int(offsets[i]) + s) for i, r in enumerate(raw) for s in range(max(0, len(r) - 49)))
    assert ((p - a >= 0) & (p - b >= 0) & (p - a <= 34)).all()


def _peak(run):
    import tracemalloc
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_batch_is_sieved_in_little_memory():
    rng = np.random.default_rng(5)
    data, offsets = rng.integers(97, 123, 7 << 20, dtype=np.uint8), np.arange(0, (7 << 20) + 1, 2048, dtype=np.int64)
    bitmaps = [slots.Bitmap(rng.integers(0, 4, 1 << 17, dtype=np.uint8)) for _ in range(2)]
    assert _peak(lambda: suffix_dedup.survivors(data, offsets, 50, None, bitmaps)) < 24 << 20  # 55 MB with all anchors at once
    whole = suffix_dedup._sieved(data, *suffix_dedup.batch_anchors(data, offsets, 50), None, bitmaps, (0, 1))
    got = suffix_dedup.survivors(data, offsets, 50, None, bitmaps)
    assert len(got[0]) and all((x == y).all() for x, y in zip(got, whole))


def test_windows_are_read_in_little_memory():
    rng, k = np.random.default_rng(6), 8192
    spans, at, anchor = rng.integers(0, 255, k * 67, dtype=np.uint8), np.arange(k) * 67, np.arange(k) // 4
    n = np.full(k, 18)
    assert _peak(lambda: suffix_dedup.window_owners(anchor, n - 1, np.arange(k), n, spans, at, 50)) < 48 << 20  # 83 MB with a place for each byte


def test_remove_repeats_keeps_columns_and_cuts_texts(spark):
    df = odd.frame(spark)
    got = suffix_dedup.remove_repeats(df)
    assert got.columns == df.columns
    texts = {(r["doc_id"]): r["text"] for r in got.where("doc_id in (4, 11, 12, 1, 3)").collect() if r["doc_id"] != 12 or r["text"].startswith("Head")}
    assert texts[4] is None and texts[1] == odd.PROSE and texts[11].startswith("Head one.")
    assert odd.PASSAGE not in texts[12] and texts[12].startswith("Head two")


def test_refine_keeps_exactly_equal_rows():
    rng = np.random.default_rng(2)
    digits = rng.integers(0, 2, (400, 5)).astype(np.uint64)
    start = rng.integers(0, 3, 400)
    rows, group = suffix_dedup.refine(start, digits)
    keys = [(int(s), *d.tolist()) for s, d in zip(start, digits)]
    many = Counter(keys)
    assert sorted(rows.tolist()) == [i for i, k in enumerate(keys) if many[k] > 1]
    assert len({keys[r] for r in rows}) == len(set(group.tolist())) == len({(keys[r], int(g)) for r, g in zip(rows, group)})


def vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups = [x[i] + rng.normal(scale=0.03, size=(n, 16)) for i, n in ((0, 60), (1, 25), (2, 5))]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([x, *groups]))]
    rows += [(1000, rows[7][1]), (1001, rows[7][1]), (1002, [2 * c for c in rows[8][1]])]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] + [0.0] * 15), (2005, [None] + [1.0] * 15), (2006, [1.0] * 3)]
    return rows, bad


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)  # tiles too
    rows, bad = vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, label int, copies string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    want = brute.links(dict(rows))
    assert {i: got[i] for i, _ in bad} == {i: (0, i, True) for i, _ in bad}
    assert set(got) == set(want) | {i for i, _ in bad}
    assert {i: got[i][0] for i in want} == {i: n for i, (n, _) in want.items()}
    assert {i: got[i][1] for i in want} == {i: c for i, (_, c) in want.items()}
    assert all(k == (c == i) for i, (_, c, k) in got.items())


def test_links_within_every_length(spark):
    """Lengths are searched apart; a rare one is not left out. Null and repeated ids, and equal vectors."""
    rng = np.random.default_rng(8)
    eights = [(i, rng.normal(size=8).tolist()) for i in range(20)]
    rows = eights + [(100, [1.0, 2.0, 3.0]), (101, [2.0, 4.0, 6.0]), (102, [1.0, 2.0, 3.1]), (103, [-1.0, 0.0, 0.0]), (104, [5.0]), (105, [7.0]), (106, [-7.0]),
                     (200, eights[0][1]), (200, eights[0][1]), (None, eights[1][1]), (None, [9.0, 1.0, 1.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    seen = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    want = Counter({(i, 0, i): 1 for i in range(2, 20)} | {(0, 2, 0): 1, (200, 2, 0): 2, (1, 1, 1): 1, (None, 1, 1): 1, (None, 0, None): 1, (103, 0, 103): 1,
                    (100, 2, 100): 1, (101, 2, 100): 1, (102, 2, 100): 1, (104, 1, 104): 1, (105, 1, 104): 1, (106, 0, 106): 1})
    assert seen == want


def test_links_at_exactly_the_limit(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [-4.0, 3.0]), (4, [0.0, 2.0])]  # cosines 0.6, -0.8, 0, 0, 0.8, 0.6
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.6).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (2, 1)}


def test_robust_prune_keeps_the_nearest():
    x = embedding_dedup.unit(np.random.default_rng(1).normal(size=(200, 8)))
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    edges = set(map(tuple, embedding_dedup.robust_prune(x)))
    assert all((i, int(j)) in edges for i, j in enumerate(sim.argmax(axis=1)))
    assert max(Counter(a for a, _ in edges).values()) <= embedding_dedup.DEGREE


def test_empty_tables(spark):
    none = odd.frame(spark, [])
    assert simhash.near_duplicates(none).count() == 0
    assert suffix_dedup.removal_report(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0


def test_removal_in_ranges_of_hashes(spark, monkeypatch):
    """A bitmap too small for all anchors: several ranges, one after the other, the same bytes removed."""
    from cxlens.llm import slots
    monkeypatch.setattr(slots, "CHUNKS", 4)
    monkeypatch.setattr(slots, "MAX_SLOT_BITS", 11)
    monkeypatch.setattr(slots, "LEAST_SLOT_BITS", 11)
    rows = [r for r in odd.texts() if r[0] != 8] + repeats()
    n = sum(len((t or "").encode()) for _, t in rows)
    assert slots.ranges(2 * n // 36) > 1
    got = Counter(map(tuple, suffix_dedup.removal_report(odd.frame(spark, rows)).collect()))
    assert got == brute.removal(rows)


def _small_bitmaps(monkeypatch):
    monkeypatch.setattr(slots, "CHUNKS", 4)
    monkeypatch.setattr(slots, "MAX_SLOT_BITS", 11)
    monkeypatch.setattr(slots, "LEAST_SLOT_BITS", 11)


@pytest.mark.parametrize("depth", [50, 67])
def test_removal_beyond_the_largest_bitmap_finds_anchors_once(spark, monkeypatch, depth):
    """However many ranges the bitmaps would take, texts are packed once and spans written once."""
    from cxlens.llm import packs
    names, real = Counter(), suffix_dedup.written

    def counted(df, name, *more):
        names[name] += 1
        return real(df, name, *more)

    _small_bitmaps(monkeypatch)
    monkeypatch.setattr(packs, "CHUNK_KEYS", 50)
    monkeypatch.setattr(suffix_dedup, "written", counted)
    rows = [r for r in odd.texts() if r[0] != 8] + repeats()
    assert slots.ranges(2 * sum(len((t or "").encode()) for _, t in rows) // (depth - 14)) > 1
    got = Counter(map(tuple, suffix_dedup.removal_report(odd.frame(spark, rows), depth).collect()))
    assert got == brute.removal(rows, depth)
    assert names["suffix-spans"] == names["suffix-packs"] == 1


def test_crowded_anchors_beyond_the_largest_bitmap(spark, monkeypatch):
    _small_bitmaps(monkeypatch)
    test_no_task_holds_a_crowded_anchor(spark, monkeypatch)


@pytest.mark.parametrize("beyond", [False, True])
def test_removal_of_a_few_bytes(spark, monkeypatch, beyond):
    if beyond:
        monkeypatch.setattr(suffix_dedup, "ranges", lambda hashes: 2)
    rows = [(1, "abc"), (2, "abc"), (3, ""), (4, None)]
    got = Counter(map(tuple, suffix_dedup.removal_report(odd.frame(spark, rows)).collect()))
    assert got == brute.removal(rows)


def test_anchors_of_runs(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    raw = [b"", b"x" * 49, *[t.encode() for _, t in repeats()], b"short", " ".join(t for _, t in repeats()).encode(), b""]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    for depth in (50, 67):
        h, p, a, b, t = want = suffix_dedup.batch_anchors(data, offsets, depth)
        got = suffix_dedup.anchors_of_runs(data, offsets, p - a, b - a, depth)
        assert len(h) and all((x == y).all() for x, y in zip(got, want))
        none = np.zeros(0, np.int64)
        assert not len(suffix_dedup.anchors_of_runs(data[:20], np.array([0, 0, 20]), none, none, depth)[0])


@pytest.mark.parametrize("tagged", [False, True])
def test_marks_of_packs(spark, monkeypatch, tagged):
    """Keys that several packs send, or send with several tags, and those that stand for many rows."""
    from cxlens.llm import packs
    monkeypatch.setattr(packs, "CHUNK_KEYS", 10)
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    chunks, many = packs.chunks_for(100), 6
    sent = {}
    for pack in range(9):
        keys = np.unique(packs.placed(rng.choice(words, pack * 4, replace=False), chunks))
        sent[pack] = (keys, (keys % np.uint64(7) + (rng.random(len(keys)) < 0.2)).astype(np.uint64), rng.integers(1, 3, len(keys)))

    def keys_of(batch):
        for pack in batch.column(0).to_pylist():
            keys, tag, n = sent[pack]
            yield pack, keys, tag if tagged else None, n if tagged else None

    marks = packs.marked(spark.range(9), keys_of, "test-marks", many)
    met, tags, rows = Counter(), {}, Counter()
    for keys, tag, n in sent.values():
        for k, g, c in zip(keys.tolist(), tag.tolist(), n.tolist()):
            met[k] += 1
            tags.setdefault(k, set()).add(g)
            tags[k] |= {-1, -2} if c > 1 else set()  # two tags in one pack
            rows[k] += c
    for pack, (keys, _, _) in sent.items():
        got = [x.tolist() for x in marks.of(pack, keys)]
        more = [len(tags[k]) > 1 if tagged else met[k] > 1 for k in keys.tolist()]
        assert got == [more, [tagged and m and rows[k] > many for m, k in zip(more, keys.tolist())]]
    assert marks.crowded == tagged


def test_share_of_slots_set_at_scale():
    """As many anchors as 30 GB of compressed texts have, in their ranges: chance sets under a tenth of a range's slots."""
    from cxlens.llm import slots
    anchors = 2 * 51_000_000_000 // 36
    a_slot = anchors / slots.ranges(anchors) / 2 ** slots.slot_bits(anchors // slots.ranges(anchors))
    assert slots.slot_bits(anchors) == slots.MAX_SLOT_BITS and 1 - np.exp(-a_slot) * (1 + a_slot) < 0.1
    few = 1_000_000
    assert slots.ranges(few) == 1 and 4 * few <= 2 ** slots.slot_bits(few) <= 8 * few


def test_a_very_long_text_is_found_in_segments():
    """24 MB in one text: the anchors' arrays stay a few times its size."""
    import tracemalloc
    data = np.random.default_rng(1).integers(32, 127, 24 << 20).astype(np.uint8)
    data[-200:] = data[1000:1200]
    tracemalloc.start()
    h, p, a, b, t = suffix_dedup.batch_anchors(data, np.array([0, len(data)]), 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * len(data)
    covered = np.zeros(len(data) - 49, bool)
    for x, y in zip(a.tolist(), b.tolist()):
        covered[x:y + 1] = True
    assert covered.all() and int((b - a + 1).sum()) == len(covered)  # each window once
