"""Ranked search against scores taken one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cxlens.llm import lexical
from tests.llm import odd

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 80)))) for i in range(n)]
    docs += [(1000 + i, "same text W1 w2, w7") for i in range(60)]  # copies
    return docs, [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(25)] + [(90, "W1 w2 w7"), (91, "w1 w1 w1")]


def test_terms_of_segments(monkeypatch):
    texts = [t for _, t in odd.texts()] + ["A-b\x00c\x7fd[E]" * 9, "é" * 50]
    want = [[t.encode() for t in terms(x)] for x in texts]
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(lexical, "SEGMENT", size)
        assert [[t for part in lexical.terms_of(x) for t in part] for x in texts] == want


@pytest.mark.parametrize("k, postings, per_pass", [(20, 1 << 20, 1 << 18), (3, 500, 1 << 18), (1, 1, 60)])
def test_search_equals_brute_force(spark, monkeypatch, k, postings, per_pass):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical, "ITEM_TERMS", per_pass)
    docs, items = corpus()
    got = lexical.ranked_search(odd.frame(spark, docs), items_frame(spark, items), k)
    assert Counter(map(tuple, got.collect())) == brute(docs, items, k)


def test_odd_documents_and_items(spark):
    docs = odd.texts() + [(None, "fox"), (None, "fox"), (7, "fox fox")]
    items = [(1, "The quick FOX"), (2, None), (3, ""), (3, "fox"), (None, "漢字かな交じり文 Köln"), (4, "nowhere-to-be-found"), (5, odd.LONG), (6, "fox fox w1")]
    got = Counter(map(tuple, lexical.ranked_search(odd.frame(spark, docs), items_frame(spark, items), 20).collect()))
    assert got == brute(docs, items, 20)


def test_empty_tables(spark):
    items = items_frame(spark, [(1, "fox")])
    assert lexical.ranked_search(odd.frame(spark, []), items).count() == 0
    assert lexical.ranked_search(odd.frame(spark), items_frame(spark, [])).count() == 0


def test_accumulators_stop():
    """Common terms create no accumulators once k documents are out of reach, and scores stay exact."""
    n = 5000
    rng = np.random.default_rng(1)
    rows = [np.array([0] * (i < 30) + [1] + [2] * int(rng.random() < 0.5), "<u4") for i in range(n)]
    block = lexical.Block(np.arange(n), np.full(n, 10), [r.tobytes() for r in rows], [np.ones(len(r), "<u4").tobytes() for r in rows], n, 10 * n, 3)
    touched = []
    real = np.partition

    def seen(a, at):
        touched.append(len(a))
        return real(a, at)

    lexical.np.partition, keep = seen, real
    try:
        found, scores = block.search(np.array([0, 1, 2]), np.array([5000, 40, 30]), 20)
    finally:
        lexical.np.partition = keep
    assert touched[0] == 30 and len(found) == 20 and set(found.tolist()) <= set(range(30))
    share = int(block.share[0])
    want = sorted((-share * (5000 + 40 + 30 * int(2 in rows[i])), i) for i in range(n) if i < 30)[:20]
    assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist())] == want
