"""Tokenizer, token counts, chunk reuse and packing, against the tokenizers library."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from cxlens.llm import bpe_codec, packing, token_counts
from cxlens.llm.bpe import LATIN_END, PATTERN, bpe, code_point_classes, pretoken_starts
from cxlens.llm.queries import tokenizer_path
from tests.llm import brute, odd


@pytest.fixture(scope="module")
def tok():
    return bpe(tokenizer_path())


def library_ids(tok, text):
    return tok.library.encode(text or "", add_special_tokens=False).ids


def random_texts(seed, n, alphabet="''’  \n\tstrevmldabcXYZ01239!?.,-é漢ñ😀²½_<|> "):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_library(tok):
    # Every Latin code point in several surroundings takes the fast path.
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'{chr(c)}" for c in range(LATIN_END)]
    for t in texts + random_texts(1, 300) + [t for _, t in odd.texts() if t and len(t) < 10_000]:
        assert tok.encode(t).tolist() == library_ids(tok, t), t
        assert tok.decode_bytes(tok.encode(t)).decode() == tok.library.decode(library_ids(tok, t), skip_special_tokens=False)


def test_every_token_encodes_to_itself(tok):
    """The count transducer relies on it."""
    from cxlens.llm.bpe import _byte_of_char
    char = {b: c for c, b in _byte_of_char().items()}
    for data, i in tok.ranks.items():
        assert [t.id for t in tok.library.model.tokenize("".join(char[b] for b in data))] == [i]


def test_pretoken_starts(tok):
    pattern = regex.compile(PATTERN)
    known = [c for c in "'’ \n\tstrevmldabXY019!?.,-éñ²½_ "]
    for t in random_texts(2, 400, "".join(known)):
        want, at = [], 0
        for piece in pattern.findall(t):
            want.append(at)
            at += len(piece.encode())
        data = np.frombuffer(t.encode(), np.uint8)
        assert np.flatnonzero(pretoken_starts(data, np.zeros(1, int))).tolist() == want, t


def test_classes_come_from_the_library(tok):
    c = code_point_classes()
    assert c(np.array([ord(x) for x in "a1 \n'漢 ²"], np.uint32)).tolist() == [1, 2, 4, 3, 0, 1, 3, 2]


@pytest.mark.parametrize("chunk, most", [(256, 300_000), (7, 300_000), (64, 50)])
def test_transducer_counts(tok, monkeypatch, chunk, most):
    """Small chunks exercise the composition of heads, few states the recompilation."""
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    machine = token_counts.CountTransducer(tok, most)
    texts = random_texts(3, 200) + ["x" * 3000, "word" * 500 + " end", "", "é" * 700]
    for a in range(0, len(texts), 20):
        raw = [t.encode() for t in texts[a:a + 20]]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        got = token_counts.count_batch(machine, np.frombuffer(b"".join(raw), np.uint8), offsets)
        assert got.tolist() == [len(library_ids(tok, t)) for t in texts[a:a + 20]]


def test_token_counts(spark, tok):
    rows = odd.texts()
    got = Counter(map(tuple, token_counts.token_counts(odd.frame(spark, rows), tok.path, 512).collect()))
    assert got == Counter((d, len((t or "").encode()), n := len(library_ids(tok, t)), n > 512) for d, t in rows)


def near_copies():
    rng = random.Random(9)
    base = " ".join(rng.choice(["river", "stone", "walks", "under", "'s", "12", "don't", "Grüße", "ende."]) for _ in range(900))
    return [(i, base[:i * 37] + "CHANGED" * (i % 3) + base[i * 41:]) for i in range(40)]


def test_chunk_reuse_round_trip(spark, tok):
    rows = odd.texts() + near_copies()
    got = Counter(map(tuple, bpe_codec.codec_report(odd.frame(spark, rows), tok.path).collect()))
    want = Counter()
    for d, t in rows:
        ids = library_ids(tok, t)
        import hashlib
        text = tok.library.decode(ids, skip_special_tokens=False)
        want[d, len(ids), brute.sha_ids(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want


def test_shared_chunks_move_once(spark, tok):
    """Uses and texts of a chunk meet in one exchange, where it is encoded: no join moves its ids again."""
    rows = near_copies() * 2
    out = bpe_codec.codec_report(odd.frame(spark, rows), tok.path)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 2
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in out.collect())
    assert got == Counter((d, len(library_ids(tok, t)), brute.sha_ids(library_ids(tok, t))) for d, t in rows)


def test_a_common_chunk_is_dealt_over_tasks(spark, tok):
    """Copies in six batches: every batch's uses of a chunk are a group of their own, and none of them is lost."""
    text = near_copies()[0][1]
    docs = odd.frame(spark, [(i, text + f" {i}") for i in range(60)] + [(100, text)]).repartition(6, "doc_id")
    plan = bpe_codec.codec_report(docs, tok.path)
    assert "apart" in plan._jdf.queryExecution().executedPlan().toString()
    want = {i: brute.sha_ids(library_ids(tok, text + f" {i}")) for i in range(60)} | {100: brute.sha_ids(library_ids(tok, text))}
    assert {r["doc_id"]: r["ids_sha256"] for r in plan.collect()} == want


def test_encode_documents(spark, tok):
    got = {r["doc_id"]: np.frombuffer(r["ids"], tok.dtype).tolist() for r in bpe_codec.encode_documents(odd.frame(spark, near_copies()), tok.path).collect()}
    assert got == {d: library_ids(tok, t) for d, t in near_copies()}


@pytest.mark.parametrize("seed", range(5))
def test_joins_of_any_pieces(tok, seed):
    rng = random.Random(seed)
    text = odd.PROSE * 2 + random_texts(seed, 1)[0] + "it's  don't" * 5
    cuts = sorted(rng.sample(range(1, len(text)), 25))
    parts = [np.array(library_ids(tok, text[a:b]), tok.dtype) for a, b in zip([0, *cuts], [*cuts, len(text)])]
    assert bpe_codec.join_parts(tok, parts).tolist() == library_ids(tok, text)


def test_chunks_are_content_defined():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    a = bpe_codec.chunk_ends(data, bpe_codec.rolling_cuts(data))
    moved = np.concatenate((rng.integers(97, 123, 333).astype(np.uint8), data))
    b = {e - 333 for e in bpe_codec.chunk_ends(moved, bpe_codec.rolling_cuts(moved))}
    assert a[-1] == len(data) and len(set(a) & b) > 0.8 * len(a)


def check_packing(rows, docs, tok, limit):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = Counter()
    for d, t in docs:
        ids = library_ids(tok, t) + [0]
        begin, end = 0, (len(ids) - 1) % limit + 1
        piece = 0
        while begin < len(ids):
            want[d, piece, begin, end - begin, brute.crc(ids[begin:end])] += 1
            begin, end, piece = end, end + limit, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    return by_sequence


def test_packing(spark, tok):
    rows = odd.texts() + near_copies()
    for limit in (64, 2048):
        got = packing.pack(odd.frame(spark, rows), tok.path, packing.Capacity(limit)).collect()
        sequences = check_packing(got, rows, tok, limit)
        least = max(sum(r["length"] for r in got) / limit, sum(2 * r["length"] > limit for r in got))
        assert len(sequences) <= 1.1 * least + 1


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(4))
def test_best_fit_respects_every_capacity(score, seed):
    rng = random.Random(seed)
    lengths = {rng.randint(1, 100): rng.randint(1, 400) for _ in range(30)}
    cap = packing.Capacity(100, documents=5, attention=4000 + 6000, weights=(1.0, 0.5, 0.5), score=score)
    used = defaultdict(lambda: np.zeros(3, int))
    placed = Counter()
    for length, rank, n, first, each, offset in packing.best_fit(lengths, cap):
        assert placed[length] == rank
        placed[length] += n
        for k in range(n):
            sequence = first + k // each
            assert used[sequence][0] == offset + k % each * length
            used[sequence] += (length, 1, length ** 2)
    assert placed == lengths
    assert all((u <= cap.vector()).all() for u in used.values())
    if score == "norm":
        bound = max(sum(k * n for k, n in lengths.items()) / 100, sum(lengths.values()) / 5, sum(k * k * n for k, n in lengths.items()) / 10_000)
        assert len(used) <= 1.25 * bound + 1


def test_best_fit_rejects_what_never_fits():
    with pytest.raises(ValueError):
        packing.best_fit({101: 1}, packing.Capacity(100))


def test_empty_tables(spark, tok):
    none = odd.frame(spark, [])
    assert token_counts.token_counts(none, tok.path, 512).count() == 0
    assert bpe_codec.codec_report(none, tok.path).count() == 0
    assert packing.pack(none, tok.path, packing.Capacity(2048)).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_two_million_blanks(tok, blank):
    """The fast path's regex gives up on such a run; the library does not."""
    text = f"a{blank * 2_000_000}b"
    assert tok.encode(text).tolist() == library_ids(tok, text)


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_state_maps_of_chunks_without_a_start(tok, monkeypatch, rounds):
    """Runs of chunks inside one pre-token, with maps that close, do not close, or are not made."""
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "MAP_ROUNDS", max(1, rounds))
    if not rounds:
        monkeypatch.setattr(token_counts.CountTransducer, "_scan", lambda *a: None)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 900))) for _ in range(30)]
    texts += ["the" * 200, "a" * 777, "ab " * 60 + "xyz" * 99, "9" * 500, "é" * 300, "漢" * 200, "", "b", " " * 300 + "c"]
    machine = token_counts.CountTransducer(tok)
    raw = [t.encode() for t in texts]
    got = token_counts.count_batch(machine, np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    assert got.tolist() == [len(library_ids(tok, t)) for t in texts]


def test_a_pretoken_of_a_megabyte(tok, monkeypatch):
    """Its chunks are mapped at once: the rounds do not grow with its length."""
    rng = random.Random(7)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1 << 20))
    machine, rounds = token_counts.CountTransducer(tok), []
    step = machine.step
    monkeypatch.setattr(machine, "step", lambda *a: rounds.append(len(a[0])) or step(*a))
    raw = np.frombuffer(text.encode(), np.uint8)
    assert token_counts.count_batch(machine, raw, np.array([0, len(raw)])).tolist() == [len(library_ids(tok, text))]
    assert len(rounds) < 12 * token_counts.CHUNK
