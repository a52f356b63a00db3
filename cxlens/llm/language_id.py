"""Language identification with string kernels.

The kernel of two texts is the blended spectrum: for n-grams of one, two and
three letters (runs of anything else count as one boundary) the number of
n-grams present in both, over the root of the numbers present in each, summed
with weights over n. Nyström landmarks, some texts of each language, make it a
feature map; kernel ridge regression, one language against the rest, makes
the scores. A batch of texts is scored by matrix products: presence times
landmarks, then times one matrix that holds the Nyström root and the weights.

The model is fitted on a bounded sample of labelled rows, at most
``SAMPLE_PER_LANGUAGE`` for each language, chosen by a hash of the id. Every
n-gram of a landmark is a feature and every letter of one is told apart, however
many scripts there are. A letter that no landmark holds can be in no feature, so
those are one symbol.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cxlens.llm.common import bounded_batches

SAMPLE_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 40
WEIGHTS = (0.2, 0.3, 0.5)
RIDGE = 1e-3
#: Bits of an n-gram code up to which its feature is looked up in a table; wider ones are searched for.
TABLE_BITS = 21
UNDETERMINED = "und"
#: Code points whose presence matrix is built at a time, and its rows.
BLOCK_CHARS, BLOCK_ROWS = 1 << 20, 256


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    languages: list[str]
    letters: str                 # the letters of the landmarks, in lower case
    features: list[np.ndarray]   # codes of the n-grams of each n, sorted
    landmarks: list[np.ndarray]  # presence of them, (landmark, feature) bool
    weights: np.ndarray          # (landmark, language)

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None, "landmarks": [np.packbits(x, axis=1) for x in self.landmarks]}

    def __setstate__(self, state):
        self.__dict__ = state
        self.landmarks = [np.unpackbits(x, axis=1, count=len(f)).astype(bool) for x, f in zip(self.landmarks, self.features)]

    def prepare(self):
        if self._ready is None:
            width = _width(self.letters)
            table = [_Numbers(f, n * width) for n, f in enumerate(self.features, 1)]
            scaled = [_scaled(x.astype(np.float32)) * w for x, w in zip(self.landmarks, WEIGHTS)]
            self._ready = _letter_table(self.letters), table, [x.T.copy() for x in scaled]
        return self._ready

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, landmark) kernel values, and whether a text has a letter."""
        letter, table, scaled = self.prepare()
        out, has = np.zeros((len(texts), len(self.weights)), np.float32), np.zeros(len(texts), bool)
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and b - a < BLOCK_ROWS and (b == a or n + len(texts[b]) <= BLOCK_CHARS):
                n, b = n + len(texts[b]), b + 1
            codes, row, has[a:b] = _codes(texts[a:b], letter, _width(self.letters))
            for grams, t, s in zip(codes, table, scaled):
                present = np.zeros((b - a, s.shape[0]), np.float32)
                f = t(grams)
                ok = f >= 0
                present[row[:len(f)][ok], f[ok]] = 1
                out[a:b] += _scaled(present) @ s
            a = b
        return out, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 without a letter."""
        k, has = self.kernel(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        s = k.astype(np.float64) @ self.weights
        best = s.argmax(axis=1)
        score = np.where(has, np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1), 0.0)
        return [self.languages[i] if h else UNDETERMINED for i, h in zip(best, has)], score


class _Numbers:
    """Number of each feature by its code; -1 for other codes."""

    def __init__(self, features: np.ndarray, bits: int):
        self.features, self.table = features, None
        if bits <= TABLE_BITS:
            self.table = np.full(1 << bits, -1, np.int32)
            self.table[features] = np.arange(len(features))

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[codes]
        if not len(self.features):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.features, codes), len(self.features) - 1)
        return np.where(self.features[at] == codes, at, -1)


def _width(letters: str) -> int:
    """Bits of a letter in an n-gram code; there are fewer than 2**20 letters, so three fit."""
    return max(7, (len(letters) + 1).bit_length())


def _scaled(present: np.ndarray) -> np.ndarray:
    return present / np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))


def _letter_table(letters: str) -> np.ndarray:
    """Number of each code point: 0 no letter, 1 another letter, from 2 on ``letters``."""
    table = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.int32, sys.maxunicode + 1)
    for i, c in enumerate(letters):
        table[ord(c)] = i + 2
    return table


def _codes(texts: list[str], letter: np.ndarray, width: int):
    """n-gram codes for n = 1, 2, 3 with the row of each place, and whether a text has a letter."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(p) for p in points])
    c = letter[np.concatenate(points)]
    # One boundary for a run of them; each text keeps the one it begins with.
    keep = (c != 0) | (np.concatenate(([1], c[:-1])) != 0) | (np.concatenate(([-1], row[:-1])) != row)
    has = np.zeros(len(texts), bool)
    has[row[c != 0]] = True
    c, row = c[keep], row[keep]
    c = c.astype(np.int64) if 3 * width > 31 else c
    two = c[:-1] << width | c[1:]
    three = two[:-1] << width | c[2:]
    # A boundary alone says nothing; n-grams across two texts have it inside and are put to 0 too.
    two[row[1:] != row[:-1]] = 0
    three[row[2:] != row[:-2]] = 0
    return [c, two, three], row, has


def sample_labelled(docs: DataFrame, per_language: int, text: str, label: str, key: str) -> list[tuple[str, str]]:
    """At most ``per_language`` (text, label) of each label from rows not held out, the smallest hashes of the id.

    Of an id with several texts the least one counts. Rows are first thinned by a threshold on the hash, so that no task
    ranks all ids of a label; it is lowered by the counts and raised again until every label has its rows.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & ~held_out(key) & F.col(key).isNotNull())
    known = known.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.xxhash64(key).alias("h"), F.col(text).cast("string").alias("text"))
    wanted = 4 * per_language + 200
    low, scale = -(1 << 63), 1.0
    sizes = known.groupBy("label").count()
    while True:
        share = F.least(F.lit(1.0), F.lit(wanted * scale) / F.col("count"))
        few = known.select("key", "label", "h").join(F.broadcast(sizes), "label").where(F.col("h") <= low + share * 2.0 ** 64)
        few = few.groupBy("key", "label", "h").agg(F.first(share).alias("share"))
        got = few.groupBy("label").agg(F.count("*").alias("n"), F.min("share").alias("share"))
        short = sizes.join(got, "label", "left").where((F.coalesce("n", F.lit(0)) < per_language) & (F.least(F.lit(1.0), F.lit(wanted * scale) / F.col("count")) < 1.0))
        if short.isEmpty():
            break
        scale *= 8
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "key"))
    ids = few.withColumn("rank", rank).where(F.col("rank") <= per_language).select("key", "label")  # bounded, so it may be broadcast
    rows = known.join(F.broadcast(ids), ["key", "label"]).groupBy("key", "label").agg(F.min("text").alias("text"))
    return sorted({(r["text"], r["label"]) for r in rows.select("text", "label").collect()})


def fit(sample: list[tuple[str, str]], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Landmarks, Nyström root and ridge weights from labelled texts."""
    plain = _letter_table("")
    sample = [(t, lang) for t, lang in sample if any(plain[ord(c)] for c in t.lower())]
    languages = sorted({lang for _, lang in sample})
    marks = [t for lang in languages for t in [t for t, x in sample if x == lang][:landmarks_per_language]]
    letters = "".join(sorted({c for t in marks for c in t.lower() if plain[ord(c)]}))
    if not languages:
        return Model([], "", [np.zeros(0, np.int64)] * 3, [np.zeros((0, 0), bool)] * 3, np.zeros((0, 0)))
    codes, row, _ = _codes(marks, _letter_table(letters), _width(letters))
    features, presence = [], []
    for grams in codes:
        gram, number = np.unique(grams, return_inverse=True)
        x = np.zeros((len(marks), len(gram)), bool)
        x[row[:len(grams)], number] = True
        features.append(gram[gram != 0])  # 0 is the boundary alone
        presence.append(x[:, gram != 0])
    model = Model(languages, letters, features, presence, np.zeros((len(marks), len(languages))))
    among = model.kernel(marks)[0].astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = model.kernel([t for t, _ in sample])[0].astype(np.float64) @ root
    target = np.where(np.array([lang for _, lang in sample])[:, None] == np.array(languages), 1.0, -1.0)
    # Each language weighs as much as the rest, so that the common one does not crowd out the others.
    weight = np.array([1 / max(1, sum(x == lang for _, x in sample)) for _, lang in sample])
    weight = weight / weight.mean()
    gram = phi.T @ (phi * weight[:, None]) + ridge * len(sample) * np.eye(phi.shape[1])
    model.weights = root @ np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    return model


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Model:
    return fit(sample_labelled(docs, SAMPLE_PER_LANGUAGE, text, label, key))


def _predictor(docs: DataFrame, model: Model):
    """A function from a text column to a struct (lang, score)."""
    from collections.abc import Iterator
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for texts in batches:
            langs, scores = [], []
            for a in range(0, len(texts), 1024):
                part, score = shared.value.predict([t or "" for t in texts.iloc[a:a + 1024]])
                langs += part
                scores += score.tolist()
            yield pd.DataFrame({"lang": langs, "score": scores})
    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    scored = pandas_udf(predict, "lang string, score double")
    return lambda text: scored(F.coalesce(F.col(text).cast("string"), F.lit("")))


def language_report(docs: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, a row for each input row.

    Null and empty texts and texts without a letter are ``und`` with score 0;
    so is every text if no row is labelled. A null id counts as an empty
    string in the fold and is never learned from; repeated rows repeat and are
    learned from once; an empty table gives an empty result. Only the text
    enters a prediction.
    """
    model = train(docs, text, key=key) if model is None else model
    d = docs.select(F.col(key).alias("doc_id"), _predictor(docs, model)(text).alias("p"))
    return d.select("doc_id", held_out().alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float, model: Model | None = None, text: str = "text") -> DataFrame:
    """Documents in a known language with at least this score, with their own columns."""
    model = train(docs, text) if model is None else model
    d = docs.select(F.struct("*").alias("r"), _predictor(docs, model)(text).alias("p"))
    return d.where((F.col("p.lang") != UNDETERMINED) & (F.col("p.score") >= min_score)).select("r.*")
