"""Secret scans, in built-in Spark expressions only.

Base spans come from three patterns, leftmost and non-overlapping for each.
The method adds what no pattern names: strings that look drawn at random. Two
first-order Markov models over characters, one of random strings and one of
ordinary identifiers, give each candidate (a run of ``CANDIDATE`` characters
outside the base spans) a log-likelihood ratio; from ``LLR_LIMIT`` on it is a
``random`` span.

Labelled samples train the models. Random: the distinct values that the base
patterns found, in all texts. Ordinary: the distinct words of a bounded sample
of texts (``TRAIN_DOCS``) that are too short to be candidates, so that no key
passes for an example, and numbers of any length; without those that touch a
base span. Each distinct string counts once, so copies do not weigh. The random model is
half the counted transitions and half the uniform ones, because keys come in more
alphabets than the sample holds; without any base match it is uniform.

A text is scanned once: its spans, values and candidates are written, and
training and scoring read them back without the text. The model is one row of
``STATES ** 2`` numbers, joined by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cxlens.llm.common import let, written


@dataclass(frozen=True)
class Pattern:
    """A kind of span: ``value`` is the group that holds the secret, of at least ``least`` characters."""
    kind: str
    regex: str
    value: int
    least: int


# The base patterns, in their order. Letters of the keywords count in either case.
PATTERNS = (
    Pattern("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 20),
    Pattern("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of at least 24 begins where the whole run begins
)
RANDOM = "random"

#: What may be a key that no pattern names, and a word of the ordinary sample.
CANDIDATE, ORDINARY = "[A-Za-z0-9+/_=-]{16,}", "(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{4,15}|[0-9+-]{16,})(?![A-Za-z0-9+/_=-])"
#: Characters of candidates; state 0 is the start of a string.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Texts of the ordinary sample, in expectation.
TRAIN_DOCS = 4000
#: Share of uniform transitions in the random model; pseudo-count of each transition of the ordinary one.
UNIFORM, PSEUDO = 0.5, 0.1
#: Natural log of how much likelier random must be.
LLR_LIMIT = 10.0
#: Places are summed up in chunks of so many matches, so that very many matches are not quadratic.
_CHUNK = 256


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def spans_of(text: Column, regex: str, value: int = 0) -> Column:
    """All matches as an array of (start, end, value); code points, end exclusive."""
    no_spans = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(between: Column, found: Column, values: Column) -> Column:
        # A match starts behind all text between the matches up to it and all matches before it.
        steps = F.transform(found, lambda m, k: F.length(F.get(between, k)) + F.length(m))

        def with_steps(steps: Column) -> Column:
            chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")),
                                 lambda c: _total(F.slice(steps, c * _CHUNK + 1, F.lit(_CHUNK))))
            bases = let(chunks, lambda s: F.transform(s, lambda _, c: _total(F.slice(s, F.lit(1), c))))

            def with_bases(bases: Column) -> Column:
                def one(m: Column, k: Column) -> Column:
                    chunk = F.floor(k / _CHUNK).cast("int")
                    start = F.get(bases, chunk) + _total(F.slice(steps, chunk * _CHUNK + 1, k - chunk * _CHUNK)) + F.length(F.get(between, k))
                    return let(start, lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), F.get(values, k).alias("value")))
                return F.transform(found, one)
            return let(bases, with_bases)
        return let(steps, with_steps)

    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    values = found if value == 0 else F.regexp_extract_all(text, F.lit(regex), F.lit(value))
    all_spans = let(F.struct(F.split(text, regex, -1).alias("b"), found.alias("m"), values.alias("v")), lambda x: placed(x["b"], x["m"], x["v"]))
    return F.when(text.rlike(regex), all_spans).otherwise(no_spans)


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the spans that are long enough."""
    return {p.kind: F.filter(spans_of(text, p.regex, p.value), lambda s: F.length(s["value"]) >= p.least) for p in PATTERNS}


def _of_kind(no: int):
    """Span to (start, no, end, value), which sorts by start and kind."""
    return lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), s["value"].alias("value"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ``base`` (spans by start and kind), ``cands`` (candidate spans beside them) and ``words`` (of the sampled texts); written."""
    n = docs.count()
    rate = min(1.0, TRAIN_DOCS / n) if n else 1.0
    t = F.col("t")
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.select("doc_id", "t", *[s.alias(k) for k, s in base_spans(t).items()])
    by_place = F.array_sort(F.concat(*[F.transform(p.kind, _of_kind(no)) for no, p in enumerate(PATTERNS)]))
    d = d.select("doc_id", "t", by_place.alias("base"))
    base = F.col("base")

    def beside(spans: Column) -> Column:
        return F.filter(spans, lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))

    sampled = F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int(rate * (1 << 20))
    words = F.when(sampled, F.transform(beside(spans_of(t, ORDINARY)), lambda s: s["value"]))
    return written(d.select("doc_id", "base", beside(spans_of(t, CANDIDATE)).alias("cands"), words.alias("words")), "secret-spans")


def states(value: Column) -> Column:
    """State of each character: its place in ALPHABET from 1 on; others are left out."""
    return F.filter(F.transform(F.split(value, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.position(c, F.lit(ALPHABET)))), lambda s: s > 0)


def _transitions(values: DataFrame, name: str) -> DataFrame:
    """(id, name): how often each transition, ``before * STATES + after``, occurs in distinct strings."""
    s = values.select("value").distinct().select(states(F.col("value")).alias("s"))
    moves = F.transform("s", lambda x, k: F.when(k == 0, x).otherwise(F.get(F.col("s"), k - 1) * STATES + x).cast("long"))
    return s.select(F.explode(moves).alias("id")).groupBy("id").agg(F.count("*").alias(name))


def ratio_model(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """One row with the array ``model``: the log-likelihood ratio of every transition.

    ``random`` and ``ordinary`` have a column ``value``; either may be empty.
    """
    cells = random.sparkSession.range(STATES * STATES)
    counts = (cells.join(_transitions(random, "r"), "id", "left").join(_transitions(ordinary, "o"), "id", "left")
              .na.fill(0, ["r", "o"]).withColumn("before", F.floor(F.col("id") / STATES)))
    per_state = counts.groupBy("before").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    uniform = 1.0 / (STATES - 1)
    counted = F.when(F.col("rs") > 0, F.col("r") / F.col("rs")).otherwise(uniform)
    as_random = UNIFORM * uniform + (1 - UNIFORM) * counted
    as_ordinary = (F.col("o") + PSEUDO) / (F.col("os") + PSEUDO * (STATES - 1))
    rows = counts.join(per_state, "before").select("id", F.log(as_random / as_ordinary).alias("x"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda c: c["x"]).alias("model"))


def score(value: Column, model: Column) -> Column:
    """Log-likelihood ratio of a string, random against ordinary."""
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(states(value), start, lambda a, s: F.struct(s.alias("before"), (a["sum"] + F.get(model, a["before"] * STATES + s)).alias("sum")),
                       lambda a: a["sum"])


def train(scanned: DataFrame) -> DataFrame:
    """The model (one row) from the scanned texts."""
    random = scanned.select(F.explode("base").alias("b")).select(F.col("b.value").alias("value"))
    return ratio_model(random, scanned.select(F.explode("words").alias("value")))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: float = LLR_LIMIT) -> DataFrame:
    """One row per input row: doc_id and ``spans``, an array of (start, kind, end, value, score) by start and kind.

    Base spans have no score. Null texts are empty; empty texts have no spans; texts of any length count whole;
    repeated rows repeat and train once; null ids are kept; an empty table gives an empty result; other columns are not read.
    """
    scanned = scan(docs, text, key)
    model = written(train(scanned), "secret-model")
    kinds = F.array(*[F.lit(p.kind) for p in PATTERNS], F.lit(RANDOM))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["no"].alias("no"), b["end"].alias("end"), b["value"].alias("value"), F.lit(None).cast("double").alias("score")))
    scored = F.transform("cands", lambda c: F.struct(c["start"].alias("start"), F.lit(len(PATTERNS)).alias("no"), c["end"].alias("end"), c["value"].alias("value"),
                                                     score(c["value"], F.col("model")).alias("score")))
    d = scanned.crossJoin(F.broadcast(model)).select("doc_id", base.alias("base"), scored.alias("scored"))
    spans = F.array_sort(F.concat("base", F.filter("scored", lambda s: s["score"] >= limit)))
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.get(kinds, s["no"]).alias("kind"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score")))
    return d.select("doc_id", named.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (all of them, ``kind:start:end``); cases as in ``find_secrets``."""
    spans = F.col("spans")
    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(p.kind).alias(f"n_{p.kind}") for p in PATTERNS]
    base = F.filter(spans, lambda s: s["kind"] != RANDOM)
    return find_secrets(docs).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
