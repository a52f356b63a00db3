"""Quality rules as a short-circuit cascade, in built-in Spark expressions only.

Each rule is a boolean expression over the text that says "reject". Its cost
(seconds for the sample) and selectivity (share of the sample it rejects) are
estimated on a bounded sample; rules then run in falling order of rejection
per cost, and ``CASE WHEN`` stops at the first rule that rejects. The verdict
is a conjunction, so the order changes the work and never the result: two runs
that time the sample differently keep the same documents.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cxlens.llm.common import let, words_of

#: Rows on which cost and selectivity are estimated. The bound is on purpose:
#: the estimate orders the rules, it decides no document.
SAMPLE_ROWS = 2000
SYMBOLS = "[#*$%&|<>]"


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.length(F.array_join(words_of(text), "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")


def n_lines(text: Column) -> Column:
    """Lines (split at \\n) that hold a word."""
    return F.size(_lines(text)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, words: Column | None = None, width: int = 3) -> Column:
    """Words inside a ``width``-word window that occurs twice or more in the text.

    Windows are compared by a 64-bit hash chained over their words. Sorting
    (hash, place) puts equal windows side by side, so no lookup is quadratic
    in the length of the text.
    """
    def covered(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - width)
        keyed = F.array_sort(F.transform(starts, lambda i: F.struct(
            F.xxhash64(*[w[i + k] for k in range(width)]).alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            again = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                             | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            places = F.flatten(F.transform(again, lambda x: F.array(*[x["i"] + k for k in range(width)])))
            return F.size(F.array_distinct(places))
        return F.when(F.size(w) < width, F.lit(0)).otherwise(let(keyed, marked))
    return let(words_of(text) if words is None else words, covered).cast("long")


@dataclass(frozen=True)
class Rule:
    """``reject``: text column -> boolean column that is true for a document to drop."""
    name: str
    reject: object


def base_rejects(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


#: Beside the two base rules. The limits are wide: they catch machine noise
#: and leave ordinary prose alone.
RULES = (
    Rule("few_words", lambda t: n_words(t) < 50),
    Rule("repeated_words", lambda t: let(words_of(t), lambda w: 100 * n_repeat_words(t, w) > 50 * F.size(w))),
    Rule("symbols", lambda t: let(n_words(t), lambda n: 10 * n_symbols(t) > n)),
    Rule("repeated_lines", lambda t: let(_lines(t), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
    Rule("long_words", lambda t: let(words_of(t), lambda w: F.length(F.array_join(w, "")) > 14 * F.size(w))),
)


def estimate(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejected share) of each rule on a bounded sample of the texts."""
    texts = docs.select(F.col(text).cast("string").alias("t"))
    rows = texts.take(sample_rows)  # reads as few partitions as it needs; limit() would cut from every one
    n, sample = max(1, len(rows)), docs.sparkSession.createDataFrame(rows, texts.schema)
    out = []
    for rule in rules:
        began = time.perf_counter()
        hit = sample.agg(F.count_if(F.coalesce(rule.reject(F.col("t")), F.lit(False)))).first()[0]
        out.append((rule, max(1e-6, time.perf_counter() - began), hit / n))
    return out


def ordered(estimates) -> list[Rule]:
    """Rules by rejection per cost, the best first; ties by cost, then by name."""
    return [r for r, _, _ in sorted(estimates, key=lambda e: (-e[2] / e[1], e[1], e[0].name))]


def cascade(rules, text: Column) -> Column:
    """True if no rule rejects; rules after the first that rejects are not evaluated."""
    out = None
    for rule in rules:
        hit = F.coalesce(rule.reject(text), F.lit(False))
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def keep_documents(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Documents that pass every rule, with the columns they came with.

    Null and empty texts have no word and go; repeated rows are judged alike
    and all stay or all go; an empty table gives an empty table; other columns
    pass through untouched.
    """
    return docs.where(cascade(ordered(estimate(docs, rules, text)), F.col(text)))


def quality_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: the base measures, the base verdict and the cascade's.

    A null text counts as no text (0 words, base_failed true). One row per
    input row, so repeated rows repeat. Only doc_id and text are read;
    further columns, whatever their names, do not matter.
    """
    order = [r for r in ordered(estimate(docs, rules)) if r.name not in ("few_words", "repeated_words")]
    text, w = F.col("text"), F.col("w")
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), words_of(F.col("text")).alias("w"))
    d = d.select("doc_id", "text", F.size(w).cast("long").alias("n_words"),
                 F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                 n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"),
                 n_repeat_words(text, w).alias("n_repeat_words"))
    failed = base_rejects(F.col("n_words"), F.col("n_repeat_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"),
                    F.when(failed, F.lit(False)).otherwise(cascade(order, text)).alias("kept"))
