"""Keyword taxonomy: ordered substring rules over lower-cased text.

``classify`` turns ordered (label, substrings) rules into one CASE expression
of ``contains`` tests on the lower-cased text. The first rule
with any hit wins; rows that pass the gate without a hit get the fallback
label; rows failing the gate get NULL. It runs inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complaint root-cause rules, in precedence order, with the
# label for gated rows that match no rule. Matching is plain substring
# search on the lower-cased review message.
ROOT_CAUSE_RULES: list[tuple[str, list[str]]] = [
    ("late_delivery", ["late", "delay", "days late", "too long", "took forever"]),
    ("damaged_defective", ["broken", "damaged", "cracked", "defective", "not work", "dented"]),
    ("wrong_item", ["wrong item", "wrong size", "wrong color", "not what i ordered",
                    "different product", "incorrect"]),
    ("seller_unresponsive", ["no response", "never replied", "unresponsive", "ignored",
                             "customer service"]),
    ("quality_below_expectations", ["cheap", "poor quality", "flimsy", "not as described",
                                    "disappointing", "poorly made", "fell apart"]),
]
ROOT_CAUSE_FALLBACK = "uncategorized_complaint"


def classify(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = ROOT_CAUSE_RULES,
             gate: Column | None = None, fallback: str | None = ROOT_CAUSE_FALLBACK) -> Column:
    """Label of the first rule whose substrings occur in ``lower(text)``.

    NULL text matches no rule (and so gets ``fallback`` when gated in).
    """
    low = F.lower(text)
    gate = F.lit(True) if gate is None else gate
    out = None
    for label, words in rules:
        hit = None
        for w in words:
            h = low.contains(w)
            hit = h if hit is None else (hit | h)
        cond = gate & F.coalesce(hit, F.lit(False))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if fallback is not None:
        out = out.when(gate, F.lit(fallback))
    return out
