"""A small table of awkward documents, with columns that carry names the operators use inside."""

import random

LONG = " ".join(f"w{i * 7919 % 1013}" for i in range(40_000))
PASSAGE = "This passage of more than fifty bytes stands in several documents alike, word by word."
PROSE = ("The quick brown fox jumps over the lazy dog while seven other animals watch from afar and nobody says a word about it. "
         "Later that day the fox returns with friends, they sit by the river, talk about the weather and go home before dark.\n"
         "On the next morning everything is quiet, the dog sleeps in the sun, and a stranger walks by without noticing anything.")


def texts():
    rng = random.Random(5)
    junk = "".join(rng.choice("ab '’\n\t0é漢😀<|>") for _ in range(300))
    return [
        (1, PROSE), (2, PROSE), (2, PROSE), (3, PROSE.replace("stranger", "traveller")), (4, None), (5, None), (6, ""), (7, " \t\n"),
        (8, LONG), (9, "x" * 5000), (10, "x" * 5000 + "y"), (11, f"Head one. {PASSAGE} Tail one."), (12, f"Head two. {PASSAGE} Tail two."),
        (12, f"Other text of the same id. {PASSAGE}"), (13, f"{PASSAGE}{PASSAGE}"), (14, "<|endoftext|>"), (15, "a <|endoftext|>'s b<|endoftext|>"),
        (16, junk), (17, "漢字かな交じり文 " * 40), (18, "Schöne Grüße aus Köln, viele Wörter, ein Straßenname. " * 6), (None, PROSE), (None, "no id here"),
        (19, "line\n" * 60), (20, "one two"), (21, "É" * 24), (22, "zé" + "É" * 26), (23, "1234567890 " * 10), (24, "don't 's 're'll  two  blanks   nbsp"),
    ]


CLASHING = ["fp", "row", "doc", "_doc", "_row", "_r", "r", "p", "key", "kept", "label", "base", "cell", "shard", "length", "_salt", "w", "n_words", "low", "id"]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(d, t, "en" if i % 2 else None, None, 0 if t is None else len(t), *(["x"] * len(CLASHING))) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema)
