"""The byte-level BPE of a tokenizer file: exact ids, pieces and pre-token starts.

``ByteBpe`` gives the ids of the tokenizers library for a ``.json`` file. Texts
of Latin letters take tiktoken with the same ranks, several times faster and
equal there (tests compare both); all others take the tokenizers library.
Instances live once in each Python worker.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Splits a text before the merges (the byte-level pre-tokenizer's own pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point both libraries' Unicode tables agree (checked by a test).
LATIN_END = 0x0250
_BEYOND_LATIN = re.compile(f"[^\0-{chr(LATIN_END - 1)}]")


@functools.cache
def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space")
        self.path, chars = path, _byte_of_char()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ranks = {bytes(map(chars.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = {s.encode(): i for s, i in special.items()}
        self.n_vocab = max([*self.ranks.values(), *special.values()]) + 1
        self.dtype = np.uint16 if self.n_vocab <= 1 << 16 else np.uint32
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=special)
        self.bytes_of = [b""] * self.n_vocab
        for t, i in [*self.ranks.items(), *self.special.items()]:
            self.bytes_of[i] = t
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        return self.fast._encode_single_piece(data)

    def has_special(self, text: str) -> bool:
        return any(s.decode() in text for s in self.special)

    def encode(self, text: str) -> np.ndarray:
        """The ids of the tokenizers library without begin and end tokens; special strings count as special."""
        if text.isascii() or not _BEYOND_LATIN.search(text):
            if not self.has_special(text):
                try:
                    return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), self.dtype)
                except ValueError:  # its regex stack is too small for a blank run of about a million; the library has no such limit
                    pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    @functools.cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(self.bytes_of), np.uint8), np.concatenate(([0], np.cumsum(self.lengths)))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes behind ids, special tokens included."""
        flat, at = self._flat
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids) or not ends[-1]:
            return b""
        where = np.arange(ends[-1]) + np.repeat(at[ids] - (ends - n), n)
        return flat[where].tobytes()


@functools.cache
def bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


# Classes of code points; OTHER covers symbols and the apostrophe, EDGE is the end of a text.
OTHER, LETTER, NUMBER, BLANK, SPACE, EDGE, UNSEEN = range(7)


class CodePointClasses:
    """Class of code points by the Unicode tables of the tokenizers library, looked up when first seen."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.table = np.full(0x110000, UNSEEN, np.uint8)
        self.kinds = [(k, pre_tokenizers.Split(Regex(p), "removed"))
                      for k, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+"))]
        self(np.arange(128, dtype=np.uint32))
        self.table[32] = SPACE

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        if (out == UNSEEN).any():
            new = np.unique(points[out == UNSEEN])
            text, kind = "".join(map(chr, new.tolist())), np.zeros(len(new), np.uint8)
            for k, split in self.kinds:
                hit = np.ones(len(new), bool)
                for _, (a, b) in split.pre_tokenize_str(text):
                    hit[a:b] = False
                kind[hit] = k
            self.table[new] = kind
            out = self.table[points]
        return out


@functools.cache
def code_point_classes() -> CodePointClasses:
    return CodePointClasses()


def pretoken_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True at each byte that begins a pre-token of ``PATTERN``.

    ``data`` holds texts in UTF-8 one after the other, ``begins`` the places
    where they begin (ascending, the first 0; empty texts do no harm). The
    pattern is a finite-window transducer over the classes of neighbouring
    code points, so it runs on whole arrays at once.
    """
    out = np.zeros(len(data), bool)
    if not len(data):
        return out
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead]
    points = first.astype(np.uint32)
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        at = np.flatnonzero((first >= low) & (first <= low + mask))
        if len(at):
            p = points[at] & mask
            for k in range(1, size):
                p = p << 6 | (data[lead[at] + k] & 0x3F)
            points[at] = p
    c = code_point_classes()(points)
    begin = np.zeros(len(data) + 1, bool)
    begin[begins] = True
    begin = begin[lead]
    prev = np.concatenate(([EDGE], c[:-1])).astype(np.uint8)
    prev[begin] = EDGE
    last = np.concatenate((begin[1:], [True]))
    blank = (c == BLANK) | (c == SPACE)
    prev_blank = (prev == BLANK) | (prev == SPACE)
    next_word = np.concatenate((~blank[1:], [False])) & ~last
    start = np.where(blank, ~prev_blank | next_word, (prev != c) & (prev != SPACE))
    quote = np.flatnonzero((points == 39) & start & ~last)
    if len(quote):
        ends = np.append(np.flatnonzero(begin), len(points))
        room = ends[np.searchsorted(ends, quote, "right")] - quote - 1
        pad = np.concatenate((points, [0, 0]))
        a, b = pad[quote + 1], np.where(room >= 2, pad[quote + 2], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[one | two] + 1] = False
        after = np.concatenate((quote[one][room[one] >= 2] + 2, quote[two][room[two] >= 3] + 3))
        start[after] = True
    out[lead] = start
    return out
