"""Byte-pair vocabularies: reading the public files, byte alphabets, merge tables."""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata

#: Entries of one generation of a word cache: bounds a worker's memory, never a result.
CACHE_ENTRIES = 60_000


class Cache(dict):
    """Values by key, made on the first look-up, in two generations.

    A full generation becomes the old one, from which what is asked for again is taken over; the one
    before is dropped.
    """

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 200:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


@functools.cache
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the others take U+0100 and up in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


# Letters and numbers of Unicode 16, which the tokenizer libraries know and this
# Python's own character data may not.
LATER = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 "
    "113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}


# Capitals of Unicode 16 and 17 and the first of their small letters, which this Python may not pair.
LATER_LOWER = "1C89>1C8A A7CB>264 A7CC>A7CD A7CE>A7CF A7D2>A7D3 A7D4>A7D5 A7DA>A7DB A7DC>19B 10D50-10D65>10D70 16EA0-16EB8>16EBB"

# Marks that the libraries' normalisation, whose character data is older, takes as letters that nothing moves past.
NEWER_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 "
    "1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F "
    "1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)


def code_points(run: str) -> range:
    low, _, high = run.partition("-")
    return range(int(low, 16), int(high or low, 16) + 1)


@functools.cache
def later_lower() -> dict[int, int]:
    return {c: int(to, 16) + k for pair in LATER_LOWER.split() for run, _, to in [pair.partition(">")] for k, c in enumerate(code_points(run))}


@functools.cache
def newer_marks() -> re.Pattern:
    return re.compile("([" + "".join(chr(c) for run in NEWER_MARKS.split() for c in code_points(run)) + "])")


@functools.cache
def possible_marks() -> re.Pattern:
    """Finds something wherever :func:`newer_marks` does, much faster: classes of many ranges above U+FFFF are tried range by range."""
    return re.compile("[" + "".join(chr(c) for run in NEWER_MARKS.split() for c in code_points(run) if c <= 0xFFFF) + "\U00010000-\U0010ffff]")


def composed(text: str) -> str:
    """NFC as the libraries know it."""
    if text.isascii():
        return text
    if possible_marks().search(text) and newer_marks().search(text):
        return "".join(part if k % 2 else unicodedata.normalize("NFC", part) for k, part in enumerate(newer_marks().split(text)))
    return unicodedata.normalize("NFC", text)


def lowered(text: str) -> str:
    """Small letters one by one, so that a final sigma is no special case, with the pairs of Unicode 16 and 17."""
    if text.isascii():
        return text.lower()
    if not later_lower().keys().isdisjoint(map(ord, set(text))):
        text = text.translate(later_lower())
    return text.replace("Σ", "σ").lower()


@functools.cache
def unicode_class(letter: str, top: int = sys.maxunicode) -> str:
    """Ranges of a regular expression's character class for a general category letter, up to the code point ``top``."""
    later = set()
    for run in LATER[letter].split():
        low, high = (int(x, 16) for x in run.split("-"))
        later.update(c for c in range(low, high + 1) if unicodedata.category(chr(c)) == "Cn")
    inside = [c for c in range(top + 1) if unicodedata.category(chr(c))[0] == letter or c in later]
    starts = [c for k, c in enumerate(inside) if not k or inside[k - 1] != c - 1]
    ends = [c for k, c in enumerate(inside) if k + 1 == len(inside) or inside[k + 1] != c + 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True))


#: White space of Unicode, as a character class.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@functools.cache
def load(path: str) -> tuple[dict[str, int], dict[int, tuple[int, int]], dict[str, int], str]:
    """(token -> id, pair of ids -> (rank, merged id) keyed by ``a << 32 | b``, added tokens, word-end suffix)."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    vocab, suffix = d["model"]["vocab"], d["model"].get("end_of_word_suffix") or ""
    pairs: dict[int, tuple[int, int]] = {}
    for rank, m in enumerate(d["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
    return vocab, pairs, {t["content"]: t["id"] for t in d["added_tokens"]}, suffix


def added_splitter(added: dict[str, int]):
    """Finds added tokens inside raw text, longest first."""
    return re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")
