"""Whole batches of texts cut into words by numpy: kind, form, hash and place of every word, without a loop over words."""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Kinds of a word.
PLAIN, NUMBER, CODE, URL, TAG, IDEOGRAPH = range(6)
#: What stands before a word.
NOTHING, COMMA, SIGN, BOUND = range(4)
#: Texts are handled together up to so many characters; a longer one is handled by itself.
TOGETHER = 1_000_000

_SPACE, _LOWER, _UPPER, _DIGIT, _END, _COMMA, _SIGN, _URL, _TAG, _PAGE, _IDEO, _SILENT = range(12)
_URL_CHAR, _TAG_CHAR = "\ue000", "\ue001"
_GROUP = np.zeros(12, np.int8)
_GROUP[[_LOWER, _UPPER, _DIGIT]] = 1
_GROUP[[_URL, _TAG, _IDEO]] = 2, 3, 4
_MARKS = re.compile(r"<[a-zA-Z/][^<>\0]*>|(?:https?://|www\.)[^\s<>\"')\]\0]+|#[^\W\d][\w-]*")
_LINK = re.compile(r"https?://|www\.|href", re.I)
_HIDDEN = re.compile("[​-‏⁠-⁤­﻿]")
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, np.uint64(0x100000001B3))]), dtype=np.uint64)


def _masked(m: re.Match) -> str:
    t = m[0]
    if t[0] == "#":
        return _TAG_CHAR * len(t)
    if t[0] == "<" and not _LINK.search(t):
        return " " * len(t)
    return _URL_CHAR * len(t)


def readable(text: str) -> str:
    """Entities, wide and hidden characters undone."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return text.replace("\0", " ")


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every character of the basic plane."""
    kind = np.zeros(0x10000, np.uint8)
    lower = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if 0x0E00 <= c <= 0x0EFF or 0x1000 <= c <= 0x109F or 0x1780 <= c <= 0x17FF or 0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF:
            kind[c] = _IDEO if cat[0] in "LM" else _SIGN
        elif cat in ("Lu", "Lt"):
            kind[c] = _UPPER
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif cat[0] in "LM":
            kind[c] = _LOWER
        elif cat[0] == "N":
            kind[c] = _DIGIT
        elif cat[0] in "PS":
            kind[c] = _SIGN
    for signs, k in ((".!?;\n\r…。！？।؟۔", _END), (",:()،、", _COMMA), ("'’\"“”„«»‘", _SILENT)):
        for ch in signs:
            kind[ord(ch)] = k
    kind[0], kind[ord(_URL_CHAR)], kind[ord(_TAG_CHAR)] = _PAGE, _URL, _TAG
    return kind, lower


@dataclass(frozen=True)
class Words:
    """The words of a slice of texts, in order; every field is an array over them but ``n_texts``."""

    n_texts: int
    text: np.ndarray  #: position of the text
    passage: np.ndarray  #: words between two ends of a line or sentence share a number
    kind: np.ndarray
    before: np.ndarray  #: the sign before the word
    size: np.ndarray  #: characters
    upper: np.ndarray  #: capital letters
    first_upper: np.ndarray
    hash: np.ndarray  #: of the word in lower case

    def __len__(self) -> int:
        return len(self.text)


def hash_of(word: str) -> int:
    """The hash that ``lex`` gives a plain word."""
    return int(lex([word]).hash[0])


def lex(texts: Sequence[str | None]) -> Words:
    """Cut texts into words.  NULL and empty texts have none."""
    whole = _MARKS.sub(_masked, "\0".join(readable(t) if t else "" for t in texts))
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    table, lower = _tables()
    codes = np.where(codes < 0x10000, codes, 0xFFFD)
    kind = table[codes]
    digit = kind == _DIGIT
    if len(kind) > 2:  # signs between two digits belong to the number
        inside = np.zeros(len(kind), bool)
        inside[1:-1] = digit[:-2] & digit[2:] & np.isin(kind[1:-1], (_END, _COMMA, _SIGN)) & (codes[1:-1] != 10)
        kind = np.where(inside, _DIGIT, kind)
    # characters of one word share a group; ideographs are paired
    group = _GROUP[kind]
    n = len(group)
    if n == 0 or not group.any():
        none = np.zeros(0, np.int64)
        return Words(len(texts), none, none, none, none, none, none, none.astype(bool), none)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(group[1:], group[:-1], out=change[1:])
    ideographs = group == 4
    if ideographs.any():
        since = np.arange(n) - np.maximum.accumulate(np.where(change, np.arange(n), 0))
        change |= ideographs & (since % 2 == 0)
    starts = np.flatnonzero(change)
    real = group[starts] > 0
    at = starts[real]
    stop = np.append(starts[1:], n)[real]
    place = np.arange(n, dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, n)))
    with np.errstate(over="ignore"):
        mixed = np.add.reduceat((lower[codes].astype(np.uint64) + np.uint64(7)) * _POWERS[place & 255], starts)[real]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    count_to = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
    within = lambda counts: (counts[stop] - counts[at]).astype(np.int64)
    digits, uppers = within(count_to(kind == _DIGIT)), within(count_to(kind == _UPPER))
    g = group[at]
    word_kind = np.select([g == 2, g == 3, g == 4, (digits > 0) & (kind[at] != _DIGIT), digits > 0], [URL, TAG, IDEOGRAPH, CODE, NUMBER], PLAIN)
    pages, ends, commas, signs = (count_to(kind == k) for k in (_PAGE, _END, _COMMA, _SIGN))
    since = np.concatenate([[0], stop[:-1]])
    between = lambda counts: counts[at] > counts[since]
    text = pages[at].astype(np.int64)
    bound = between(ends) | between(pages)
    bound[0] = True
    before = np.select([bound, between(commas), between(signs)], [BOUND, COMMA, SIGN], NOTHING)
    return Words(len(texts), text, np.cumsum(bound) - 1, word_kind, before, stop - at, uppers, kind[at] == _UPPER, mixed.view(np.int64))


def slices(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are handled together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size + n > TOGETHER and i > start:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def since_last(owner: np.ndarray, value: np.ndarray, apart: int = 1 << 30) -> np.ndarray:
    """Words since the same hash stood in the same owner (a text or passage); ``apart`` where it did not."""
    n = len(owner)
    made = np.full(n, apart, np.int64)
    if n < 2:
        return made
    with np.errstate(over="ignore"):
        both = value.view(np.uint64) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(both, kind="stable")
    a, b = order[:-1], order[1:]
    same = both[a] == both[b]
    made[b[same]] = b[same] - a[same]
    return made
