"""The values of many JSON texts at once, as arrays over the bytes of an Arrow string column.

Quotes, brackets, colons and commas are found by comparing bytes; nesting depth is a running sum; brackets pair up in
the order of depth and place; each value's parent is the last bracket opened one level above it.  No text is walked:
the only loops are over wrapped bodies and over distinct strings with escapes.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJECT, ARRAY, STRING, SCALAR, NULL = range(5)
_SCALARS = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity"
_ALL_SCALARS = re.compile(rf"(?:(?:{_SCALARS})\n)*+\Z".encode())
_SCALAR = re.compile(rf"(?:{_SCALARS})\Z".encode())
_OUTER = "\ufeff \t\r\n\0"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_PLAIN, _SIGN, _BLANK, _QUOTE, _SLASH = range(5)
_BYTES = np.zeros(256, np.uint8)
_BYTES[list(b"{}[]:,")] = _SIGN
_BYTES[list(b" \t\r\n")] = _BLANK
_BYTES[ord('"')], _BYTES[ord("\\")] = _QUOTE, _SLASH
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b"\"\\/bfnrtu")] = True


def unwrapped(bodies: pa.Array) -> pa.Array:
    """Bodies without byte-order mark, outer white space and up to three wrappings as a JSON string; damaged wrappings NULL."""
    bare = pc.utf8_trim(bodies.cast(pa.large_string()), _OUTER)
    wrapped = np.flatnonzero(pc.fill_null(pc.starts_with(bare, '"'), False).to_numpy(zero_copy_only=False))
    if not len(wrapped):
        return bare
    made = bare.to_pylist()
    for i in wrapped.tolist():
        value = made[i]
        for _ in range(3):
            if not value.startswith('"'):
                break
            try:
                value = json.loads(value)
            except ValueError:
                value = None
                break
            value = value.strip(_OUTER)
        made[i] = value
    return pa.array(made, pa.large_string())


@dataclass
class Nodes:
    """Every value of the readable texts in the order they stand; arrays over values."""

    data: np.ndarray  #: bytes of all texts
    text: np.ndarray  #: row of the column
    kind: np.ndarray
    start: np.ndarray
    stop: np.ndarray  #: behind the value's last byte
    parent: np.ndarray  #: the value that holds it, -1 at the top
    place: np.ndarray  #: position in an array that holds it, else 0
    key_start: np.ndarray  #: its key in an object that holds it, without quotes; -1 where there is none
    key_stop: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((np.arange(len(self.parent)), self.parent))
        self._by_parent = order
        self._parents = self.parent[order]
        self._keys: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.text)

    def strings(self, start: np.ndarray, stop: np.ndarray) -> pa.Array:
        """The byte ranges as an Arrow string array; -1 starts are NULL."""
        size = np.where(start < 0, 0, stop - start)
        offsets = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - np.maximum(start, 0), size)
        made = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data[index])))
        return pc.if_else(pa.array(start < 0), pa.scalar(None, pa.large_string()), made) if (start < 0).any() else made

    def texts(self, at: np.ndarray) -> pa.Array:
        """Values as text: strings without their quotes and escapes, others as written, nulls and missing ones (-1) NULL."""
        there = at >= 0
        i = np.maximum(at, 0)
        if not len(self):
            return pa.nulls(len(at), pa.string())
        quote = (self.kind[i] == STRING).astype(np.int64)
        gone = ~there | (self.kind[i] == NULL)
        return unescaped(self.strings(np.where(gone, -1, self.start[i] + quote), self.stop[i] - quote), quote > 0)

    def named(self, key: str) -> tuple[np.ndarray, np.ndarray]:
        """(parents, values) of the members with a key, in order of their parents; of repeated keys the last."""
        if key not in self._keys:
            raw = key.encode()
            at = np.flatnonzero((self.key_stop - self.key_start == len(raw)) & (self.key_start >= 0))
            for k, c in enumerate(raw):
                at = at[self.data[self.key_start[at] + k] == c]
            order = np.lexsort((at, self.parent[at]))
            at = at[order]
            parents = self.parent[at]
            last = np.append(parents[1:] != parents[:-1], True) if len(at) else np.zeros(0, bool)
            self._keys[key] = parents[last], at[last]
        return self._keys[key]

    def member(self, at: np.ndarray, key: str) -> np.ndarray:
        """The member ``key`` of each value, -1 where there is none."""
        parents, values = self.named(key)
        if not len(parents):
            return np.full(len(at), -1)
        k = np.minimum(np.searchsorted(parents, at), len(parents) - 1)
        return np.where((parents[k] == at) & (at >= 0), values[k], -1)

    def members(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, index into ``at``, position): the elements of arrays, and other values by themselves; missing ones give none."""
        index = np.flatnonzero(at >= 0)
        at = at[index]
        first = np.searchsorted(self._parents, at, side="left")
        size = np.searchsorted(self._parents, at, side="right") - first
        is_list = self.kind[at] == ARRAY
        n = np.where(is_list, size, 1)
        offsets = np.concatenate([[0], np.cumsum(n)])
        owner = np.repeat(np.arange(len(at)), n)
        place = np.arange(offsets[-1]) - offsets[:-1][owner]
        inside = self._by_parent[np.minimum(first[owner] + place, max(0, len(self) - 1))] if len(self) else owner
        return np.where(is_list[owner], inside, at[owner]), index[owner], place

    def filled(self) -> np.ndarray:
        """Whether a value that is neither null nor an empty string lies at any depth of each value."""
        content = (self.kind == SCALAR) | ((self.kind == STRING) & (self.stop - self.start > 2))
        total = np.concatenate([[0], np.cumsum(content)])
        return total[np.searchsorted(self.start, self.stop, side="left")] > total[: len(self)]


def unescaped(strings: pa.Array, quoted: np.ndarray) -> pa.Array:
    """Escapes of JSON strings undone; each different one once."""
    odd = np.flatnonzero(pc.fill_null(pc.match_substring(strings, "\\"), False).to_numpy(zero_copy_only=False) & quoted)
    if len(odd):
        made = strings.to_pylist()
        known: dict[str, str] = {}
        for i in odd.tolist():
            raw = made[i]
            if raw not in known:
                known[raw] = json.loads(f'"{raw}"').encode("utf-8", "replace").decode("utf-8")
            made[i] = known[raw]
        return pa.array(made, pa.string())
    return strings.cast(pa.string())


def _damaged_strings(data: np.ndarray, inside: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """Where strings hold what no JSON string may hold: control characters and unknown escapes."""
    control = np.flatnonzero(data < 32)
    at = escapes[inside[escapes]]
    ahead = lambda k: data[np.minimum(at + k, len(data) - 1)]
    wrong = ~_ESCAPED[ahead(1)]
    unicode = ahead(1) == ord("u")
    for k in range(2, 6):
        wrong |= unicode & ~_HEX[ahead(k)]
    return np.concatenate([control[inside[control]], at[wrong]])


def read(texts: pa.Array) -> Nodes:
    """The values of all texts that are well-formed JSON; others give none."""
    rows = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False))
    texts = texts.drop_null().cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n, none = len(data), np.zeros(0, np.int64)
    if not n:
        return Nodes(data, none, none, none, none, none, none, none, none)
    text_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
    kinds = _BYTES[data]
    heads = offsets[:-1][offsets[:-1] < n]
    slashes = np.flatnonzero(kinds == _SLASH)
    escape, escaped = np.zeros(n, bool), np.zeros(n + 1, bool)
    if len(slashes):  # every second of a run of backslashes is escaped, and so is what follows an odd run
        new_run = np.concatenate([[True], np.diff(slashes) != 1]) | np.isin(slashes, heads)
        first_of = np.maximum.accumulate(np.where(new_run, np.arange(len(slashes)), 0))
        acting = slashes[(np.arange(len(slashes)) - first_of) % 2 == 0]
        escape[acting] = True
        escaped[acting + 1] = True
        escaped[heads] = False
    quotes = np.flatnonzero((kinds == _QUOTE) & ~escaped[:n])
    is_quote = np.zeros(n, bool)
    is_quote[quotes] = True
    odd = np.bitwise_xor.accumulate(is_quote)  # within a string, its first quote included, once texts start even
    carried = np.concatenate([[False], odd])[np.minimum(offsets[:-1], n)]
    if carried.any():
        odd ^= np.repeat(carried, np.diff(offsets))
    outside = ~odd & ~is_quote
    sign = outside & (kinds == _SIGN)
    plain = outside & (kinds != _SIGN) & (kinds != _BLANK)
    edge = np.zeros(n + 1, bool)
    edge[heads] = True
    edge[n] = True
    begins, ends = plain.copy(), plain.copy()
    begins[1:] &= ~plain[:-1] | edge[1:n]
    ends[:-1] &= ~plain[1:] | edge[1:n]
    s0, s1 = np.flatnonzero(begins), np.flatnonzero(ends) + 1

    good = np.ones(len(offsets) - 1, bool)
    good[np.diff(offsets) == 0] = False
    quotes_before = np.searchsorted(quotes, offsets)
    good[np.diff(quotes_before) % 2 == 1] = False
    good[text_of(_damaged_strings(data, odd & ~is_quote, np.flatnonzero(escape)))] = False
    if len(s0):
        size = s1 - s0 + 1
        at = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(at[-1]) - np.repeat(at[:-1] - s0, size)
        joined = data[np.minimum(index, n - 1)].copy()
        joined[at[1:] - 1] = 10
        if not _ALL_SCALARS.match(joined.tobytes()):
            whole = data.tobytes()
            wrong = [a for a, b in zip(s0.tolist(), s1.tolist()) if not _SCALAR.match(whole, a, b)]
            good[text_of(np.array(wrong, np.int64))] = False

    # tokens in order: signs, strings (at their first quote) and scalars (at their first byte)
    token = np.sort(np.concatenate([np.flatnonzero(sign), s0, np.flatnonzero(is_quote & odd)]))
    token = token[good[text_of(token)]]
    kind = data[token]
    opens = (kind == ord("{")) | (kind == ord("["))
    closes = (kind == ord("}")) | (kind == ord("]"))
    owner = text_of(token)
    level = np.cumsum(opens.astype(np.int64) - closes)
    first = np.searchsorted(owner, np.arange(len(good)), side="left")
    last = np.searchsorted(owner, np.arange(len(good)), side="right")
    good &= last > first
    ground = np.where(first > 0, level[np.minimum(first - 1, max(0, len(level) - 1))] if len(level) else 0, 0)
    if len(level):
        lowest = np.full(len(good), 0)
        np.minimum.at(lowest, owner, level - ground[owner])
        total = np.where(last > first, level[np.maximum(last - 1, 0)] - ground, 0)
        good &= (lowest >= 0) & (total == 0)
    kept = good[owner]
    token, kind, opens, closes, owner = token[kept], kind[kept], opens[kept], closes[kept], owner[kept]
    m = len(token)
    if not m:
        return Nodes(data, none, none, none, none, none, none, none, none)
    level = np.cumsum(opens.astype(np.int64) - closes)
    holder_level = level - opens  # level of the bracket that holds the token; of a closing one, that of its opening one's
    own_level = level + closes  # a bracket's own level
    brackets = np.flatnonzero(opens | closes)
    ordered = brackets[np.lexsort((brackets, own_level[brackets]))]
    partner = np.full(m, -1)
    partner[ordered[0::2]], partner[ordered[1::2]] = ordered[1::2], ordered[0::2]
    mismatch = closes & (data[token] - data[token[partner]] != 2)
    opened = np.flatnonzero(opens)
    rank = opened[np.lexsort((opened, own_level[opened]))]
    keys = own_level[rank] * (m + 1) + rank
    inner = np.where(closes, own_level, holder_level)
    found = np.searchsorted(keys, inner * (m + 1) + np.arange(m), side="left") - 1
    holder = np.where(inner > 0, rank[np.maximum(found, 0)], -1) if len(rank) else np.full(m, -1)
    within = np.where(holder >= 0, kind[np.maximum(holder, 0)], 0)  # { or [ or 0

    head = np.concatenate([[True], owner[1:] != owner[:-1]])
    before = np.where(head, 0, np.concatenate([[0], kind[:-1]]))
    is_string = kind == ord('"')
    is_sign = (kind == ord(":")) | (kind == ord(","))
    starts = ~closes & ~is_sign
    key = is_string & (within == ord("{")) & ((before == ord("{")) | (before == ord(",")))
    key_before = np.concatenate([[False], key[:-1]]) & ~head
    value_before = ~head & ~key_before & ~np.isin(before, list(b"{[:,"))
    fine = np.select(
        [key, starts & (within == 0), starts & (within == ord("[")), starts, kind == ord(":"), kind == ord(","), closes],
        [True, head, (before == ord("[")) | (before == ord(",")), before == ord(":"), key_before, value_before & (within != 0), value_before | (before == kind - 2)],
        False,
    )
    good[owner[~fine | mismatch]] = False

    comma = (kind == ord(",")) & (within == ord("["))
    order = np.lexsort((np.arange(m), holder))
    passed = np.cumsum(comma[order])
    group = np.concatenate([[True], holder[order][1:] != holder[order][:-1]])
    base = np.maximum.accumulate(np.where(group, np.concatenate([[0], passed[:-1]]), 0))
    place = np.empty(m, np.int64)
    place[order] = passed - base
    value = starts & ~key & good[owner]
    at = np.flatnonzero(value)
    number = np.full(m, -1)
    number[at] = np.arange(len(at))
    quote_no = np.searchsorted(quotes, token)
    closing = quotes[np.minimum(quote_no + 1, len(quotes) - 1)] if len(quotes) else np.zeros(m, np.int64)
    scalar_stop = s1[np.minimum(np.searchsorted(s0, token), len(s0) - 1)] if len(s0) else np.zeros(m, np.int64)
    stop = np.select([opens, is_string], [token[np.maximum(partner, 0)] + 1, closing + 1], scalar_stop)
    named = np.where(within[at] == ord("{"), at - 2, -1)  # key and colon stand before it
    key_at = token[np.maximum(named, 0)]
    node_kind = np.select([kind[at] == ord("{"), kind[at] == ord("["), is_string[at], kind[at] == ord("n")], [OBJECT, ARRAY, STRING, NULL], SCALAR)
    return Nodes(
        data, rows[owner[at]], node_kind, token[at], stop[at], np.where(holder[at] >= 0, number[np.maximum(holder[at], 0)], -1),
        np.where(within[at] == ord("["), place[at], 0), np.where(named >= 0, key_at + 1, -1), np.where(named >= 0, closing[np.maximum(named, 0)], -1),
    )
