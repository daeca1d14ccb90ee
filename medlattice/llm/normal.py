"""Words of a text as they are meant, whatever layout, mark-up, encoding or look-alike letters did to them."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts and signs that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v",
    "ԝ": "w", "х": "x", "у": "y", "з": "3",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe",
}
#: What misreading a letter gives, folded on both sides of a comparison.
MISREAD = {"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "5": "s", "$": "s", "@": "a"}

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrtbf\"'/\\])")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_SOFT_BREAK = re.compile(r"(?<=\w)[-‐‑]\s*\n[>|#*\s]*(?=\w)")


def _class(chars) -> re.Pattern:
    """A pattern of single characters."""
    return re.compile("[" + "".join(f"\\u{c:04x}" for c in chars) + "]")


_HIDDEN = _class([*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xAD, 0xFEFF, 0x34F, 0x180E])
_ACCENT = _class([c for c in range(0x10000) if unicodedata.combining(chr(c))])
_LOOKALIKE = re.compile("[" + "".join(LOOKALIKES) + "]")
_LATIN = str.maketrans(LOOKALIKES)
_READ = str.maketrans(MISREAD)
_WORD_SIGNS = re.compile(r"[^\w\s]|_")


def _unescape(m: re.Match) -> str:
    if m[1] or m[2]:
        return chr(int(m[1] or m[2], 16))
    return {"n": "\n", "r": "\n", "t": "\t", "b": "", "f": "\n"}.get(m[3], m[3])


def _percent(m: re.Match) -> str:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def without_comments(text: str) -> str:
    """A space for every closed comment of the mark-up."""
    made, start = [], 0
    while (first := text.find("<!--", start)) >= 0 and (last := text.find("-->", first)) >= 0:
        made += [text[start:first], " "]
        start = last + 3
    return "".join([*made, text[start:]]) if made else text


def plain(text: str) -> str:
    """The text without mark-up, escapes, hidden characters, odd encodings and line-end hyphens; letters kept."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "<" in text:
        text = _TAG.sub(" ", without_comments(text))
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "%" in text:
        text = _PERCENT.sub(_percent, text)
    if "Ã" in text or "â€" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "-" in text or "‐" in text:
        text = _SOFT_BREAK.sub("", text)
    return text


def fold(text: str) -> str:
    """Case, accents and look-alike letters removed."""
    text = text.casefold()
    if not text.isascii():
        text = _ACCENT.sub("", unicodedata.normalize("NFKD", text))
        if _LOOKALIKE.search(text):
            text = text.translate(_LATIN)
    return text


def words(text: str | None) -> list[str]:
    """Words in order: folded, without the punctuation in and around them (``2.38`` is ``238``, ``nmol/L`` ``nmoll``)."""
    if not text:
        return []
    return [w for w in _WORD_SIGNS.sub("", fold(plain(text))).split() if w]


def read_alike(word: str) -> str:
    """The same for words that a misreading turns into each other."""
    return word.translate(_READ).replace("rn", "m").replace("vv", "w").replace("cl", "d")
