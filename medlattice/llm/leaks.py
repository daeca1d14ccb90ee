"""Evaluation items given away by training documents, whole or in part, reworded or re-parameterised.

Numbers, names and units of items and documents become typed placeholders; the hashes of windows of the templates that
remain are joined with those of the items.  Windows that follow each other in item and document make a stretch; in it
the slots are compared, and only words that agree count.  A stretch whose slots and words differ too often is another
text of the same template, not a copy.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, dimension, spread
from .lexing import slices
from .normal import plain, read_alike, words

NUMBER, UNIT, NAME = "\x01n", "\x01u", "\x01p"
#: Units of measure, as words() spells them.
UNITS = frozenset("mg g kg ug ng l ml dl mmhg mmoll umoll nmoll moll mgl ugl gl gdl mgdl ul 109l min lmin bpm npx ms mm cm m km c f iu iul mlmin h s percent".split())
#: Number words up to twenty, and tens, by language and as words() spells them.
NUMBER_WORDS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty",
    "de": "null eins zwei drei vier funf sechs sieben acht neun zehn elf zwolf dreizehn vierzehn funfzehn sechzehn siebzehn achtzehn neunzehn zwanzig",
    "fr": "zero un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dixsept dixhuit dixneuf vingt",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho diecinueve veinte",
}
TENS = {
    "en": "twenty thirty forty fifty sixty seventy eighty ninety", "de": "zwanzig dreissig vierzig funfzig sechzig siebzig achtzig neunzig",
    "fr": "vingt trente quarante cinquante soixante quatrevingt", "es": "veinti treinta cuarenta cincuenta sesenta setenta ochenta noventa",
}


def _spelled_numbers() -> frozenset[str]:
    """Numbers in words: units, tens, and tens with a unit before or behind them.

    One is left out by itself, as it is an article too; so are the spellings of two words.
    """
    made: set[str] = set()
    for language, small in NUMBER_WORDS.items():
        units = small.split()
        tens = TENS[language].split()
        made.update(units[2:])
        made.update(t for t in tens if t != "veinti")
        for t in tens:
            for u in units[1:20]:
                made.update({f"{u}und{t}", f"{'ein' if u == 'eins' else u}und{t}"} if language == "de" else {t + u, f"{t}et{u}"} if language == "fr" else {t + u})
    return frozenset(made)


READ_SPELLED = frozenset(read_alike(w) for w in _spelled_numbers())
READ_UNITS = frozenset(read_alike(w) for w in UNITS)


@dataclass(frozen=True)
class Rule:
    """When a document gives an item away."""

    window: int = 3  #: template words in a hashed window
    gap: int = 2  #: words of item or document between two windows of a stretch
    stretch: int = 8  #: agreeing words a stretch must have
    agreement: float = 0.75  #: share of a stretch's words that must agree
    conflict: float = 0.34  #: share of a stretch's aligned slots that may hold another value in a copy
    share: float = 1 / 3  #: share of the item's words that all its stretches together must hold
    template_share: float = 0.5  #: the same where most of them lie in stretches with other slots
    literal: float = 0.97  #: share of a stretch's words between slots that agree where it is the item with other slots
    shared_by: int = 3  #: items that must end in the same sentence for it to be a standard instruction
    instruction: int = 6  #: least words of a standard instruction


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if s]


@dataclass(frozen=True)
class Vocabulary:
    """The words of all items, as a misreading leaves them, and those of them that are names."""

    known: frozenset[str]
    names: frozenset[str]


def item_body(text: str | None, standard: frozenset[str] | set[str]) -> list[str]:
    """The sentences of an item without a standard instruction at its end; an item that is nothing else keeps it."""
    sentences = _sentences(plain(text)) if text else []
    if len(sentences) > 1 and " ".join(words(sentences[-1])) in standard:
        sentences = sentences[:-1]
    return sentences


def ending(text: str | None) -> tuple[str, str]:
    """The words of a text's last sentence and of what stands before it."""
    sentences = _sentences(plain(text)) if text else []
    return (" ".join(words(sentences[-1])), " ".join(words(" ".join(sentences[:-1])))) if sentences else ("", "")


def standard_endings(texts: Iterable[str | None], rule: Rule = Rule()) -> frozenset[str]:
    """Last sentences that stand behind several different beginnings; copies of one item say nothing."""
    bodies: dict[str, set[str]] = defaultdict(set)
    for t in texts:
        end, body = ending(t)
        if body and len(end.split()) >= rule.instruction:
            bodies[end].add(body)
    return frozenset(e for e, b in bodies.items() if len(b) >= rule.shared_by)


def word_roles(sentences: Sequence[str]) -> Iterator[tuple[str, int, int]]:
    """(word, written like a name, written in lower case) for the words of an item without digits."""
    for s in sentences:
        for k, raw in enumerate(s.split()):
            for w in words(raw):
                if not any(c.isdigit() for c in w):
                    yield read_alike(w), int(k > 0 and raw[:1].isupper()), int(k > 0 and raw[:1].islower())


def vocabulary(roles: Iterable[tuple[str, int, int]]) -> Vocabulary:
    """Names are the words written like one and never in lower case."""
    known, names, lower = set(), set(), set()
    for w, name, small in roles:
        known.add(w)
        if name:
            names.add(w)
        if small:
            lower.add(w)
    return Vocabulary(frozenset(known), frozenset(names - lower))


class Marks(dict):
    """word -> (as read, mark), remembered; a word that no item knows may stand for a name."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[str, str]:
        read = read_alike(word)
        if word.isdigit():
            mark = NUMBER
        elif read in READ_UNITS:
            mark = UNIT
        elif read in READ_SPELLED:
            mark = NUMBER
        elif read in self.vocabulary.known:
            mark = NAME if read in self.vocabulary.names else read
        else:
            mark = NUMBER if word[0].isdigit() else NAME
        if len(self) > 500_000:  # the words of a crawl have no end
            self.clear()
        self[word] = (read, mark)
        return read, mark


def template(tokens: Sequence[str], marks: Marks) -> tuple[list[str], list[str]]:
    """Words as read, and the template with numbers, units and names replaced."""
    pairs = [marks[w] for w in tokens]
    return [p[0] for p in pairs], [p[1] for p in pairs]


class Codes(dict):
    """Words as 64-bit numbers, remembered; placeholders have the lowest bit set, words have not."""

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh3_64_intdigest(word) & ~1 | (word[0] == "\x01")
        if len(self) > 500_000:
            self.clear()
        self[word] = code
        return code


class Lexicon(dict):
    """word -> its number, with the codes of what it is read as and of its mark by number."""

    def __init__(self, marks: Marks, codes: Codes):
        super().__init__()
        self.marks, self.codes = marks, codes
        self.said: list[int] = []
        self.meant: list[int] = []

    def __missing__(self, word: str) -> int:
        read, mark = self.marks[word]
        self.said.append(self.codes[read])
        self.meant.append(self.codes[mark])
        self[word] = number = len(self.said) - 1
        return number

    def of(self, texts: Sequence[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all words of the texts in order."""
        if len(self) > 500_000:  # the words of a crawl have no end
            self.clear()
            self.said.clear()
            self.meant.clear()
        numbers = np.fromiter((self[w] for t in texts for w in t), np.int64, sum(map(len, texts)))
        return np.array(self.said, np.uint64)[numbers], np.array(self.meant, np.uint64)[numbers]


def _rolled(codes: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A hash for every window of ``width`` codes."""
    made = np.full(max(0, len(codes) - width + 1), salt, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            made = (made ^ codes[k : len(codes) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            made ^= made >> np.uint64(31)
    return made.view(np.int64)


def window_hashes(read: list[str], marks: list[str], codes: Codes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the template's windows and of those of the words themselves, and which template windows hold words enough."""
    said = np.fromiter((codes[w] for w in read), np.uint64, len(read))
    meant = np.fromiter((codes[m] for m in marks), np.uint64, len(marks))
    literal = np.concatenate([[0], np.cumsum(1 - (meant & np.uint64(1)).astype(np.int64))])
    n = max(0, len(read) - width + 1)
    return _rolled(meant, width, 11), _rolled(said, width, 23), literal[width : width + n] - literal[:n] >= 2


def item_windows(read: list[str], marks: list[str], codes: Codes, width: int) -> np.ndarray:
    """The hash by which each window of an item is looked for.

    German nouns look like names: a window with too few words that are none is looked for by its words themselves.
    """
    meant, said, enough = window_hashes(read, marks, codes, width)
    return np.where(enough, meant, said)


@dataclass
class Index:
    """Items with their words, templates and windows: what a single process needs to judge texts."""

    rule: Rule
    marks: Marks
    codes: Codes = field(default_factory=Codes)
    items: dict[int, tuple[list[str], list[str]]] = field(default_factory=dict)
    windows: dict[int, list[tuple[int, int]]] = field(default_factory=dict)


def build_index(items: Sequence[tuple[int, str | None]], rule: Rule = Rule(), standard: frozenset[str] | None = None, known: Vocabulary | None = None) -> Index:
    """Index items given as (id, text); a sentence that ends many different ones is no part of any."""
    standard = standard_endings((t for _, t in items), rule) if standard is None else standard
    bodies = {i: item_body(t, standard) for i, t in items if i is not None and t}
    known = vocabulary(r for s in bodies.values() for r in word_roles(s)) if known is None else known
    index = Index(rule, Marks(known))
    windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, sentences in bodies.items():
        tokens = words(" ".join(sentences))
        if tokens:
            index.items[i] = template(tokens, index.marks)
            for p, h in enumerate(item_windows(*index.items[i], index.codes, rule.window).tolist()):
                windows[h].append((i, p))
    index.windows = dict(windows)
    return index


def _runs(hits: list[tuple[int, int]], width: int) -> list[list[int]]:
    """[item from, item to, document from, document to] of windows that follow each other on one diagonal."""
    made: list[list[int]] = []
    open_runs: dict[int, list[int]] = {}
    for d, p in hits:
        run = open_runs.get(d - p)
        if run is not None and p <= run[1]:
            run[1], run[3] = p + width, d + width
        else:
            run = [p, p + width, d, d + width]
            open_runs[d - p] = run
            made.append(run)
    return made


def _filled_anew(item: list[str], document: list[str], aligned: dict[int, int], slots: set[int], agree: set[int], rule: Rule) -> bool:
    """Whether a stretch is the item with other parameters: the words between the slots agree, and equal slots stay equal."""
    between = [p for p in aligned if p not in slots]
    if sum(p in agree for p in between) < rule.literal * len(between):
        return False
    value: dict[str, str] = {}
    return all(value.setdefault(item[p], document[aligned[p]]) == document[aligned[p]] for p in slots) and len(set(value.values())) == len(value)


def stretches(item: list[str], document: list[str], hits: list[tuple[int, int]], rule: Rule, item_marks: list[str], document_marks: list[str]) -> list[tuple[int, int, int, int, set[int], bool]]:
    """Stretches of the document in the item's order: item and document range, the item's words held, and whether the slots agree.

    Where the slots agree, the passage is the item's and holds its words, single changed or dropped ones too; where
    they hold other values, it is the template with other parameters, and only words that agree are held.
    """
    runs = sorted(_runs(hits, rule.window), key=lambda r: (r[2], r[0]))
    score = [r[1] - r[0] for r in runs]
    before = [-1] * len(runs)
    ending: dict[int, list[int]] = defaultdict(list)  # earlier runs by their end in the document
    for j, b in enumerate(runs):
        own, best = b[1] - b[0], 0
        for i in sorted((i for e in range(b[2] - rule.gap, b[2] + rule.window) for i in ending.get(e, ())), reverse=True):
            a = runs[i]
            if a[2] < b[2] and a[0] < b[0] and a[1] - b[0] < own and -rule.window < b[0] - a[1] <= rule.gap and -rule.window < b[2] - a[3] <= rule.gap:
                gain = score[i] - max(0, a[1] - b[0], a[3] - b[2]) - (1 if b[2] - b[0] != a[2] - a[0] else 0)
                if gain > best:
                    best, before[j] = gain, i
        score[j] = own + best
        ending[b[3]].append(j)
    taken, made = set(), []
    held: set[int] = set()
    for j in sorted(range(len(runs)), key=lambda j: -score[j]):
        chain, k = [], j
        while k >= 0 and k not in taken:
            chain.append(k)
            taken.add(k)
            k = before[k]
        if not chain:
            continue
        chain.reverse()
        aligned = {p + s: d + s for p, q, d, _ in (runs[k] for k in chain) for s in range(q - p)}
        for a, b in zip(chain, chain[1:]):  # single words between two runs
            gap_item, gap_document = runs[b][0] - runs[a][1], runs[b][2] - runs[a][3]
            if gap_item == gap_document:
                aligned |= {runs[a][1] + s: runs[a][3] + s for s in range(gap_item)}
        agree = {p for p, d in aligned.items() if item[p] == document[d]}
        first, last = runs[chain[0]], runs[chain[-1]]
        # a number in words says nothing about one in digits
        slots = [p for p, d in aligned.items() if item_marks[p][0] == "\x01" == document_marks[d][0] and (document[d] in READ_SPELLED) == (item[p] in READ_SPELLED)]
        same = sum(p in agree for p in slots)
        fresh = agree - held
        if len(fresh) >= rule.stretch and len(agree) >= rule.agreement * max(last[1] - first[0], last[3] - first[2]):
            own = len(slots) - same <= rule.conflict * len(slots) or _filled_anew(item, document, aligned, set(slots), agree, rule)
            if own and len(slots) - same <= rule.conflict * len(slots):
                fresh = set(range(first[0], last[1])) - held
            held |= fresh | agree
            made.append((first[0], last[1], first[2], last[3], fresh, own))
    return made


def enough_windows(n: int, rule: Rule) -> float:
    """Different windows of an item of ``n`` words that a document must share to be looked at."""
    return max(3, 0.25 * rule.share * n)


def compare(item: tuple[list[str], list[str]], read: list[str], marks: list[str], hits: list[tuple[int, int]], rule: Rule) -> tuple[int, int, int] | None:
    """(words held, words of the item, stretches) where the document gives the item away, else None."""
    n = len(item[0])
    if len({p for _, p in hits}) < enough_windows(n, rule):
        return None
    parts = stretches(item[0], read, hits, rule, item[1], marks)
    held = sum(len(s[4]) for s in parts)
    own = sum(len(s[4]) for s in parts if s[5])
    if held and held >= (rule.share if 2 * own >= held else max(rule.share, rule.template_share)) * n:
        return held, n, len(parts)
    return None


def judge(text: str | None, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, words held, words of the item, stretches) for every item that the text gives away."""
    tokens = words(text)
    if len(tokens) < index.rule.stretch:
        return []
    read, marks = template(tokens, index.marks)
    meant, said, _ = window_hashes(read, marks, index.codes, index.rule.window)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, pair in enumerate(zip(meant.tolist(), said.tolist())):
        for h in pair:
            for i, p in index.windows.get(h, ()):
                hits[i].append((d, p))
    found = ((i, compare(index.items[i], read, marks, at, index.rule)) for i, at in hits.items())
    return [(i, *case) for i, case in found if case]


#: Words and standard instructions that all items together may have; they are held by every task.
MAX_WORDS, MAX_ENDINGS = 20_000_000, 100_000
#: Bits of the filter of window hashes at most; a larger item set makes it less selective, and no less exact.
FILTER_BITS = 1 << 30
SCHEMA = "doc_id long, item_id long, words_held int, item_words int, n_stretches int"


def _bounded(rows: DataFrame, most: int, what: str) -> pa.Table:
    made = rows.limit(most + 1).toArrow()
    if made.num_rows > most:
        raise ValueError(f"more than {most} {what}")
    return made


def learn(items: DataFrame, rule: Rule) -> tuple[frozenset[str], Vocabulary]:
    """Standard instructions and words of all items (item_id, t), counted in one pass each."""

    def ends(batches):
        for pdf in batches:
            pairs = [ending(t) for t in pdf["t"]]
            kept = [(e, xxhash.xxh3_64_intdigest(b) >> 1) for e, b in pairs if b and len(e.split()) >= rule.instruction]
            yield pd.DataFrame(kept, columns=["e", "b"])

    shared = items.select("t").mapInPandas(ends, "e string, b long").distinct().groupBy("e").count().where(F.col("count") >= rule.shared_by).select("e")
    standard = frozenset(_bounded(shared, MAX_ENDINGS, "standard instructions").column(0).to_pylist())

    def told(batches):
        for pdf in batches:
            made = pd.DataFrame([r for t in pdf["t"] for r in word_roles(item_body(t, standard))], columns=["w", "n", "l"])
            yield made.groupby("w", as_index=False).max()

    roles = items.select("t").mapInPandas(told, "w string, n int, l int").groupBy("w").agg(F.max("n").alias("n"), F.max("l").alias("l"))
    rows = _bounded(roles, MAX_WORDS, "different words of items").to_pydict()
    return standard, vocabulary(zip(rows["w"], rows["n"], rows["l"]))


def _filter(windows: DataFrame) -> tuple[int, np.ndarray]:
    """(bits to drop, bit set) of all window hashes: sixteen bits or more for each, up to FILTER_BITS."""
    n = windows.count()
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
    drop = 64 - (bits.bit_length() - 1)
    placed = windows.select(F.shiftrightunsigned("h", drop).alias("top")).select(F.shiftright("top", 5).alias("slot"), F.expr("shiftleft(1L, cast(top % 32 as int))").alias("bit"))
    parts = placed.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    made = np.zeros(bits // 32, np.uint32)
    made[parts.column("slot").to_numpy()] = parts.column("bits").to_numpy().astype(np.uint32)
    return drop, made


def _within(hashes: np.ndarray, drop: int, bits: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through; each that an item has, and few others."""
    top = hashes.view(np.uint64) >> np.uint64(drop)
    return (bits[(top >> np.uint64(5)).astype(np.int64)] >> (top & np.uint64(31)).astype(np.uint32)) & 1 > 0


def near_enough(places: np.ndarray, rule: Rule) -> np.ndarray:
    """Which of the sorted places of shared windows may belong to a stretch: those in groups that span one."""
    if not len(places):
        return np.zeros(0, bool)
    group = np.concatenate([[0], np.cumsum(np.diff(places) > rule.window + rule.gap)])
    first = places[np.searchsorted(group, group, side="left")]
    last = places[np.searchsorted(group, group, side="right") - 1]
    return last + rule.window - first >= rule.stretch


def shared_windows(texts: Sequence[list[str]], lexicon: Lexicon, chosen: tuple[int, np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash): the different window hashes of each text that pass the filter, near enough to others."""
    said, meant = lexicon.of(texts)
    size = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    n = max(0, len(owner) - rule.window + 1)
    whole = owner[:n] == owner[rule.window - 1 : rule.window - 1 + n] if n else np.zeros(0, bool)  # windows of one text
    hashes = [_rolled(codes, rule.window, salt) for codes, salt in ((meant, 11), (said, 23))]
    passed = [_within(h, *chosen) & whole for h in hashes] if n else [whole, whole]
    places = np.flatnonzero(passed[0] | passed[1])
    apart = owner[places] * (rule.window + rule.gap + 1)  # texts lie too far from each other for a stretch
    places = places[near_enough(places + apart, rule)]
    kept = np.zeros(n, bool)
    kept[places] = True
    at = [np.flatnonzero(kept & p) for p in passed]
    pairs = np.empty(sum(map(len, at)), [("text", np.int64), ("hash", np.int64)])
    pairs["text"], pairs["hash"] = np.concatenate([owner[a] for a in at]), np.concatenate([h[a] for h, a in zip(hashes, at)])
    order = np.lexsort((pairs["hash"], pairs["text"]))
    pairs = pairs[order]
    fresh = np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]
    return pairs["text"][fresh], pairs["hash"][fresh]


def find_leaks(documents: DataFrame, items: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, words_held, item_words, n_stretches): each document with each item it gives away.

    Every document is read once, however many items there are.  The hashes of its template windows that pass a bit
    filter of the items' windows, in groups long enough for a stretch, are joined with the items' windows; pairs that
    share windows enough are compared word by word.  Copies of a document are reported each.  Null and empty texts and
    items give nothing, rows without an id neither; items of one id count as their longest text.
    """
    spark = documents.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("t")).where("item_id is not null and t is not null")
    asked = cut(asked.groupBy("item_id").agg(F.max_by("t", F.struct(F.length("t"), F.col("t"))).alias("t")))
    standard, known = learn(asked, rule)
    shared = spark.sparkContext.broadcast((standard, known))

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, codes = Marks(shared.value[1]), Codes()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = item_windows(*template(words(" ".join(item_body(t, shared.value[0]))), marks), codes, rule.window)
                yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(np.full(len(made), i)), pa.array(np.arange(len(made)), pa.int32()), pa.array(np.full(len(made), len(made) + rule.window - 1), pa.int32())], names=["h", "item_id", "p", "n"])

    windows = cut(asked.mapInArrow(cut_items, "h long, item_id long, p int, n int"))
    chosen = spark.sparkContext.broadcast(_filter(windows))

    def cut_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(Marks(shared.value[1]), Codes())
        for batch in batches:
            column = batch.column(1).to_pylist()
            for a, b in slices(column):
                texts = [words(t) for t in column[a:b]]
                text, hashes = shared_windows(texts, lexicon, chosen.value, rule)
                held, first = np.unique(text, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), pa.array(hashes))
                at = pa.array(held + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists], names=["doc_id", "text", "hashes"])

    pages = spread(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    looked = cut(pages.where("doc_id is not null").mapInArrow(cut_documents, "doc_id long, text string, hashes array<long>"))
    # a place of an item has one hash and a document names each hash once, so these sums count different places
    places = windows.groupBy("h", "item_id").agg(F.count("*").alias("places"), F.first("n").alias("n"))
    pairs = (
        looked.select("doc_id", F.explode("hashes").alias("h"))
        .join(places, "h")
        .groupBy("doc_id", "item_id")
        .agg(F.sum("places").alias("shared"), F.first("n").alias("n"))
        .where(F.col("shared") >= F.greatest(F.lit(3), F.lit(0.25 * rule.share) * F.col("n")))
        .select("doc_id", "item_id")
    )
    both = looked.select("doc_id", "text").join(pairs, "doc_id").join(dimension(asked), "item_id").select("doc_id", "text", "item_id", "t").sortWithinPartitions("doc_id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, codes = Marks(shared.value[1]), Codes()
        held: dict[int, tuple] = {}
        for batch in batches:
            rows, last = [], None
            for d, t, i, item_text in zip(*(c.to_pylist() for c in batch.columns)):
                if i not in held:
                    if len(held) > 10_000:
                        held.clear()
                    item = template(words(" ".join(item_body(item_text, shared.value[0]))), marks)
                    held[i] = item, item_windows(*item, codes, rule.window).tolist()
                if t != last:  # the pairs of a document follow each other
                    last, (read, meant) = t, template(words(t), marks)
                    at: dict[int, list[int]] = defaultdict(list)
                    hashes = window_hashes(read, meant, codes, rule.window)
                    for k, pair in enumerate(zip(hashes[0].tolist(), hashes[1].tolist())):
                        for h in pair:
                            at[h].append(k)
                item, windows_of = held[i]
                hits = sorted((k, p) for p, h in enumerate(windows_of) if h in at for k in at[h])
                case = compare(item, read, meant, hits, rule)
                if case:
                    rows.append((d, i, *case))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "words_held", "item_words", "n_stretches"])

    return both.mapInArrow(check, SCHEMA)


def leaks_by_item(leaks: DataFrame) -> DataFrame:
    """Per item: documents that give it away and the most words any of them holds."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("words_held").alias("most_words"), F.max("item_words").alias("item_words"))
