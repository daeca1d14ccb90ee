"""Keyword-stuffed pages, link lists and product tags, found by how unlike prose their words follow each other.

A page is read twice as a sequence of marks.  The reading *by vocabulary* has the roles of function words, known words,
unknown words and classes (numbers, codes, links, repetitions).  The reading *by form* knows no word of any language:
its marks are length, case, what stands before a word, and how lately the page had the word already.  For each an
interpolated trigram model is trained on the prose of the corpus, honest lists included, and a page is judged by the
counts of the half of the pages that it is not in.  A stretch is abnormal where both readings are abnormally
surprising, or where the page repeats itself with abnormally little surprise; prose in a language or on a subject that
the corpus does not hold is surprising by vocabulary, and plain by form.  A page that consists of abnormal stretches
for at least half its characters is flagged.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut, spread
from .lexing import BOUND, CODE, COMMA, IDEOGRAPH, NUMBER, PLAIN, SIGN, TAG, URL, Words, hash_of, lex, since_last, slices

#: Words that build sentences, by role; a spelling that has several roles stands under its most usual one.
FUNCTION_WORDS = {
    "determiner": "a an the this that these those each either neither both any all no other some such same own its his her my our your their der die das dem den des ein eine einem einen einer eines dies diese dieser kein keine keinen la le les l un une des du ce ces cette son sa ses leur el los las del una uno este esta estos su sus mi",
    "preposition": "about after at before below between by during for from in into of off on through to under until up with within without over since than as auf aus bei beim bis durch für gegen im ins mit nach ohne über um unter vom von vor zu zum zur zwischen in an seit à au aux avec chez dans de depuis en entre par pour sans sous sur vers al ante antes bajo con contra desde durante hacia hasta para por según sin sobre tras",
    "conjunction": "and or but if because although so when where which while who whom whose how why what aber als dass doch ob oder sondern und weil wenn wie damit da denn et ou où mais que qu qui comme si car donc y o pero porque cuando donde aunque e",
    "pronoun": "i me he him she it we us they them you there er es ich ihm ihn ihr sie sich man wir uns il elle ils elles on nous vous je lui se s y'a c ella lo nos me yo",
    "auxiliary": "am are is was were be been being can could did do does had has have having may might must should will would hat hatte ist sind war waren werden wird wurde kann ja haben ai a ont est et était être été avait sont es era fue ser son ha había está hay",
    "particle": "again also just more most not nor once only out rather then very here yet too alle also am nicht noch nur so wieder dann ne n pas plus tout très aussi más muy ni no ya también",
}
ROLES = tuple(FUNCTION_WORDS)

#: Marks of the reading by vocabulary, after the roles.
START, WORD, UNKNOWN, NAME, NUM, MIXED, LINK, HASHTAG, AGAIN, OTHER_SCRIPT = range(len(ROLES), len(ROLES) + 10)
WORD_MARKS = OTHER_SCRIPT + 1
#: Marks of the reading by form: classes times signs before, then the start and the end of a passage.
SHORT, MIDDLE, LONG, SHORT_NAME, MIDDLE_NAME, LONG_NAME, F_NUM, F_MIXED, F_NEAR, F_FAR, F_LINK, F_TAG, F_OTHER = range(13)
FORM_CLASSES, SIGNS_BEFORE = 13, 3
F_START = FORM_CLASSES * SIGNS_BEFORE
F_STOP = F_START + 1
FORM_MARKS = F_STOP + 1
#: Marks that prose holds few of; each costs at least what it costs without context.
ODD_WORDS = (UNKNOWN, LINK, HASHTAG, AGAIN)
ODD_FORMS = tuple(c * SIGNS_BEFORE + b for c in (F_NEAR, F_FAR, F_LINK, F_TAG) for b in range(SIGNS_BEFORE))


@dataclass(frozen=True)
class Rule:
    """Parameters of training and judging."""

    sentence_words: int = 6  #: least words of a training sentence
    function_share: float = 0.25  #: share of function words that makes a sentence prose
    known_share: float = 0.9  #: share of known words and classes that makes a passage trainable
    look_back: int = 8  #: words of a passage in which the same word again is a repetition
    near: int = 12  #: words of a page in which a long word again is a near repetition
    far: int = 60  #: and a far one
    window: int = 15  #: words over which surprise is averaged
    high: float = 2.3  #: surprise per word by vocabulary, in nats, from which a stretch is abnormal
    form_high: float = 2.55  #: and by form
    low: float = 0.25  #: surprise per word by form below which a stretch is abnormal
    prose_page: float = 0.25  #: share of a page's words in sentences that makes it a page of prose
    known_pages: float = 3e-4  #: share of all pages that are prose and hold a word, from which it is known
    known_purity: float = 0.6  #: share of prose pages among the pages that hold a known word
    least_words: int = 6  #: words under which a page says too little to be judged
    share: float = 0.5  #: share of a page's characters in abnormal stretches that flags it


@functools.lru_cache(maxsize=1)
def _roles() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the function words in order, and their roles."""
    role = {}
    for k, name in enumerate(ROLES):
        for w in FUNCTION_WORDS[name].split():
            role.setdefault(hash_of(w), k)
    hashes = np.array(sorted(role), np.int64)
    return hashes, np.array([role[h] for h in hashes.tolist()], np.int64)


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value, -1 where it is missing."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


@dataclass(frozen=True)
class Read:
    """Words with their roles (-1: none) and which of them stand in sentences."""

    words: Words
    role: np.ndarray
    plain: np.ndarray
    sentence: np.ndarray  #: by passage
    again: np.ndarray  #: words since the word stood in the passage


def _per(owner: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=what, minlength=n)


def read(words: Words, rule: Rule) -> Read:
    """Roles, and which passages are sentences: long enough, with function words, few repetitions and no link."""
    hashes, roles = _roles()
    at = _find(hashes, words.hash)
    plain = words.kind == PLAIN
    role = np.where(plain & (at >= 0), roles[at], -1)
    n = int(words.passage[-1]) + 1 if len(words) else 0
    per = lambda what: _per(words.passage, what, n)
    content = plain & (role < 0)
    since = since_last(words.passage, words.hash)
    again = content & (since < 1 << 30)
    all_plain, function = per(plain), per(role >= 0)
    sentence = (
        (all_plain >= rule.sentence_words)
        & (per(words.kind == URL) == 0)
        & (function >= rule.function_share * all_plain)
        & (per(again) <= 0.25 * per(content))
    )
    return Read(words, role, plain, sentence, since)


def by_vocabulary(r: Read, known: np.ndarray, rule: Rule) -> np.ndarray:
    """The marks of the reading by vocabulary; ``known`` are sorted hashes."""
    w = r.words
    content = r.plain & (r.role < 0)
    near = r.again <= rule.look_back
    return np.select(
        [r.role >= 0, content & near, content & (_find(known, w.hash) >= 0), content & w.first_upper, content, w.kind == NUMBER, w.kind == CODE, w.kind == URL, w.kind == TAG],
        [r.role, AGAIN, WORD, NAME, UNKNOWN, NUM, MIXED, LINK, HASHTAG],
        OTHER_SCRIPT,
    )


def by_form(r: Read, last: np.ndarray, rule: Rule) -> np.ndarray:
    """The marks of the reading by form; ``last`` are the words since the page had each."""
    w = r.words
    long_word = (r.plain | (w.kind == CODE)) & (w.size >= 5)
    size = np.select([w.size <= 3, w.size <= 6], [SHORT, MIDDLE], LONG) + np.where(w.first_upper, SHORT_NAME, 0)
    form = np.select(
        [long_word & (last <= rule.near), long_word & (last <= rule.far), r.plain & (w.upper >= 2) & (w.upper == w.size), r.plain, w.kind == NUMBER, w.kind == CODE, w.kind == URL, w.kind == TAG],
        [F_NEAR, F_FAR, F_MIXED, size, F_NUM, F_MIXED, F_LINK, F_TAG],
        F_OTHER,
    )
    before = np.select([w.before == COMMA, w.before == SIGN], [1, 2], 0)
    return form * SIGNS_BEFORE + before


def _before(marks: np.ndarray, passage: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The mark two places and one place before each, within the passage."""
    one, two = np.full(len(marks), start), np.full(len(marks), start)
    if len(marks) > 1:
        one[1:] = np.where(passage[1:] == passage[:-1], marks[:-1], start)
    if len(marks) > 2:
        two[2:] = np.where(passage[2:] == passage[:-2], marks[:-2], start)
    return two, one


def _last(passage: np.ndarray) -> np.ndarray:
    """Whether a word is its passage's last."""
    last = np.ones(len(passage), bool)
    last[:-1] = passage[1:] != passage[:-1]
    return last


def trainable(r: Read, marks: np.ndarray, rule: Rule) -> np.ndarray:
    """By passage: sentences, and passages of known words and classes; not those of repetitions and links."""
    passage = r.words.passage
    n = len(r.sentence)
    whole = np.bincount(passage, minlength=n)
    good = _per(passage, ~np.isin(marks, ODD_WORDS), n)
    told = _per(passage, (marks == WORD) | (r.role >= 0), n)
    return r.sentence | ((whole >= 3) & (good >= rule.known_share * whole) & (told > 0))


def grams(r: Read, known: np.ndarray, rule: Rule) -> np.ndarray:
    """Codes of the trigrams of all trainable passages: those by vocabulary, then those by form."""
    if not len(r.words):
        return np.zeros(0, np.int64)
    passage = r.words.passage
    marks = by_vocabulary(r, known, rule)
    taken = trainable(r, marks, rule)[passage]
    two, one = _before(marks, passage, START)
    coded = ((two * WORD_MARKS + one) * WORD_MARKS + marks)[taken]
    form = by_form(r, since_last(r.words.text, r.words.hash), rule)
    two, one = _before(form, passage, F_START)
    inner = ((two * FORM_MARKS + one) * FORM_MARKS + form)[taken]
    ends = taken & _last(passage)
    final = ((one * FORM_MARKS + form) * FORM_MARKS + F_STOP)[ends]
    return np.concatenate([coded, WORD_MARKS**3 + np.concatenate([inner, final])])


class Model:
    """Surprise of every trigram of ``size`` marks, interpolated with bigrams and single marks, as a table."""

    def __init__(self, counts: np.ndarray, size: int, odd: tuple[int, ...]):
        three = counts.reshape(size, size, size).astype(float)
        two = three.sum(axis=0)
        one = two.sum(axis=0)
        over = lambda a, n: a / np.maximum(n, 1.0)
        single = one / max(1.0, one.sum())
        p = 0.6 * over(three, three.sum(axis=2, keepdims=True)) + (0.3 * over(two, two.sum(axis=1, keepdims=True)))[None] + 0.099 * single + 1e-5
        p[:, :, odd] = np.minimum(p[:, :, odd], single[list(odd)] + 1e-5)
        self.size, self.table = size, -np.log(p).ravel()

    def surprise(self, two: np.ndarray, one: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return self.table[(two * self.size + one) * self.size + marks]


def models(counts: np.ndarray) -> tuple[Model, Model]:
    """The models by vocabulary and by form, from trigram counts in the order of ``grams``."""
    return Model(counts[: WORD_MARKS**3], WORD_MARKS, ODD_WORDS), Model(counts[WORD_MARKS**3 :], FORM_MARKS, ODD_FORMS)


def _averaged(values: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Mean over the ``width`` words around each, within its text."""
    n = len(values)
    total = np.concatenate([[0.0], np.cumsum(values)])
    first = np.searchsorted(text, text, side="left")
    last = np.searchsorted(text, text, side="right")
    size = np.minimum(width, last - first)
    low = np.clip(np.arange(n) - width // 2, first, last - size)
    return (total[low + size] - total[low]) / size


def surprises(r: Read, known: np.ndarray, pair: tuple[Model, Model], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Mean surprise around every word, by vocabulary and by form."""
    w = r.words
    marks = by_vocabulary(r, known, rule)
    two, one = _before(marks, w.passage, START)
    told = pair[0].surprise(two, one, marks)
    last = since_last(w.text, w.hash)
    form = by_form(r, last, rule)
    two, one = _before(form, w.passage, F_START)
    shown = pair[1].surprise(two, one, form) + np.where(_last(w.passage), pair[1].surprise(one, form, np.full(len(w), F_STOP)), 0.0)
    # a script that the training never saw cannot be judged by form, only by its repetitions
    strange_script = w.kind == IDEOGRAPH
    shown = np.where(strange_script, np.where(last <= rule.near, 2 * rule.form_high, 0.5 * rule.form_high), shown)
    return _averaged(told, w.text, rule.window), _averaged(shown, w.text, rule.window)


def judge(texts: list[str | None], known: np.ndarray, pair: tuple[Model, Model], rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of characters in abnormal stretches, mean surprise by form, words) of every text."""
    w = lex(texts)
    n = len(texts)
    if not len(w):
        return np.zeros(n), np.zeros(n), np.zeros(n, int)
    r = read(w, rule)
    told, shown = surprises(r, known, pair, rule)
    abnormal = ((told >= rule.high) & (shown >= rule.form_high)) | (shown <= rule.low)
    whole = _per(w.text, w.size, n)
    n_words = np.bincount(w.text, minlength=n)
    return _per(w.text, w.size * abnormal, n) / np.maximum(whole, 1), _per(w.text, shown, n) / np.maximum(n_words, 1), n_words


def _sliced(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list]]:
    texts = batch.column(column).to_pylist()
    for a, b in slices(texts):
        yield a, b, texts[a:b]


#: Counts of different words that a task holds before it hands them on.
HELD = 1 << 20


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts (key, n, ...) of several parts with each key once."""
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *[np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(keys)).astype(np.int64) for k in range(1, len(parts[0]))]


def _word_counts(texts: list[str | None], rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, pages that hold it, pages of prose among them) of some texts; word 0 stands for any page."""
    w = lex(texts)
    zero = np.zeros(1, np.int64)
    if not len(w):
        return zero, zero + len(texts), zero
    r = read(w, rule)
    within = _per(w.text, r.plain & r.sentence[w.passage], len(texts))
    good = within >= rule.prose_page * np.maximum(_per(w.text, r.plain, len(texts)), 1)
    told = r.plain & ((w.upper == 0) | ((w.before == BOUND) & w.first_upper & (w.upper == 1)))
    told &= since_last(np.where(told, w.text, -1), w.hash) == 1 << 30  # each word once a page
    every, at = np.unique(w.hash[told], return_inverse=True)
    prose = np.bincount(at, weights=good[w.text[told]], minlength=len(every)).astype(np.int64)
    return np.append(every, 0), np.append(np.bincount(at, minlength=len(every)), len(texts)), np.append(prose, 0)


def known_words(pages: DataFrame, rule: Rule) -> np.ndarray:
    """Sorted hashes of the words that enough pages of prose hold, and few pages without it in comparison.

    Counted over all pages, and combined within a task before they are handed on.  A page holds so many different words
    on average, and each known one is on ``known_pages`` of all pages, so there are at most average / ``known_pages`` of
    them, however large the corpus is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda part: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], names=["word", "n_pages", "n_prose"])
        held: list[tuple] = []
        for batch in batches:
            for _, _, texts in _sliced(batch):
                held.append(_word_counts(texts, rule))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield rows(held[0])
                        held = []
        if held:
            yield rows(_merged(held))

    sums = cut(pages.mapInArrow(count, "word long, n_pages long, n_prose long").groupBy("word").agg(F.sum("n_pages").alias("n_pages"), F.sum("n_prose").alias("n_prose")))
    whole = sums.where("word = 0").agg(F.max("n_pages")).first()[0] or 0
    least = max(3, rule.known_pages * whole)
    kept = sums.where((F.col("word") != 0) & (F.col("n_prose") >= least) & (F.col("n_prose") >= rule.known_purity * F.col("n_pages"))).select("word")
    words = np.sort(kept.toArrow().column(0).to_numpy())
    drop_cut(sums)
    return words


GRAMS = WORD_MARKS**3 + FORM_MARKS**3


def train(pages: DataFrame, rule: Rule = Rule()) -> tuple[np.ndarray, np.ndarray]:
    """Known words, and the trigram counts of the corpus' prose in each half of its pages.

    Both are counted over all pages.  There are GRAMS different trigrams whatever the corpus, so what a task holds and
    hands on, and what reaches the driver, is bounded by construction.
    """
    known = known_words(pages, rule)
    shared = pages.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros((2, GRAMS), np.int64)
        for batch in batches:
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for a, b, texts in _sliced(batch):
                for h in (0, 1):
                    own = [t for t, x in zip(texts, half[a:b]) if x == h]
                    made[h] += np.bincount(grams(read(lex(own), rule), shared.value, rule), minlength=GRAMS)
        at, gram = np.nonzero(made)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(gram), pa.array(made[at, gram])], names=["half", "gram", "n"])

    rows = pages.mapInArrow(count, "half long, gram long, n long").groupBy("half", "gram").agg(F.sum("n").alias("n")).toArrow()
    made = np.zeros((2, GRAMS), np.int64)
    made[rows.column("half").to_numpy(), rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    shared.unpersist()
    return known, made


SCHEMA = "doc_id long, strange_share double, surprise double, n_words int, stuffed boolean"


def score_pages(documents: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, strange_share, surprise, n_words, stuffed) of every page, by a model trained on the other half of them.

    The halves are made by a hash of the text, so copies fall into one.  Null and empty texts and those of fewer than
    ``least_words`` words are not stuffed; copies are judged each.
    """
    kept = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = spread(kept)
    pages = (dealt if dealt is kept else cut(dealt)).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("long"))
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, rule))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        pairs = [models(counts[1]), models(counts[0])]
        for batch in batches:
            half = batch.column("half").to_numpy(zero_copy_only=False)
            share, surprise, n_words = np.zeros(len(half)), np.zeros(len(half)), np.zeros(len(half), int)
            for a, b, texts in _sliced(batch):
                for h in (0, 1):
                    own = np.flatnonzero(half[a:b] == h)
                    share[a + own], surprise[a + own], n_words[a + own] = judge([texts[i] for i in own], known, pairs[h], rule)
            stuffed = (share >= rule.share) & (n_words >= rule.least_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(share), pa.array(surprise), pa.array(n_words, pa.int32()), pa.array(stuffed)],
                names=["doc_id", "strange_share", "surprise", "n_words", "stuffed"],
            )

    return pages.mapInArrow(work, SCHEMA)
