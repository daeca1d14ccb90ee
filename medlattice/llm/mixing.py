"""Mix sources to target shares of the tokens, with capped repetition."""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..session import cut

#: A public byte-level BPE vocabulary as ranks; its folder is a parameter of every function that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published way of cutting text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Sources a mixture may have; their sums are held on the driver.
MAX_SOURCES = 10_000


@functools.lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for NULL and empty."""

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(tokenizer).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return counted(text)


def plain_source(value: Column) -> Column:
    """A label in lower case with single underscores; NULL if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(value), r"(?U)^\s+|\s+$", ""), r"(?U)[\s_-]+", "_")
    return F.when(F.length(bare) > 0, bare)


@dataclass(frozen=True)
class Plan:
    """What a source contributes: whole passes, then a last one up to ``rest`` tokens."""

    source: str
    target: float
    weight: float
    tokens: float
    available: int
    passes: int
    rest: float
    max_repeats: int
    exponent: float = 0.0


def tempered(targets: Mapping[str, float], sizes: Mapping[str, float], exponent: float) -> dict[str, float]:
    """Weights between the targets (exponent 0) and the sources' own token shares (1): t^(1-e) * p^e, normalised."""
    whole = sum(sizes.values())
    raw = {s: targets[s] ** (1 - exponent) * (sizes[s] / whole) ** exponent for s in targets}
    return {s: w / sum(raw.values()) for s, w in raw.items()}


def entropy(weights: Mapping[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def best_exponent(value, steps: int = 80) -> float:
    """Where ``value``, which rises and then falls over [0, 1], is greatest."""
    low, high = 0.0, 1.0
    for _ in range(steps):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if value(a) >= value(b) else (a, high)
    return max((0.0, (low + high) / 2, 1.0), key=value)


def bisect_exponent(value, goal: float, high: float, steps: int = 60) -> float:
    """The smallest exponent up to ``high`` at which a rising ``value`` reaches the goal; ``high`` if it does not."""
    low = 0.0
    if value(low) >= goal:
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if value(middle) >= goal else (middle, high)
    return high


def plan_mix(targets: Mapping[str, tuple[float, int]], sizes: Mapping[str, int], budget: float | None = None, least_entropy: float | None = None) -> list[Plan]:
    """How much each source gives.

    ``targets``: share and most repeats by source; ``sizes``: tokens by source.  Sources without tokens can give
    nothing; the others keep their shares relative to each other.  Without a budget it is the largest for which the
    targets hold exactly.  Beyond that the exponent is bisected: weights move from the targets towards the sources'
    own shares just as far as the repetition limit (or the wanted entropy) asks; what still cannot be had is cut off
    the budget.
    """
    live = {s: t for s, (t, r) in targets.items() if t > 0 and r > 0 and sizes.get(s, 0) > 0}
    if not live:
        return [Plan(s, t, 0.0, 0.0, int(sizes.get(s, 0)), 0, 0.0, r) for s, (t, r) in targets.items()]
    wanted = {s: t / sum(live.values()) for s, t in live.items()}
    most = {s: sizes[s] * targets[s][1] for s in live}
    amounts = {s: float(sizes[s]) for s in live}
    reach = lambda w: min(most[s] / w[s] for s in live)
    goal = reach(wanted) if budget is None else float(budget)
    # the logarithm of each weight is convex in the exponent, so the budget that all limits allow has one maximum
    most_budget = lambda e: reach(tempered(wanted, amounts, e))
    exponent = bisect_exponent(most_budget, goal * (1 - 1e-12), best_exponent(most_budget))
    if least_entropy is not None:
        mixed = lambda e: entropy(tempered(wanted, amounts, e))
        exponent = max(exponent, bisect_exponent(mixed, least_entropy, best_exponent(mixed)))
    weights = tempered(wanted, amounts, exponent)
    goal = min(goal, reach(weights))
    made = []
    for s, (t, r) in targets.items():
        tokens = goal * weights.get(s, 0.0)
        size = int(sizes.get(s, 0))
        passes = min(r, int(tokens / size * (1 + 1e-12))) if size and tokens else 0
        made.append(Plan(s, t, weights.get(s, 0.0), tokens, size, passes, max(0.0, tokens - passes * size) if passes < r else 0.0, r, exponent))
    return made


def sized(documents: DataFrame, tokenizer: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, place): documents of a named source with at least a token, written once."""
    return cut(
        documents.select("doc_id", plain_source(F.col("source")).alias("source"), count_tokens(F.col("text"), tokenizer).alias("n_tokens"))
        .where("source is not null and n_tokens > 0")
        .withColumn("place", F.xxhash64("doc_id", F.lit(seed)))
    )


def _targets(mix: DataFrame) -> dict[str, tuple[float, int]]:
    rows = mix.groupBy(plain_source(F.col("source")).alias("s")).agg(F.sum("target_share").alias("t"), F.min("max_repeats").alias("r")).where("s is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["s"]: (float(r["t"] or 0), int(r["r"] or 0)) for r in sorted(rows, key=lambda r: r["s"])}


def realise(docs: DataFrame, plan: list[Plan], seed: int = 7) -> DataFrame:
    """(doc_id, source, repeat_no, n_tokens, order_key): the training set, to be read in order of ``order_key``.

    Documents are hashed into blocks of about a thousand; the hash order is the permutation.  A source's last pass
    takes whole blocks while their running sum fits, then documents of the next block while they fit.  The running
    sums go over (source, block) rows and over one block, never over a source.
    """
    used = [p for p in plan if p.tokens > 0]
    empty = docs.where("false").select("doc_id", "source", F.lit(0).alias("repeat_no"), "n_tokens", F.col("place").alias("order_key"))
    if not used:
        return empty
    count = docs.count()
    blocks = max(16, min(65_536, count // 1000))
    by = lambda what: F.element_at(F.create_map(*[F.lit(v) for p in used for v in (p.source, what(p))]), F.col("source"))
    # a document larger than the whole last pass is no part of it and lies beyond all blocks
    block = F.when(F.col("n_tokens") <= by(lambda p: p.rest), F.pmod(F.shiftright("place", 17), F.lit(blocks)).cast("int")).otherwise(blocks)
    docs = docs.where(F.col("source").isin(*[p.source for p in used])).withColumn("block", block)
    sums = docs.where(F.col("block") < blocks).groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    upto = sums.withColumn("before", F.sum("tokens").over(Window.partitionBy("source").orderBy("block")) - F.col("tokens"))
    edge = upto.where((F.col("before") <= by(lambda p: p.rest)) & (F.col("before") + F.col("tokens") > by(lambda p: p.rest))).select("source", "block", "before").collect()
    last = {r["source"]: (r["block"], r["before"]) for r in edge}
    whole = lambda p: last.get(p.source, (blocks if p.rest > 0 else -1, 0))
    at_edge = F.col("block") == by(lambda p: whole(p)[0])
    inner = docs.where(at_edge).withColumn("sum", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("place", "doc_id")) + by(lambda p: whole(p)[1]))
    inner = inner.withColumn("extra", (F.col("sum") <= by(lambda p: p.rest)).cast("int")).drop("sum")
    outer = docs.where(~at_edge).withColumn("extra", (F.col("block") < by(lambda p: whole(p)[0])).cast("int"))
    copies = by(lambda p: p.passes) + F.col("extra")
    return (
        outer.unionByName(inner)
        .withColumn("copies", copies)
        .where("copies > 0")
        .select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("repeat_no"), "n_tokens")
        .withColumn("order_key", F.xxhash64("doc_id", "repeat_no", F.lit(seed)))
    )


def mix(
    documents: DataFrame, targets: DataFrame, budget: float | None = None, least_entropy: float | None = None, tokenizer: str = TOKENIZER, seed: int = 7, passes: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """The training set and its report.

    The budget is in tokens, or as ``passes`` over all tokens of the sources that the targets name; without either it
    is the largest that holds the targets exactly.  The report has a row per source of ``targets``: the share wanted,
    planned and reached, the exponent found, tokens, documents, passes.  Documents of other sources, of none, or without
    a token are not used.
    """
    wanted = _targets(targets)
    docs = sized(documents, tokenizer, seed)
    sizes = {r["source"]: int(r["n"]) for r in docs.where(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = plan_mix(wanted, sizes, passes * sum(sizes.values()) if budget is None and passes is not None else budget, least_entropy)
    made = realise(docs, plan, seed)
    spark = documents.sparkSession
    schema = "source string, target_share double, weight double, exponent double, planned_tokens double, available_tokens long, max_repeats int"
    dims = spark.createDataFrame([(p.source, p.target, p.weight, p.exponent, p.tokens, p.available, p.max_repeats) for p in plan], schema)
    got = made.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_records"), F.max(F.col("repeat_no") + 1).alias("most_repeats"))
    whole = F.sum("tokens").over(Window.partitionBy())
    report = (
        dims.join(got, "source", "left")
        .withColumn("share", F.coalesce(F.col("tokens") / whole, F.lit(0.0)))
        .select(
            "source", "target_share", "weight", "share", "exponent", "planned_tokens", "available_tokens", "max_repeats",
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )
    return made, report


def mix_check(documents: DataFrame, report: DataFrame, slack: float = 0.01) -> DataFrame:
    """Per source: documents it has, and whether the mixture keeps the plan, the repetitions and the budget.

    ``as_planned``: the tokens are not above the plan and the share is within ``slack`` of its weight, and within one
    part in as many as the source has documents beyond that, as it gives whole ones only; ``tempered``: the exponent lies
    between 0 and 1.
    """
    there = documents.where(F.length("text") > 0).groupBy(plain_source(F.col("source")).alias("source")).agg(F.count("*").alias("n_documents"))
    return report.join(there, "source", "left").select(
        "source",
        "max_repeats",
        F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"),
        (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"),
        ((F.abs(F.col("share") - F.col("weight")) <= slack + F.coalesce(1 / F.col("n_documents"), F.lit(0.0))) & (F.col("tokens") <= F.col("planned_tokens") + 1e-6 * F.abs("planned_tokens") + 1)).alias("as_planned"),
        ((F.col("exponent") > 0) & (F.col("exponent") < 1)).alias("tempered"),
    )
