"""Train, validation and test splits that keep the records of one entity together."""

from __future__ import annotations

import functools
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import as_column, canonical_id, not_blank
from ..session import cut, drop_cut

#: Distinct values of the label that the splits may be balanced over.
MAX_LABELS = 1000
#: Components that anneal together on average; which of them do is told by their hash alone.
BUCKET = 4000


def entity_key(value: Column | str) -> Column:
    """One key per entity: the id's digits, or the value as written where it is no id; NULL if blank."""
    value = as_column(value)
    return F.when(not_blank(value), F.coalesce(canonical_id(value), F.concat(F.lit("raw:"), value)))


def confirmed_links(links: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs of keys whose latest verdict, in either order, is ``confirmed``.

    Verdicts of one time are decided by arrival and then the higher ``link_id``; rows with a null or blank id and
    links of an id to itself say nothing.
    """
    old, new = entity_key("old_id"), entity_key("new_id")
    return (
        links.select(
            F.when(old.isNotNull() & new.isNotNull(), F.least(old, new)).alias("a"),
            F.when(old.isNotNull() & new.isNotNull(), F.greatest(old, new)).alias("b"),
            F.lower(F.trim(F.regexp_replace("status", r"\s+", " "))).alias("status"),
            F.struct("linked_at", "loaded_at", "link_id").alias("rank"),
        )
        .where("a is not null and a <> b")
        .groupBy("a", "b")
        .agg(F.max_by("status", "rank").alias("status"))
        .where("status = 'confirmed'")
        .select("a", "b")
    )


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Alternating large-star and small-star steps: every step is a minimum per node (combined before the shuffle) and an
    equi-join, so a node with very many links is never gathered, and long chains shrink by half in a round.  Each
    round ends in a table in the shared folder.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        drop_cut(now)
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def anneal(x: np.ndarray, split: np.ndarray, off: np.ndarray, scale: np.ndarray, rng: np.random.Generator, sweeps: int, heat: float) -> np.ndarray:
    """Move and exchange whole components to bring the weighted deviation ``off`` to zero.

    ``x``: a row of masses (rows, then rows per label) for each component; ``off``: how far each split is above its
    target in this share of the data.  Single moves and exchanges of two components are proposed in turn; worse states
    are taken with a falling probability, and the best state met is returned.
    """
    n, k = len(x), len(off)
    if n == 0:
        return split
    weighted = x * scale
    off = off * scale
    split = split.copy()
    cost = float((off * off).sum())
    best_cost, undo, accepted = cost, [], 0
    steps = sweeps * n
    first, second = rng.integers(0, n, steps), rng.integers(0, n, steps)
    to, luck, swap = rng.integers(0, k, steps), rng.random(steps), rng.random(steps) < 0.5
    start = heat * cost + 1e-12
    for t in range(steps):
        i, a = first[t], split[first[t]]
        if swap[t]:
            j = second[t]
            b = split[j]
            change = weighted[j] - weighted[i]
        else:
            j, b = -1, to[t]
            change = -weighted[i]
        if a == b:
            continue
        delta = 2.0 * float(change @ (off[a] - off[b])) + 2.0 * float(change @ change)
        if delta < 0 or luck[t] < np.exp(-delta / (start * (1.0 - t / steps) + 1e-15)):
            off[a] += change
            off[b] -= change
            undo.append((i, a, j, b))
            split[i] = b
            if j >= 0:
                split[j] = a
            cost += delta
            if cost < best_cost - 1e-15:
                best_cost, accepted = cost, len(undo)
    for i, a, j, b in reversed(undo[accepted:]):  # back to the best state met
        split[i] = a
        if j >= 0:
            split[j] = b
    return split


def component_masses(units: DataFrame, label: str) -> tuple[DataFrame, list]:
    """(component, mass array): rows of each component, in all and per label; and the labels in order."""
    labels = [r[0] for r in units.select(label).distinct().limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} values of {label}")
    labels = sorted(labels, key=lambda v: (v is None, v))
    counts = [F.sum(F.when(F.col(label).eqNullSafe(v), F.col("n")).otherwise(0)).cast("double") for v in labels]
    return units.groupBy("component").agg(F.array(F.sum("n").cast("double"), *counts).alias("mass")), labels


def _annealer(step: int, off: np.ndarray, scale: np.ndarray, whole: float, sweeps: int, seed: int):
    """One bucket's part of a round."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component", kind="stable")
        x = np.stack(pdf["mass"].to_numpy())
        c, b = (int(k) for k in key)
        rng = np.random.default_rng([seed, step, c, b])
        split = anneal(x, pdf["split"].to_numpy(), off[c] * (x[:, 0].sum() / whole), scale, rng, sweeps, 0.1 / (step + 1))
        return pdf.assign(split=split.astype("int32"))

    return work


def search_splits(
    masses: DataFrame, shares: Mapping[str, float], labels: int, chains: int = 2, rounds: int = 3, sweeps: int = 4, seed: int = 7, enough: float = 1e-9
) -> DataFrame:
    """(component, split): hashed assignment improved by parallel annealing, the best chain and round kept.

    Components fall into buckets by their hash; every bucket of every chain anneals on its own, in the order of its
    components and from a seed of its own, against its part of the deviation that all splits show together.  So the
    result depends on the components, the shares and the seed alone, not on partitions or cores.  After a round the
    deviations are summed again, and the search ends early where the cost falls under ``enough``.  Only splits x labels
    sums reach the driver.
    """
    names = list(shares)
    target = np.array([shares[n] for n in names], float)
    if (target < 0).any() or not target.sum() > 0:
        raise ValueError("shares must be non-negative and not all zero")
    target = target / target.sum()
    edges = np.cumsum(target)[:-1]
    u = F.pmod(F.xxhash64("component", "chain"), F.lit(1 << 30)) / float(1 << 30)
    at = functools.reduce(lambda c, i: F.when(u >= float(edges[i]), i + 1).otherwise(c), range(len(edges)), F.lit(0))
    masses = cut(masses.select("component", "mass"))
    buckets = max(1, -(-masses.count() // BUCKET))
    now = cut(
        masses.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(buckets)).cast("int"))
        .withColumn("chain", F.explode(F.array(*[F.lit(c) for c in range(chains)])))
        .withColumn("split", at.cast("int"))
    )
    best: tuple[float, int, DataFrame] | None = None
    frames = [masses]
    for step in range(rounds + 1):
        frames.append(now)
        sums = now.groupBy("chain", "split").agg(F.array(*[F.sum(F.col("mass")[i]) for i in range(labels + 1)]).alias("s")).collect()
        state = np.zeros((chains, len(names), labels + 1))
        for r in sums:
            state[r["chain"], r["split"]] = r["s"]
        total = state[0].sum(axis=0)
        off = state - target[None, :, None] * total[None, None, :]
        scale = 1.0 / np.maximum(total, 1.0)
        scale[0] *= max(1.0, labels) ** 0.5
        costs = ((off * scale) ** 2).sum(axis=(1, 2))
        chain = int(costs.argmin())
        if best is None or costs[chain] < best[0]:
            best = (float(costs[chain]), chain, now)
        if step == rounds or total[0] == 0 or best[0] <= enough:
            break
        now = cut(now.groupBy("chain", "bucket").applyInPandas(_annealer(step, off, scale, float(total[0]), sweeps, seed), now.schema))
    _, chain, kept = best
    naming = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("split") + 1)
    result = kept.where(F.col("chain") == chain).select("component", naming.alias("split"))
    for frame in frames:
        if frame is not kept:
            drop_cut(frame)
    return result


DEFAULT_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def memberships(tasks: DataFrame, links: DataFrame, entity: str = "patient_id", row: str = "task_row", label: str = "task", shares: Mapping[str, float] = DEFAULT_SHARES, **search) -> DataFrame:
    """(entity as written, row, component, split) - one row per distinct spelling of an entity.

    Rows without an entity are components of their own and carry their row id in ``row`` (NULL otherwise).
    """
    single = ~not_blank(entity)
    units = (
        tasks.select(
            F.when(~single, F.col(entity)).alias("value"), F.when(single, F.col(row)).alias("row"), F.col(label).alias("label")
        )
        .groupBy("value", "row", "label")
        .agg(F.count("*").alias("n"))
        .withColumn("node", F.coalesce(entity_key("value"), F.concat(F.lit("row:"), F.coalesce(F.col("row").cast("string"), F.lit("")))))
    )
    person = connected(confirmed_links(links))
    units = cut(
        units.join(person.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("value", "row", "label", "n", "component")
    )
    masses, labels = component_masses(units, "label")
    found = search_splits(masses, shares, len(labels), **search)
    return units.select("value", "row", "component").distinct().join(found, "component").withColumnRenamed("value", entity)


def split_rows(tasks: DataFrame, links: DataFrame, entity: str = "patient_id", row: str = "task_row", column: str = "assigned_split", member: DataFrame | None = None, **options) -> DataFrame:
    """Every row of ``tasks`` with its split in ``column``; all rows of one entity share it.

    Tables may be empty.  Repeated rows count as often as they occur.  Rows without an entity get a split each; those
    that have no row id either share one.  Extra columns of any name stay.
    """
    member = memberships(tasks, links, entity, row, **options) if member is None else member
    named = member.where(F.col(entity).isNotNull()).select(F.col(entity).alias("_v"), F.col("split").alias("_s"))
    lone = member.where(F.col(entity).isNull()).select(F.col("row").alias("_r"), F.col("split").alias("_s"))
    whole = tasks.select(F.struct(*[F.col(f"`{c}`") for c in tasks.columns]).alias("_row"), F.col(entity).alias("_entity"), F.col(row).alias("_id"), not_blank(entity).alias("_having"))
    both = whole.where("_having").join(named, F.col("_entity") == F.col("_v")).select("_row", "_s").unionByName(
        whole.where("not _having").join(lone, F.col("_id").eqNullSafe(F.col("_r"))).select("_row", "_s")
    )
    return both.select("_row.*", F.col("_s").alias(column))


def same_entity(member: DataFrame, entity: str = "patient_id") -> DataFrame:
    """(patient_id_a, patient_id_b): the smallest spelling of each component with each other one of its split."""
    values = member.where(F.col(entity).isNotNull() & (F.col(entity) != ""))
    first = values.groupBy("component", "split").agg(F.min(entity).alias("patient_id_a"))
    return (
        values.join(first, ["component", "split"])
        .where(F.col(entity) != F.col("patient_id_a"))
        .select("patient_id_a", F.col(entity).alias("patient_id_b"))
    )


def split_report(rows: DataFrame, shares: Mapping[str, float] = DEFAULT_SHARES, label: str = "task", column: str = "assigned_split") -> DataFrame:
    """Per split and label (NULL: all of them): rows, the share reached and the share wanted."""
    wanted = F.create_map(*[F.lit(v) for kv in shares.items() for v in kv])
    counts = rows.groupBy(column, label).agg(F.count("*").alias("n")).withColumn("scope", F.coalesce(F.col(label), F.lit("(none)")))
    both = counts.groupBy(column, "scope").agg(F.sum("n").alias("n_rows")).unionByName(
        counts.groupBy(column).agg(F.sum("n").alias("n_rows")).withColumn("scope", F.lit("(all)"))
    )
    whole = both.groupBy("scope").agg(F.sum("n_rows").alias("whole"))
    return both.join(whole, "scope").select(
        "scope", F.col(column).alias("split"), "n_rows", (F.col("n_rows") / F.col("whole")).alias("share"), wanted[F.col(column)].alias("target_share")
    )


def split_check(tasks: DataFrame, links: DataFrame, shares: Mapping[str, float] = DEFAULT_SHARES, entity: str = "patient_id", row: str = "task_row", label: str = "task", **options) -> DataFrame:
    """Per label (``(all)``: all rows) and split: rows of the label, whether the split's share is as wanted, and torn entities.

    As wanted means within 0.01, and for a label within 0.02 and half the root of its rows beyond that; torn are
    components whose rows lie in more than one split.
    """
    member = cut(memberships(tasks, links, entity, row, label, shares, **options))
    torn = member.select("component", "split").distinct().groupBy("component").count().where("count > 1").count()
    report = split_report(split_rows(tasks, links, entity, row, member=member), shares, label)
    splits = tasks.sparkSession.createDataFrame([(s, float(t) / sum(shares.values())) for s, t in shares.items()], "split string, wanted double")
    whole = report.groupBy("scope").agg(F.sum("n_rows").alias("n_rows"))
    slack = F.when(F.col("scope") == "(all)", F.lit(0.01)).otherwise(0.02 + 0.5 / F.sqrt("n_rows"))
    return (
        whole.crossJoin(F.broadcast(splits))  # labels x splits
        .join(report.select("scope", "split", "share"), ["scope", "split"], "left")
        .select("scope", "split", "n_rows", (F.abs(F.coalesce("share", F.lit(0.0)) - F.col("wanted")) <= slack).alias("as_wanted"), F.lit(torn).cast("long").alias("torn"))
    )
