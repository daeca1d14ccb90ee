"""Top-k vector retrieval and what entity linking builds on it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors scored at a time against every index row.
BLOCK_QUERIES = 2_000


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The vector at length 1; a zero vector stays, NaN is an error."""
    bad = F.exists(v, lambda x: F.isnan(x))
    length = norm(v)
    return F.when(bad, F.raise_error(F.lit("a vector holds NaN")).cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length)))


def inner_product(a: Column, b: Column) -> Column:
    """The inner product; vectors of different length are an error."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(product)


def hashed_encoding(size: int = 64, n: int = 3):
    """A model-free text encoder as a pandas UDF: hashed character n-grams, at length 1."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(texts: pd.Series) -> pd.Series:
        import zlib

        made = []
        for t in texts:
            v = np.zeros(size)
            padded = f" {(t or '').lower()} "
            for k in range(max(0, len(padded) - n + 1)):
                h = zlib.crc32(padded[k : k + n].encode())
                v[h % size] += 1.0 if h >> 31 else -1.0
            length = np.linalg.norm(v)
            made.append((v / length if length else v).tolist())
        return pd.Series(made)

    return encode


def top_k(queries: DataFrame, index: DataFrame, k: int = 5, threshold: float | None = None, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, concept_id, score): the k nearest concepts by inner product, exact.

    ``queries`` (query_id, vector) is the stated query set, taken in blocks of bounded size; every index row
    (concept_id, vector) is scored against a block where it lies, and each task keeps its k best per query, so what is
    shuffled is tasks x queries x k rows and never pairs.  Ties go to the smaller concept id.  The threshold applies
    after the top k.
    """
    spark = queries.sparkSession
    schema = f"query_id {dict(queries.dtypes)['query_id']}, concept_id {dict(index.dtypes)['concept_id']}, score double"
    count = queries.count()
    parts = max(1, -(-count // block))
    found = None
    for b in range(parts):
        rows = (queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b)).select("query_id", "vector").collect()
        if not rows:
            continue
        matrix = np.array([r[1] for r in rows], np.float64)
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], matrix))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best: tuple | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(flat) != batch.num_rows * q.shape[1]:
                    raise ValueError("vectors differ in length")
                best = _best(q @ flat.reshape(batch.num_rows, -1).T, batch.column(0).to_numpy(zero_copy_only=False), k, best)
            if best is not None:
                row, score, concept = best
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in row.tolist()]), pa.array(concept.tolist()), pa.array(score)], names=["query_id", "concept_id", "score"])

        part = index.select("concept_id", "vector").mapInArrow(work, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema.replace("score", "rank int, score"))
    from pyspark.sql import Window

    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "concept_id")))
    kept = ranked.where(F.col("rank") <= k)
    return (kept if threshold is None else kept.where(F.col("score") >= threshold)).select("query_id", "rank", "concept_id", "score")


def _best(s: np.ndarray, concepts: np.ndarray, k: int, before: tuple | None) -> tuple:
    """(row, score, concept) of the k best per row of ``s`` and those of ``before``, ties by the smaller concept.

    All of a row's k-th score are looked at; ids are taken for these only.
    """
    n = s.shape[1]
    floor = np.partition(s, n - k, axis=1)[:, n - k : n - k + 1] if n > k else np.full((len(s), 1), -np.inf)
    row, column = np.nonzero(s >= floor)
    score, concept = s[row, column], concepts[column]
    if concept.dtype == object:
        concept = concept.astype(str)
    if before is not None:
        row, score, concept = (np.concatenate([a, b]) for a, b in zip(before, (row, score, concept)))
    order = np.lexsort((concept, -score, row))
    row, score, concept = row[order], score[order], concept[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[kept], score[kept], concept[kept]


def link_mentions(mentions: DataFrame, matches: DataFrame) -> DataFrame:
    """Mentions in their order with their matches; repeated mentions share them, mentions without stay with none.

    ``mentions``: (mention_no, mention); ``matches``: (mention, rank, concept_id, score).
    """
    of = matches.groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("rank", "concept_id", "score"))).alias("matches"))
    return mentions.join(of, "mention", "left").withColumn("matches", F.coalesce("matches", F.expr("cast(array() as array<struct<rank:int,concept_id:string,score:double>>)")))


def gaps(mentions: DataFrame, matches: DataFrame, low: float = 0.5) -> DataFrame:
    """(term, kind, n, score): unmatched terms with their count, and terms whose best score is under ``low``."""
    best = matches.groupBy("mention").agg(F.max("score").alias("score"))
    joined = mentions.join(best, "mention", "left")
    kind = F.when(F.col("score").isNull(), "unmatched").when(F.col("score") < low, "low_confidence")
    return joined.withColumn("kind", kind).where("kind is not null").groupBy(F.col("mention").alias("term"), "kind").agg(F.count("*").alias("n"), F.max("score").alias("score")).orderBy(F.desc("n"), "score", "term")


def expand_acronyms(value: Column, table: Mapping[str, str]) -> Column:
    """A term that is an acronym, or its words that are, written out; white space stays."""
    if not table:
        return value
    known = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k.upper(), v)])
    get = lambda c: F.try_element_at(known, F.upper(c))
    parts = F.regexp_extract_all(value, F.lit(r"\s+|\S+"), 0)
    return F.coalesce(get(F.trim(value)), F.array_join(F.transform(parts, lambda p: F.coalesce(get(p), p)), ""))


def add_concepts(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the new concepts that it does not hold; the first of repeated new ids."""
    first = new.groupBy("concept_id").agg(*[F.min_by(c, F.struct(*[x for x in new.columns if x not in ("vector", "concept_id")])).alias(c) if len(new.columns) > 2 else F.first(c).alias(c) for c in new.columns if c != "concept_id"])
    return index.unionByName(first.join(index.select("concept_id"), "concept_id", "left_anti").select(*index.columns))


def ground_edges(edges: DataFrame, grounded: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type): edges all of whose ends have a concept; an interaction gives one per source."""
    of = grounded.select(F.col("name"), "concept_id")
    every = edges.select("edge_id", F.explode("sources").alias("source"), F.size("sources").alias("n"), "target", "edge_type")
    found = (
        every.join(of.select(F.col("name").alias("source"), F.col("concept_id").alias("source_id")), "source")
        .join(of.select(F.col("name").alias("target"), F.col("concept_id").alias("target_id")), "target")
    )
    whole = found.groupBy("edge_id").agg(F.count("*").alias("got"), F.max("n").alias("n")).where("got = n").select("edge_id")
    return found.join(whole, "edge_id", "left_semi").select("edge_id", "source_id", "target_id", "edge_type")


def reject_entities(entities: DataFrame, generic: Sequence[str], types: Sequence[str], least: float = 0.7) -> DataFrame:
    """Entities that are no generic terms, of no unwanted type, and matched well enough; one per concept, the first."""
    kept = entities.where(~F.lower("mention").isin([g.lower() for g in generic]) & ~F.coalesce(F.col("semantic_type").isin(list(types)), F.lit(False)) & (F.col("score") >= least))
    first = kept.groupBy("document_id", "concept_id").agg(F.min_by(F.struct("mention", "score", "semantic_type"), F.struct("mention_no")).alias("e"), F.min("mention_no").alias("mention_no"))
    return first.select("document_id", "concept_id", "mention_no", "e.*")


def descendants(parents: DataFrame, roots: DataFrame, most_depth: int = 50) -> DataFrame:
    """(root, concept_id): each root with all concepts below it, itself included, level by level.

    ``parents``: (child, parent).  Every level is an equi-join of the new frontier; concepts met before are not
    followed again, so cycles end.
    """
    from ..session import cut

    seen = frontier = cut(roots.select(F.col("concept_id").alias("root"), "concept_id").distinct())
    for _ in range(most_depth):
        below = frontier.join(parents, F.col("concept_id") == F.col("parent")).select("root", F.col("child").alias("concept_id")).distinct()
        frontier = cut(below.join(seen, ["root", "concept_id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"the hierarchy is deeper than {most_depth}")


def document_counts(linked: DataFrame) -> DataFrame:
    """Per document: mentions, linked ones, distinct concepts."""
    return linked.groupBy("document_id").agg(F.count("*").alias("n_mentions"), F.count("concept_id").alias("n_linked"), F.countDistinct("concept_id").alias("n_concepts"))


def grounded_relations(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(document_id, source_ids, target_id, relation): edges between linked entities, each once, the first.

    An end is read as a label of its document in any letter case, or by an id in ``[SNOMED:id]``.  ``edges``:
    (document_id, edge_no, sources, target, relation); ``labels``: (document_id, label, concept_id).  Edges with an end
    that is neither are left out; sources count in any order.
    """
    named = labels.groupBy("document_id", F.lower(F.trim("label")).alias("label")).agg(F.min("concept_id").alias("named_id"))
    kind = dict(labels.dtypes)["concept_id"]

    def ground(df: DataFrame, end: str, to: str) -> DataFrame:
        stated = F.regexp_extract(end, r"\[SNOMED:\s*(\w+)\]", 1).try_cast(kind)
        bare = F.lower(F.trim(F.regexp_replace(end, r"\[[^\]]*\]", "")))
        return df.withColumn("label", bare).join(named, ["document_id", "label"], "left").withColumn(to, F.coalesce("named_id", stated)).drop("label", "named_id")

    ends = edges.select("document_id", "edge_no", "relation", "target", F.size("sources").alias("n"), F.explode("sources").alias("source"))
    found = ground(ground(ends, "source", "source_id"), "target", "target_id").where("source_id is not null and target_id is not null")
    whole = found.groupBy("document_id", "edge_no", "relation", "target_id", "n").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.count("*").alias("got")).where("got = n")
    first = whole.groupBy("document_id", "source_ids", "target_id", "relation").agg(F.min("edge_no").alias("edge_no"))
    return first.select("document_id", "source_ids", "target_id", "relation", "edge_no")


def check_concept_sets(bridge: DataFrame, roots: DataFrame) -> None:
    """An error unless every concept has a code and holds its own root: bridge (concept_id, code), roots (concept_id, code)."""
    lost = roots.join(bridge, ["concept_id", "code"], "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"concept sets without their root: {', '.join(str(r['concept_id']) for r in lost)}")


def check_families(families: DataFrame, panel: DataFrame) -> None:
    """An error unless every family has two candidates at least and all of them are in the panel."""
    lost = families.join(panel.select("concept_id"), "concept_id", "left_anti").limit(5).collect()
    small = families.groupBy("family_id").agg(F.countDistinct("concept_id").alias("n")).where("n < 2").limit(5).collect()
    if lost or small:
        raise ValueError(f"unknown candidates {[r['concept_id'] for r in lost]}, families of one {[r['family_id'] for r in small]}")
