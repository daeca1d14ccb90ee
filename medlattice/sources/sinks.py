"""Writers whose last step is a manifest, so that a reader can tell a whole result from a broken one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import put
from .files import exists

#: Keys of a JSON row that are left out when NULL; all others are written as null.
OPTIONAL_KEYS = ("family_id", "horizon_days", "window_document_ids", "text_reference_policy", "stress_variant")


def json_lines(df: DataFrame, optional: Iterable[str] = OPTIONAL_KEYS) -> DataFrame:
    """(value): rows as JSON with sorted keys; optional keys only where they hold something."""
    names = sorted(df.columns)
    gone = [c for c in names if c in set(optional)]
    parts = []
    for c in names:
        shell = F.to_json(F.struct(F.col(f"`{c}`").alias(c)), {"ignoreNullFields": "false"})
        member = F.substring(shell, F.lit(2), F.length(shell) - 2)
        parts.append(F.when(F.col(f"`{c}`").isNotNull(), member) if c in gone else member)
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 by file of a folder, read where the files are."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = df.select(F.col("path"), F.sha2("content", 256).alias("h")).collect()
    return {r[0].split(folder.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1]: r[1] for r in rows}


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_bundle(tables: Mapping[str, DataFrame], folder: str, metadata: dict[str, Any], order: Mapping[str, list[str]] | None = None) -> dict[str, str]:
    """An immutable export: JSON lines per table in ranges of its order, metadata, then the digests of all files.

    The folder must be new.  Files are ordered within and among themselves, so a table is read in order without being
    gathered in one task.
    """
    if not tables:
        raise ValueError("nothing to write")
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, folder):
        raise FileExistsError(folder)
    for name, df in tables.items():
        keys = (order or {}).get(name)
        ordered = df.orderBy(*keys) if keys else df
        json_lines(ordered).write.text(f"{folder}/{name}")
    _write_text(spark, f"{folder}/metadata.json", json.dumps(metadata, sort_keys=True, ensure_ascii=False, default=str))
    sums = {k: v for k, v in digests(spark, folder).items() if not k.rsplit("/", 1)[-1].startswith(("_", "."))}
    _write_text(spark, f"{folder}/SHA256SUMS.json", json.dumps(sums, sort_keys=True))
    return sums


def write_tables(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Every table below the folder as Parquet or CSV."""
    for name, df in tables.items():
        writer = df.write.mode(mode)
        if form == "csv":
            writer.option("header", True).csv(f"{folder}/{name}")
        elif form == "parquet":
            writer.option("compression", "snappy").parquet(f"{folder}/{name}")
        else:
            raise ValueError(f"unknown form {form}")


def write_npx(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_plink(genotypes: DataFrame, variants: DataFrame, samples: DataFrame, folder: str, most_variants: int = 10_000) -> None:
    """``.pvar``, ``.psam`` and a wide dosage table; wide only for few variants."""
    from ..operators.pivot import attribute_list, block_pivot

    variants.select(F.col("chrom").alias("#CHROM"), F.col("pos").alias("POS"), F.col("variant_id").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT")).write.options(sep="\t", header=True).csv(f"{folder}/pvar")
    samples.select(F.col("person_id").alias("#IID"), F.col("sex").alias("SEX")).write.options(sep="\t", header=True).csv(f"{folder}/psam")
    names = attribute_list(variants, "variant_id", most_variants)
    wide = block_pivot(genotypes, "person_id", "variant_id", {"dosage": "{}"}, names)
    wide.withColumnRenamed("person_id", "IID").write.options(header=True, compression="gzip").csv(f"{folder}/genotypes")


def write_index(index: DataFrame, path: str) -> None:
    """A vector index is its table, sorted by concept within files so that look-ups skip row groups."""
    index.sortWithinPartitions("concept_id").write.mode("overwrite").parquet(path)


def write_association_bundle(arrays: Mapping[str, DataFrame], folder: str, provenance: dict[str, Any], most_bytes: int = 256 * 2**20) -> dict[str, Any]:
    """A table per array and a manifest with sizes, digests and schemas, written last; a failure leaves no folder."""
    spark = next(iter(arrays.values())).sparkSession
    if exists(spark, folder):
        raise FileExistsError(folder)
    try:
        for name, df in arrays.items():
            df.write.parquet(f"{folder}/{name}")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
        rows = files.select("path", "length", F.sha2("content", 256).alias("h")).collect()
        if sum(r["length"] for r in rows) > most_bytes:
            raise ValueError("the bundle is too large")
        manifest = {
            "provenance": provenance,
            "arrays": {n: [f"{c} {t}" for c, t in df.dtypes] for n, df in sorted(arrays.items())},
            "files": {r["path"].split(folder.rstrip("/") + "/", 1)[-1]: {"bytes": r["length"], "sha256": r["h"]} for r in rows},
        }
        _write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
        return manifest
    except Exception:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        raise


def run_batch(recipes: Iterable[tuple[int, Any]], run: Callable[[Any], Any], journal: str, spark: SparkSession | None = None) -> int:
    """One closing line per recipe in the journal, with counts at its end; the number of failures.

    With a session the journal lies in its file system, else on the driver's disk; a journal that is there is not touched.
    """
    counts = {"done": 0, "failed": 0}

    def lines() -> Iterator[bytes]:
        for number, recipe in recipes:
            said = {"line": number, "input_sha256": hashlib.sha256(json.dumps(recipe, sort_keys=True, default=str).encode()).hexdigest()}
            try:
                if isinstance(recipe, Exception):
                    raise recipe
                said |= {"status": "done", "result": run(recipe)}
                counts["done"] += 1
            except Exception as e:  # noqa: BLE001 - reported per recipe
                said |= {"status": "failed", "error": str(e)}
                counts["failed"] += 1
            yield (json.dumps(said, sort_keys=True, default=str) + "\n").encode()
        yield (json.dumps(counts) + "\n").encode()

    if spark is not None:
        put(spark, journal, lines(), replace=False, flush=True)
        return counts["failed"]
    with Path(journal).open("xb") as f:
        for line in lines():
            f.write(line)
            f.flush()
    return counts["failed"]
