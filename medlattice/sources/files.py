"""Readers of record archives, delimited files, vocabularies and bundles."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import TABLE_ORDER
from ..operators.npx import NPX_SCHEMA, require
from ..session import file_system, put

#: Columns of headerless files.
GP_COLUMNS = ("EID", "data_provider", "event_date", "read2", "read3", "value1", "value2", "value3")
GENETIC_DICTIONARY_COLUMNS = ("affy_id", "chromosome", "index", "variant0", "variant1", "variant2", "variant3")
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files of a folder, sorted; names only, never contents."""
    fs, where = file_system(spark, folder)
    if not fs.exists(where):
        raise FileNotFoundError(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isFile())


def strings(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """A delimited file with every cell as text; quotes may span lines, empty cells are NULL."""
    return spark.read.options(header=header, inferSchema=False, sep=sep, quote=quote, escape='"' if quote else "\\", multiLine=bool(quote), mode="PERMISSIVE").csv(path)


def read_archive(spark: SparkSession, path: str, into: str) -> dict[str, DataFrame]:
    """``csv/<table>.csv`` of a zip archive: patients and the clinical tables, unpacked into the shared folder ``into``.

    The archive is read where the driver runs and written through the session's file system.  A missing table is an error.
    """
    wanted = ["patients", *TABLE_ORDER]
    with zipfile.ZipFile(path) as z:
        names = {n.rsplit("/", 1)[-1]: n for n in z.namelist() if n.startswith("csv/") and n.endswith(".csv")}
        missing = [t for t in wanted if f"{t}.csv" not in names]
        if missing:
            raise FileNotFoundError(f"the archive lacks {', '.join(missing)}")
        for t in wanted:
            with z.open(names[f"{t}.csv"]) as source:
                put(spark, f"{into}/csv/{t}.csv", iter(lambda: source.read(1 << 20), b""))  # noqa: B023
    return {t: strings(spark, f"{into}/csv/{t}.csv") for t in wanted}


def read_present(spark: SparkSession, folder: str, tables: Iterable[str] = ("patients", *TABLE_ORDER)) -> dict[str, DataFrame]:
    """The tables whose file is there; others are left out."""
    return {t: strings(spark, f"{folder}/{t}.csv") for t in tables if exists(spark, f"{folder}/{t}.csv")}


def delimiter(spark: SparkSession, path: str) -> str:
    """Tab if the first line has more tabs than commas."""
    line = spark.read.text(path).limit(1).collect()
    first = line[0][0] if line else ""
    return "\t" if first.count("\t") > first.count(",") else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Delimiter from the first line; tab files have no quotes."""
    sep = delimiter(spark, path)
    return strings(spark, path, sep, quote="" if sep == "\t" else '"')


def typed(df: DataFrame, dates: Sequence[str] = ()) -> DataFrame:
    """Text columns as date, bigint or double where every given cell is one; bad cells of ``dates`` become NULL."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    counts = []
    for c in texts:
        v = F.col(f"`{c}`")
        counts += [F.count(v).alias(f"n_{c}"), *[F.count(v.try_cast(t)).alias(f"{t}_{c}") for t in ("bigint", "double", "date")]]
    row = df.agg(*counts).first()
    made = {}
    for c in texts:
        n = row[f"n_{c}"]
        kind = "date" if c in dates else next((t for t in ("bigint", "double", "date") if n and row[f"{t}_{c}"] == n), "string")
        made[c] = F.col(f"`{c}`").try_cast(kind).alias(c) if kind != "string" else F.col(f"`{c}`")
    return df.select(*[made.get(c, F.col(f"`{c}`")) for c in df.columns])


def csv_to_parquet(spark: SparkSession, source: str, target: str, force: bool = False) -> dict[str, int | str]:
    """Each delimited file of a folder as Parquet: rows written, ``skipped`` where it was there, or the error's text.

    Ragged lines are cut or filled up; a file that fails does not stop the others.
    """
    done: dict[str, int | str] = {}
    for name in listing(spark, source):
        if not name.endswith((".csv", ".tsv", ".txt")):
            continue
        out = f"{target}/{name.rsplit('.', 1)[0]}.parquet"
        if not force and exists(spark, out):
            done[name] = "skipped"
            continue
        try:
            df = typed(read_delimited(spark, f"{source}/{name}"))
            df.write.mode("overwrite").parquet(out)
            done[name] = spark.read.parquet(out).count()
        except Exception as e:  # noqa: BLE001 - reported per file
            done[name] = f"error: {str(e).splitlines()[0]}"
    return done


def read_wide(spark: SparkSession, folder: str, part: str | None = None, rows: int | None = None) -> dict[str, DataFrame]:
    """Wide tab files by name, those whose name holds ``part``; ``rows`` of each at most; an error if there are none."""
    names = [n for n in listing(spark, folder) if n.endswith((".tsv", ".txt")) and not n.endswith(".md5") and (part is None or part in n)]
    if not names:
        raise FileNotFoundError(f"no tab files in {folder}")
    made = {n.rsplit(".", 1)[0]: strings(spark, f"{folder}/{n}", "\t", quote="") for n in names}
    return made if rows is None else {n: df.limit(rows) for n, df in made.items()}


def read_headerless(spark: SparkSession, folder: str, columns: Sequence[str], rows_per_file: int | None = None) -> DataFrame:
    """Headerless tab files as one table; a row cap counts per file, in the order of its lines."""
    names = [f"{folder}/{n}" for n in listing(spark, folder) if not n.endswith(".md5")]
    if not names:
        raise FileNotFoundError(f"no files in {folder}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    read = lambda p: spark.read.options(sep="\t", quote="", header=False, mode="PERMISSIVE").schema(schema).csv(p)
    if rows_per_file is None:
        return read(names)
    made = None
    for n in names:
        part = read(n).limit(rows_per_file)
        made = part if made is None else made.unionByName(part)
    return made


def read_gp(spark: SparkSession, folder: str, rows_per_file: int | None = None) -> DataFrame:
    return read_headerless(spark, folder, GP_COLUMNS, rows_per_file)


def read_genetic_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return read_headerless(spark, folder, GENETIC_DICTIONARY_COLUMNS)


def read_plink(spark: SparkSession, path: str, first: str) -> DataFrame:
    """A ``.pvar`` or ``.psam`` file: ``##`` lines skipped, the ``#`` of the heading removed (``first`` is its name)."""
    lines = spark.read.text(path)
    head = lines.where(F.startswith("value", F.lit("#")) & ~F.startswith("value", F.lit("##"))).limit(1).collect()
    if not head or not head[0][0].startswith(f"#{first}"):
        raise ValueError(f"{path} has no #{first} heading")
    columns = head[0][0][1:].split("\t")
    body = lines.where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0))
    cells = F.split("value", "\t")
    return body.select(*[F.try_element_at(cells, F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])


def read_pvar(spark: SparkSession, path: str) -> DataFrame:
    df = read_plink(spark, path, "CHROM")
    return df.withColumn("POS", F.col("POS").try_cast("bigint")) if "POS" in df.columns else df


def read_psam(spark: SparkSession, path: str) -> DataFrame:
    return read_plink(spark, path, "IID")


def read_npx(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), [c.split()[0] for c in NPX_SCHEMA.split(", ")])


def read_bundles(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(path, body) of the JSON files below a folder that hold a bundle; malformed ones are left out.

    With ``most`` those first by path.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    df = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    kept = df.where(F.try_variant_get(F.try_parse_json("body"), "$.resourceType", "string") == "Bundle")
    return kept if most is None else kept.orderBy("path").limit(most)


def file_index(spark: SparkSession, folders: dict[str, str], most: int | None = None) -> DataFrame:
    """(id, name, one array of paths per modality, modalities): the files of each patient by the UUID in their name.

    The full outer merge of the listings is one grouping.  Files without a UUID belong to nobody.
    """
    parts = None
    for modality, folder in sorted(folders.items()):
        if not exists(spark, folder):
            continue
        df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
        df = df.select(F.lit(modality).alias("m"), "path")
        parts = df if parts is None else parts.unionByName(df)
    if parts is None:
        raise FileNotFoundError("none of the folders exists")
    base = F.element_at(F.split("path", "/"), -1)
    named = parts.withColumn("id", F.lower(F.regexp_extract(base, UUID, 0))).where("id <> ''").withColumn("name", patient_name(base))
    made = named.groupBy("id").agg(
        F.min("name").alias("name"), F.array_sort(F.collect_set("m")).alias("modalities"),
        *[F.array_sort(F.collect_list(F.when(F.col("m") == m, F.col("path")))).alias(f"{m}_paths") for m in sorted(folders)],
    )
    return made if most is None else made.orderBy("id").limit(most)


def patient_name(base: Column) -> Column:
    """``First123_Last456_<uuid>`` as ``First Last``; NULL where the name is of another form."""
    a, b = F.regexp_extract(base, r"^([^_\d]+)\d*_([^_\d]+)\d*_", 1), F.regexp_extract(base, r"^([^_\d]+)\d*_([^_\d]+)\d*_", 2)
    return F.when((a != "") & (b != ""), F.concat(a, F.lit(" "), b))


def files_of(index: DataFrame, patient_id: str, modality: str) -> DataFrame:
    """The paths of one patient."""
    return index.where(F.col("id") == patient_id.lower()).select(F.explode(f"{modality}_paths").alias("path"))


def read_genomics(spark: SparkSession, folder: str) -> DataFrame:
    """All patients' variant files in one scan, with the patient from the file's name."""
    df = spark.read.options(header=True, recursiveFileLookup=True, pathGlobFilter="*.csv").csv(folder)
    return df.withColumn("patient_id", F.lower(F.regexp_extract("_metadata.file_path", UUID, 0)))


def read_series(spark: SparkSession, folder: str, decode, schema: str, most: int | None = None) -> DataFrame:
    """Binary image files through ``decode`` (an iterator of frames with path and content); unreadable ones are its to skip."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    return (df if most is None else df.orderBy("path").limit(most)).mapInPandas(decode, schema)


def vocabulary_umls(spark: SparkSession, path: str) -> DataFrame:
    """(concept_id, term, synonyms) of the English SNOMED rows of a concept file.

    The term is the last preferred string in the order of the file, else the first of all; every other string is a
    synonym, and so is the first one if it was not preferred.  Blocks are ordered by where they begin, rows within a block
    by how they are read, so it does not matter how the file is dealt out.
    """
    raw = spark.read.options(sep="|", quote="", header=False).csv(path)
    code, text = F.col("_c13"), F.col("_c14")
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = raw.withColumn("n", place).where("_c11 = 'SNOMEDCT_US' and _c1 = 'ENG'").select(code.alias("concept_id"), text.alias("t"), (F.col("_c6") == "Y").alias("p"), "n")
    made = rows.groupBy("concept_id").agg(
        F.max_by("t", F.when(F.col("p"), F.col("n"))).alias("preferred"), F.min_by("t", "n").alias("first"), F.min_by("p", "n").alias("first_preferred"), F.collect_set("t").alias("all")
    )
    term = F.coalesce("preferred", "first")
    others = F.filter("all", lambda s: s != term)
    return made.select("concept_id", term.alias("term"), F.array_sort(others).alias("synonyms"))


def vocabulary_csv(spark: SparkSession, path: str, concept_id: str = "concept_id", term: str = "term", semantic_type: str | None = None, most: int | None = None) -> DataFrame:
    df = require(strings(spark, path), [c for c in (concept_id, term, semantic_type) if c])
    made = df.select(F.col(concept_id).alias("concept_id"), F.col(term).alias("term"), (F.col(semantic_type) if semantic_type else F.lit(None).cast("string")).alias("semantic_type"))
    return made if most is None else made.orderBy("concept_id").limit(most)


def vocabulary_omop(spark: SparkSession, path: str, vocabulary: str = "SNOMED", standard_only: bool = True, domains: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """Valid concepts of one vocabulary, standard ones only if asked, of the given domains."""
    df = read_delimited(spark, path).where((F.col("vocabulary_id") == vocabulary) & (F.coalesce("invalid_reason", F.lit("")) == ""))
    if standard_only:
        df = df.where("standard_concept = 'S'")
    if domains is not None:
        df = df.where(F.col("domain_id").isin(list(domains)))
    made = df.select(F.col("concept_code").alias("concept_id"), F.col("concept_name").alias("term"), F.col("concept_class_id").alias("semantic_type"))
    return made if most is None else made.orderBy("concept_id").limit(most)


def vocabulary_acronyms(spark: SparkSession, path: str, acronym: str = "acronym", expansion: str = "expansion", most: int = 50_000) -> dict[str, str]:
    """The acronyms of a delimited file and what they stand for, as linking.expand_acronyms takes them; of repeats the first in order."""
    df = require(strings(spark, path), [acronym, expansion]).where(F.col(acronym).isNotNull() & F.col(expansion).isNotNull())
    rows = df.groupBy(F.upper(F.trim(acronym)).alias("a")).agg(F.min(F.trim(expansion)).alias("e")).where("a <> ''").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} acronyms")
    return {r["a"]: r["e"] for r in rows}


def sample_vocabulary(spark: SparkSession) -> DataFrame:
    """A few invented concepts to try the linker with."""
    from ..operators.vignettes import PANEL

    return spark.createDataFrame([(c, n, "disorder", a) for n, c, a, *_ in PANEL], "concept_id string, term string, semantic_type string, synonyms array<string>")


def strict_json(text: str) -> Any:
    """JSON without repeated keys and without numbers that are not finite."""

    def once(pairs: list) -> dict:
        made = dict(pairs)
        if len(made) != len(pairs):
            raise ValueError("a key repeats")
        return made

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no number of JSON")

    return json.loads(text, object_pairs_hook=once, parse_constant=refuse)


def closed(value: dict, allowed: Iterable[str], required: Iterable[str] = ()) -> dict:
    """The object itself, if it has all required and no unknown keys."""
    unknown, missing = set(value) - set(allowed), set(required) - set(value)
    if unknown or missing:
        raise ValueError(f"unknown keys {sorted(unknown)}, missing keys {sorted(missing)}")
    return value


def read_recipes(path: str, most_bytes: int = 16 * 2**20) -> Iterable[tuple[int, Any]]:
    """(line number, recipe or error) of a JSON-lines file."""
    with Path(path).open("rb") as f:
        for number, line in enumerate(f, 1):
            if not line.strip():
                continue
            try:
                if len(line) > most_bytes:
                    raise ValueError("the line is too long")
                yield number, strict_json(line.decode("utf-8"))
            except (ValueError, UnicodeDecodeError) as e:
                yield number, e


def md5_check(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(name, md5, good): digests of the files against a table (name, md5)."""
    df = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("got"))
    return expected.join(df, "name", "left").select("name", "md5", F.coalesce(F.col("got") == F.lower("md5"), F.lit(False)).alias("good"))


def by_extension(names: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Listing rows (name) whose name ends in one of the extensions, letter case aside."""
    pattern = "|".join(e.lstrip(".").replace(".", r"\.") for e in extensions)
    return names.where(F.col("name").rlike(rf"(?i)\.({pattern})$"))
