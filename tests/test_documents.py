"""Patient documents, periods, genetic findings, exact medians, histories and answers on small fixtures with awkward cases."""

import hashlib
import statistics
from datetime import date

from pyspark.sql import functions as F

from medlattice.functions import text
from medlattice.operators import genetics, notes, npx, vignettes, windows
from medlattice.sources import files

from .conftest import rows

PEOPLE = "patient_id string, name string, gender string, birth_date string, address string, text string"
FACTS = "patient_id string, section string, date string, pos int, display string, status string, detail string, value string, rank string"


def _facts(*made):
    return [(*f, *[None] * (8 - len(f)), "x") for f in made]


def test_patient_documents(spark):
    people = [("a", "Ann", "", None, "1 Road", "t"), ("b", None, None, None, None, "t"), ("c", "Cy", "male", "1990-01-01", None, "t")]
    many = [("c", "conditions", f"20{i:02d}-01-01T10:00:00", i, f"c{i}") for i in range(53)]
    facts = _facts(
        ("a", "conditions", "2020-02-03T10:00", 1, "Gout", "active"), ("a", "conditions", None, 2, None, ""), ("a", "conditions", "2020-02-03T10:00", 0, "Rash"),
        ("a", "medications", None, 1, "Salve"), ("a", "medications", "2021-01-01", 2, None, "stopped"),
        ("a", "encounters", "2020-01-01", 1, "Visit", None, "AMB", "cough"), ("a", "encounters", None, 2, None),
        ("a", "vital-signs", None, 1, "Weight", None, "kg", "70"), ("a", "vital-signs", "2020-01-01", 2, "Height", None, None, "180"), ("a", "survey", "2020-01-01", 1, "Smoker"),
        ("a", "procedures", "2020-05-05T00:00", 1, "Scan"), ("b", "survey", "2020-01-01", 1, "Smoker"), ("z", "conditions", "2020-01-01", 1, "of nobody"), *many,
    )
    genes = spark.createDataFrame([("c", "## GENETIC / GENOMIC FINDINGS\nx")], "patient_id string, text string")
    df, fs = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(facts, FACTS)
    got = dict(rows(notes.patient_documents(df, fs, genes)))
    assert got["a"] == (
        "## PATIENT DEMOGRAPHICS\nName: Ann\nAddress: 1 Road\n\n## CONDITIONS / DIAGNOSES\n- Unknown date: Unknown condition\n- 2020-02-03: Rash\n- 2020-02-03: Gout [active]\n\n"
        "## MEDICATIONS\n- Salve\n- Unknown medication (2021-01-01) [stopped]\n\n## ENCOUNTERS / VISITS\n- Unknown date: Unknown\n- 2020-01-01: Visit (AMB) - cough\n\n"
        "## OBSERVATIONS (Labs, Vitals)\n\n### Vital Signs (Recent)\n- 2020-01-01: Height: 180\n- : Weight: 70 kg\n\n## PROCEDURES\n- Scan (2020-05-05)"
    )
    assert got["b"] == "## PATIENT DEMOGRAPHICS\n\n## OBSERVATIONS (Labs, Vitals)" and set(got) == {"a", "b", "c"}
    lines = got["c"].split("\n")
    assert lines.count("  ... and 3 more conditions") == 1 and "- 2052-01-01: c52" in lines and "- 2002-01-01: c2" not in lines and got["c"].endswith("\n\n## GENETIC / GENOMIC FINDINGS\nx")
    short = dict(rows(notes.patient_documents(df, fs, most_tokens=5)))
    assert short["a"] == got["a"][:20] + "\n\n[... truncated for length ...]"
    assert dict(rows(notes.patient_documents(df, fs.where("false"))))["b"] == "## PATIENT DEMOGRAPHICS" and notes.patient_documents(df.where("false"), fs).count() == 0


def test_period_texts(spark):
    events = [("a", "condition", date(2010, 1, 1), 2, "late"), ("a", "condition", date(2010, 1, 1), 1, None), ("a", "encounter", date(2011, 5, 5), 1, "v"), ("a", "procedure", date(2017, 1, 1), 1, "p"), ("a", "observation", date(2017, 1, 1), 1, None)]
    events += [("b", "medication", date(2000, 1, 1), i, f"m{i:02d}") for i in range(14)] + [("b", "procedure", date(2000, 1, 1), i, f"p{i}") for i in range(7)]
    got = {(r["patient_id"], r["from_year"]): r for r in notes.period_texts(spark.createDataFrame(events, "patient_id string, kind string, date date, pos int, display string")).collect()}
    assert set(got) == {("a", 2010), ("a", 2015), ("b", 2000)}
    assert got["a", 2010]["text"] == "## PERIOD: 2010 - 2014\n\nConditions diagnosed:\n  - Unknown\n  - late\n\nEncounters: 1 visits" and got["a", 2010]["n_events"] == 3
    assert got["a", 2015]["text"] == "## PERIOD: 2015 - 2017\n\nProcedures:\n  - p\n\nObservations recorded: 1"
    assert got["b", 2000]["text"].count("  - ") == 15 and "m09" in got["b", 2000]["text"] and "m10" not in got["b", 2000]["text"]


def test_genetic_text(spark):
    said = ["Pathogenic", "Benign", "Likely benign", "Drug response", "not provided"]
    data = [("a", f"rs{i}", "Unlisted" if i % 2 else "G1", said[i % 5], "C", "A", "true", i) for i in range(60)] + [("b", "rs1", "G2", "Benign", "C", "A", "True", 1), ("b", "rs2", "G2", "Benign", "A", "A", "true", 2), ("b", "rs1", "G2", "Benign", "C", "A", "true", 3)]
    df = spark.createDataFrame(data, "patient_id string, rsid string, gene string, significance string, allele string, ancestral_allele string, variant string, row_no int")
    found = genetics.gene_findings(df).withColumn("rank", F.col("row_no")).withColumn("chromosome", F.when(F.col("rsid") != "rs1", "7"))
    assert {r["significance"]: r["priority"] for r in found.collect()} == {"Pathogenic": 1, "Benign": 10, "Likely benign": 9, "Drug response": 4, "not provided": 100}
    got = dict(rows(notes.genetic_text(found)))
    assert [line for line in got["a"].split("\n") if line.startswith("###")] == ["### Pathogenic Variants", "### Drug response Variants", "### not provided Variants"]
    assert got["a"].count("- rs") == 30 and "- rs5 - Chr7" in got["a"] and "- rs0 (G1) - Chr7" in got["a"]
    assert got["b"] == "## GENETIC / GENOMIC FINDINGS\n\n### Benign Variants\n- rs1 (G2) - Chr?"


def test_exact_median(spark):
    values = {"a": [1.0, 2.0, 2.0, 9.0], "b": [5.0], "c": [-3.0] * 40 + [0.001 * i for i in range(39)], "d": [0.1, 0.10001], "e": []}
    data = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("e", None), ("e", float("nan"))]
    got = dict(rows(npx.exact_median(spark.createDataFrame(data, "g string, v double"), "g", "v")))
    assert got == {k: statistics.median(v) for k, v in values.items() if v}


def test_history_hash(spark):
    docs = [("p", r, date(2020, m, 1), date(2020, m, 2), f"{m}", f"text {m}", 1) for r in ("1d", "1mo") for m in (3, 1, 2)] + [("q", "1d", date(2020, 1, 1), date(2020, 1, 2), "9", None, 1)]
    df = spark.createDataFrame(docs, "patient_id string, resolution string, window_start date, window_end date, document_id string, text string, n_events int")
    people = spark.createDataFrame([("p",), ("q",), ("r",)], "Id string")
    got = {(r["patient_id"], r["resolution"]): r for r in windows.history_documents(people, df.repartition(7)).collect()}
    whole = hashlib.sha256(b"text 1\ntext 2\ntext 3").hexdigest()
    assert got["p", "1d"]["input_sha256"] == got["p", "1mo"]["input_sha256"] == whole and got["p", "1d"]["window_document_ids"] == ["1", "2", "3"]
    assert got["r", "1d"]["n_events"] == 0 and got["r", "1d"]["input_sha256"] == hashlib.sha256(windows.EMPTY_HISTORY.encode()).hexdigest() and got["q", "1d"]["input_sha256"] == hashlib.sha256(b"").hexdigest()


def test_answers_after_open_thoughts(spark):
    clean = lambda s: spark.range(1).select(text.clean_response(F.lit(s))).first()[0]
    assert clean("<unused94>thought\nlet me see\n\nSUBJECTIVE: cough\nPLAN: rest") == "SUBJECTIVE: cough\nPLAN: rest"
    assert clean("<unused94>thought\nhm\nPLAN first\n# Note\ntext") == "# Note\ntext"
    assert clean("<unused94>thought only thoughts") == "only thoughts" and clean("plain\n# Note") == "plain\n# Note" and clean("") == ""


def test_controls_of_each_condition(spark):
    visits = vignettes.visits(vignettes.patients(spark, 12)).where("offset = 0")
    n = {(r["negative_type"]): r["n"] for r in visits.groupBy("negative_type").agg(F.countDistinct("patient_id").alias("n")).collect()}
    assert n == {"case": 6 * 16, "mimic": 3 * 16, "unrelated": 3 * 16} and len(vignettes.PANEL) == 16
    told = visits.where("negative_type = 'mimic'").select("condition", F.regexp_extract("text", "Symptoms: (.*?); F", 1).alias("t")).distinct().collect()
    mimics = {row[0]: row[6] for row in vignettes.PANEL}
    assert all(r["t"] in mimics[r["condition"]] for r in told)


def test_acronyms_of_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("acronym,expansion\nhd,heart disease\n HD ,zzz\n,none\nMS,multiple sclerosis\n")
    assert files.vocabulary_acronyms(spark, str(tmp_path / "a.csv")) == {"HD": "heart disease", "MS": "multiple sclerosis"}
