"""Data model, bundles, proteins, linking, graphs, genes, notes, vignettes, sources, sinks and streams."""

import json
import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlattice.functions import rng, text
from medlattice.operators import causal, fhir, genetics, linking, meds, notes, npx, omop, vignettes
from medlattice.operators.events import TABLE_ORDER
from medlattice.sources import files, sinks
from medlattice.streaming import events as streams

from .conftest import day, rows, ts


def test_omop(spark):
    tables = {
        "patients": spark.createDataFrame([("a", day("1990-02-03"), None, "M"), ("b", None, day("2020-01-01"), None)], "Id string, BIRTHDATE date, DEATHDATE date, GENDER string"),
        "encounters": spark.createDataFrame([("e", "a", day("2019-01-01"), day("2019-01-05"), "URGENTCARE"), ("f", "z", day("2019-01-01"), None, None)], "Id string, PATIENT string, START date, STOP date, ENCOUNTERCLASS string"),
        "medications": spark.createDataFrame([("a", "e", day("2019-01-01"), day("2019-01-11"), "M"), ("q", "x", day("2019-01-01"), None, None)], "PATIENT string, ENCOUNTER string, START date, STOP date, CODE string"),
        "observations": spark.createDataFrame([("a", "e", day("2019-01-01"), "O", v, "u") for v in ("1.5", "nan", "high", None)], "PATIENT string, ENCOUNTER string, DATE date, CODE string, VALUE string, UNITS string"),
        "procedures": spark.createDataFrame([("a", "e", "P")], "PATIENT string, ENCOUNTER string, CODE string"),
    }
    made = omop.convert(tables, date(2024, 1, 1))
    assert "procedure_occurrence" not in made and made["cdm_source"].count() == 1
    assert {r["gender_concept_id"] for r in made["person"].collect()} == {8507, 0}
    drugs = {r["drug_source_value"]: r for r in made["drug_exposure"].collect()}
    assert drugs["M"]["days_supply"] == 10 and drugs["M"]["visit_occurrence_id"] is not None and drugs[None]["person_id"] == 0 and drugs[None]["visit_occurrence_id"] is None
    assert made["measurement"].count() == 1 and made["observation"].count() == 3 and made["death"].count() == 1
    assert made["observation_period"].count() == 1
    assert {r["visit_concept_id"] for r in made["visit_occurrence"].collect()} == {9203, 9202}
    assert omop.event_stream(made).count() == 2 + 2 + 4 + 1
    names = spark.createDataFrame([("1", None, "V"), ("1", "one", "V"), ("1", "uno", "W")], "concept_code string, concept_name string, vocabulary_id string")
    assert rows(omop.add_concept_names(spark.createDataFrame([(1,), (2,)], "c int"), "c", names, "V")) == [(1, "one"), (2, None)]


def test_event_shards(spark, tmp_path):
    df = spark.createDataFrame([("b", ts("2020-01-02"), "x"), ("a", ts("2020-01-03"), "y"), ("a", ts("2020-01-01"), "z")], "subject_id string, time timestamp_ntz, code string")
    meds.write_events(df, str(tmp_path / "m"), 2)
    assert [r["code"] for r in meds.read_events(spark, str(tmp_path / "m")).collect()] == ["z", "y", "x"]
    assert [r["code"] for r in meds.read_events(spark, str(tmp_path / "m"), ["b"]).collect()] == ["x"]
    assert meds.read_events(spark, str(tmp_path / "m"), []).count() == 0
    with pytest.raises(FileNotFoundError):
        meds.read_events(spark, str(tmp_path / "nowhere"))
    (tmp_path / "empty/data").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        meds.read_events(spark, str(tmp_path / "empty"))


BUNDLE = {"resourceType": "Bundle", "entry": [
    {"resource": {"resourceType": "Patient", "id": "p", "name": [{"given": ["Ann", "B"], "family": "Lee"}], "gender": "female", "birthDate": "1990-01-01", "address": [{"line": ["1 Road"], "city": "", "state": "S"}],
        "telecom": [{"system": "email", "value": "x"}, {"system": "phone", "value": "1"}], "maritalStatus": {"text": "Married"}}},
    {"resource": {"resourceType": "Condition", "code": {"coding": [{"code": "1", "display": "Asthma"}, {"code": "2"}]}, "onsetDateTime": "2020"}},
    {"resource": {"resourceType": "MedicationRequest", "medicationCodeableConcept": {"coding": [{"display": "Inhaler", "code": "m"}]}, "status": "active"}},
    {"resource": {"resourceType": "Observation", "code": {"text": "Weight"}, "valueQuantity": {"value": 70.5, "unit": "kg"}, "valueString": "no", "category": [{"coding": [{"code": "Vital"}]}]}},
    {"resource": {"resourceType": "Observation", "code": {"coding": [{"code": "o"}]}, "valueCodeableConcept": {"text": "yes"}, "valueString": "no"}},
    {"resource": {"resourceType": "Procedure", "code": {"coding": []}, "performedPeriod": {"start": "2019"}}}, {"resource": {"resourceType": "Encounter", "class": {"code": "AMB"}}},
]}


def test_fhir(spark):
    df = spark.createDataFrame([(1, json.dumps(BUNDLE)), (2, "{broken"), (3, None), (4, "null")], "record_id long, body string")
    found = fhir.resources(df)
    assert found.count() == 7 and {r[0] for r in found.select("patient_id").distinct().collect()} == {"p"}
    p = fhir.demographics(found).first()
    assert (p["name"], p["given"], p["address"], p["phone"], p["marital_status"]) == ("Ann B Lee", "Ann B", "1 Road, S", "1", "Married")
    assert rows(fhir.conditions(found).select("code", "display", "onset_date")) == [("1", "Asthma", "2020")]
    values = rows(fhir.observations(found).select("display", "value_num", "value_str", "unit"))
    assert values == [("Weight", 70.5, None, "kg"), (None, None, "yes", None)]
    assert fhir.observations(found, "vital").count() == 1 and fhir.procedures(found).first()["performed_date"] == "2019" and fhir.encounters(found).first()["class"] == "AMB"
    people = fhir.demographics(found).withColumn("modalities", F.array(F.lit("fhir"), F.lit("notes")))
    hit = lambda d: d.count() == 1
    assert hit(fhir.with_fact(people, fhir.conditions(found), "asth")) and not hit(fhir.with_fact(people, fhir.conditions(found), "asth", True)) and hit(fhir.with_fact(people, fhir.conditions(found), "1"))
    assert hit(fhir.search(people, fhir.conditions(found), fhir.medications(found), "INHAL")) and hit(fhir.search(people, fhir.conditions(found), fhir.medications(found), "lee"))
    assert hit(fhir.with_observation(people, fhir.observations(found), low=100.0)) and not hit(fhir.with_observation(people, fhir.observations(found), display="weight", low=100.0))
    assert hit(fhir.with_gender(people, "Female")) and hit(fhir.with_modality(people, ["fhir"])) and not hit(fhir.with_modality(people, ["fhir", "dicom"])) and hit(fhir.with_modality(people, ["fhir", "dicom"], False))
    assert hit(fhir.by_prefix(people, "p")) and hit(fhir.sample(people, 9)) and fhir.dataset_rows(people, fhir.conditions(found), fhir.medications(found)).first()["n_conditions"] == 1


def test_simulated_readings(spark):
    panel = npx.default_panel(3)
    config = npx.SimulationConfig(1000, panel, tuple("case" if i % 2 else "baseline" for i in range(1000)), {"case": {"PROT0001": 2.0}}, missing_rate=0.3, qc_rate=0.1, mode="mcar", seed=4)
    df = npx.simulate(spark, config)
    assert [f"{c} {t}" for c, t in df.dtypes] == ["sample_id string", "protein_id string", "npx double", "qc_warning boolean", "group string", "plate_id string"]
    d = df.where("protein_id = 'PROT0001'").groupBy("group").agg(F.avg("npx").alias("m")).collect()
    means = {r["group"]: r["m"] for r in d}
    assert abs(means["case"] - means["baseline"] - 2.0) < 0.1
    share = df.agg(F.count("*") / 3000, F.avg(F.col("qc_warning").cast("int"))).first()
    assert abs(share[0] - 0.7) < 0.03 and abs(share[1] - 0.1) < 0.03 and df.select("plate_id").distinct().count() == 11
    assert rows(df) == rows(npx.simulate(spark, config).repartition(7))
    low = npx.PanelConfig(("a",), {"a": 1.0}, {"a": 0.6}, {"a": 2.0})
    assert npx.simulate(spark, npx.SimulationConfig(1000, low, missing_rate=0.0)).count() < 400
    assert npx.simulate(spark, npx.SimulationConfig(0, low)).count() == 0
    for bad in (dict(n_samples=-1), dict(missing_rate=2.0), dict(mode="x"), dict(groups=("a",))):
        with pytest.raises(ValueError):
            npx.SimulationConfig(**({"n_samples": 5, "panel": low} | bad))
    for bad in (("a", "a"), ("a", "b")):
        with pytest.raises(ValueError):
            npx.PanelConfig(bad, {"a": 1.0}, {"a": 1.0}, {"a": 1.0})


def test_student():
    t, df = np.array([0.0, 1.0, 2.228, 12.706, -3.0]), np.array([5.0, 1.0, 10.0, 1.0, 30.0])
    assert np.allclose(npx.student_two_sided(t, df), [1.0, 0.5, 0.05, 0.05, 0.00538], atol=1e-4)


def test_effects(spark, tmp_path):
    (tmp_path / "c.csv").write_text("disease,protein_uniprot,delta_npx,se_delta,extra\nd,P,0.5,0.1,x\nd,Q,0,0.1,y\ne,P,-1,,z\n")
    df = npx.effects(spark, str(tmp_path / "c.csv"))
    assert rows(npx.effect_map(df, ["d", "e"])) == [("P", {"d": 0.5, "e": -1.0})]
    (tmp_path / "bad.csv").write_text("disease,protein_uniprot,delta_npx,se_delta\nd,P,much,0.1\n")
    with pytest.raises(Exception, match="no number"):
        npx.effects(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "less.csv").write_text("disease\nd\n")
    with pytest.raises(ValueError):
        npx.effects(spark, str(tmp_path / "less.csv"))


def test_top_k_against_brute_force(spark):
    g = np.random.default_rng(2)
    v = g.normal(size=(300, 8)).round(1)
    index = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "concept_id long, vector array<double>").repartition(7)
    for block in (2000, 3):
        got = rows(linking.top_k(index.where("concept_id < 10").select(F.col("concept_id").alias("query_id"), "vector"), index, 4, block=block).select("query_id", "rank", "concept_id"))
        want = [(q, k + 1, int(i)) for q in range(10) for k, i in enumerate(sorted(range(300), key=lambda i, q=q: (-round(float(v[q] @ v[i]), 9), i))[:4])]
        assert got == sorted(want, key=repr)
    assert linking.top_k(index.where("false").select(F.col("concept_id").alias("query_id"), "vector"), index).count() == 0
    short = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    with pytest.raises(Exception, match="differ"):
        linking.top_k(short, index).collect()
    with pytest.raises(Exception, match="NaN"):
        spark.createDataFrame([([float("nan")],)], "v array<double>").select(linking.normalised(F.col("v"))).collect()
    words = spark.createDataFrame([("heart failure",), ("heart  failure",), (None,)], "t string").select(linking.hashed_encoding()("t").alias("v")).collect()
    assert len(words[0]["v"]) == 64 and sum(x * y for x, y in zip(words[0]["v"], words[1]["v"])) > 0.7


def test_causal(spark):
    said = "```\nObesity[lifestyle] ++> Diabetes[condition] (year 2) => Neuropathy\n- DrugA && DrugB => Failure[condition]\n* BRCA1 || BRCA2 ?+> Cancer\nDrugB && DrugA => failure[condition]\nno edge\nA causes B\n-> lost\n```"
    edges = causal.parse_edges(spark.createDataFrame([(1, said), (2, None), (3, "")], "doc_id long, text string"))
    got = sorted((r["line_no"], r["step"], tuple(r["sources"]), r["target"], r["edge_type"], r["interaction"]) for r in edges.collect())
    assert got == [
        (1, 0, ("Obesity[lifestyle]",), "Diabetes[condition] (year 2)", "++>", None), (1, 1, ("Diabetes[condition] (year 2)",), "Neuropathy", "=>", None), (2, 0, ("DrugA", "DrugB"), "Failure[condition]", "=>", "and"),
        (3, 0, ("BRCA1", "BRCA2"), "Cancer", "?+>", "or"), (6, 0, ("A",), "B", "causes", None),
    ]
    names = {r["name"]: (r["node_type"], r["node_time"]) for r in causal.nodes(edges).collect()}
    assert names["Diabetes"] == ("condition", "year 2") and names["Neuropathy"] == ("unknown", None)
    assert causal.causes_of(edges, "diab", "risk").count() == 1 and causal.consequences_of(edges, "drugb").count() == 1
    assert sorted(r["length"] for r in causal.chains(edges, "obes").collect()) == [1, 2]
    assert causal.expanded(edges).where("relation = 'member_of'").count() == 4
    assert "Obesity_lifestyle_" in causal.mermaid(edges).first()["mermaid"]


def test_phenotypes(spark):
    alleles = {"a": ((0, 0), (0, 1)), "b": ((0, 1), (1, 2)), "c": ((1, 1), (2, 2))}
    g = spark.createDataFrame([(p, v, h, a[k][h]) for p, a in alleles.items() for k, v in enumerate(("one", "two")) for h in (0, 1)], genetics.GENOTYPE)
    e = spark.createDataFrame([("one", 1, "t", 2.0), ("two", 2, "t", 10.0)], "variant_id string, allele_index int, trait_id string, beta double")
    assert rows(genetics.additive(g, e)) == [("a", "t", 0.0), ("b", "t", 12.0), ("c", "t", 24.0)]
    assert rows(genetics.dominance(g, e)) == [("a", "t", 0.0), ("b", "t", 12.0), ("c", "t", 0.0)]
    pair = spark.createDataFrame([("one", 1, "two", 1, 1.0, 0.0, "t", 3.0)], "variant_1 string, allele_1 int, variant_2 string, allele_2 int, centre_1 double, centre_2 double, trait_id string, beta double")
    assert rows(genetics.interaction(g, pair)) == [("a", "t", -3.0), ("b", "t", 0.0), ("c", "t", 0.0)]
    assert rows(genetics.compound_het(g, pair)) == [("a", "t", 0.0), ("b", "t", 3.0), ("c", "t", 0.0)]
    for cov in ([[1.0, 0.5], [0.5, 2.0]], [[1.0, 1.0], [1.0, 1.0]], [[0.0, 0.0], [0.0, 3.0]]):
        a = genetics.covariance_factor(np.array(cov))
        assert np.allclose(a @ a.T, cov)
    for bad in ([[1.0, 2.0], [2.0, 1.0]], [[0.0, 1.0], [1.0, 1.0]], [[1.0, float("nan")], [0.0, 1.0]]):
        with pytest.raises(ValueError):
            genetics.covariance_factor(np.array(bad))
    assert genetics.table_signature(g, []) == genetics.table_signature(g.repartition(5), [])
    s = genetics.stream_seed("a", 1)
    assert s and genetics.stream_seed("a", 1) == s != genetics.stream_seed("a", 1, taken=[s])


def test_branch_covariance(spark):
    """A balanced tree worked out by hand: two pairs of people, each joined below the root."""
    edges = spark.createDataFrame([(0, p, c) for p, c in [(8, 0), (8, 1), (9, 2), (9, 3), (10, 4), (10, 5), (11, 6), (11, 7), (12, 8), (12, 9), (13, 10), (13, 11), (14, 12), (14, 13)]], "tree_id int, parent int, child int")
    times = spark.createDataFrame([*[(i, 0.0) for i in range(8)], *[(i, 1.0) for i in range(8, 12)], (12, 6.0), (13, 6.0), (14, 10.0)], "node int, time double")
    owners = spark.createDataFrame([(p, n) for i, p in enumerate("abcd") for n in (2 * i, 2 * i + 1)], "person_id string, node int")
    trees = spark.createDataFrame([(0, 10.0)], "tree_id int, span double")
    m = genetics.branch_covariance(genetics.branch_features(edges, times, trees, owners), list("abcd"), centre=False, normalise=False)
    assert np.allclose(m, [[9.5, 4, 0, 0], [4, 9.5, 0, 0], [0, 0, 9.5, 4], [0, 0, 4, 9.5]])
    band = genetics.branch_covariance(genetics.branch_features(edges, times, trees, owners, band=(6.0, 10.0)), list("abcd"))
    assert np.allclose(band, np.kron([[1, -1], [-1, 1]], np.ones((2, 2))))


def test_text(spark):
    df = spark.createDataFrame([("  éAsthma asthma,  asthma attack\n",)], "t string")
    assert df.select(text.mask(F.col("t"), ["asthma", "Asthma Attack"])).first()[0] == "  éAsthma ,  \n"
    assert df.select(text.collapse(F.col("t"))).first()[0] == "éAsthma asthma, asthma attack"
    assert df.select(text.scrub(F.lit("id p1 (p11) x;"), F.array(F.lit("p1"), F.lit("")))).first()[0] == "id (p11) x"
    assert df.select(text.format_size(F.lit(1536.0))).first()[0] == "1.5 KB"
    assert df.select(text.clean_response(F.lit("<think>a\nb</think> yes <|end_of_text|>"))).first()[0] == "yes"
    u = [r[0] for r in spark.range(2000).select(rng.uniform("s", F.col("id"))).collect()]
    n = [r[0] for r in spark.range(2000).select(rng.normal("s", F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03 and abs(np.std(n) - 1) < 0.06


def test_vignettes(spark):
    docs = vignettes.documents(vignettes.visits(vignettes.patients(spark, 12)))
    assert docs.groupBy("patient_id").count().where("count <> 6").count() == 0 and docs.groupBy("patient_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    leak = docs.where("explicitness = 'implicit'").where(F.size(text.mentions(F.col("text"), vignettes.all_aliases())) > 0)
    assert leak.count() == 0
    with pytest.raises(ValueError):
        vignettes.patients(spark, 13)
    cases = vignettes.stress_cases(spark, {"f": ["x", "y"]}, 2)
    assert cases.where("variant = 'clue_deleted'").select("text").distinct().count() == 1 and cases.count() == 2 * 3 * 3


def test_notes(spark):
    facts = spark.createDataFrame([("p", f"20{i:02d}", i, f"c{i}", None) for i in range(9)] + [("p", None, 99, "undated", "active")], "patient_id string, date string, pos int, display string, status string")
    kept = notes.recent(facts, 3)
    assert [r["display"] for r in kept.orderBy("rank").collect()] == ["undated", "c8", "c7"]
    assert notes.section_text(kept, "H", "thing", 3).first()["text"] == "## H\n- Unknown date: undated [active]\n- 2008: c8\n- 2007: c7\n  ... and 7 more things"
    assert [r["display"] for r in notes.recent(facts, 1, "0").collect()] == ["c8"]
    note = spark.createDataFrame([(1, "## S - x\na\nPLANNING b\n**Plan:**\nc"), (2, "free"), (3, None)], "note_id long, text string")
    assert rows(notes.sections(note)) == [(1, "PLAN", "c"), (2, "ASSESSMENT", "free")] or rows(notes.sections(note))[0][1] == "PLAN"


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for t in ("patients", *TABLE_ORDER):
            z.writestr(f"csv/{t}.csv", 'Id,NOTE\n1,"two\nlines, quoted"\n')
    made = files.read_archive(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"))
    assert len(made) == 12 and made["supplies"].first()["NOTE"] == "two\nlines, quoted"
    assert set(files.read_present(spark, str(tmp_path / "out/csv"), ["patients", "nothing"])) == {"patients"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.tsv").write_text('a\tb\tc\n1\t"q\t2020-01-01\n2\tz\t2020-02-01\textra\n3\n')
    (tmp_path / "d/y.csv").write_text("a,b\n1.5,x\n")
    assert files.delimiter(spark, str(tmp_path / "d/x.tsv")) == "\t"
    assert files.csv_to_parquet(spark, str(tmp_path / "d"), str(tmp_path / "p")) == {"x.tsv": 3, "y.csv": 1}
    assert files.csv_to_parquet(spark, str(tmp_path / "d"), str(tmp_path / "p"))["x.tsv"] == "skipped"
    assert [t for _, t in spark.read.parquet(str(tmp_path / "p/x.parquet")).dtypes] == ["bigint", "string", "date"]
    assert set(files.read_wide(spark, str(tmp_path / "d"), "x")) == {"x"}
    with pytest.raises(FileNotFoundError):
        files.read_wide(spark, str(tmp_path / "d"), "zzz")
    (tmp_path / "g").mkdir()
    for n in "ab":
        (tmp_path / f"g/{n}.txt").write_text("".join(f"{n}{i}\t1\t2\t3\t4\t5\t6\t7\n" for i in range(4)))
    assert files.read_gp(spark, str(tmp_path / "g"), 3).count() == 6 and files.read_gp(spark, str(tmp_path / "g")).columns == list(files.GP_COLUMNS)
    (tmp_path / "v.pvar").write_text("##x\n#CHROM\tPOS\tID\n1\t5\trs\n")
    assert rows(files.read_pvar(spark, str(tmp_path / "v.pvar"))) == [("1", 5, "rs")]
    with pytest.raises(ValueError):
        files.read_psam(spark, str(tmp_path / "v.pvar"))
    u = "0a1b2c3d-0000-4000-8000-00000000000f"
    for m in ("fhir", "notes"):
        (tmp_path / m).mkdir()
        (tmp_path / m / f"Ann12_Lee3_{u.upper()}.json").write_text(json.dumps(BUNDLE))
    (tmp_path / "fhir/bad.json").write_text("{")
    assert files.read_bundles(spark, str(tmp_path / "fhir")).count() == 1
    index = files.file_index(spark, {m: str(tmp_path / m) for m in ("fhir", "notes")})
    r = index.first()
    assert (r["id"], r["name"], r["modalities"], len(r["notes_paths"])) == (u, "Ann Lee", ["fhir", "notes"], 1) and files.files_of(index, u, "fhir").count() == 1
    umls = [["1", "ENG", "", "", "", "", "N", "", "", "", "", "SNOMEDCT_US", "PT", "77", "first", ""], ["1", "ENG", "", "", "", "", "Y", "", "", "", "", "SNOMEDCT_US", "PT", "77", "best", ""], ["1", "FRE", "", "", "", "", "Y", "", "", "", "", "SNOMEDCT_US", "PT", "77", "autre", ""]]
    (tmp_path / "M.RRF").write_text("".join("|".join(x) + "|\n" for x in umls))
    assert rows(files.vocabulary_umls(spark, str(tmp_path / "M.RRF"))) == [("77", "best", ["first"])]
    (tmp_path / "C.csv").write_text("concept_name\tconcept_code\tvocabulary_id\tstandard_concept\tinvalid_reason\tdomain_id\tconcept_class_id\nA\t1\tSNOMED\tS\t\tCondition\tDisorder\nB\t2\tSNOMED\tS\tD\tCondition\tDisorder\nC\t3\tX\tS\t\tCondition\tDisorder\n")
    assert rows(files.vocabulary_omop(spark, str(tmp_path / "C.csv"), domains=["Condition"])) == [("1", "A", "Disorder")]
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(ValueError):
            files.strict_json(bad)
    with pytest.raises(ValueError):
        files.closed({"a": 1}, ["b"])
    names = spark.createDataFrame([("x.CSV",), ("x.csv.gz",), ("xcsv",)], "name string")
    assert rows(files.by_extension(names, [".csv", "csv.gz"])) == [("x.CSV",), ("x.csv.gz",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None, None), (1, "x", "f")], "b int, a string, family_id string")
    out = str(tmp_path / "bundle")
    sums = sinks.write_bundle({"documents": df}, out, {"n": 2}, {"documents": ["b"]})
    lines = [r[0] for r in spark.read.text(f"{out}/documents").collect()]
    assert sorted(lines) == ['{"a":"x","b":1,"family_id":"f"}', '{"a":null,"b":2}'] and "metadata.json" in sums
    with pytest.raises(FileExistsError):
        sinks.write_bundle({"documents": df}, out, {})
    made = sinks.write_association_bundle({"g": df}, str(tmp_path / "assoc"), {"seed": 1})
    assert made["arrays"]["g"] and all(len(v["sha256"]) == 64 for v in made["files"].values())
    with pytest.raises(ValueError):
        sinks.write_association_bundle({"g": df}, str(tmp_path / "big"), {}, most_bytes=1)
    assert not (tmp_path / "big").exists()
    recipes = [(1, {"a": 1}), (2, ValueError("bad")), (3, {"a": 0})]
    assert sinks.run_batch(recipes, lambda r: 1 / r["a"], str(tmp_path / "journal")) == 2
    assert sinks.run_batch(recipes, lambda r: 1 / r["a"], str(tmp_path / "shared"), spark) == 2
    assert (tmp_path / "shared").read_text() == (tmp_path / "journal").read_text()
    assert json.loads((tmp_path / "journal").read_text().splitlines()[-1]) == {"done": 1, "failed": 2}
    g = genetics.random_genotypes(spark, 5, 3)
    v = spark.createDataFrame([("1", 5, "V0", "A", "C"), ("1", 6, "V1", "A", "C"), ("1", 7, "V2", "A", "C")], "chrom string, pos int, variant_id string, ref string, alt string")
    sinks.write_plink(g, v, g.select("person_id", F.lit(1).alias("sex")).distinct(), str(tmp_path / "plink"))
    back = spark.read.option("header", True).csv(str(tmp_path / "plink/genotypes"))
    assert back.columns == ["IID", "V0", "V1", "V2"] and back.count() == 5
    sinks.write_tables({"t": df}, str(tmp_path / "tables"), "csv")
    with pytest.raises(ValueError):
        sinks.write_tables({"t": df}, str(tmp_path / "tables"), "xml")


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    data = [("a", ts("2020-01-01T01:00:00"), "x", 1), ("a", ts("2020-01-01T02:00:00"), "y", 2), ("a", ts("2020-01-01T01:00:00"), "x", 1), ("a", ts("2020-03-05T00:00:00"), "z", 3), ("b", ts("2021-01-01T00:00:00"), "q", 4)]
    schema = "subject_id string, time timestamp, code string, event_id long"
    spark.createDataFrame(data, schema.replace("timestamp", "timestamp_ntz")).withColumn("time", F.col("time").cast("timestamp")).write.parquet(str(src))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.table(name)

    stream = lambda: streams.read_shards(spark, str(src), schema)
    assert run(streams.deduplicated(stream(), ["event_id"]), "once").count() == 4
    days = run(streams.day_bundles(streams.deduplicated(stream(), ["event_id"]), None), "days")
    assert rows(days.where("subject_id = 'a'").select("day", "n_events")) == [(date(2020, 1, 1), 2), (date(2020, 3, 5), 1)]
    assert run(streams.episodes(stream()), "episodes").where("subject_id = 'a'").count() == 2
    from medlattice.operators import orphans

    def split(batch):
        refs = batch.select(F.lit("t").alias("table_name"), F.lit("f").alias("field_name"), F.lit("p").alias("parent"), F.col("event_id").alias("row_id"), F.lit(None).cast("binary").alias("key"), F.col("time").cast("timestamp_ntz").alias("loaded_at"))
        return refs, spark.createDataFrame([], "parent string, key binary, start timestamp_ntz, stop timestamp_ntz")

    taker = streams.OrphanStream(split)
    q = stream().writeStream.foreachBatch(taker.take).option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and taker.state.orphans.count() == 5
    assert orphans.snapshot(taker.state).agg(F.sum("n_open")).first()[0] == 5


def test_recipe(spark, tmp_path):
    g = spark.createDataFrame([(p, "V1", h, a) for p, (x, y) in {"a": (0, 1), "b": (1, 1), "c": (0, 0)}.items() for h, a in ((0, x), (1, y))], genetics.GENOTYPE)
    g.write.parquet(str(tmp_path / "g"))
    spark.createDataFrame([("V1", 10)], "variant_id string, position int").write.parquet(str(tmp_path / "s"))
    recipe = {"genotypes": str(tmp_path / "g"), "sites": str(tmp_path / "s"), "traits": ["t"], "seed": 3, "effects": {"dominance": [["V1", 1, "t", 1.0]]}, "effect_rules": [["t", 2, 0.5]], "residual_covariance": [[0.0]], "observed_probability": 1.0}
    manifest = genetics.run_recipe(spark, recipe, str(tmp_path / "out"))
    assert set(manifest["arrays"]) == {"phenotypes", "genotypes"}
    made = spark.read.parquet(str(tmp_path / "out/phenotypes"))
    assert rows(made.select("person_id", "complete", "observed_value")) == [("a", 1.5, 1.5), ("b", 1.0, 1.0), ("c", 0.0, 0.0)]
    for bad in ({"x": 1}, {"effects": {"magic": []}}, {"effect_rules": [["t", 9, 0.5]]}):
        with pytest.raises(ValueError):
            genetics.run_recipe(spark, recipe | bad, str(tmp_path / "bad"))


def test_grounding_checks(spark):
    edges = spark.createDataFrame([("d", 1, ["A", "b"], "C [SNOMED:7]", "=>"), ("d", 2, ["B", "a"], "x[SNOMED:7]", "=>"), ("d", 3, ["A"], "unknown", "=>")], "document_id string, edge_no int, sources array<string>, target string, relation string")
    labels = spark.createDataFrame([("d", "a", 1), ("d", "B", 2), ("e", "unknown", 9)], "document_id string, label string, concept_id long")
    assert rows(linking.grounded_relations(edges, labels)) == [("d", [1, 2], 7, "=>", 1)]
    panel = spark.createDataFrame([("a", "1"), ("b", "2")], "concept_id string, code string")
    linking.check_concept_sets(panel, panel)
    with pytest.raises(ValueError):
        linking.check_concept_sets(panel.where("code = '1'"), panel)
    with pytest.raises(ValueError):
        linking.check_families(spark.createDataFrame([("f", "a"), ("f", "zz")], "family_id string, concept_id string"), panel)
    with pytest.raises(ValueError):
        linking.check_families(spark.createDataFrame([("f", "a")], "family_id string, concept_id string"), panel)
    linking.check_families(spark.createDataFrame([("f", "a"), ("f", "b")], "family_id string, concept_id string"), panel)


def test_command_line(spark, tmp_path, monkeypatch):
    from medlattice import cli

    heads = {t: "PATIENT,ENCOUNTER,START,DESCRIPTION,CODE,REASONCODE,REASONDESCRIPTION,VALUE,UNITS,MODALITY_DESCRIPTION,BODYSITE_DESCRIPTION" for t in TABLE_ORDER}
    heads |= {"patients": "Id,BIRTHDATE,DEATHDATE", "encounters": "Id,PATIENT,START,DESCRIPTION,REASONCODE,REASONDESCRIPTION"}
    body = {"patients": "p,1990-01-01,\n", "encounters": "e,p,2019-01-01T00:00:00Z,visit for asthma,,\n", "conditions": "p,e,2019-01-01,Asthma,C1,,,,,,\n"}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for t, h in heads.items():
            z.writestr(f"csv/{t}.csv", h + "\n" + body.get(t, ""))
    (tmp_path / "b.csv").write_text("concept_id,code\nasthma,C1\n")
    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    args = [str(tmp_path / "a.zip"), str(tmp_path / "out"), "--work", str(tmp_path / "w"), "--bridge", str(tmp_path / "b.csv"), "--cutoff", "2020-01-01", "--alias", "asthma"]
    with pytest.raises(SystemExit):
        cli.main([*args, "--sha256", "00"])
    assert cli.main(args) == 0
    docs = spark.read.json(str(tmp_path / "out/documents"))
    assert docs.where("explicitness = 'implicit'").where(F.lower("text").contains("asthma")).count() == 0 and docs.where("explicitness = 'explicit'").count() == 3
    assert (tmp_path / "out/SHA256SUMS.json").exists()
    with pytest.raises(FileExistsError):
        cli.main(args)
