"""Controlled vignettes, longitudinal histories and stress cases, generated where they are needed.

Every choice is a function of its key (see functions.rng), so a corpus of any size is made in parallel and is the same
for any partitioning.
"""

from __future__ import annotations

from datetime import date
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.text import mask
from .splits import hash_split, stratified_split
from .windows import RESOLUTIONS, lookback_start

#: Days before the anchor, and those on which a visit is clinical.
OFFSETS = (0, 3, 7, 21, 60, 180, 300)
CLINICAL_OFFSETS = (0, 7, 180)
LONG_OFFSETS = (0, 3, 7, 21, 60, 180, 300, 500, 700, 900, 1050)
VARIANTS = ("sufficient", "clue_deleted", "no_information")

#: A panel of teaching conditions in our own words: name, concept, aliases, complaints, findings, treatments, and mimics,
#: which are what a control may show that looks alike and is not it.  Another panel of the same columns can be given.
PANEL = (
    ("Asthma", "C:101", ["asthma", "reactive airway disease"], ["wheeze at night", "cough after running"], ["prolonged expiration", "reversible obstruction"], ["inhaled steroid", "rescue inhaler"], ["cough from a cold, airflow normal"]),
    ("Diabetes", "C:102", ["diabetes", "type 2 diabetes"], ["thirst all day", "frequent urination"], ["raised fasting glucose", "glycated haemoglobin above range"], ["metformin", "basal insulin"], ["thirst in hot weather, glucose normal"]),
    ("Migraine", "C:103", ["migraine", "migraine with aura"], ["one-sided throbbing headache", "zigzag lines before headache"], ["normal neurological examination", "light sensitivity"], ["a triptan", "propranolol"], ["pressing headache after screen work"]),
    ("Hypothyroidism", "C:104", ["hypothyroidism", "underactive thyroid"], ["feeling cold", "slow weight gain"], ["raised thyrotropin", "dry skin"], ["levothyroxine"], ["tired in winter, thyrotropin in range"]),
    ("Gout", "C:105", ["gout", "gouty arthritis"], ["sudden toe pain", "swollen big toe"], ["urate crystals", "red hot joint"], ["allopurinol", "colchicine"], ["bruised toe after a knock"]),
    ("Anaemia", "C:106", ["anaemia", "iron deficiency anaemia"], ["tired on stairs", "pale look"], ["low ferritin", "small red cells"], ["oral iron"], ["tired after night shifts, blood count normal"]),
    ("Psoriasis", "C:107", ["psoriasis", "plaque psoriasis"], ["scaly elbows", "itching scalp"], ["silvery plaques", "pitted nails"], ["calcipotriol", "light therapy"], ["dry elbows from washing"]),
    ("Glaucoma", "C:108", ["glaucoma", "open-angle glaucoma"], ["bumping into door frames", "dim side vision"], ["raised eye pressure", "cupped optic disc"], ["latanoprost drops"], ["strained eyes, pressure normal"]),
    ("Osteoporosis", "C:109", ["osteoporosis", "brittle bones"], ["lost height", "back pain after a light fall"], ["low bone density", "wedge fracture"], ["a bisphosphonate", "calcium"], ["back pain after lifting, density normal"]),
    ("Gallstones", "C:110", ["gallstones", "cholelithiasis"], ["pain under the right ribs after meals", "nausea in the evening"], ["stones on ultrasound", "tender upper abdomen"], ["planned gallbladder surgery"], ["heartburn after coffee, ultrasound clear"]),
    ("Sleep apnoea", "C:111", ["sleep apnoea", "obstructive sleep apnoea"], ["loud snoring", "drowsy at the wheel"], ["repeated pauses on sleep study", "crowded throat"], ["a breathing mask at night"], ["short nights with a newborn"]),
    ("Atrial fibrillation", "C:112", ["atrial fibrillation", "irregular heart rhythm"], ["fluttering in the chest", "short of breath on the stairs"], ["irregular pulse", "no P waves on the tracing"], ["apixaban", "bisoprolol"], ["skipped beats after coffee, tracing normal"]),
    ("Coeliac disease", "C:113", ["coeliac disease", "gluten enteropathy"], ["bloating after bread", "loose stools"], ["raised transglutaminase antibodies", "flat villi"], ["a gluten-free diet"], ["bloating after beans, antibodies negative"]),
    ("Carpal tunnel syndrome", "C:114", ["carpal tunnel syndrome", "median nerve compression"], ["numb fingers at night", "dropping cups"], ["slow median nerve conduction", "positive wrist flexion test"], ["a wrist splint"], ["stiff fingers after gardening"]),
    ("Kidney stones", "C:115", ["kidney stones", "renal colic"], ["waves of flank pain", "red urine"], ["stone on scan", "blood in urine"], ["tamsulosin", "plenty of fluids"], ["flank muscle strain, scan clear"]),
    ("Vertigo", "C:116", ["positional vertigo", "benign positional vertigo"], ["spinning when turning in bed", "unsteady on rising"], ["typical eye jerks on tilting", "normal hearing"], ["a repositioning manoeuvre"], ["light-headed before breakfast"]),
)
PANEL_COLUMNS = "condition string, concept_id string, aliases array<string>, complaints array<string>, findings array<string>, treatments array<string>, mimics array<string>"
COMMON_COMPLAINTS = ["no particular complaint", "a mild cold", "a routine question"]
COMMON_FINDINGS = ["no persistent abnormality", "a normal examination"]
COMMON_TREATMENTS = ["no new treatment", "advice only"]
BACKGROUND = ["Repeat prescription collected.", "Telephone call about an appointment.", "Vaccination record checked."]


def panel(spark: SparkSession, rows=PANEL) -> DataFrame:
    return spark.createDataFrame(list(rows), PANEL_COLUMNS)


def all_aliases(rows=PANEL) -> list[str]:
    return sorted({a for row in rows for a in [row[0], *row[2]]})


def _pick(options: Column, *key: Column | str | int) -> Column:
    return F.element_at(options, (F.floor(rng.uniform(*key) * F.size(options)) + 1).cast("int"))


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def patients(spark: SparkSession, per_condition: int, seed: int = 42, conditions=PANEL) -> DataFrame:
    """Cases and controls of every condition: (patient_id, condition, ..., positive, negative_type, split, age, anchor).

    Every second control is a ``mimic`` of its condition, the others are ``unrelated``.
    """
    if per_condition < 12 or per_condition % 2:
        raise ValueError("an even number of at least 12 patients per condition is needed")
    half = per_condition // 2
    rows = panel(spark, conditions).withColumn("arm", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(half - 1))))
    ident = F.concat(F.regexp_replace("concept_id", ":", ""), F.lit("-"), F.col("arm").cast("string"), F.lit("-"), F.lpad(F.col("i").cast("string"), 4, "0"))
    rows = rows.withColumn("patient_id", ident).withColumn("positive", F.col("arm") == 1)
    rows = rows.withColumn("negative_type", F.when(F.col("positive"), "case").when(F.col("i") % 2 == 0, "mimic").otherwise("unrelated"))
    split = stratified_split(rows.withColumn("stratum", F.concat_ws("/", "concept_id", "arm")), "stratum", "patient_id", seed)
    placed = rows.join(split.select("patient_id", "split"), "patient_id")
    age = F.floor(20 + 60 * rng.uniform(seed, "age", F.col("patient_id"))).cast("int")
    anchor = F.date_add(F.lit(date(2021, 1, 15)), F.floor(1000 * rng.uniform(seed, "anchor", F.col("patient_id"))).cast("int"))
    return placed.withColumn("age", age).withColumn("anchor", anchor)


def visits(people: DataFrame, offsets: tuple[int, ...] = OFFSETS, clinical: tuple[int, ...] = CLINICAL_OFFSETS, seed: int = 42) -> DataFrame:
    """Dated events of each patient: clinical visits tell of the condition (for controls of what mimics it, or of nothing), others are background."""
    rows = people.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    key = (F.col("patient_id"), F.col("offset"))
    of = lambda own, other, name: F.when(F.col("positive"), _pick(F.col(own), seed, name, *key)).otherwise(_pick(_texts(other), seed, name, *key))
    said = F.when(F.col("negative_type") == "mimic", _pick(F.col("mimics"), seed, "m", *key)).otherwise(of("complaints", COMMON_COMPLAINTS, "c"))
    told = F.concat(F.lit("Symptoms: "), said, F.lit("; Findings: "), of("findings", COMMON_FINDINGS, "f"), F.lit("; Treatment reviewed: "), of("treatments", COMMON_TREATMENTS, "t"), F.lit("."))
    visit = F.col("offset").isin(*clinical)
    return rows.select(
        "patient_id", "condition", "concept_id", "positive", "negative_type", "split", "age", "anchor", "offset",
        F.date_sub("anchor", F.col("offset")).alias("date"),
        F.when(visit, told).otherwise(_pick(_texts(BACKGROUND), seed, "b", *key)).alias("text"),
        F.when(visit & F.col("positive"), F.concat(F.lit("Recorded diagnosis: "), "condition", F.lit("."))).otherwise("").alias("diagnosis"),
        (visit & F.col("positive")).alias("event_positive"),
    )


def documents(events: DataFrame) -> DataFrame:
    """Six documents per patient: three look-back windows, explicit and with every alias of the panel removed."""
    rows = events.withColumn("resolution", F.explode(_texts(list(RESOLUTIONS))))
    rows = rows.withColumn("window_start", lookback_start(F.col("anchor"), F.col("resolution"))).where((F.col("date") > F.col("window_start")) & (F.col("date") <= F.col("anchor")))
    rows = rows.withColumn("explicitness", F.explode(_texts(["explicit", "implicit"])))
    said = F.when(F.col("explicitness") == "explicit", F.trim(F.concat("text", F.lit(" "), "diagnosis"))).otherwise(F.trim(mask(F.col("text"), all_aliases(), "the condition")))
    line = F.struct("date", F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(": "), said).alias("l"))
    made = rows.groupBy("patient_id", "condition", "concept_id", "positive", "negative_type", "split", "age", "anchor", "resolution", "window_start", "explicitness").agg(F.array_sort(F.collect_list(line)).alias("x"), F.bool_or("event_positive").alias("support"))
    head = F.concat(F.lit("Adult aged "), F.col("age").cast("string"), F.lit(". Clinical record through "), F.date_format("anchor", "yyyy-MM-dd"), F.lit("."))
    return made.select(
        F.concat_ws("-", "patient_id", "resolution", "explicitness").alias("document_id"), "patient_id", "condition", "concept_id", "positive",
        "negative_type", "split", "resolution", "explicitness", "window_start", F.col("anchor").alias("window_end"),
        F.size("x").alias("n_events"), F.concat(head, F.lit("\n"), F.array_join(F.transform("x", lambda v: v["l"]), "\n")).alias("text"), "support",
    )


def stress_cases(spark: SparkSession, families: dict[str, list[str]], repetitions: int = 3, seed: int = 42) -> DataFrame:
    """(family, repeat, combination, variant, patient_id, split, date, text, gold, abstain): paired clue deletions.

    A combination is one candidate or the first two.  Only ``sufficient`` holds the marked findings; with them deleted
    all candidates read alike, so the answer must be to abstain.
    """
    if repetitions < 1:
        raise ValueError("repetitions must be positive")
    combos = []
    for family, members in sorted(families.items()):
        for combo in [*[(m,) for m in members], *list(combinations(members[:2], 2))]:
            combos.append((family, list(combo)))
    rows = spark.createDataFrame(combos, "family string, combination array<string>")
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))).withColumn("variant", F.explode(_texts(list(VARIANTS))))
    patient = F.concat(F.lit("stress-"), F.substring(F.sha2(F.concat_ws("|", "family", F.col("repeat").cast("string"), F.array_join("combination", "+")), 256), 1, 18))
    rows = rows.withColumn("patient_id", patient).withColumn("split", hash_split(F.col("patient_id"), seed))
    clue = F.array_join(F.transform("combination", lambda c: F.concat(F.lit("Marked finding of "), c, F.lit(" is present."))), " ")
    context = F.lit("Reports ongoing symptoms; detailed characterization is unavailable.")
    text = F.when(F.col("variant") == "no_information", F.lit("")).when(F.col("variant") == "clue_deleted", context).otherwise(F.concat(context, F.lit(" "), clue))
    enough = F.col("variant") == "sufficient"
    return rows.select(
        "family", "repeat", F.array_join("combination", "+").alias("combination"), "variant", "patient_id", "split",
        F.date_add(F.lit(date(2018, 1, 10)), F.col("repeat") * 35).alias("date"), text.alias("text"),
        F.when(enough, F.array_join("combination", "+")).otherwise("").alias("gold"), (~enough).alias("abstain"),
    )
