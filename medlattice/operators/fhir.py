"""Resource bundles as variants, and the fact tables read off them without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dimension


def parse(body: Column) -> Column:
    """The body as a variant; NULL where it is damaged.  A byte-order mark and one string wrapping are undone."""
    bare = F.regexp_replace(body, "^[\\uFEFF\\s]+|\\s+$", "")
    whole = F.try_parse_json(bare)
    inner = F.try_variant_get(whole, "$", "string")
    return F.when(F.schema_of_variant(whole) == "STRING", F.try_parse_json(inner)).otherwise(whole)


def text(v: Column, *paths: str) -> Column:
    """The first of the paths that holds something, as text; empty text counts as nothing."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])


def one(v: Column, path: str, rest: str = "") -> tuple[str, str]:
    """A path into a field that is a list or a single object."""
    return f"$.{path}[0]{rest}", f"$.{path}{rest}"


def many(v: Column, path: str) -> Column:
    """The members of a field that is a list or a single object."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(F.try_variant_get(v, path, "variant").isNotNull(), F.array(F.try_variant_get(v, path, "variant"))))


def resources(records: DataFrame, record_id: str = "record_id", body: str = "body") -> DataFrame:
    """(record_id, pos, resource_type, resource, patient_id): every resource with its bundle's first patient."""
    parsed = records.select(F.col(record_id).alias("record_id"), parse(F.col(body)).alias("v")).where("v is not null and not is_variant_null(v)")
    kind = F.try_variant_get("v", "$.resourceType", "string")
    bundle = F.coalesce(kind == "Bundle", F.lit(False)) | F.try_variant_get("v", "$.entry", "variant").isNotNull()
    entries = F.coalesce(many(F.col("v"), "$.entry"), F.expr("cast(array() as array<variant>)"))
    inside = F.transform(entries, lambda e: F.try_variant_get(e, "$.resource", "variant"))
    listed = parsed.withColumn("all", F.when(bundle, inside).otherwise(F.array("v")))
    patient = F.filter("all", lambda r: F.coalesce(F.try_variant_get(r, "$.resourceType", "string") == "Patient", F.lit(False)))
    owned = listed.withColumn("patient_id", F.when(F.size(patient) > 0, F.try_variant_get(F.try_element_at(patient, F.lit(1)), "$.id", "string")))
    return (
        owned.select("record_id", "patient_id", F.posexplode("all").alias("pos", "resource"))
        .where("resource is not null and not is_variant_null(resource)")
        .withColumn("resource_type", F.try_variant_get("resource", "$.resourceType", "string"))
    )


def of_type(found: DataFrame, kind: str) -> DataFrame:
    return found.where(F.col("resource_type") == kind)


_CODE = ("$.code.coding[0]", "$.code.coding")
_KEY = ("record_id", "patient_id", "pos")


def _in(paths: tuple[str, ...], field: str) -> list[str]:
    return [f"{p}.{field}" for p in paths]


def demographics(found: DataFrame) -> DataFrame:
    """One row per Patient resource: the first name and address; a plain text name is a family name."""
    r = F.col("resource")
    given = F.coalesce(*[F.when(F.size(x) > 0, F.array_join(x, " ")) for p in ("$.name[0].given", "$.name.given") for x in [F.try_variant_get(r, p, "array<string>")]], text(r, "$.name[0].given", "$.name.given"))
    family = text(r, "$.name[0].family", "$.name.family")
    line = F.coalesce(*[F.when(F.size(x) > 0, F.array_join(x, ", ")) for p in ("$.address[0].line", "$.address.line") for x in [F.try_variant_get(r, p, "array<string>")]], text(r, "$.address[0].line", "$.address.line"))
    parts = [line, *[text(r, f"$.address[0].{k}", f"$.address.{k}") for k in ("city", "state", "postalCode", "country")]]
    telecom = F.coalesce(many(r, "$.telecom"), F.expr("cast(array() as array<variant>)"))
    phone = F.try_element_at(F.filter(telecom, lambda t: F.coalesce(F.try_variant_get(t, "$.system", "string") == "phone", F.lit(False))), F.lit(1))
    return of_type(found, "Patient").select(
        "record_id", "pos",
        text(r, "$.id").alias("id"),
        F.nullif(F.concat_ws(" ", given, family), F.lit("")).alias("name"),
        given.alias("given"), family.alias("family"),
        text(r, "$.gender").alias("gender"), text(r, "$.birthDate").alias("birth_date"),
        F.nullif(F.concat_ws(", ", *parts), F.lit("")).alias("address"),
        F.try_variant_get(phone, "$.value", "string").alias("phone"),
        text(r, "$.maritalStatus.text", "$.maritalStatus.coding[0].display").alias("marital_status"),
    )


def _coded(found: DataFrame, kind: str, at: tuple[str, ...], **fields: Column) -> DataFrame:
    r = F.col("resource")
    return of_type(found, kind).select(
        *_KEY, text(r, *_in(at, "code")).alias("code"), text(r, *_in(at, "display"), at[0].rsplit(".coding", 1)[0] + ".text").alias("display"), text(r, *_in(at, "system")).alias("system"),
        *[c.alias(n) for n, c in fields.items()],
    )


def conditions(found: DataFrame) -> DataFrame:
    r = F.col("resource")
    return _coded(found, "Condition", _CODE, onset_date=text(r, "$.onsetDateTime", "$.onsetPeriod.start"), clinical_status=text(r, "$.clinicalStatus.coding[0].code", "$.clinicalStatus.text", "$.clinicalStatus"))


def medications(found: DataFrame) -> DataFrame:
    r = F.col("resource")
    at = ("$.medicationCodeableConcept.coding[0]", "$.medicationCodeableConcept.coding")
    return _coded(found, "MedicationRequest", at, status=text(r, "$.status"), authored_on=text(r, "$.authoredOn"))


def encounters(found: DataFrame) -> DataFrame:
    r = F.col("resource")
    return of_type(found, "Encounter").select(
        *_KEY, text(r, "$.id").alias("id"), text(r, "$.type[0].coding[0].display", "$.type[0].text", "$.code.coding[0].display").alias("type"), text(r, "$.class.code", "$.class").alias("class"),
        text(r, "$.status").alias("status"), text(r, "$.period.start").alias("start"), text(r, "$.period.end").alias("end"), text(r, "$.reasonCode[0].coding[0].display").alias("reason"),
    )


def observations(found: DataFrame, category: str | None = None) -> DataFrame:
    """Values by kind: a quantity before a coded text before a string; numbers and texts in columns of their own."""
    r = F.col("resource")
    number = F.try_variant_get(r, "$.valueQuantity.value", "double")
    said = F.when(number.isNull(), text(r, "$.valueCodeableConcept.text", "$.valueCodeableConcept.coding[0].display", "$.valueString"))
    made = _coded(
        found, "Observation", _CODE, value_num=number, value_str=said, unit=text(r, "$.valueQuantity.unit"), date=text(r, "$.effectiveDateTime", "$.effectivePeriod.start"),
        category=text(r, "$.category[0].coding[0].code", "$.category[0].text"),
    )
    return made if category is None else made.where(F.lower("category") == category.lower())


def procedures(found: DataFrame) -> DataFrame:
    r = F.col("resource")
    return _coded(found, "Procedure", _CODE, status=text(r, "$.status"), performed_date=text(r, "$.performedDateTime", "$.performedPeriod.start"))


# Cohort predicates: a cohort is a frame of patients with an ``id``; each filter is a semi-join that keeps its columns.


def _has(value: Column, what: str, case: bool) -> Column:
    return F.contains(value, F.lit(what)) if case else F.contains(F.lower(value), F.lit(what.lower()))


def with_fact(people: DataFrame, facts: DataFrame, what: str, case_sensitive: bool = False) -> DataFrame:
    """Patients with a fact whose display holds the text or whose code is exactly it (conditions, medications)."""
    hits = facts.where(_has(F.col("display"), what, case_sensitive) | (F.col("code") == what)).select(F.col("patient_id").alias("id")).distinct()
    return people.join(hits, "id", "left_semi")


def with_gender(people: DataFrame, gender: str) -> DataFrame:
    return people.where(F.lower("gender") == gender.lower())


def with_modality(people: DataFrame, wanted: list[str], every: bool = True) -> DataFrame:
    """Patients with all or any of the modalities in their array column ``modalities``."""
    has = F.array(*[F.lit(w) for w in wanted])
    return people.where(F.size(F.array_except(has, "modalities")) == 0 if every else F.arrays_overlap("modalities", has))


def search(people: DataFrame, conditions_: DataFrame, medications_: DataFrame, what: str) -> DataFrame:
    """Patients whose name, a condition or a medication holds the text, in any letter case."""
    hits = people.where(_has(F.col("name"), what, False)).select("id")
    for facts in (conditions_, medications_):
        hits = hits.unionByName(facts.where(_has(F.col("display"), what, False)).select(F.col("patient_id").alias("id")))
    return people.join(hits.distinct(), "id", "left_semi")


def with_observation(people: DataFrame, facts: DataFrame, code: str | None = None, display: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Patients with such an observation; values that are no numbers pass the range, as they cannot fail it."""
    kept = facts
    if code is not None:
        kept = kept.where(F.col("code") == code)
    if display is not None:
        kept = kept.where(_has(F.col("display"), display, False))
    value = F.col("value_num")
    if low is not None:
        kept = kept.where(value.isNull() | (value >= low))
    if high is not None:
        kept = kept.where(value.isNull() | (value <= high))
    return people.join(kept.select(F.col("patient_id").alias("id")).distinct(), "id", "left_semi")


def by_prefix(people: DataFrame, prefix: str) -> DataFrame:
    """The first patient whose id is or begins with the prefix."""
    return people.where(F.col("id").startswith(prefix)).orderBy("id").limit(1)


def sample(people: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n patients in the order of a hash, the same for any partitioning."""
    return people.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(n)


def dataset_rows(people: DataFrame, conditions_: DataFrame, medications_: DataFrame) -> DataFrame:
    """Per patient: what there is of each modality and counts of facts, zeros kept."""
    n = lambda facts, name: facts.groupBy(F.col("patient_id").alias("id")).agg(F.count("*").alias(name))
    made = people.join(n(conditions_, "n_conditions"), "id", "left").join(n(medications_, "n_medications"), "id", "left")
    return made.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_conditions", "n_medications")})


def summary(people: DataFrame) -> DataFrame:
    """Patients in all, by modality, and with all modalities of the set."""
    names = ("fhir", "notes", "genomics")
    has = {m: F.array_contains("modalities", m) for m in names}
    whole = has["fhir"] & has["notes"] & has["genomics"]
    return people.agg(F.count("*").alias("n_patients"), *[F.count_if(c).alias(f"with_{m}") for m, c in has.items()], F.count_if(whole).alias("with_all"))


def merge_modalities(listings: dict[str, DataFrame]) -> DataFrame:
    """(id, modalities): the full outer merge of listings that each hold an ``id``, by one grouping."""
    parts = None
    for name, df in sorted(listings.items()):
        part = df.select("id", F.lit(name).alias("m")).where("id is not null")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("id").agg(F.array_sort(F.collect_set("m")).alias("modalities"))


def imaging_flags(people: DataFrame, facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, conditions): imaging conditions by words in a patient's diagnoses, ``normal`` where there is none.

    ``mapping`` (needle, flag) is a small table; the flags of a patient are a set.
    """
    hits = facts.join(dimension(mapping), F.contains(F.lower("display"), F.col("needle"))).groupBy(F.col("patient_id").alias("id")).agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    return people.select("id").distinct().join(hits, "id", "left").select("id", F.coalesce("flags", F.array(F.lit("normal"))).alias("flags"))
