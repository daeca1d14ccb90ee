"""Text of clinical notes: recent facts, sections, entity lines and token tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quote

#: Most facts of a section, and how undated facts sort ("9999": first, "0": last).
SECTION_CAPS = {"conditions": 50, "medications": 30, "encounters": 20, "vital signs": 20, "laboratory": 30, "procedures": 20}
UNDATED_LAST = ("vital signs", "laboratory")
#: Headings and what they are called otherwise.
SECTION_ALIASES = {
    "PATIENT STORY": ("PATIENT STORY", "PATIENT NARRATIVE", "HISTORY", "PATIENT HISTORY"),
    "SUBJECTIVE": ("SUBJECTIVE", "S:", "S.", "CHIEF COMPLAINT", "HPI"),
    "OBJECTIVE": ("OBJECTIVE", "O:", "O.", "PHYSICAL EXAM", "EXAMINATION", "FINDINGS"),
    "ASSESSMENT": ("ASSESSMENT", "A:", "A.", "DIAGNOSIS", "DIAGNOSES", "IMPRESSION"),
    "PLAN": ("PLAN", "P:", "P.", "TREATMENT", "RECOMMENDATIONS", "MANAGEMENT"),
    "FUTURE CONSIDERATIONS": ("FUTURE CONSIDERATIONS", "FUTURE", "PROGNOSIS", "FOLLOW-UP", "FOLLOWUP"),
    "SUMMARY": ("SUMMARY", "CONCLUSION", "BRIEF SUMMARY"),
    "CAUSAL_GRAPH": ("CAUSAL GRAPH", "CAUSAL_GRAPH", "CAUSAL RELATIONSHIPS"),
}


def recent(facts: DataFrame, cap: int, undated: str = "9999", key: str = "patient_id") -> DataFrame:
    """The ``cap`` latest facts of each patient with their rank, and how many there are in all.

    ``facts``: (key, date string, pos, ...).  An undated fact sorts as the text ``undated``; ties keep their order.
    The rank filter becomes a group limit before the shuffle, so a patient with very many facts sends ``cap`` a task.
    """
    w = Window.partitionBy(key).orderBy(F.coalesce("date", F.lit(undated)).desc(), "pos")
    n = facts.groupBy(key).agg(F.count("*").alias("n_all"))
    return facts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).join(n, key)


def section_text(kept: DataFrame, heading: str, noun: str, cap: int, key: str = "patient_id") -> DataFrame:
    """(key, text): the section as dated lines under its heading, and a line about those left out."""
    day = F.coalesce(F.substring("date", 1, 10), F.lit("Unknown date"))
    status = F.when(F.length(F.coalesce("status", F.lit(""))) > 0, F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise("")
    line = F.concat(F.lit("- "), day, F.lit(": "), F.coalesce("display", F.lit("Unknown " + noun)), status)
    made = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("x"), F.max("n_all").alias("n"))
    rest = F.when(F.col("n") > cap, F.concat(F.lit("\n  ... and "), (F.col("n") - cap).cast("string"), F.lit(f" more {noun}s"))).otherwise("")
    return made.select(key, F.concat(F.lit(f"## {heading}\n"), F.array_join(F.transform("x", lambda v: v["l"]), "\n"), rest).alias("text"))


#: Headings of a patient's document, most lines below each, and what its facts are called.
DOCUMENT_SECTIONS = (
    ("conditions", "CONDITIONS / DIAGNOSES", 50, "condition"),
    ("medications", "MEDICATIONS", 30, "medication"),
    ("encounters", "ENCOUNTERS / VISITS", 20, "encounter"),
    ("vital-signs", "Vital Signs (Recent)", 20, None),
    ("laboratory", "Laboratory Results (Recent)", 30, None),
    ("procedures", "PROCEDURES", 20, "procedure"),
)
DOCUMENT_END = "\n\n[... truncated for length ...]"


def _with(before: str, value: str, after: str) -> Column:
    """The value between two texts, or nothing where it is missing or empty."""
    return F.when(F.length(F.coalesce(value, F.lit(""))) > 0, F.concat(F.lit(before), value, F.lit(after))).otherwise("")


def _document_line() -> Column:
    """A fact as it stands in its section; ``detail`` is the class of an encounter or the unit of a value."""
    day = F.substring("date", 1, 10)
    dated = F.coalesce(day, F.lit("Unknown date"))
    said = F.when(F.length(F.coalesce("value", F.lit(""))) > 0, F.concat(F.lit(": "), F.trim(F.concat_ws(" ", "value", "detail")))).otherwise("")
    name = lambda other: F.coalesce("display", F.lit(other))
    return F.concat(
        F.lit("- "),
        F.when(F.col("section") == "conditions", F.concat(dated, F.lit(": "), name("Unknown condition"), _with(" [", "status", "]")))
        .when(F.col("section") == "medications", F.concat(name("Unknown medication"), _with(" (", "day", ")"), _with(" [", "status", "]")))
        .when(F.col("section") == "encounters", F.concat(dated, F.lit(": "), name("Unknown"), _with(" (", "detail", ")"), _with(" - ", "value", "")))
        .when(F.col("section") == "procedures", F.concat(name("Unknown procedure"), _with(" (", "day", ")")))
        .otherwise(F.concat(F.coalesce(day, F.lit("")), F.lit(": "), name("Unknown"), said)),
    )


def patient_documents(people: DataFrame, facts: DataFrame, genetics: DataFrame | None = None, most_tokens: int = 50_000, key: str = "patient_id") -> DataFrame:
    """(key, text): demographics and the latest facts of each section as one text per patient, cut at ``most_tokens``.

    ``people``: (key, name, gender, birth_date, address); ``facts``: (key, section, date, pos, display, status, detail,
    value), all text but ``pos``, ``section`` as in DOCUMENT_SECTIONS or any other for observations of no category;
    ``genetics``: (key, text).  Of an encounter ``detail`` is the class and ``value`` the reason.  A section without facts
    is left out, a missing or empty field too; undated facts stand first, undated values last.  Each patient sends at
    most a section's lines a task.
    """
    order = F.when(F.col("section").isin("vital-signs", "laboratory"), F.coalesce("date", F.lit("0"))).otherwise(F.coalesce("date", F.lit("9999")))
    rank = F.row_number().over(Window.partitionBy(key, "section").orderBy(order.desc(), "pos"))
    most = F.lit(0)
    for section, _, cap, _ in DOCUMENT_SECTIONS:
        most = F.when(F.col("section") == section, cap).otherwise(most)
    kept = facts.withColumn("rank", rank).where(F.col("rank") <= max(c for _, _, c, _ in DOCUMENT_SECTIONS)).where(F.col("rank") <= most)
    line = F.struct("rank", _document_line().alias("l"))
    lines = kept.withColumn("day", F.substring("date", 1, 10)).groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("lines"))
    counts = facts.withColumn("section", F.when(F.col("section").isin([d[0] for d in DOCUMENT_SECTIONS]), F.col("section")).otherwise("other")).groupBy(key, "section").agg(F.count("*").alias("n"))
    held = counts.join(lines, [key, "section"], "left").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("section", F.struct("n", "lines").alias("v")))).alias("held"))
    of = lambda section: F.try_element_at("held", F.lit(section))

    def titled(section: str, heading: str, cap: int, noun: str) -> Column:
        rest = F.when(of(section)["n"] > cap, F.concat(F.lit("\n  ... and "), (of(section)["n"] - cap).cast("string"), F.lit(f" more {noun}s"))).otherwise("")
        return F.when(of(section).isNotNull(), F.concat(F.lit(f"## {heading}\n"), of(section)["lines"], rest))

    described = {d[0]: d[1:] for d in DOCUMENT_SECTIONS}
    values = F.when(
        F.coalesce(of("vital-signs"), of("laboratory"), of("other")).isNotNull(),
        F.concat(F.lit("## OBSERVATIONS (Labs, Vitals)"), *[F.coalesce(F.concat(F.lit(f"\n\n### {described[s][0]}\n"), of(s)["lines"]), F.lit("")) for s in ("vital-signs", "laboratory")]),
    )
    person = F.concat(F.lit("## PATIENT DEMOGRAPHICS"), _with("\nName: ", "name", ""), _with("\nGender: ", "gender", ""), _with("\nDate of Birth: ", "birth_date", ""), _with("\nAddress: ", "address", ""))
    whole = people.join(held, key, "left")
    whole = whole.join(genetics.select(key, F.col("text").alias("_genes")), key, "left") if genetics is not None else whole.withColumn("_genes", F.lit(None).cast("string"))
    parts = [person, titled("conditions", *described["conditions"]), titled("medications", *described["medications"]), titled("encounters", *described["encounters"]), values, titled("procedures", *described["procedures"]), F.col("_genes")]
    return whole.select(key, truncated(F.concat_ws("\n\n", *parts), most_tokens, DOCUMENT_END).alias("text"))


def period_texts(events: DataFrame, years: int = 5, key: str = "patient_id") -> DataFrame:
    """(key, from_year, to_year, n_events, text): what happened in every period of ``years`` from a patient's first year.

    ``events``: (key, kind, date, pos, display).  The first ten conditions and medications and five procedures of a
    period are named, encounters and observations are counted; a period without events is left out.
    """
    year = F.year("date")
    spans = events.groupBy(key).agg(F.min(year).alias("low"), F.max(year).alias("high"))
    placed = events.join(spans, key).withColumn("chunk", F.floor((year - F.col("low")) / years).cast("int"))
    by = [key, "chunk", "kind"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("date", "pos"))
    named = placed.withColumn("rank", rank).where(F.col("rank") <= 10).where((F.col("rank") <= 5) | (F.col("kind") != "procedure"))
    line = F.struct("rank", F.concat(F.lit("  - "), F.coalesce("display", F.lit("Unknown"))).alias("l"))
    lines = named.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("lines"))
    first = F.col("low") + F.col("chunk") * years
    counts = placed.groupBy(*by).agg(F.count("*").alias("n"), F.min(first).alias("from_year"), F.min(F.least(first + years - 1, F.col("high"))).alias("to_year"))
    made = counts.join(lines, by).groupBy(key, "chunk").agg(
        F.min("from_year").alias("from_year"), F.min("to_year").alias("to_year"), F.sum("n").alias("n_events"),
        F.map_from_entries(F.collect_list(F.struct("kind", F.struct("n", "lines").alias("v")))).alias("held"),
    )
    of = lambda kind: F.try_element_at("held", F.lit(kind))
    listed = lambda kind, heading: F.coalesce(F.concat(F.lit(f"\n{heading}:\n"), of(kind)["lines"]), F.lit(None))
    counted = lambda kind, heading, after: F.concat(F.lit(f"\n{heading}: "), of(kind)["n"].cast("string"), F.lit(after))
    parts = [
        F.concat(F.lit("## PERIOD: "), F.col("from_year").cast("string"), F.lit(" - "), F.col("to_year").cast("string")),
        listed("condition", "Conditions diagnosed"), listed("medication", "Medications prescribed"), counted("encounter", "Encounters", " visits"), listed("procedure", "Procedures"), counted("observation", "Observations recorded", ""),
    ]
    return made.select(key, "from_year", "to_year", "n_events", F.concat_ws("\n", *parts).alias("text"))


def genetic_text(findings: DataFrame, key: str = "patient_id") -> DataFrame:
    """(key, text): a patient's variants by significance, the most important first, ten each.

    ``findings``: (key, rsid, gene, chromosome, significance, priority, rank), ``rank`` counting within patient and
    significance and ``n`` its variants in all.  Benign variants are named only where there are no others.
    """
    gene = F.when(F.col("gene") != "Unlisted", F.concat(F.lit(" ("), "gene", F.lit(")"))).otherwise("")
    line = F.struct("rank", F.concat(F.lit("- "), "rsid", gene, F.lit(" - Chr"), F.coalesce("chromosome", F.lit("?"))).alias("l"))
    kinds = findings.groupBy(key, "significance", "priority").agg(
        F.min("rank").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("lines")
    )
    benign = F.contains(F.lower("significance"), F.lit("benign"))
    each = F.struct("priority", "significance", benign.alias("benign"), F.concat(F.lit("\n### "), "significance", F.lit(" Variants\n"), "lines").alias("l"))
    made = kinds.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("k"))
    shown = F.when(F.size("k") > 1, F.filter("k", lambda x: ~x["benign"])).otherwise(F.col("k"))
    return made.select(key, F.array_join(F.concat(F.array(F.lit("## GENETIC / GENOMIC FINDINGS")), F.transform(shown, lambda x: x["l"])), "\n").alias("text"))


def truncated(text: Column, most_tokens: int = 50_000, suffix: str = "\n... [truncated]") -> Column:
    return F.when(F.length(text) > most_tokens * 4, F.concat(F.substring(text, 1, most_tokens * 4), F.lit(suffix))).otherwise(text)


def _heading(line: Column) -> Column:
    """The section a line opens, or NULL."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(F.trim(line)), r"^[#*\- \t]+", ""), r"[:* \t]+$", "")
    named = [(alias, section) for section, aliases in SECTION_ALIASES.items() for alias in aliases]
    pattern = "^(" + "|".join(quote(alias) for alias, _ in named) + r")(?![\p{L}\p{N}])"
    of = F.create_map(*[F.lit(x) for pair in named for x in pair])
    return F.try_element_at(of, F.regexp_extract(bare, pattern, 1))


def sections(notes: DataFrame, note_id: str = "note_id", text: str = "text") -> DataFrame:
    """(note_id, section, content): lines under each heading; what stands on the heading's line is dropped.

    A section named twice keeps its last content.  A text without any section is all assessment.  Lines are folded in
    their row, so a long note is never split over a shuffle.
    """
    lines = F.transform(F.split(F.col(text), "\n"), lambda l: F.struct(l.alias("l"), F.when(F.trim(l).isin("", "---", "***", "___"), None).otherwise(_heading(l)).alias("h")))
    start = F.struct(F.lit(None).cast("string").alias("at"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("m"))

    def put(m: Column, key: Column, value: Column) -> Column:
        return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))

    def step(s: Column, x: Column) -> Column:
        return (
            F.when(x["h"].isNotNull(), F.struct(x["h"].alias("at"), put(s["m"], x["h"], F.lit("")).alias("m")))
            .when(s["at"].isNotNull(), F.struct(s["at"].alias("at"), put(s["m"], s["at"], F.concat(F.try_element_at(s["m"], s["at"]), F.lit("\n"), x["l"])).alias("m")))
            .otherwise(s)
        )

    found = F.map_filter(F.transform_values(F.aggregate(lines, start, step, lambda s: s["m"]), lambda _, v: F.btrim(v, F.lit(" \t\r\n"))), lambda _, v: v != "")
    whole = F.create_map(F.lit("ASSESSMENT"), F.btrim(F.col(text), F.lit(" \t\r\n")))
    made = notes.select(F.col(note_id).alias("note_id"), F.when(F.size(found) == 0, whole).otherwise(found).alias("m"))
    return made.where("m is not null").select("note_id", F.explode("m").alias("section", "content"))


#: Words by which a line is talk about the task and no entity.
TALK = ("i ", "the user", "want", "need", "identify", "extract", "should", "will", "let me", "here are", "following", "entities", "soap note", "output", "no medical", "no entities")


def entity_lines(answer: Column) -> Column:
    """The entities an answer lists a line each: bullets, fences, JSON shells and talk removed."""
    bare = F.filter(F.transform(F.split(answer, "\n"), lambda l: F.trim(l)), lambda l: (l != "") & ~F.startswith(l, F.lit("#")) & ~F.startswith(l, F.lit("```")) & ~l.isin("[", "]", "{", "}"))
    shell = lambda l: F.startswith(l, F.lit("{")) & F.endswith(l, F.lit("}"))
    named = F.transform(bare, lambda l: F.when(shell(l), F.regexp_extract(l, r'"entity"\s*:\s*"([^"]+)"', 1)).otherwise(l))
    clean = F.transform(named, lambda l: F.trim(F.regexp_replace(l, r"^[-•*0-9.) ]+", "")))
    talk = lambda l: F.exists(F.array(*[F.lit(t) for t in TALK]), lambda t: F.contains(F.lower(l), t))
    said = F.transform(F.filter(clean, lambda l: (l != "") & ~talk(l)), lambda l: F.trim(F.substring_index(l, "|", 1)))
    return F.filter(said, lambda l: (F.length(l) > 2) & (F.length(l) < 100) & l.rlike(r"(?U)\p{L}"))


def token_table(stats: DataFrame) -> DataFrame:
    """(note_id, type, id, input_tokens, output_tokens, seconds): rows by chunk and step, and their totals per note.

    ``stats`` has those columns without totals.
    """
    total = stats.groupBy("note_id", F.concat(F.lit("total_"), F.col("type"), F.lit("s")).alias("type")).agg(
        F.lit(None).cast("string").alias("id"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("seconds").alias("seconds")
    )
    return stats.unionByName(total.select(*stats.columns))


def hierarchical(chunking: Column, forced: Column, tokens: Column, most: int, chunks: Column) -> Column:
    """Whether a note is made by chunks: if chunking is on and forced, too long, or of more than two chunks."""
    return chunking & (forced | (tokens > most) | (chunks > 2))


def through_model(prompts: DataFrame, answer, schema: str = "prompt_id string, response string") -> DataFrame:
    """The seam to a model: ``answer`` maps an iterator of pandas frames (prompt_id, prompt) to (prompt_id, response)."""
    return prompts.select("prompt_id", "prompt").mapInPandas(answer, schema)


def catalogue_filter(catalogue: DataFrame, modality: str | None = None, access: str | None = None, tag: str | None = None) -> DataFrame:
    """Entries by part of their modality, by access and by tag, letter case aside."""
    kept = catalogue
    if modality is not None:
        kept = kept.where(F.contains(F.lower("modality"), F.lit(modality.lower())))
    if access is not None:
        kept = kept.where(F.lower("access") == access.lower())
    if tag is not None:
        kept = kept.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
    return kept


def caps_of(sections_: Mapping[str, int] = SECTION_CAPS) -> Sequence[tuple[str, int, str]]:
    return [(name, cap, "0" if name in UNDATED_LAST else "9999") for name, cap in sections_.items()]
