"""Notes, vignettes and text functions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import notes, vignettes
from ..operators.clean import CLEAN_SQL
from .common import History, Registry, table

registry = Registry()
on = registry.on

_ALIASES = ["stenosis", "sclerosis", "pulmonary sclerosis"]


#: White space as the (?U) classes of the engine's patterns take it.
_BLANK = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@on(rf"""select doc_id, regexp_replace(regexp_replace(text, '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g') as collapsed, length(text) // 4 as tokens from documents where text is not null""")
def fn_collapse_and_tokens(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").where("text is not null")
    return docs.select("doc_id", text.collapse(F.col("text")).alias("collapsed"), text.token_estimate(F.col("text")).alias("tokens"))


_B, _A = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_M = f"'{_B}(?:pulmonary sclerosis|sclerosis|stenosis){_A}'"


@on(rf"select doc_id, regexp_replace(regexp_replace(lower(text), {_M}, '\1\2', 'gi'), {_M}, '\1\2', 'gi') as masked from documents")
def fn_masked_text(spark: SparkSession, root: str) -> DataFrame:
    """Longest aliases first, whole words only, in any script's letter case."""
    return table(spark, root, "documents").select("doc_id", text.mask(F.lower("text"), _ALIASES).alias("masked"))


@on(rf"""select doc_id, a as alias from documents, (values ('stenosis'), ('sclerosis'), ('pulmonary sclerosis')) t(a) where regexp_matches(lower(text), '{_B}' || a || '{_A}')""")
def fn_alias_mentions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.explode(text.mentions(F.lower("text"), _ALIASES)).alias("alias"))


@on(rf"""with d as (select row_id, trim(regexp_replace(regexp_replace(coalesce(DESCRIPTION, '') || ' ref ' || row_id || ' and 0a1b2c3d-0000-4000-8000-00000000000f ;', '{_B}' || row_id || '{_A}', '\1\2', 'g'), '0a1b2c3d-0000-4000-8000-00000000000f', '', 'g')) as t from conditions)
select row_id, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ;') as scrubbed from d""")
def fn_scrubbed_ids(spark: SparkSession, root: str) -> DataFrame:
    said = F.concat(F.coalesce("DESCRIPTION", F.lit("")), F.lit(" ref "), F.col("row_id").cast("string"), F.lit(" and 0a1b2c3d-0000-4000-8000-00000000000f ;"))
    return table(spark, root, "conditions").select("row_id", text.scrub(said, F.array(F.col("row_id").cast("string"))).alias("scrubbed"))


@on("""select o_orderkey as id, case when s < 1024 then printf('%.1f B', s) when s < 1048576 then printf('%.1f KB', s / 1024) when s < 1073741824 then printf('%.1f MB', s / 1048576) else printf('%.1f GB', s / 1073741824) end as size from (select o_orderkey, 2.0 ** (o_orderkey % 40) * 1.5 as s from orders)""")
def fn_format_size(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), text.format_size(F.pow(F.lit(2.0), (F.col("o_orderkey") % 40).cast("double")) * 1.5).alias("size"))


@on("select doc_id, upper(lang[1]) || lower(lang[2:]) as label, sha256(text) as text_sha256, md5(text) as text_md5 from documents where text is not null")
def wn09_text_hashes(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").where("text is not null")
    return docs.select("doc_id", text.capitalise(F.col("lang")).alias("label"), F.sha2("text", 256).alias("text_sha256"), F.md5("text").alias("text_md5"))


@on("select count(*) as n_documents, count(distinct text) as n_texts from documents where text is not null")
def se05_distinct_texts(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").where("text is not null")
    return docs.agg(F.count("*").alias("n_documents"), F.countDistinct(F.sha2("text", 256)).alias("n_texts"))


@on("""select o_custkey as id, 'a' || chr(10) || 'a' || chr(10) || chr(10) || 'a' || chr(10) || 'b' as limited, 'x' || 'the same phrase again ' || 'end' as once from orders""")
def fn_repetition_limits(spark: SparkSession, root: str) -> DataFrame:
    lines, phrase = F.lit("a\na\na\n\na\nb"), F.lit("x" + "the same phrase again " * 6 + "end")
    return table(spark, root, "orders").select(F.col("o_custkey").alias("id"), text.limit_line_runs(lines).alias("limited"), text.collapse_phrases(phrase).alias("once"))


def _facts(spark: SparkSession, root: str) -> DataFrame:
    c = History(spark, root).tables["conditions"]
    pos = F.concat_ws("/", "CODE", F.coalesce("ENCOUNTER", F.lit("")))
    return c.select(F.col("PATIENT").alias("patient_id"), F.col("START").cast("string").alias("date"), pos.alias("pos"), F.col("DESCRIPTION").alias("display"), F.lit("active").alias("status"))


_RECENT = f"""with {CLEAN_SQL}, f as (select PATIENT as patient_id, s::varchar as date, CODE || '/' || coalesce(ENCOUNTER, '') as pos, dsc as display from condition),
k as (select *, row_number() over (partition by patient_id order by coalesce(date, '9999') desc, pos) as rank, count(*) over (partition by patient_id) as n_all from f)"""


@on(f"{_RECENT} select patient_id, date, pos, display, cast(rank as int) as rank, n_all from k where rank <= 50")
def so03_recent_facts(spark: SparkSession, root: str) -> DataFrame:
    return notes.recent(_facts(spark, root), 50).drop("status")


@on(f"""{_RECENT} select patient_id, '## CONDITIONS / DIAGNOSES' || chr(10) || string_agg('- ' || date || ': ' || coalesce(display, 'Unknown condition') || ' [active]', chr(10) order by rank) || case when max(n_all) > 50 then chr(10) || '  ... and ' || (max(n_all) - 50) || ' more conditions' else '' end as text
from k where rank <= 50 group by 1""")
def so03_section_text(spark: SparkSession, root: str) -> DataFrame:
    return notes.section_text(notes.recent(_facts(spark, root), 50), "CONDITIONS / DIAGNOSES", "condition", 50)


_LINES = """
fact as (
  select c_custkey as patient_id, 'conditions' as section, cast(o_orderdate::date as varchar) as date, o_orderkey * 10 as pos, o_orderpriority as display, o_orderstatus as status, null as detail, null as value from customer join orders on o_custkey = c_custkey where o_orderkey % 3 = 0
  union all select o_custkey, 'encounters', case when o_orderkey % 11 > 0 then cast(o_orderdate::date as varchar) end, o_orderkey * 10, o_orderpriority, null, o_orderstatus, case when o_orderkey % 2 = 0 then 'check' end from orders
  union all select o_custkey, case l_linenumber when 1 then 'vital-signs' when 2 then 'laboratory' when 3 then 'procedures' when 4 then 'survey' else 'medications' end, case when l_partkey % 13 > 0 then cast(l_shipdate::date as varchar) end, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey,
    case when l_partkey % 17 > 0 then 'part ' || l_partkey end, l_returnflag, case when l_linenumber < 3 then 'mmol' end, case when l_linenumber < 3 then cast(l_quantity::int as varchar) end from lineitem join orders on o_orderkey = l_orderkey
)"""


def _lines(spark: SparkSession, root: str) -> DataFrame:
    """Orders and their lines as the facts of customers, so that every section has some."""
    orders, items = table(spark, root, "orders"), table(spark, root, "lineitem")
    day = lambda c, when: F.when(when, F.col(c).cast("date").cast("string"))
    none = F.lit(None).cast("string")
    k = F.col("l_linenumber")
    names = ["patient_id", "section", "date", "pos", "display", "status", "detail", "value"]
    conditions = orders.where("o_orderkey % 3 = 0").select("o_custkey", F.lit("conditions"), day("o_orderdate", F.lit(True)), F.col("o_orderkey") * 10, "o_orderpriority", "o_orderstatus", none, none).toDF(*names)
    visits = orders.select("o_custkey", F.lit("encounters"), day("o_orderdate", F.col("o_orderkey") % 11 > 0), F.col("o_orderkey") * 10, "o_orderpriority", none, "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "check")).toDF(*names)
    section = F.when(k == 1, "vital-signs").when(k == 2, "laboratory").when(k == 3, "procedures").when(k == 4, "survey").otherwise("medications")
    rest = items.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_custkey", section, day("l_shipdate", F.col("l_partkey") % 13 > 0), (F.col("l_orderkey") * 10 + k) * 1_000_000 + F.col("l_partkey"), F.when(F.col("l_partkey") % 17 > 0, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))), "l_returnflag",
        F.when(k < 3, "mmol"), F.when(k < 3, F.col("l_quantity").cast("int").cast("string")),
    ).toDF(*names)
    return conditions.unionByName(visits).unionByName(rest)


_CAPS = "(values " + ", ".join(f"('{d[0]}', {d[2]})" for d in notes.DOCUMENT_SECTIONS) + ") cap(section, most)"
_HEADED = " || ".join(
    f"coalesce(chr(10) || chr(10) || {h} || max(case when section = '{s}' then lines || " + (f"case when n > {cap} then chr(10) || '  ... and ' || (n - {cap}) || ' more {noun}s' else '' end" if noun else "''") + " end), '')"
    for s, h, cap, noun in ((d[0], f"'## {d[1]}' || chr(10)", d[2], d[3]) for d in notes.DOCUMENT_SECTIONS if d[3])
)
_VALUES = "case when bool_or(section in ('vital-signs', 'laboratory', 'survey')) then chr(10) || chr(10) || '## OBSERVATIONS (Labs, Vitals)' || " + " || ".join(f"coalesce(chr(10) || chr(10) || '### {d[1]}' || chr(10) || max(case when section = '{d[0]}' then lines end), '')" for d in notes.DOCUMENT_SECTIONS if not d[3]) + " else '' end"
_PARTS = _HEADED.split(" || coalesce(chr(10) || chr(10) || '## PROCEDURES'")
_BODY = f"{_PARTS[0]} || {_VALUES} || coalesce(chr(10) || chr(10) || '## PROCEDURES'{_PARTS[1]}"


@on(f"""with {_LINES},
k as (select *, row_number() over (partition by patient_id, section order by coalesce(date, case when section in ('vital-signs', 'laboratory') then '0' else '9999' end) desc, pos) as rank, count(*) over (partition by patient_id, section) as n from fact),
l as (select *, '- ' || case section
  when 'conditions' then coalesce(date, 'Unknown date') || ': ' || coalesce(display, 'Unknown condition') || coalesce(' [' || status || ']', '')
  when 'medications' then coalesce(display, 'Unknown medication') || coalesce(' (' || date || ')', '') || coalesce(' [' || status || ']', '')
  when 'encounters' then coalesce(date, 'Unknown date') || ': ' || coalesce(display, 'Unknown') || coalesce(' (' || detail || ')', '') || coalesce(' - ' || value, '')
  when 'procedures' then coalesce(display, 'Unknown procedure') || coalesce(' (' || date || ')', '')
  else coalesce(date, '') || ': ' || coalesce(display, 'Unknown') || coalesce(': ' || value || ' ' || detail, '') end as line
  from k left join {_CAPS} using (section) where rank <= coalesce(most, 1)),
s as (select patient_id, section, max(n) as n, string_agg(line, chr(10) order by rank) as lines from l group by 1, 2),
d as (select patient_id, {_BODY} as body from s group by 1),
t as (select c_custkey as patient_id, '## PATIENT DEMOGRAPHICS' || chr(10) || 'Name: ' || c_name || chr(10) || 'Address: ' || c_mktsegment || coalesce(body, '') as text from customer left join d on patient_id = c_custkey)
select patient_id, case when length(text) > 8000 then text[:8000] || chr(10) || chr(10) || '[... truncated for length ...]' else text end as text from t""")
def so03_patient_documents(spark: SparkSession, root: str) -> DataFrame:
    none = F.lit(None).cast("string")
    people = table(spark, root, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("name"), none.alias("gender"), none.alias("birth_date"), F.col("c_mktsegment").alias("address"))
    return notes.patient_documents(people, _lines(spark, root), most_tokens=2000)


@on(f"""with {_LINES},
e as (select patient_id, case section when 'conditions' then 'condition' when 'medications' then 'medication' when 'encounters' then 'encounter' when 'procedures' then 'procedure' else 'observation' end as kind, date::date as date, pos, display from fact where date is not null),
b as (select *, min(year(date)) over (partition by patient_id) as low, max(year(date)) over (partition by patient_id) as high from e),
p as (select *, (year(date) - low) // 2 as chunk from b),
r as (select *, row_number() over (partition by patient_id, chunk, kind order by date, pos) as rank, low + chunk * 2 as f from p),
k as (select patient_id, chunk, kind, count(*) as n, min(f) as f, min(least(f + 1, high)) as t, string_agg(case when rank <= (case kind when 'procedure' then 5 else 10 end) then '  - ' || coalesce(display, 'Unknown') end, chr(10) order by rank) as lines from r group by 1, 2, 3)
select patient_id, min(f)::int as from_year, min(t)::int as to_year, sum(n)::bigint as n_events, '## PERIOD: ' || min(f) || ' - ' || min(t)
  || coalesce(chr(10) || chr(10) || 'Conditions diagnosed:' || chr(10) || max(case kind when 'condition' then lines end), '') || coalesce(chr(10) || chr(10) || 'Medications prescribed:' || chr(10) || max(case kind when 'medication' then lines end), '')
  || coalesce(chr(10) || chr(10) || 'Encounters: ' || max(case kind when 'encounter' then n end) || ' visits', '') || coalesce(chr(10) || chr(10) || 'Procedures:' || chr(10) || max(case kind when 'procedure' then lines end), '')
  || coalesce(chr(10) || chr(10) || 'Observations recorded: ' || max(case kind when 'observation' then n end), '') as text
from k group by patient_id, chunk""")
def wn10_period_texts(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("section")
    kinds = F.when(kind == "conditions", "condition").when(kind == "medications", "medication").when(kind == "encounters", "encounter").when(kind == "procedures", "procedure").otherwise("observation")
    events = _lines(spark, root).where("date is not null").select("patient_id", kinds.alias("kind"), F.col("date").cast("date").alias("date"), "pos", "display")
    return notes.period_texts(events, 2)


_NOTE = "intro\n# Subjective: dropped\ncough\n\nfever\n**PLAN**\nrest\nPlanning is fine\n## Findings\n- clear lungs\n---\nPLAN - revised\nwater"


@on("""select note_id, section, content from (select o_orderkey as note_id from orders) o, (values ('SUBJECTIVE', 'cough' || chr(10) || chr(10) || 'fever'), ('OBJECTIVE', '- clear lungs' || chr(10) || '---'), ('PLAN', 'water')) s(section, content) where note_id % 2 = 0
union all select o_orderkey, 'ASSESSMENT', 'no heading here ' || o_orderkey from orders where o_orderkey % 2 = 1""")
def fn_note_sections(spark: SparkSession, root: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 2 == 0, F.lit(_NOTE)).otherwise(F.concat(F.lit(" no heading here "), F.col("o_orderkey").cast("string")))
    return notes.sections(table(spark, root, "orders").select(F.col("o_orderkey").alias("note_id"), said.alias("text")))


@on("""select id, e as entity from (select c_custkey as id from customer), (values ('cough'), ('chest pain'), ('anaemia')) t(e)""")
def flt12_entity_lines(spark: SparkSession, root: str) -> DataFrame:
    answer = F.lit('```json\n# list\n1. cough\n- chest pain | symptom\n{"entity": "anaemia"}\n{"other": 1}\nHere are the entities\nab\n[\n]')
    return table(spark, root, "customer").select(F.col("c_custkey").alias("id"), F.explode(notes.entity_lines(answer)).alias("entity"))


@on("""with s as (select l_orderkey as note_id, 'chunk' as type, l_linenumber::varchar as id, l_partkey as input_tokens, l_suppkey as output_tokens, l_quantity as seconds from lineitem)
select * from s union all select note_id, 'total_chunks', null, sum(input_tokens)::bigint, sum(output_tokens)::bigint, sum(seconds) from s group by note_id""")
def ag23_token_table(spark: SparkSession, root: str) -> DataFrame:
    stats = table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("note_id"), F.lit("chunk").alias("type"), F.col("l_linenumber").cast("string").alias("id"), F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), F.col("l_quantity").alias("seconds")
    )
    return notes.token_table(stats)


@on("select l_orderkey as id, l_linenumber as line, l_partkey % 2 = 0 and (l_suppkey % 5 = 0 or l_quantity > 30 or l_linenumber > 2) as chunked from lineitem")
def fn_hierarchical_rule(spark: SparkSession, root: str) -> DataFrame:
    rule = notes.hierarchical(F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 5 == 0, F.col("l_quantity"), 30, F.col("l_linenumber"))
    return table(spark, root, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), rule.alias("chunked"))


@on("select p_partkey as id from part where lower(p_type) like '%o%' and lower(p_brand) = 'brand#11' ")
def flt09_catalogue_filter(spark: SparkSession, root: str) -> DataFrame:
    entries = table(spark, root, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("modality"), F.lit("Open").alias("access"), F.array("p_brand", F.lit("x")).alias("tags"))
    return notes.catalogue_filter(entries, "O", "open", "BRAND#11").select("id")


@on()
def gn01_vignettes(spark: SparkSession, root: str) -> DataFrame:
    return vignettes.documents(vignettes.visits(vignettes.patients(spark, 24)))


@on()
def gn02_longitudinal(spark: SparkSession, root: str) -> DataFrame:
    """Eleven dated events per patient, for look-back tiling."""
    return vignettes.visits(vignettes.patients(spark, 24), vignettes.LONG_OFFSETS)


@on("select * from (values ('explicit', true), ('implicit', false)) t(explicitness, names_condition)")
def gn01_leak_check(spark: SparkSession, root: str) -> DataFrame:
    """Explicit vignettes name conditions of the panel, implicit ones do not."""
    docs = vignettes.documents(vignettes.visits(vignettes.patients(spark, 24)))
    return docs.groupBy("explicitness").agg(F.bool_or(F.size(text.mentions(F.col("text"), vignettes.all_aliases())) > 0).alias("names_condition"))


@on("""with f(family, combination) as (values ('joints', 'Gout'), ('joints', 'Anaemia'), ('joints', 'Gout+Anaemia'), ('tired', 'Anaemia'), ('tired', 'Diabetes'), ('tired', 'Anaemia+Diabetes')),
r as (select *, 'stress-' || substr(sha256(family || '|' || repeat || '|' || combination), 1, 18) as patient_id from f, range(3) t(repeat), (values ('sufficient'), ('clue_deleted'), ('no_information')) v(variant))
select family, cast(repeat as int) as repeat, combination, variant, patient_id, (date '2018-01-10' + cast(repeat * 35 as int))::date as date, case when variant = 'sufficient' then combination else '' end as gold, variant <> 'sufficient' as abstain from r""")
def gn05_stress_cases(spark: SparkSession, root: str) -> DataFrame:
    made = vignettes.stress_cases(spark, {"joints": ["Gout", "Anaemia"], "tired": ["Anaemia", "Diabetes"]})
    return made.select("family", "repeat", "combination", "variant", "patient_id", "date", "gold", "abstain")


QUERIES, ORACLES = registry.queries, registry.oracles
