"""Causal graphs from text, and questions to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Operators with name, direction, strength and weight.
OPERATORS = {
    "++>": ("strongly_increases", "risk", "strong", 0.8),
    "+>": ("increases", "risk", "moderate", 0.5),
    "?+>": ("possibly_increases", "risk", "uncertain", 0.3),
    "-->": ("strongly_decreases", "protective", "strong", -0.8),
    "->": ("decreases", "protective", "moderate", -0.5),
    "?->": ("possibly_decreases", "protective", "uncertain", -0.3),
    "=>": ("causes", "causal", "direct", 1.0),
    "?=>": ("possibly_causes", "causal", "uncertain", 0.5),
    "<=>": ("bidirectional", "causal", "direct", 1.0),
    "~>": ("associated", "causal", "uncertain", 0.2),
    "increases": ("increases", "risk", "moderate", 0.5),
    "decreases": ("decreases", "protective", "moderate", -0.5),
    "causes": ("causes", "causal", "direct", 1.0),
}
DIRECTIONS = ("risk", "protective", "causal")

#: Any operator; Java tries alternatives in order, so longer ones stand first.
_ANY = "|".join(s if s.isalpha() else "".join("\\" + c for c in s) for s in sorted(OPERATORS, key=lambda s: (-len(s), s)))


def edge_types(spark) -> DataFrame:
    """(edge_type, relation, direction, strength, weight)."""
    return spark.createDataFrame([(k, *v) for k, v in OPERATORS.items()], "edge_type string, relation string, direction string, strength string, weight double")


def node_name(term: Column) -> Column:
    """What stands before ``[type]``, without a time in brackets at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(term, r"(?s)(.)\[\w+\].*$", "$1"), r"\s*\([^)]*\)\s*$", ""))


def node_type(term: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(term, r".\[(\w+)\]", 1)), F.lit(""))


def node_time(term: Column) -> Column:
    return F.nullif(F.regexp_extract(term, r"\(([^)]+)\)\s*$", 1), F.lit(""))


def _bare_line(line: Column) -> Column:
    for mark in ("#", "-", r"\*"):
        line = F.trim(F.regexp_replace(line, f"^{mark}+", ""))
    return line


def parse_edges(texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges of each text: (doc_id, key, line_no, step, sources, target, edge_type, interaction), ends as written.

    A line ``A op B op C`` gives an edge per operator; ``&&`` and ``||`` join sources to an interaction.  Fenced lines
    and leading bullets are no part of it, and edges with an empty end are none.  Repeated edges of a text are given
    once, the first.
    """
    lines = texts.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"\r", "")))
    lines = lines.where(~F.startswith("raw", F.lit("```"))).withColumn("line", _bare_line(F.col("raw"))).where(F.col("line").rlike(_ANY))
    tidy = lambda t: F.btrim(t, F.lit(" -,"))
    lines = lines.select("doc_id", "line_no", F.transform(F.split("line", _ANY), tidy).alias("terms"), F.regexp_extract_all("line", F.lit(f"({_ANY})"), 1).alias("signs"))
    made = lines.select("doc_id", "line_no", "terms", F.posexplode("signs").alias("step", "edge_type"))
    source, target = F.try_element_at("terms", F.col("step") + 1), F.try_element_at("terms", F.col("step") + 2)
    made = made.select("doc_id", "line_no", "step", source.alias("source"), target.alias("target"), "edge_type").where("source <> '' and target <> ''")
    parts = lambda sign: F.filter(F.transform(F.split("source", sign), lambda t: F.trim(t)), lambda t: t != "")
    both, either = parts(" && "), parts(r" \|\| ")
    joint = F.when(F.size(both) > 1, F.struct(both.alias("s"), F.lit("and").alias("i"))).when(F.size(either) > 1, F.struct(either.alias("s"), F.lit("or").alias("i"))).otherwise(F.struct(F.array("source").alias("s"), F.lit(None).cast("string").alias("i")))
    made = made.withColumn("j", joint).select("doc_id", "line_no", "step", F.col("j.s").alias("sources"), "target", "edge_type", F.col("j.i").alias("interaction"))
    first = made.withColumn("key", edge_key(F.col("sources"), F.col("target"), F.col("edge_type"))).groupBy("doc_id", "key").agg(F.min_by(F.struct(*made.columns[1:]), F.struct("line_no", "step")).alias("e"))
    return first.select("doc_id", "key", "e.*")


def edge_key(sources: Column, target: Column, edge_type: Column) -> Column:
    """Equal for edges that say the same: sources in any order, letter case aside."""
    return F.concat_ws("␟", F.array_join(F.array_sort(F.transform(sources, lambda s: F.lower(s))), "␞"), F.lower(target), edge_type)


def nodes(edges: DataFrame) -> DataFrame:
    """(doc_id, name, node_type, node_time): a stated type is better than none, a later one better than an earlier."""
    at = F.col("line_no") * 1000 + F.col("step")
    ends = edges.select("doc_id", at.alias("at"), F.explode(F.concat("sources", F.array("target"))).alias("raw"))
    ends = ends.select("doc_id", "at", node_name(F.col("raw")).alias("name"), node_type(F.col("raw")).alias("t"), node_time(F.col("raw")).alias("w"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return ends.groupBy("doc_id", "name").agg(F.coalesce(last("t"), F.lit("unknown")).alias("node_type"), last("w").alias("node_time"))


def with_attributes(edges: DataFrame) -> DataFrame:
    return edges.join(F.broadcast(edge_types(edges.sparkSession)), "edge_type", "left")


def causes_of(edges: DataFrame, what: str, direction: str | None = None) -> DataFrame:
    """Edges whose target holds the text; of one direction only if asked (``risk`` or ``protective`` ones, say)."""
    kept = with_attributes(edges).where(F.contains(F.lower("target"), F.lit(what.lower())))
    return kept if direction is None else kept.where(F.col("direction") == direction)


def consequences_of(edges: DataFrame, what: str) -> DataFrame:
    """Edges one of whose sources holds the text."""
    return with_attributes(edges).where(F.contains(F.lower(F.array_join("sources", " ")), F.lit(what.lower())))


def interactions(edges: DataFrame, kind: str | None = None) -> DataFrame:
    return edges.where(F.size("sources") > 1 if kind is None else F.col("interaction") == kind)


def chains(edges: DataFrame, start: str, depth: int = 5, exact: bool = False) -> DataFrame:
    """(doc_id, path, length): every path of edges from a node that holds ``start``, prefixes too, no edge twice.

    Which edge may follow which is found once, by a join within a document - on the equal node if ``exact``, else by the
    text it holds; every step is then an equi-join of the paths' last edges with these, bounded by a document's own edges.
    """
    after = F.lower(F.regexp_replace("target", r"\s*\([^)]*\)\s*$", ""))
    keyed = cut(edges.select("doc_id", "key", F.lower(F.array_join("sources", " ")).alias("source"), after.alias("target"), "sources"))
    ends = keyed.select("doc_id", F.col("key").alias("last"), "target")
    if exact:  # one row per source node, met by equality
        begins = keyed.select(F.col("doc_id").alias("d"), F.col("key").alias("next"), F.explode(F.array_distinct(F.transform("sources", lambda s: F.lower(s)))).alias("source"))
        meets = F.col("source") == F.col("target")
    else:
        begins = keyed.select(F.col("doc_id").alias("d"), F.col("key").alias("next"), "source")
        meets = F.contains("source", F.col("target"))
    follows = cut(ends.join(begins, (F.col("doc_id") == F.col("d")) & meets).select("doc_id", "last", "next"))
    front = keyed.where(F.contains("source", F.lit(start.lower()))).select("doc_id", F.array("key").alias("path"), F.col("key").alias("last"))
    found = front
    for _ in range(depth - 1):
        front = front.join(follows, ["doc_id", "last"]).where(~F.array_contains("path", F.col("next"))).select("doc_id", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last"))
        found = found.unionByName(front)
    return found.select("doc_id", "path", F.size("path").alias("length"))


def chain_counts(edges: DataFrame, start: str, depth: int = 5, exact: bool = False) -> DataFrame:
    """(doc_id, length, n): how many paths :func:`chains` finds of each length, counted without making them all.

    Edges that say the same sources and target are one row with their number, which may follow which is found between
    distinct texts, and paths are made up to ``depth - 2`` edges, with the number of ways to deal out equal edges.  The
    ways to go on by one edge are the edges that follow the last one, less those already on the path; by two, the sum of
    that over the edges that follow, less those on the path, each also less itself where it may follow itself.
    """
    met = (lambda source, target: F.array_contains(source, target)) if exact else (lambda source, target: F.contains(source, target))
    said = F.lower(F.array_join("sources", " "))
    source = F.array_distinct(F.transform("sources", lambda s: F.lower(s))) if exact else said
    target = F.lower(F.regexp_replace("target", r"\s*\([^)]*\)\s*$", ""))
    same = edges.select("doc_id", source.alias("source"), target.alias("target"), F.contains(said, F.lit(start.lower())).alias("starts"))
    same = cut(same.groupBy("doc_id", "source", "target", "starts").agg(F.count("*").alias("m")).withColumn("no", F.monotonically_increasing_id()))
    counted = same.where("starts").groupBy("doc_id").agg(F.sum("m").alias("n")).select("doc_id", F.lit(1).alias("length"), "n")
    if depth < 2:
        return counted
    begins = same.select(F.col("doc_id").alias("d"), "source").distinct()
    if exact:  # one row per source node, met by equality
        begins, meets = begins.withColumn("node", F.explode("source")), F.col("node") == F.col("at")
    else:
        meets = F.contains("source", F.col("at"))
    meets = cut(same.select("doc_id", F.col("target").alias("at")).distinct().join(begins, (F.col("doc_id") == F.col("d")) & meets).select("doc_id", "at", "source"))
    onward = meets.join(same, ["doc_id", "source"]).groupBy("doc_id", "at").agg(F.sum("m").alias("onward")).withColumnRenamed("at", "target")
    live = same.join(onward, ["doc_id", "target"]).withColumn("after", F.col("onward") - met(F.col("source"), F.col("target")).cast("long"))
    steps = cut(meets.join(live, ["doc_id", "source"]))  # edges that nothing follows end a path and are in ``onward`` only
    beyond = steps.groupBy("doc_id", "at").agg(F.sum(F.col("m") * F.col("after")).alias("beyond"))

    path = lambda k: [f"{c}{i}" for i in range(1, k + 1) for c in ("no", "source", "target", "after")]
    named = lambda k: [F.col(c).alias(f"{c}{k}") for c in ("no", "source", "target", "after")]
    front = cut(live.where("starts").select("doc_id", "onward", F.col("m").alias("ways"), *named(1)))
    parts, last = [counted], max(1, depth - 2)
    for k in range(1, last + 1):
        if k > 1:
            again = sum(((F.col(f"no{i}") == F.col("no")).cast("long") for i in range(1, k)), F.lit(0))
            grown = front.drop("onward").join(steps.withColumnRenamed("at", f"target{k - 1}"), ["doc_id", f"target{k - 1}"])
            front = cut(grown.select("doc_id", "onward", (F.col("ways") * (F.col("m") - again)).alias("ways"), *path(k - 1), *named(k)).where("ways > 0"))
        follows = lambda a, b: met(F.col(f"source{b}"), F.col(f"target{a}")).cast("long")
        on = [follows(k, i) for i in range(1, k + 1)]
        parts.append(front.groupBy("doc_id").agg(F.sum(F.col("ways") * (F.col("onward") - sum(on))).alias("n")).select("doc_id", F.lit(k + 1).alias("length"), "n"))
    if depth > 2:
        k = last
        back = sum(on[p - 1] * (sum(follows(p, i) for i in range(1, k + 1)) - F.col(f"after{p}")) for p in range(1, k + 1))
        parts.append(front.groupBy("doc_id").agg(F.sum(F.col("ways") * back).alias("n")).select("doc_id", F.lit(depth).alias("length"), "n"))
        ends = front.groupBy("doc_id", F.col(f"target{k}").alias("at")).agg(F.sum("ways").alias("ways"))
        parts.append(ends.join(beyond, ["doc_id", "at"]).groupBy("doc_id").agg(F.sum(F.col("ways") * F.col("beyond")).alias("n")).select("doc_id", F.lit(depth).alias("length"), "n"))
        # two edges on, but the second is one of the path
        between = steps.groupBy("doc_id", "at", F.col("target").alias("by")).agg(F.sum("m").alias("m"))
        through = between.join(meets.select("doc_id", F.col("at").alias("by"), "source"), ["doc_id", "by"]).groupBy("doc_id", "at", "source").agg(F.sum("m").alias("m"))
        held = front.select("doc_id", F.col(f"target{k}").alias("at"), "ways", F.explode(F.array(*[f"source{i}" for i in range(1, k + 1)])).alias("source"))
        held = held.groupBy("doc_id", "at", "source").agg(F.sum("ways").alias("ways"))
        parts.append(held.join(through, ["doc_id", "at", "source"]).groupBy("doc_id").agg((-F.sum(F.col("ways") * F.col("m"))).alias("n")).select("doc_id", F.lit(depth).alias("length"), "n"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("doc_id", "length").agg(F.sum("n").alias("n")).where("n > 0")


def summary(edges: DataFrame) -> DataFrame:
    """Per text: nodes, edges, interactions and edges by direction."""
    n = nodes(edges).groupBy("doc_id").agg(F.count("*").alias("n_nodes"))
    e = with_attributes(edges).groupBy("doc_id").agg(
        F.count("*").alias("n_edges"), F.count_if(F.size("sources") > 1).alias("n_interactions"),
        *[F.count_if(F.col("direction") == d).alias(f"n_{d}") for d in DIRECTIONS],
    )
    return n.join(e, "doc_id")


def mermaid(edges: DataFrame) -> DataFrame:
    """(doc_id, mermaid): a flow chart per text, edges in order."""
    ident = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9]", "_")
    line = F.concat(F.lit("    "), ident(F.col("source")), F.lit('["'), F.col("source"), F.lit('"] -->|'), F.col("edge_type"), F.lit("| "), ident(F.col("target")), F.lit('["'), F.col("target"), F.lit('"]'))
    rows = edges.select("doc_id", "line_no", "step", "edge_type", "target", F.posexplode("sources").alias("k", "source"))
    made = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "step", "k", line.alias("l")))).alias("x"))
    return made.select("doc_id", F.concat(F.lit("flowchart LR\n"), F.array_join(F.transform("x", lambda v: v["l"]), "\n")).alias("mermaid"))


def expanded(edges: DataFrame) -> DataFrame:
    """(doc_id, source, target, relation): a plain graph, in which an interaction is a node with its members."""
    joint = F.concat(F.lit("("), F.array_join("sources", " AND "), F.lit(")"))
    single = edges.where(F.size("sources") == 1).select("doc_id", F.col("sources")[0].alias("source"), "target", F.col("edge_type").alias("relation"))
    multi = edges.where(F.size("sources") > 1)
    whole = multi.select("doc_id", joint.alias("source"), "target", F.col("edge_type").alias("relation"))
    member = multi.select("doc_id", F.explode("sources").alias("source"), joint.alias("target"), F.lit("member_of").alias("relation"))
    return single.unionByName(whole).unionByName(member).distinct()


def from_expanded(graph: DataFrame) -> DataFrame:
    """The relations of a plain graph, without membership."""
    return graph.where("relation <> 'member_of'")
