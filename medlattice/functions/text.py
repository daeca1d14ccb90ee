"""String functions of the document pipeline as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(pattern: str) -> str:
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def collapse(value: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def alternation(aliases: Sequence[str]) -> str:
    """A pattern for any alias as a whole word, longest first, in any letter case."""
    ordered = sorted({a for a in aliases if a}, key=lambda a: (-len(a), a))
    return r"(?iU)(?<!\w)(?:" + "|".join(quote(a) for a in ordered) + r")(?!\w)"


def mask(value: Column, aliases: Sequence[str], by: str = "") -> Column:
    """The text without the aliases."""
    return F.regexp_replace(value, alternation(aliases), by.replace("\\", "\\\\").replace("$", "\\$")) if any(aliases) else value


def mentions(value: Column, aliases: Sequence[str]) -> Column:
    """The aliases that the text holds, in the order given."""
    return F.array_compact(F.array(*[F.when(value.rlike(alternation([a])), F.lit(a)) for a in aliases]))


def scrub(value: Column, ids: Column) -> Column:
    """The text without the given ids (array column) and any UUID, tidied."""
    pattern = lambda i: F.concat(F.lit(r"(?U)(?<!\w)\Q"), i, F.lit(r"\E(?!\w)"))
    known = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda i: F.length(i) > 0)
    without = F.aggregate(known, value, lambda t, i: F.regexp_replace(t, pattern(i), F.lit("")))
    bare = F.regexp_replace(without, r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "")
    return F.btrim(collapse(bare), F.lit(" ;"))


def capitalise(value: Column) -> Column:
    """First letter upper, all others lower case."""
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, 2, 1_000_000_000)))


def token_estimate(value: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(value) / 4).cast("bigint")


def format_size(size: Column) -> Column:
    """Bytes with a unit and one decimal: 1536 is ``1.5 KB``."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    made = F.format_string("%.1f PB", size / float(1024**5))
    for k in range(len(units) - 2, -1, -1):
        made = F.when(size < float(1024 ** (k + 1)), F.format_string(f"%.1f {units[k]}", size / float(1024**k))).otherwise(made)
    return made


#: What an answer begins with after thoughts that were never closed, in the order in which it is looked for.
ANSWER_MARKS = (r"\n#\s", r"\n\*\*[A-Z]", r"\nSUBJECTIVE", r"\nOBJECTIVE", r"\nASSESSMENT", r"\nPLAN", r"\nPATIENT STORY")


def _past_open_thought(value: Column) -> Column:
    """Where thoughts were begun and not closed: the answer from its first mark on, or all but the opening token."""
    rest = F.regexp_replace(value, r"(?i)^\s*<unused\d+>thought\s*", "")
    for mark in reversed(ANSWER_MARKS):
        rest = F.when(F.regexp_like(value, F.lit(f"(?i){mark}")), F.regexp_extract(value, f"(?is)({mark}.*)", 1)).otherwise(rest)
    return F.when(F.regexp_like(value, F.lit(r"(?i)^\s*<unused\d+>.{0,40}?thought")), rest).otherwise(value)


def clean_response(value: Column) -> Column:
    """A model's answer without its thinking blocks, closed or not, and control tokens."""
    without = F.regexp_replace(value, r"(?is)<(think|thinking|unused94)>.*?</?(think|thinking|unused95)>", "")
    without = _past_open_thought(without)
    bare = F.regexp_replace(without, r"<\|?[a-z_]+(?:of_text|_start|_end|start_of_turn|end_of_turn)[a-z_]*\|?>|<unused\d+>", "")
    return F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")


def limit_line_runs(value: Column, most: int = 2) -> Column:
    """At most ``most`` equal non-empty lines in a row."""
    lines = F.split(value, "\n")
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        n = F.when(line.eqNullSafe(s["last"]), s["n"] + 1).otherwise(1)
        keep = (F.length(F.trim(line)) == 0) | (n <= most)
        return F.struct(line.alias("last"), n.alias("n"), F.when(keep, F.concat(s["out"], F.array(line))).otherwise(s["out"]).alias("out"))

    return F.array_join(F.aggregate(lines, start, step, lambda s: s["out"]), "\n")


def collapse_phrases(value: Column, least: int = 20, times: int = 5) -> Column:
    """A phrase of ``least`` characters or more that follows itself ``times`` times or more, once."""
    return F.regexp_replace(value, r"(?s)(.{%d,}?)\1{%d,}" % (least, times - 1), "$1")


def json_array_span(value: Column, schema: str) -> Column:
    """The first [...] span of an answer as an array; empty if it is no JSON."""
    span = F.regexp_extract(value, r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(F.when(F.length(span) > 0, span), schema), F.array().cast(schema))
