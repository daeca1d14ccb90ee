"""Identifiers that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX32 = "^[0-9a-f]{32}$"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def canonical_id(value: Column | str) -> Column:
    """The 32 hexadecimal digits of an id, lower case; NULL where the value is no id.

    Upper case, braces, missing dashes, outer white space, ``urn:uuid:`` and ``Type/`` prefixes do not matter.
    """
    bare = F.regexp_replace(F.lower(as_column(value)), r"^\s*(?:urn:uuid:|[a-z]+/)|[-{}()\s]", "")
    return F.when(bare.rlike(HEX32), bare)


def canonical_id_sql(expr: str) -> str:
    """The same rule for the SQL oracle."""
    bare = rf"regexp_replace(lower({expr}), '^\s*(urn:uuid:|[a-z]+/)|[-{{}}()\s]', '', 'g')"
    return f"(case when regexp_matches({bare}, '{HEX32}') then {bare} end)"


def not_blank(value: Column | str) -> Column:
    return F.coalesce(F.length(F.trim(F.regexp_replace(as_column(value), r"\s+", " "))) > 0, F.lit(False))
