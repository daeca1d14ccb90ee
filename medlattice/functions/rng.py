"""Counter-based random numbers: a value depends on its key only, never on partitioning or order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """Uniform in [0, 1) from the SHA-256 of the joined key; bit-identical in any engine with SHA-256."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def normal(*key: Column | str | int) -> Column:
    """Standard normal by Box-Muller from two uniforms of the key."""
    first = F.greatest(uniform(*key, "a"), F.lit(2.0**-53))
    return F.sqrt(-2.0 * F.log(first)) * F.cos(2.0 * math.pi * uniform(*key, "b"))


def uniform_sql(*key: str) -> str:
    """The same in SQL; arguments are SQL expressions or quoted literals."""
    joined = " || ':' || ".join(f"cast({k} as varchar)" for k in key)
    return f"(cast(('0x' || substr(sha256({joined}), 1, 13))::ubigint as double) / 4503599627370496.0)"


def normal_sql(*key: str) -> str:
    return f"(sqrt(-2.0 * ln(greatest({uniform_sql(*key, chr(39) + 'a' + chr(39))}, {2.0**-53!r}))) * cos({2.0 * math.pi!r} * {uniform_sql(*key, chr(39) + 'b' + chr(39))}))"
