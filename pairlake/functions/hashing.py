"""Draws that are pure functions of their key.

Every sample, shuffle and random choice hashes "seed:tag:key..." with MD5, so results
do not depend on partitioning and another SQL engine gets the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, tag: str, *keys: Column | str) -> Column:
    """Hex MD5 of the key; a null part counts as a tab, which no number has."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[F.coalesce(p.cast("string"), F.lit("\t")) for p in parts]).cast("binary"))


def draw(seed: int, tag: str, *keys: Column | str) -> Column:
    """A non-negative 60-bit integer."""
    return F.conv(F.substring(digest(seed, tag, *keys), 1, 15), 16, 10).cast("long")


def uniform(seed: int, tag: str, *keys: Column | str) -> Column:
    """A double in [0, 1)."""
    return F.conv(F.substring(digest(seed, tag, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def digest_sql(seed: int, tag: str, *keys: str) -> str:
    """The same key's MD5 in DuckDB SQL."""
    return "md5('" + f"{seed}:{tag}:' || " + " || ':' || ".join(f"coalesce(cast({k} as varchar), chr(9))" for k in keys) + ")"


def draw_sql(seed: int, tag: str, *keys: str) -> str:
    return f"cast('0x' || substr({digest_sql(seed, tag, *keys)}, 1, 15) as bigint)"


def uniform_sql(seed: int, tag: str, *keys: str) -> str:
    return f"(cast('0x' || substr({digest_sql(seed, tag, *keys)}, 1, 8) as bigint) / 4294967296.0)"
