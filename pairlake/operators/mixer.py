"""Mixing signals into one training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sampling

COLUMNS = ("anchor", "positive", "negative", "signal_type")
#: Column sets that are understood, first match wins: (needed, anchor, positive, has a negative).
LAYOUTS = (
    (("anchor", "positive", "negative"), "anchor", "positive", True),
    (("query", "document"), "query", "document", False),
    (("anchor", "positive"), "anchor", "positive", False),
    (("text1", "text2"), "text1", "text2", False),
    (("text", "label"), "text", "label", False),
)


def drop_bad_instructions(rows: DataFrame) -> DataFrame:
    """Without null first texts, clustering prompts and pairs of a text with itself."""
    return rows.where(F.col("text1").isNotNull() & ~F.col("text1").startswith("cluster:") & ~F.col("text1").eqNullSafe(F.col("text2")))


def normalized(rows: DataFrame, name: str) -> DataFrame:
    """anchor, positive, negative, signal_type of any known layout; unknown ones give no rows."""
    have = set(rows.columns)
    for needed, anchor, positive, has_negative in LAYOUTS:
        if have >= set(needed):
            negative = F.col("negative") if has_negative else F.lit(None)
            return rows.select(F.col(anchor).alias("anchor"), F.col(positive).alias("positive"), negative.cast("string").alias("negative"), F.lit(name).alias("signal_type"))
    return rows.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in COLUMNS])


def deduplicated(rows: DataFrame, *order: str) -> DataFrame:
    """One row per (anchor, positive), nulls equal: the first in the stated order.

    Pairs are told apart by the 128 bits of their MD5, so texts are not sorted.
    """
    key = F.md5(F.to_json(F.struct(F.md5("anchor").alias("a"), F.md5("positive").alias("p"))))  # a null is left out
    w = Window.partitionBy("pair").orderBy(*order)
    return rows.withColumn("pair", key).withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn", "pair")


def mix(signals: dict[str, tuple[DataFrame, int | None]], seed: int = 42) -> DataFrame:
    """Signals in order of precedence, each with a sample size (None for all) -> shuffled, deduplicated rows."""
    parts = []
    for i, (name, (rows, n)) in enumerate(signals.items()):
        rows = drop_bad_instructions(rows) if name == "instruction_pairs" else rows
        part = normalized(rows, name)
        part = part if n is None else sampling.exact(part, n, seed, "anchor", "positive")
        parts.append(part.withColumn("signal_order", F.lit(i)))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    one = deduplicated(merged, "signal_order", "negative")
    return sampling.shuffled(one, seed, "anchor", "positive").select(*COLUMNS)


def mix_stats(signals: dict[str, DataFrame], mixed: DataFrame) -> DataFrame:
    """signal_type, available, kept."""
    rows = None
    for name, df in signals.items():
        n = df.groupBy().agg(F.count(F.lit(1)).alias("available")).withColumn("signal_type", F.lit(name))
        rows = n if rows is None else rows.unionByName(n)
    kept = mixed.groupBy("signal_type").agg(F.count(F.lit(1)).alias("kept"))
    return rows.join(kept, "signal_type", "left").select("signal_type", "available", F.coalesce("kept", F.lit(0)).alias("kept"))
