"""Samples, shuffles and draws that depend on keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest, draw, uniform


def bernoulli(rows: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    return rows.where(uniform(seed, "bernoulli", *keys) < share)


def percent_for(target: int, total: float = 2.49e9, margin: float = 4.0) -> float:
    """Per cent of edges to sample so that about ``target`` survive the later filters."""
    return min(100.0, max(0.1, target / total * 100 * margin))


def modulus_for(target: int, total: int = 1_010_770_373, share: float = 0.12) -> int:
    return max(1, int(total * share / target))


#: Rows that one task may bring into order.
HEAD = 100_000


def exact(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows (all if there are fewer), the least by hash; ties by key.

    A larger sample is cut by the first four digits of the hash, whose 65 536 counts tell
    which rows are in; only those with the digits at the limit are brought into order.
    """
    h = digest(seed, "exact", *keys)
    if n <= HEAD:
        return rows.orderBy(h, *keys).limit(n)
    cell, before = F.substring(h, 1, 4), 0
    for c in rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect():
        if before + c["n"] > n:
            return rows.where(cell < c["cell"]).unionByName(rows.where(cell == c["cell"]).orderBy(h, *keys).limit(n - before))
        before += c["n"]
    return rows


def numbered(rows: DataFrame, key: str, *by: str, block: int = 1 << 16) -> DataFrame:
    """Rows with ``idx`` from 0 in the order of an integer key and ``n``, in each group of ``by``.

    Ranks inside blocks of keys and the blocks' running sums, so no task sorts a whole group.
    """
    rows = rows.withColumn("b", F.floor(F.col(key) / block))
    order = Window.partitionBy(*by).orderBy("b")
    counts = rows.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.select(*by, "b", (F.sum("c").over(order) - F.col("c")).alias("before"), F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by, "b").orderBy(key)) - 1
    return rows.join(sums, [*by, "b"]).withColumn("idx", F.col("before") + rank).drop("b", "before")


def stratified(rows: DataFrame, by: str, n: int, seed: int, *keys: str) -> DataFrame:
    """The first n of each class in hashed order."""
    w = Window.partitionBy(by).orderBy(digest(seed, "stratum", *keys), *keys)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """A global order by hash."""
    return rows.orderBy(digest(seed, "shuffle", *keys), *keys)


def random_pairs(rows: DataFrame, by: str, key: str, draws: Column, seed: int) -> DataFrame:
    """by, draw, first, second: ordered pairs of distinct members of a group; draws are independent."""
    w = Window.partitionBy(by)
    members = rows.select(by, key, (F.row_number().over(w.orderBy(key)) - 1).alias("idx"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") > 1)
    groups = members.select(by, "n").distinct().withColumn("draws", draws).where(F.col("draws") > 0)
    drawn = groups.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws").cast("long"))))
    i = draw(seed, "first", by, "draw") % F.col("n")
    j = draw(seed, "second", by, "draw") % (F.col("n") - 1)
    drawn = drawn.withColumns({"i": i, "j": F.when(j >= i, j + 1).otherwise(j)})
    one = members.select(by, F.col("idx").alias("i"), F.col(key).alias("first"))
    two = members.select(by, F.col("idx").alias("j"), F.col(key).alias("second"))
    return drawn.join(one, [by, "i"]).join(two, [by, "j"]).select(by, "draw", "first", "second")


def replicated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times; none for less than one."""
    return rows.withColumn("copy", times).where(F.col("copy") >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copy").cast("int"))))
