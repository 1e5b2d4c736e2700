"""Connected components of a distributed edge table, by alternating stars.

Large-star joins every larger neighbour of a node to the node's least neighbour,
small-star joins every smaller one; both keep connectivity, and repeated they leave
each node joined to the least of its component (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Rounds grow with the logarithm of the
node count. Only edges are held, never a component in one task: a node's least
neighbour comes from an aggregate that is partial before the shuffle, and goes back to
the edges of hubs by broadcast (of at most BROADCAST_ROWS nodes), of others by a join.

Edges with a null end are left out; repeated edges and loops change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first())


def _with_least(pairs: DataFrame, n: int) -> DataFrame:
    """Edges (u, v) with m, the least v of their u; ``n`` is about the number of edges."""
    if n <= BROADCAST_ROWS:  # no hub among so few can weigh on a task
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    many = max(256, 8 * n // BROADCAST_ROWS)  # fewer than BROADCAST_ROWS nodes have so many edges
    hubs = cut(least.where(F.col("degree") >= many).select("u", F.col("m").alias("hub_m")))
    marked = pairs.join(F.broadcast(hubs), "u", "left")
    rest = marked.where(F.col("hub_m").isNull()).select("u", "v").join(least.where(F.col("degree") < many).select("u", "m"), "u")
    return marked.where(F.col("hub_m").isNotNull()).select("u", "v", F.col("hub_m").alias("m")).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node of its component, for nodes that have an edge."""
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = cut(pairs.distinct())
    state = _state(pairs)
    if state[0] <= BROADCAST_ROWS:  # so few that one task does each round without a shuffle
        pairs = pairs.coalesce(1)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, state[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large, state[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = small.where(F.col("u") != F.col("v"))
        pairs = cut((pairs.coalesce(1) if state[0] <= BROADCAST_ROWS else pairs).distinct())
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
