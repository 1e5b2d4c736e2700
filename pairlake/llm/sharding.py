"""Sharding by sampled splitters.

Rows are ordered by (60 bits of the text's MD5, doc_id), so that equal texts stand
next to each other and doc_id divides a group of any size. A size-weighted sample
of the keys gives quantile boundaries of many small ranges; rows are dealt to
ranges by binary search over the boundaries. Ranges that turn out overfull are
subdivided by the quantiles of a second, denser sample of their own keys. Exact
sizes per range then give each range its place in the whole order, a running sum
inside the range gives each row its place, and the shard is the place's share of
all bytes: shards differ from equal by at most one row's size.

Only DataFrame operations are used. The driver-side values are the byte total, the
boundary lists and the sums per range, whose lengths are fixed by ``max_ranges``. Only
narrow columns are shuffled (key, id, size), once; ``write_shards`` shuffles whole rows
once. A range is sorted by one task, which can spill: with more than some 10**10 rows,
raise ``max_ranges``.

Defined results: a null text has no bytes, size 8 and checksum 0, and sorts as the
empty text; a null doc_id sorts first. Rows equal in text and doc_id are told apart
only by their place, so any of them may have any of their slots. An empty table
gives no rows. Extra columns of the input are ignored, or written as they are by
``write_shards``, which refuses a table that has a column ``shard`` or ``slot``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHARDS = 24
#: Bytes added to every record.
RECORD_OVERHEAD = 8


def prepared(docs: DataFrame, *others: str) -> DataFrame:
    """documents -> doc_id, size, text_crc32, key, which are all that the plan needs, and any others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        *others,
        "doc_id",
        (F.octet_length(text) + F.lit(RECORD_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.struct(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("k"), F.col("doc_id").cast("long").alias("d")).alias("key"),
    )


def _below(bounds: Column, key: Column, n: int) -> Column:
    """How many of the ``n`` sorted boundaries are at or below the key, by binary search."""
    steps = [1 << i for i in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at),
    )


def _splitters(sample: DataFrame, ways: int) -> list[tuple[int, int | None]]:
    """Quantile boundaries of a sample of keys: ``ways`` - 1 of them, without repeats."""
    got = sample.agg(F.sort_array(F.collect_list("key")).alias("keys")).first()["keys"]
    cut = [got[len(got) * i // ways] for i in range(1, ways)] if got else []
    return list(dict.fromkeys((r["k"], r["d"]) for r in cut))


def _bounds(pairs: list[tuple[int, int | None]]) -> Column:
    number = lambda x: "cast(null as bigint)" if x is None else f"cast('{x}' as bigint)"
    return F.expr("array(" + ", ".join(f"named_struct('k', {number(k)}, 'd', {number(d)})" for k, d in pairs) + ")")


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"cast('{v}' as bigint)" for v in values) + ")")


def _draw(rows: DataFrame, rate: float, seed: int) -> DataFrame:
    """Rows drawn with probability size * rate by a hash of the key: the same ones in every attempt."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("key.k"), F.col("key.d")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(u < F.col("size") * rate)


def _dealt(rows: DataFrame, bounds: list[tuple[int, int | None]]) -> DataFrame:
    return rows.withColumn("range", _below(_bounds(bounds), F.col("key"), len(bounds)) if bounds else F.lit(0))


def planned(rows: DataFrame, shards: int = SHARDS, range_bytes: int = 8 << 20, max_ranges: int = 1024, per_range: int = 16) -> Callable[[DataFrame], DataFrame]:
    """Rows with size and key -> a function that gives these rows, with any other columns, their shard and slot.

    ``range_bytes`` is the aim for one range. ``max_ranges`` bounds their number, and
    with it the samples (about ``per_range`` keys for each range) and the tables of
    range sums, which are all that the driver sees. A range of over twice its even
    share is subdivided. Give a table that is cheap to read again (see ``staged``).
    """
    total = rows.agg(F.sum("size")).first()[0]
    if total is None:
        return lambda whole: whole.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    ranges = int(min(max_ranges, max(4 * shards, -(-total // range_bytes))))
    even, rate = total / ranges, ranges * per_range / total
    bounds = _splitters(_draw(rows, rate, 1), ranges)
    coarse = _dealt(rows, bounds)
    held = coarse.groupBy("range").agg(F.sum("size").alias("held")).where(F.col("held") > 2 * even).collect()
    if held:
        ways = {r["range"]: int(r["held"] / even) + 1 for r in held}
        over = coarse.where(F.col("range").isin(list(ways)))
        cuts = set(bounds)
        for r in _draw(over, 4 * rate, 2).groupBy("range").agg(F.sort_array(F.collect_list("key")).alias("keys")).collect():
            n, w = len(r["keys"]), ways[r["range"]]
            cuts |= {(k["k"], k["d"]) for i in range(1, w) for k in [r["keys"][n * i // w]]}
        lowest = -(1 << 63)
        bounds = sorted(cuts, key=lambda b: (b[0], lowest if b[1] is None else b[1]))
        coarse = _dealt(rows, bounds)
    sums = {r["range"]: (r["bytes"], r["n"]) for r in coarse.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    bytes_before, rows_before = [0], [0]
    for i in range(max(sums) + 1):
        size, n = sums.get(i, (0, 0))
        bytes_before.append(bytes_before[-1] + size)
        rows_before.append(rows_before[-1] + n)

    def placed(dealt: DataFrame) -> DataFrame:
        """The row's place in the whole order, and the shard in which its middle byte is."""
        order = Window.partitionBy("range").orderBy("key")
        inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        middle = F.get(_longs(bytes_before), F.col("range")) + inside + F.floor(F.col("size") / 2)
        at = F.get(_longs(rows_before), F.col("range")) + F.row_number().over(order) - 1
        share = F.expr(f"cast(middle as decimal(38, 0)) * {shards} div {total}")
        found = dealt.withColumn("middle", middle).withColumn("at", at.cast("long"))
        return found.withColumn("shard", F.least(F.lit(shards - 1), share).cast("int")).drop("middle")

    # a shard starts in the range that has its first byte, after that range's rows of earlier shards
    edge = [bisect_right([b * shards for b in bytes_before], s * total) - 1 for s in range(shards)]
    there = placed(_dealt(rows.select("size", "key"), bounds).where(F.col("range").isin(edge[1:])))
    counts = there.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("n")).collect()
    starts = [rows_before[r] + sum(c["n"] for c in counts if c["range"] == r and c["shard"] < s) for s, r in enumerate(edge)]

    def place(whole: DataFrame) -> DataFrame:
        found = placed(_dealt(whole, bounds))
        return found.withColumn("slot", F.col("at") - F.get(_longs(starts), F.col("shard"))).select(*whole.columns, "shard", "slot")

    return place


def shard(rows: DataFrame, shards: int = SHARDS, **limits: int) -> DataFrame:
    """Rows with size and key -> the same columns with shard and slot; law ``bytes``."""
    return planned(rows, shards, **limits)(rows)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """documents -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = shard(staged(prepared(docs), "shard-keys"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole rows under ``shard=N`` folders, in slot order inside each file, every row once.

    Rows take their texts along through the one shuffle by range, so nothing is joined
    back and repeated or null ids are no matter; a shard is written by the tasks that
    hold its ranges.
    """
    clash = {"shard", "slot"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are names of the result")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = prepared(docs.withColumn("_row", F.struct(*own)), "_row")
    placed = planned(staged(rows.drop("_row"), "shard-keys"), shards)(rows)
    placed.select("_row.*", "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
