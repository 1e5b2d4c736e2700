"""Exchange of packed keys between blocks of documents and buckets of keys.

Documents are dealt to blocks by a hash of their id, so a block has a bounded share
of the text whatever the ids, sources or copies are. A block answers with one small
packed row per bucket of keys instead of a row per key; a bucket compares what all
blocks sent, and answers each block with a packed row again. A key is sent once per
block, however often it occurs there, which is the aggregation before the shuffle
that keeps hot keys harmless.

All steps are deterministic functions of a block or a bucket, so lost tasks can be
run again alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec

#: Rows that go from blocks to buckets and back: kind tells the messages apart.
MESSAGE = "block int, kind int, bucket long, payload binary"
FIELDS = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int64()), ("payload", pa.binary())])
#: Kinds: a document that stands for its class of equal ones, and the buckets' answers.
FIRST, ANSWER, SECOND_ANSWER = 0, 1, 2


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows with a ``doc_id``, dealt to blocks by its hash."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")


def firsts(classes: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, digest binary) of the classes' first documents, as messages to their blocks."""
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    return classes.select(block.alias("block"), F.lit(FIRST).alias("kind"), F.col("doc_id").alias("bucket"), F.col("digest").alias("payload"))


def on_blocks(docs: DataFrame, messages: DataFrame, step: Callable[[pa.Table, pa.Table], pa.Table], schema: str, blocks: int) -> DataFrame:
    """``step`` of each block's documents and the messages to it."""
    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        out = step(left, right)
        textvec.give_back()
        return out

    right = messages.repartition(blocks, "block")
    return docs.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(whole, schema)


def on_buckets(messages: DataFrame, step: Callable[[pa.Table], pa.Table], buckets: int) -> DataFrame:
    """``step`` of all that was sent to a bucket."""

    def whole(sent: pa.Table) -> pa.Table:
        out = step(sent)
        textvec.give_back()
        return out

    return messages.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(whole, MESSAGE)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 64-bit keys, by their upper half; the lower half tells keys of a bucket apart."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def table_of(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS)], schema=FIELDS)


def messages_of(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(bucket, payload) of one kind, in the order of buckets."""
    rows = zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("payload").to_pylist())
    return sorted(((b, p) for k, b, p in rows if k == kind), key=lambda x: x[0])


def kept_rows(docs: pa.Table, messages: pa.Table, digest: str = "digest") -> pa.Table:
    """The documents of a block that stand for their class: one row each, in the order of (doc_id, digest)."""
    want = {(b, p) for b, p in messages_of(messages, FIRST)}
    at: dict[tuple[int, bytes], int] = {}
    for i, key in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column(digest).to_pylist())):
        if key in want:
            at.setdefault(key, i)
    return docs.take(pa.array([at[k] for k in sorted(at)], pa.int64()))
