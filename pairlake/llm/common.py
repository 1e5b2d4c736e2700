"""Helpers shared by the operators: inputs, scratch space, arithmetic."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words: U+0009 to U+000D and U+0020.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names.

    Where none is named, a local session, whose executors are this machine, gets one of
    its own; on a cluster that would lose data with an executor, so it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = named or f"/tmp/checkpoints/pairlake-{os.getpid()}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a wide intermediate table to the shared folder and read it back.

    Parquet is several times smaller than a checkpoint of the same rows; a lost
    executor only costs the tasks that it ran. ``discard`` removes the table again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/pairlake-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that each application has staged and not discarded.
_written: dict[str, list[str]] = {}


def written(spark: SparkSession) -> int:
    """How many tables this application has staged and not discarded."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> int:
    """Remove the tables that were staged after the first ``since``, but for those that a table is read from; how many.

    Results are lazy: call it when all that was made of these tables is written.
    """
    bare = lambda p: p.split(":", 1)[-1].lstrip("/")
    keep = {bare(f).rsplit("/", 1)[0] for f in but.inputFiles()} if but is not None else set()
    own = _written.get(spark.sparkContext.applicationId, [])
    gone = [p for p in own[since:] if bare(p) not in keep]
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        own.remove(path)
    return len(gone)


def text_key(text: str | None) -> str:
    """Name of a text as ``text_key_column`` gives it; a null text is as an empty one."""
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest()


def text_key_column(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def blocks_for(docs: DataFrame, text: str = "text", target: int = 8 << 20, least: int = 64) -> int:
    """A number of blocks such that each holds about ``target`` bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(max(least, -(-total // target)))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and give it to ``body`` as a variable.

    Catalyst may copy an expression into every place that names it; inside a
    lambda that would evaluate it once per element.
    """
    return F.transform(F.array(value), body)[0]


#: Rows of a small table that may be sent to every task, if they also have fewer bytes than the second bound.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20
#: Parts of each key's rows where a table is too large to be sent.
SALTS = 16


def with_small(rows: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join a table that is usually small and cheap to count, without nulls in its key.

    Below BROADCAST_ROWS and BROADCAST_BYTES, both measured, it is broadcast.
    Beyond, the join is a shuffle in which each key's rows are dealt to SALTS tasks, so
    that a key with a third of all rows does not land in one.
    """
    return beside(rows, small, key, fits(small), how)


def beside(rows: DataFrame, small: DataFrame, key: str | list[str], sent: bool, how: str = "inner") -> DataFrame:
    """The join of ``with_small`` for a table whose size is known: ``sent`` tells whether it is below the bounds."""
    keys = [key] if isinstance(key, str) else key
    if sent:
        return rows.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    others = [F.col(c) for c in rows.columns if c not in keys] or [F.lit(0)]
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "_salt"], how).drop("_salt")


def fits(small: DataFrame) -> bool:
    """Whether a table is below both bounds, its strings, lists and structs measured as they would be written out."""
    n = small.count()
    if n > BROADCAST_ROWS:
        return False
    wide = [c for c, kind in small.dtypes if kind in ("string", "binary") or kind.startswith(("array", "struct", "map"))]
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct(*wide))))).first()[0] if n and wide else 0
    return (size or 0) + 8 * n * len(small.columns) <= BROADCAST_BYTES
