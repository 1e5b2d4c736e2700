"""Benchmark decontamination by size-partitioned MinHash containment search.

An item of the benchmark leaks into a document when at least ``threshold`` of the
item's distinct five-word shingles occur in the document, however long that is.
Jaccard similarity cannot see a short item in a long document, so the MinHash here is
the one for sets of different sizes: a sketch keeps every shingle whose hash is below
a bound, not the k least, so that the sketch of the item and of the document under
the same bound meet exactly in the sketch of their intersection, and the share of an
item's sketch that a document has estimates the containment itself, without regard
to the document's size (Irber et al., "Lightweight compositional analysis of
metagenomes with FracMinHash and minimum metagenome covers", 2022).

Items are partitioned by size. Partition s takes the hashes below 2**64 / 4**s, and
an item belongs to the last partition in which its sketch still has ``SKETCH``
hashes; so items of a few shingles are sketched whole, and of the longest ones a few
dozen hashes of each are enough. A document is sketched under all bounds at once: a
shingle is in its sketches of the partitions up to the one that its hash allows.
The threshold on the containment becomes, for a sketch of m hashes, the least number
of hits that an item at the threshold falls short of with probability ``MISS`` at
most, by the binomial tail. Every candidate is then verified by exact containment of
its shingles as words, so false candidates cost time but change nothing.

The search: documents stream past a filter of all sketched hashes, which is a sorted
array up to ``FILTER_HASHES`` of them and a Bloom filter of fixed size beyond; a document
keeps the hashes that pass (few: an item has them too, or the Bloom filter errs, in
under 1 % of cases up to some 13 million hashes). A document with the hits that an
item asks for has at least one of all but ``needed`` - 1 of its hashes, so only these,
the ones that fewest items have, are joined by hash: a phrase that all items begin
with pairs nothing. Hits are then counted over the whole sketches, and the documents
with candidates are read once more for the verification. So the benchmark may have
any size: documents are read twice whatever it is, and no item is sent to all tasks.
Copies of a text are one document until the verification.

Defined results: words are runs of other than U+0009..U+000D and U+0020, with A-Z
lower-cased. An item of one to four words has one shingle, its whole sequence, and
leaks only into a document of just these words. Items or documents without words
(null text included) never match. Repeated item rows count once; repeated documents
are each reported. A null id is reported as null. Extra columns are ignored; an empty
table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .common import staged, text_key_column, with_small

WORDS, THRESHOLD = 5, 0.75
#: Least hashes in a sketch of a partition, and the bound on the chance that an item at the threshold is missed.
SKETCH, MISS = 32, 1e-9
#: Partitions: bounds fall by a factor of four from each to the next.
PARTITIONS = 20
#: Hashes that the filter holds one by one, and the bits of the Bloom filter beyond.
FILTER_HASHES, FILTER_BITS = 1 << 21, 1 << 28
#: Parts in which the candidates of one document are verified.
VERIFY_PARTS = 16

_U = np.uint64


def hits_needed(m: int, whole: bool, threshold: float = THRESHOLD) -> int:
    """Hits in a sketch of ``m`` hashes that make a candidate; a whole set is no sample and needs the threshold itself.

    Hits of an item at the threshold are hypergeometric, which has thinner tails
    than the binomial used here.
    """
    if whole:
        return max(1, -(-int(round(threshold * 100)) * m // 100))
    below = 0.0
    for h in range(m + 1):
        below += comb(m, h) * threshold**h * (1 - threshold) ** (m - h)
        if below > MISS:
            return max(1, h)
    return m


def partition_of(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Partition of an item by its sorted distinct hashes, and its sketch there."""
    last = 0, hashes
    for s in range(1, PARTITIONS):
        sketch = hashes[: np.searchsorted(hashes, _U((1 << 64) >> 2 * s))]
        if len(sketch) < SKETCH:
            break
        last = s, sketch
    return last


def exact_shingles(text: str | None, k: int = WORDS) -> set[tuple[bytes, ...]]:
    """The distinct shingles of a text, as words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def _hash_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, end, data, offsets in textvec.passes(texts):
        h, row, _ = textvec.Words(data, offsets).shingles(WORDS)
        h, at = textvec.distinct_by_row(h, row, end - first)
        yield from (h[a:b] for a, b in zip(at[:-1], at[1:]))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, text) -> item, partition, needed, sketch (all its hashes), rare (those that few items have, which are looked up)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [partition_of(h) for h in _hash_sets(batch.column("text"))]
            needed = [hits_needed(len(h), s == 0, threshold) for s, h in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array([s for s, _ in found], pa.int32()), pa.array(needed, pa.int32()), pa.array([h.astype(np.int64) for _, h in found], pa.list_(pa.int64()))],
                ["item", "partition", "needed", "sketch"],
            )

    made = staged(items.select("item", "text").mapInArrow(make, "item string, partition int, needed int, sketch array<long>"), "item-sketches")
    rows = made.select("item", "needed", F.size("sketch").alias("m"), F.explode("sketch").alias("hash"))
    often = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("often", "hash"))
    rare = rows.join(often, "hash").withColumn("rank", rank).where(F.col("rank") <= F.col("m") - F.col("needed") + 1)
    return staged(made.join(rare.groupBy("item").agg(F.collect_list("hash").alias("rare")), "item"), "sketches")


class Filter:
    """Which hashes any sketch has: exactly, or by a Bloom filter with two positions of the hash."""

    def __init__(self, sketched: DataFrame) -> None:
        self.last = _U(FILTER_BITS - 1)
        hashes = sketched.select(F.explode("sketch").alias("h")).distinct()
        self.sorted = self.bits = None
        if hashes.count() <= FILTER_HASHES:
            self.sorted = np.sort(hashes.toArrow().column("h").to_numpy().astype(np.int64).view(_U))
            self.seen = np.zeros(1 << 20, bool)
            self.seen[(self.sorted & _U((1 << 20) - 1)).astype(np.int64)] = True
            return
        places = [F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned("h", 28).bitwiseAND(F.lit(FILTER_BITS - 1))]
        at = hashes.select(F.explode(F.array(*places)).alias("p")).select(F.shiftright("p", 5).alias("word"), F.expr("shiftleft(1L, cast(p & 31 as int)) as bit"))
        words = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 32 rows
        self.bits = np.zeros(FILTER_BITS // 32, np.uint32)
        self.bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that pass."""
        if self.sorted is not None:
            some = np.flatnonzero(self.seen[(h & _U((1 << 20) - 1)).astype(np.int64)]) if len(self.sorted) else np.zeros(0, np.int64)
            own = h[some]
            return some[self.sorted[np.minimum(np.searchsorted(self.sorted, own), len(self.sorted) - 1)] == own] if len(some) else some
        ok = np.arange(len(h))
        for shift in (_U(0), _U(28)):
            p = ((h[ok] >> shift) & self.last).astype(np.int64)
            ok = ok[(self.bits[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) > 0]
        return ok


def candidates(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """(text_key, text) and sketches -> text_key, item: the pairs with the hits that the item asks for, once each."""
    known = Filter(sketched)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hits, at = [], [], 0
            for first, end, data, offsets in textvec.passes(batch.column("text")):
                h, row, _ = textvec.Words(data, offsets).shingles(WORDS)
                some = known.passes(h)
                h, at = textvec.distinct_by_row(h[some], row[some], end - first)
                for i in np.flatnonzero(np.diff(at)):
                    keys.append(first + int(i))
                    hits.append(h[at[i] : at[i + 1]].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("text_key").take(pa.array(keys, pa.int64())), pa.array(hits, pa.list_(pa.int64()))], ["text_key", "hits"])

    found = staged(docs.mapInArrow(passing, "text_key string, hits array<long>").dropDuplicates(["text_key"]), "shared-hashes")
    looked = sketched.select("item", F.explode("rare").alias("hash"))
    pairs = with_small(found.select("text_key", F.explode("hits").alias("hash")), looked, "hash").select("text_key", "item").distinct()
    # the document's hashes and the item's, side by side
    pairs = with_small(pairs.join(found, "text_key"), sketched.select("item", "needed", "sketch"), "item")
    return pairs.where(F.size(F.array_intersect("hits", "sketch")) >= F.col("needed")).select("text_key", "item")


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    numerator = int(round(threshold * 100))
    item_shingles = lru_cache(maxsize=4_096)(exact_shingles)
    last, have = None, set()
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):  # a row at a time, as texts can be long
            row = {c: batch.column(c)[i].as_py() for c in ("doc_id", "text_key", "items")}
            if row["text_key"] != last:
                last, have = row["text_key"], exact_shingles(batch.column("text")[i].as_py())
            for item in row["items"]:
                own = item_shingles(item["item_text"])
                n = len(own & have)
                if 100 * n >= numerator * len(own):
                    out.append((row["doc_id"], item["item_id"], n, len(own), row["text_key"]))
        columns = list(zip(*out)) or [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], ["doc_id", "item_id", "n_shared", "n_shingles", "text_key"])


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents, benchmark -> doc_id, item_id, n_shared, n_shingles, containment of each leak."""
    return keyed_leaks(docs, benchmark, threshold).drop("text_key")


def keyed_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``leaks`` with the key of the document's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key_column().alias("text_key"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).distinct()
    items = items.withColumn("item", F.md5(F.to_json(F.struct("item_id", "text"))))
    found = candidates(docs.select("text_key", "text"), sketches(items, threshold))
    told = found.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    part = F.pmod(F.xxhash64("item"), F.lit(VERIFY_PARTS)).alias("part")
    told = staged(told.groupBy("text_key", part).agg(F.collect_list(F.struct("item_id", "item_text")).alias("items")).drop("part"), "candidates")
    both = with_small(docs, told, "text_key").select("doc_id", "text_key", "text", "items")
    verified = both.mapInArrow(lambda batches: _verified(batches, threshold), "doc_id long, item_id long, n_shared long, n_shingles long, text_key string")
    return verified.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents into which no item leaks, by their texts, whatever their doc_id."""
    leaking = staged(keyed_leaks(docs, benchmark, threshold).select(F.col("text_key").alias("_key")).distinct(), "leaking-texts")
    keyed = docs.withColumn("_key", text_key_column())
    return with_small(keyed, leaking, "_key", "left_anti").select(docs.columns)


#: DuckDB SQL over ``docs`` (a relation with doc_id, text) for the rows of ``leaks``.
def leaks_sql(docs: str = "documents") -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+')"
    shingles = "case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end"
    return f"""
with dw as (select doc_id, {words} as w from {docs}),
  iw as (select distinct item_id, {words} as w from benchmark),
  d as (select distinct doc_id, unnest({shingles}) as s, case when len(w) < 5 then len(w) else 5 end as k from dw),
  i as (select distinct item_id, unnest({shingles}) as s, case when len(w) < 5 then len(w) else 5 end as k from iw),
  n as (select item_id, count(*) as n_shingles from i group by item_id),
  m as (select doc_id, item_id, count(*) as n_shared from d join i on d.s = i.s and d.k = i.k group by doc_id, item_id)
select doc_id, item_id, n_shared, n_shingles, round(n_shared / n_shingles, 6) as containment
from m join n using (item_id) where 100 * n_shared >= 75 * n_shingles
"""
