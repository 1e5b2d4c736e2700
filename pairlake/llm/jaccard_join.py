"""N-gram Jaccard join by rare-first prefix filtering, and its connected groups.

Two documents link when the Jaccard similarity of their sets of distinct five-word
shingles is 0.75 or more. Equal word sequences are one class from the start. The
shingles of a class are ordered by how many classes have them, rarest first; a pair
that links must share one of the first n/4 + 1 of both (prefix filter), and a
shingle that only one class has can't be shared, so a class whose prefix is all of
such shingles has no partner and is done. The others post their prefixes. Pairs met
in a posting list pass the length filter and the positional filter in the join, the
suffix filter before the shingle sets are intersected, and each is verified once.

Groups need no pair twice over: in rounds, each class is paired with the one pivot
that it shares most postings with (of a list, the class with the least share of
shingles of its own is the pivot), links are merged into components, and only lists
that still hold several components go on, with other pivots. What is left after the
rounds is joined in full: all pairs of different components in a list, from the side
of those outside the list's largest component. So no link is lost, and a large group
of near copies costs a few pairs per member instead of all pairs.

Counts of classes per shingle are exchanged as packed keys between blocks of
documents and buckets of shingles (see ``blocked``); their 32-bit halves can only
merge two shingles' counts, which changes the order, the same for all, but not the
result. Shingles are compared by 64-bit hashes.

Defined results: words are runs of other than U+0009..U+000D and U+0020, A-Z
lower-cased. One to four words make one shingle, the whole sequence. A document
without words or with a null text has an empty set, is linked with nothing and is
its own component. A null doc_id counts as 2**63 - 1, larger than every other, and is
reported as null; a component has that id if a document of that id is in it, and
null if all its ids are null. Counts of classes per shingle are exact up to 65 535 and
stand at that beyond, which changes only the order among the very commonest. Repeated rows link like any equal texts; different texts with one doc_id are
different documents. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocked, textvec
from .common import blocks_for, cut, staged, text_key, text_key_column, with_small
from .components import components
from .repeats import NO_ID

WORDS = 5
#: Rounds with pivots before what is left is joined in full.
ROUNDS = 3

_U = np.uint64


def enough(shared, n_a, n_b):
    """100 * intersection >= 75 * union, in whole numbers: for columns and for integers."""
    return 7 * shared >= 3 * (n_a + n_b)


def _digest_column(w: textvec.Words) -> list[bytes]:
    a, b = w.digests()
    raw = np.stack([a, b], axis=1).astype("<u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests: list[bytes] = []
        counts = [np.zeros(0, np.int64)]
        for _, _, data, offsets in textvec.passes(batch.column("text")):
            w = textvec.Words(data, offsets)
            digests += _digest_column(w)
            counts.append(w.counts())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("no_id"), pa.array(digests, pa.binary()), pa.array(np.concatenate(counts), pa.int64()), pa.array([text_key(t.as_py()) for t in batch.column("text")], pa.string())], ["doc_id", "no_id", "digest", "n_words", "text_key"])


def _sets(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, end to end, and the rows' offsets."""
    parts, sizes = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for first, end, data, offsets in textvec.passes(docs.column("text")):
        h, row, _ = textvec.Words(data, offsets).shingles(WORDS)
        h, at = textvec.distinct_by_row(h, row, end - first)
        parts.append(h)
        sizes.append(np.diff(at))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _firsts_of(docs: pa.Table, messages: pa.Table) -> pa.Table:
    digests = [d for _, _, data, offsets in textvec.passes(docs.column("text")) for d in _digest_column(textvec.Words(data, offsets))]
    return blocked.kept_rows(docs.append_column("digest", pa.array(digests, pa.binary())), messages)


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and lower half of a hash in one word."""
    return (blocked.bucket_of(h, buckets) << _U(32)) | (h & _U(0xFFFFFFFF))


def _edges(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    b = (keys >> _U(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(b, prepend=-1)) if len(b) else []
    for i, j in zip(starts, [*starts[1:], len(b)]):
        yield int(b[i]), int(i), int(j)


def _send(buckets: int):
    """Each distinct shingle of a block once; counts where two of its classes or more have it."""

    def step(docs: pa.Table, messages: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return blocked.table_of([])
        keys, counts = np.unique(_short(_sets(_firsts_of(docs, messages))[0], buckets), return_counts=True)
        out = []
        for bucket, i, j in _edges(keys):
            packed = textvec.pack((keys[i:j] & _U(0xFFFFFFFF)).astype(np.uint32))
            many = np.flatnonzero(counts[i:j] > 1).astype(np.uint32)
            raw = np.int64([len(packed)]).tobytes() + packed + many.tobytes() + counts[i:j][many].astype(np.uint32).tobytes()
            out.append((docs.column("block")[0].as_py(), 0, bucket, raw))
        return blocked.table_of(out)

    return step


def _count(messages: pa.Table) -> pa.Table:
    """Answer: for each shingle that a block sent, in order, whether two classes or more have it, and then how many."""
    sent = sorted(zip(messages.column("block").to_pylist(), messages.column("bucket").to_pylist(), messages.column("payload").to_pylist()))
    values, counts = [], []
    for _, _, raw in sent:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        v = textvec.unpack(raw[8 : 8 + n])
        many, times = np.frombuffer(raw, np.uint32, -1, 8 + n).reshape(2, -1)
        c = np.ones(len(v), np.int64)
        c[many] = times
        values.append(v)
        counts.append(c)
    seen, which = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)
    out = []
    for (block, bucket, _), v in zip(sent, values):
        n = np.minimum(total[np.searchsorted(seen, v)], 65535)
        out.append((block, blocked.ANSWER, bucket, np.packbits(n > 1).tobytes() + n[n > 1].astype(np.uint16).tobytes()))
    return blocked.table_of(out)


SETS = "doc long, first long, digest binary, n long, post array<long>, pos array<int>, shared binary"


def _post(buckets: int):
    """A row per class, named by half its digest: set size; and if its prefix has shingles of other classes, these and its shared shingles."""

    def step(docs: pa.Table, messages: pa.Table) -> pa.Table:
        docs = _firsts_of(docs, messages) if docs.num_rows else docs.append_column("digest", pa.array([], pa.binary()))
        h, at = _sets(docs)
        short = _short(h, buckets)
        keys = np.unique(short)
        frequency = np.ones(len(keys), np.int64)
        answers = dict(blocked.messages_of(messages, blocked.ANSWER))
        for bucket, i, j in _edges(keys):
            bits = -(-(j - i) // 8)
            many = np.unpackbits(np.frombuffer(answers[bucket], np.uint8, bits), count=j - i).astype(bool)
            frequency[i:j][many] = np.frombuffer(answers[bucket], np.uint16, -1, bits)
        common = frequency[np.searchsorted(keys, short)] if len(h) else np.zeros(0, np.int64)
        post, pos, shared = [], [], []
        for a, b in zip(at[:-1], at[1:]):
            n, alone = int(b - a), int((common[a:b] == 1).sum())
            prefix = n // 4 + 1
            if alone >= prefix or not n:
                post.append(None), pos.append(None), shared.append(None)
                continue
            order = np.lexsort((h[a:b], common[a:b]))[alone:prefix]
            post.append(h[a:b][order].astype(np.int64))
            pos.append(np.arange(alone, prefix, dtype=np.int32))
            shared.append(h[a:b][common[a:b] > 1].tobytes())
        return pa.Table.from_arrays(
            [
                pa.array([int.from_bytes(d[:8], "little", signed=True) for d in docs.column("digest").to_pylist()], pa.int64()),
                docs.column("doc_id"), docs.column("digest"), pa.array(np.diff(at), pa.int64()),
                pa.array(post, pa.list_(pa.int64())), pa.array(pos, pa.list_(pa.int32())), pa.array(shared, pa.binary()),
            ],
            ["doc", "first", "digest", "n", "post", "pos", "shared"],
        )

    return step


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the overlap of two sorted sets: split both at y's middle, add the lesser halves."""
    if not depth or len(x) < 8 or len(y) < 8:
        return min(len(x), len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    return suffix_bound(x[:at], y[:middle], depth - 1) + suffix_bound(x[at:], y[middle:], depth - 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        keep = []
        for n_a, n_b, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "x", "y"))):
            x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
            keep.append(enough(suffix_bound(x, y), n_a, n_b) and enough(len(np.intersect1d(x, y, assume_unique=True)), n_a, n_b))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) pairs of classes -> those that link."""
    x = sets.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("x"))
    y = sets.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("y"))
    return with_small(x, pairs, "a").join(y, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(_verified, "a long, b long")


def _filters(n_a: Column, n_b: Column, i: Column, j: Column) -> Column:
    """Length filter, and positional filter: true for a linked pair at its first shingle in common."""
    return enough(F.least(n_a, n_b), n_a, n_b) & enough(F.least(n_a - i, n_b - j), n_a, n_b)


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the components that links join."""
    one = labels.select(F.col("doc").alias("a"), F.col("comp").alias("comp_a"))
    two = labels.select(F.col("doc").alias("b"), F.col("comp").alias("comp_b"))
    edges = with_small(with_small(links, one, "a"), two, "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    roots = components(edges).withColumnRenamed("node", "comp")
    return cut(with_small(labels, roots, "comp", "left").select("doc", F.coalesce("root", "comp").alias("comp")))


def _grouped(sets: DataFrame) -> DataFrame:
    """(doc, comp): the component of each class that posts."""
    posting = sets.where(F.col("post").isNotNull())
    lists = posting.select("doc", "n", (F.get("pos", F.lit(0)) / F.col("n")).alias("own"), F.explode(F.arrays_zip("post", "pos")).alias("p"))
    lists = lists.select("doc", "n", "own", F.col("p.post").alias("token"), F.col("p.pos").alias("pos"))
    labels = cut(posting.select("doc", F.col("doc").alias("comp")))
    tried = None

    def new(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))

    k = 0
    while k <= ROUNDS:
        now = with_small(lists, labels, "doc")
        # the first pivot of a list has the least share of shingles of its own: of near copies, that
        # is the one nearest to what they were made from; later ones are so among a part of the list
        part = F.pmod(F.xxhash64("doc", F.lit(k)), F.lit(4 if k else 1))
        key = F.struct(part.alias("h"), "own", F.col("doc").alias("p_doc"), F.col("n").alias("p_n"), F.col("pos").alias("p_pos"), F.col("comp").alias("p_comp"))
        pivots = now.groupBy("token").agg(F.min(key).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        if k < ROUNDS:
            met = now.join(pivots.select("token", "p.*"), "token").where(F.col("comp") != F.col("p_comp"))
            met = met.where(_filters(F.col("n"), F.col("p_n"), F.col("pos"), F.col("p_pos")))
            votes = met.groupBy("doc", "p_doc").agg(F.count(F.lit(1)).alias("votes"))
            if tried is not None:
                votes = votes.withColumns({"a": F.least("doc", "p_doc"), "b": F.greatest("doc", "p_doc")}).join(tried, ["a", "b"], "left_anti")
            pairs = votes.groupBy("doc").agg(F.max_by("p_doc", F.struct("votes", "p_doc")).alias("b")).withColumnRenamed("doc", "a")
        else:
            left = now.join(pivots.select("token"), "token", "left_semi")
            counts = left.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("held"))
            main = counts.groupBy("token").agg(F.max_by("comp", F.struct("held", "comp")).alias("main"))
            left = left.join(main, "token")
            few = left.where(F.col("comp") != F.col("main")).select("token", *[F.col(c).alias(f"l_{c}") for c in ("doc", "n", "pos", "comp")])
            met = few.join(left, "token").where((F.col("comp") != F.col("l_comp")) & ((F.col("comp") == F.col("main")) | (F.col("l_doc") < F.col("doc"))))
            met = met.where(_filters(F.col("n"), F.col("l_n"), F.col("pos"), F.col("l_pos")))
            pairs = met.select(F.col("l_doc").alias("a"), F.col("doc").alias("b"))
        pairs = new(pairs)
        if pairs.isEmpty():  # pivots have nothing left to tell
            k = ROUNDS if k < ROUNDS else ROUNDS + 1
            continue
        links = cut(verify(pairs, posting))
        labels = _relabelled(labels, links)
        tried = pairs if tried is None else tried.unionByName(pairs)
        k += 1
    return labels


def groups(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id."""
    members = _members(docs).withColumns({"least": F.coalesce("root", "first", "doc_id"), "g": _group()})
    if docs.where(F.col("doc_id") == NO_ID).isEmpty():
        real = F.col("least") != NO_ID
    else:  # that id is in use: a component has it if one of its documents does
        own = members.where((F.col("least") == NO_ID) & ~F.col("no_id")).select("g").distinct()
        members = members.join(own.withColumn("real", F.lit(True)), "g", "left")
        real = (F.col("least") != NO_ID) | F.col("real")
    return members.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(real, F.col("least")).alias("component_id"),
    )


def _group() -> Column:
    """A name for the component of a row of ``_members``; rows without words are grouped by doc_id and text."""
    return F.coalesce(F.col("comp").cast("string"), F.col("doc").cast("string"), F.concat_ws(":", "doc_id", "text_key"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all columns: least doc_id (nulls last), then least key of its text.

    Rows without words are grouped by doc_id and text.
    """
    first = _members(docs).groupBy(_group().alias("g")).agg(F.min(F.struct("doc_id", "text_key")).alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r.text_key").alias("_key"))
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_key": text_key_column()})
    return keyed.join(first, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select(docs.columns)


def _members(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID for null), no_id, text_key, and of the row's class: doc, first, n, comp, root."""
    n = blocks_for(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    members = rows.mapInArrow(_keyed, "doc_id long, no_id boolean, digest binary, n_words long, text_key string")
    classes = members.where("n_words > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    texts = blocked.dealt(rows.drop("no_id"), n)
    first = blocked.firsts(classes, n)
    sent = blocked.on_blocks(texts, first, _send(n), blocked.MESSAGE, n)
    known = first.unionByName(blocked.on_buckets(sent, _count, n))
    sets = staged(blocked.on_blocks(texts, known, _post(n), SETS, n), "shingle-sets")
    labels = _grouped(sets)
    named = sets.select("doc", "first").join(labels, "doc")
    roots = named.groupBy("comp").agg(F.min("first").alias("root"))
    known = sets.select("digest", "doc", "first", "n").join(labels.join(roots, "comp").select("doc", "comp", "root"), "doc", "left")
    return members.join(known, "digest", "left")


def groups_sql(docs: str = "documents") -> str:
    """DuckDB SQL for the rows of ``groups``."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shingles = "case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end"
    return f"""
with recursive w as (select doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') as w from {docs}),
  s as (select distinct doc_id, unnest({shingles}) as s, case when len(w) < 5 then len(w) else 5 end as k from w),
  n as (select doc_id, count(*) as n from s group by doc_id),
  both_have as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
  links as (select a, b from both_have join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
  reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
  least_of as (select a, min(b) as m from reach group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id left join least_of on a = w.doc_id
"""
