"""Suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered only through their first 50 bytes, by most-significant-digit
passes over 8-byte digits; the groups that are still equal after the last digit are
exactly the repeated 50-byte strings. A byte is removed when it is covered by such a
string that also starts in a document with a smaller doc_id.

The distributed form: each string belongs to its minimizer, the least hash among the
24-byte grams inside it, so equal strings always meet in the bucket of the same
gram. A first round exchanges only the distinct grams of each block and leaves those
that occur in more than one document; the strings around them, as runs that share
their minimizer (49 bytes longer than the number of strings), are then sent to the
gram's bucket, once per block with the least doc_id, and sorted there. Strings of
grams that occur in a large share of all blocks are dealt by a hash of the whole
string instead, so that no common passage gathers its surroundings in one bucket.
Equal texts are reduced to the first document beforehand.

Defined results: a null text is empty. Texts under 50 bytes lose nothing. A null
doc_id counts as 2**63 - 1, larger than every other. Documents with the same doc_id are not
smaller than each other, so none of them is removed for the other. Repeated rows
each get their row. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocked, textvec
from .common import blocks_for

#: Bytes of a repeated string, and of the grams that are its possible minimizers.
LENGTH, GRAM = 50, 24
NO_ID = (1 << 63) - 1
RESULT = "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_U = np.uint64
#: Text in a block, and parts of a bucket that are sorted apart: bounds of a worker's memory.
BLOCK_BYTES, PARTS = 4 << 20, 8


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        a = pick(a[:-have], a[have:])
        have *= 2
    return pick(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


class Grams:
    """Of a pass: the minimizer of each string that lies in one row, and runs of strings that share it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        n, width = len(data), length - GRAM + 1
        self.keys = np.zeros(0, _U)
        self.starts = self.ends = self.rows = np.zeros(0, np.int64)
        if n < length:
            return
        up, down = textvec.powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, _U)
            np.cumsum(textvec._BYTE[data] * up[:n], out=sums[1:])
            grams = textvec.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        self.sums, self.down = sums, down
        least = _sliding(grams, width, np.minimum)
        inside = np.zeros(len(least) + 1, np.int64)
        full = np.flatnonzero(np.diff(offsets) >= length)
        inside[offsets[full]] += 1
        np.subtract.at(inside, offsets[full + 1] - length + 1, 1)
        valid = np.cumsum(inside[:-1]) > 0
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        first = np.zeros(len(least), bool)
        first[offsets[full]] = True
        starts = np.flatnonzero(valid & (new | first))
        stop = np.ones(len(least), bool)
        stop[:-1] = new[1:] | first[1:] | ~valid[1:]
        ends = np.flatnonzero(valid & stop) + 1
        # where a gram repeats, as in a run of one letter, a run can be longer than a gram's reach
        pieces = -(-(ends - starts) // width)
        which = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.starts = starts[which] + nth * width
        self.ends = np.minimum(self.starts + width, ends[which])
        self.keys = least[self.starts]
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1

    def string_hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return textvec.mix((self.sums[at + length] - self.sums[at]) * self.down[at] ^ _U(0x5EED))


def _passes(docs: pa.Table, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, Grams]]:
    for first, _, data, offsets in textvec.passes(docs.column("text")):
        yield first, data, offsets, Grams(data, offsets, length)


def _split(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted distinct keys by bucket: (bucket, their lower halves)."""
    b = blocked.bucket_of(keys, buckets)
    edges = np.flatnonzero(np.diff(b, prepend=-1)) if len(keys) else []
    for i, j in zip(edges, [*edges[1:], len(keys)]):
        yield int(b[i]), np.unique((keys[i:j] & _U(0xFFFFFFFF)).astype(np.uint32))


def _block_keys(docs: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct minimizers, and whether two of its documents have them."""
    found, owners = [], []
    for first, _, _, grams in _passes(docs, length):
        if len(grams.keys):
            found.append(grams.keys)
            owners.append(grams.rows + first)
    if not found:
        return np.zeros(0, _U), np.zeros(0, bool)
    keys, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(keys, kind="stable")  # rows stay in order
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(keys)) - 1
    return keys[starts], owner[starts] != owner[last]


def _send_keys(buckets: int, length: int):
    def step(docs: pa.Table, messages: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return blocked.table_of([])
        block = docs.column("block")[0].as_py()
        keys, _ = _block_keys(blocked.kept_rows(docs, messages), length)
        return blocked.table_of([(block, 0, b, textvec.pack(low)) for b, low in _split(keys, buckets)])

    return step


def _compare_keys(blocks: int):
    """Answer: for each key that a block sent, in order, two bits: another block has it; it is hot."""

    def step(messages: pa.Table) -> pa.Table:
        sent = sorted(zip(messages.column("block").to_pylist(), messages.column("bucket").to_pylist(), messages.column("payload").to_pylist()))
        values = [textvec.unpack(p) for _, _, p in sent]
        seen, times = np.unique(np.concatenate(values), return_counts=True)
        out = []
        for (block, bucket, _), v in zip(sent, values):
            n = times[np.searchsorted(seen, v)]
            bits = np.packbits(np.stack([n > 1, n >= max(16, blocks // 4)]))
            out.append((block, blocked.ANSWER, bucket, bits.tobytes()))
        return blocked.table_of(out)

    return step


def _shared(docs: pa.Table, messages: pa.Table, buckets: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's minimizers that two documents or more have, sorted, and which of them are hot."""
    keys, twice = _block_keys(docs, length)
    answers = dict(blocked.messages_of(messages, blocked.ANSWER))
    hot = np.zeros(len(keys), bool)
    b, low = blocked.bucket_of(keys, buckets), (keys & _U(0xFFFFFFFF)).astype(np.uint32)
    edges = np.flatnonzero(np.diff(b, prepend=-1)) if len(keys) else []
    for i, j in zip(edges, [*edges[1:], len(keys)]):
        sent = np.unique(low[i:j])
        bits = np.unpackbits(np.frombuffer(answers[int(b[i])], np.uint8), count=2 * len(sent)).reshape(2, -1).astype(bool)
        place = np.searchsorted(sent, low[i:j])
        twice[i:j] |= bits[0][place]
        hot[i:j] = bits[1][place]
    return keys[twice], hot[twice]


class Records:
    """The distinct runs of strings that a block sends, and where they occur in it."""

    def __init__(self, docs: pa.Table, messages: pa.Table, buckets: int, length: int) -> None:
        keys, hot = _shared(docs, messages, buckets, length)
        width = 2 * length - GRAM
        ids = np.array(docs.column("doc_id").to_pylist(), np.int64)
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("bytes", "row", "at", "count", "bucket")}
        for first, data, offsets, grams in _passes(docs, length):
            if not len(grams.keys) or not len(keys):
                continue
            place = np.minimum(np.searchsorted(keys, grams.keys), len(keys) - 1)
            use = keys[place] == grams.keys
            starts, ends, rows, key, is_hot = grams.starts[use], grams.ends[use], grams.rows[use], grams.keys[use], hot[place[use]]
            bucket = blocked.bucket_of(key, buckets).astype(np.int64)
            if is_hot.any():  # each string for itself
                n = (ends - starts)[is_hot]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[is_hot], n)
                own = blocked.bucket_of(grams.string_hashes(at, length), buckets).astype(np.int64)
                starts, ends = np.concatenate([starts[~is_hot], at]), np.concatenate([ends[~is_hot], at + 1])
                rows = np.concatenate([rows[~is_hot], np.repeat(rows[is_hot], n)])
                bucket = np.concatenate([bucket[~is_hot], own])
            if not len(starts):
                continue
            size = ends - starts + length - 1
            padded = np.concatenate([data, np.zeros(width, np.uint8)])
            text = np.lib.stride_tricks.sliding_window_view(padded, width)[starts].copy()
            text[np.arange(width) >= size[:, None]] = 0
            parts["bytes"].append(np.concatenate([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), size.astype(np.uint8)[:, None], text], axis=1))
            parts["row"].append(rows + first)
            parts["at"].append(starts - offsets[rows])
            parts["count"].append(ends - starts)
        self.n = 0
        if not parts["row"]:
            return
        whole = np.ascontiguousarray(np.concatenate(parts["bytes"]))
        self.row, self.at, self.count = (np.concatenate(parts[k]) for k in ("row", "at", "count"))
        distinct, self.record = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_inverse=True)
        self.n = len(distinct)
        flat = distinct.view(np.uint8).reshape(self.n, -1)
        self.bucket = flat[:, :4].copy().view(">u4").ravel().astype(np.int64)
        self.size, self.text = flat[:, 4].astype(np.int64), flat[:, 5:]
        self.least = np.full(self.n, NO_ID, np.int64)
        np.minimum.at(self.least, self.record, ids[self.row])

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1)) if self.n else []
        for i, j in zip(edges, [*edges[1:], self.n]):
            yield int(self.bucket[i]), int(i), int(j)


def squeeze(raw: bytes) -> bytes:
    """Length and compressed bytes: long strings travel once per block, so they are worth it."""
    return np.int64([len(raw)]).tobytes() + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unsqueeze(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int(np.frombuffer(packed, np.int64, 1)[0]), asbytes=True)


def _send_strings(buckets: int, length: int):
    def step(docs: pa.Table, messages: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return blocked.table_of([])
        block, out = docs.column("block")[0].as_py(), []
        records = Records(blocked.kept_rows(docs, messages), messages, buckets, length)
        for bucket, i, j in records.by_bucket():
            size = records.size[i:j]
            text = records.text[i:j][np.arange(records.text.shape[1]) < size[:, None]]
            raw = np.int64([j - i]).tobytes() + size.astype(np.uint8).tobytes() + records.least[i:j].tobytes() + text.tobytes()
            out.append((block, 0, bucket, squeeze(raw)))
        return blocked.table_of(out)

    return step


def radix_groups(digits: Iterator[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over ``n`` strings: the members of groups of two or more, and their group.

    After each digit, strings that are alone in their group are settled and leave.
    """
    alive, group = np.arange(n), np.zeros(n, np.int64)
    for digit in digits:
        own = digit[alive]
        order = np.lexsort((own, group))
        alive, group, own = alive[order], group[order], own[order]
        new = np.ones(len(alive), bool)
        new[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        alive, group = alive[many], group[many]
        if not len(alive):
            break
    return alive, group


def _compare_strings(length: int):
    """Answer: for each string of each record that a block sent, a bit: a smaller document has it."""

    def step(messages: pa.Table) -> pa.Table:
        sent = sorted(zip(messages.column("block").to_pylist(), messages.column("bucket").to_pylist(), messages.column("payload").to_pylist()))
        sizes, leasts, texts = [], [], []
        for _, _, payload in sent:
            raw = unsqueeze(payload)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            sizes.append(np.frombuffer(raw, np.uint8, n, 8).astype(np.int64))
            leasts.append(np.frombuffer(raw, np.int64, n, 8 + n))
            texts.append(np.frombuffer(raw, np.uint8, -1, 8 + 9 * n))
        size, least, text = np.concatenate(sizes), np.concatenate(leasts), np.concatenate(texts)
        del texts
        count = size - length + 1
        starts = np.cumsum(size) - size
        record = np.repeat(np.arange(len(size), dtype=np.int32), count)
        at = (np.arange(count.sum(), dtype=np.int64) - np.repeat(np.cumsum(count) - count - starts, count)).astype(np.int32)
        # eight bytes at any place as one big-endian number, read where they stand
        eights = np.ndarray(len(text) - 7, ">u8", text, strides=(1,))
        part = (textvec.mix(eights[at].astype(_U)) % _U(PARTS)).astype(np.uint8)
        smaller = np.zeros(len(at), bool)
        for p in range(PARTS):  # the first digit deals strings to parts, which are sorted one by one
            own = np.flatnonzero(part == p)
            here, owner = at[own], least[record[own]]
            places = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
            member, group = radix_groups((eights[here + d].astype(_U) for d in places), len(own))
            if len(member):
                least_of = np.full(group[-1] + 1, NO_ID, np.int64)
                np.minimum.at(least_of, group, owner[member])
                smaller[own[member]] = least_of[group] < owner[member]
        out, i = [], 0
        for (block, bucket, _), s in zip(sent, sizes):
            j = i + int((s - length + 1).sum())
            out.append((block, blocked.SECOND_ANSWER, bucket, np.packbits(smaller[i:j]).tobytes()))
            i = j
        return blocked.table_of(out)

    return step


def removed_spans(docs: pa.Table, messages: pa.Table, buckets: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each document of a block that loses something: (row, starts, ends) of its removed runs."""
    records = Records(docs, messages, buckets, length)
    if not records.n:
        return
    ids = np.array(docs.column("doc_id").to_pylist(), np.int64)
    answers = dict(blocked.messages_of(messages, blocked.SECOND_ANSWER))
    strings = records.size - length + 1
    smaller = np.zeros(int(strings.sum()), bool)
    base = np.cumsum(strings) - strings
    for bucket, i, j in records.by_bucket():
        n = int(strings[i:j].sum())
        smaller[base[i] : base[i] + n] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=n)
    n = records.count
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    record, row = np.repeat(records.record, n), np.repeat(records.row, n)
    gone = smaller[base[record] + step] | (ids[row] > records.least[record])
    row, at = row[gone], (np.repeat(records.at, n) + step)[gone]
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    edges = np.flatnonzero(np.diff(row[first], prepend=-1)) if len(first) else []
    for i, j in zip(edges, [*edges[1:], len(first)]):
        yield int(row[first[i]]), at[first[i:j]], at[last[i:j]] + length


def _cut(buckets: int, length: int):
    def step(docs: pa.Table, messages: pa.Table) -> pa.Table:
        docs = blocked.kept_rows(docs, messages) if docs.num_rows else docs
        texts = [t.encode("utf-8", "surrogatepass") for t in docs.column("text").to_pylist()]
        removed = [(0, 0)] * len(texts)
        kept = list(texts)
        for row, starts, ends in removed_spans(docs, messages, buckets, length) if texts else ():
            removed[row] = (int((ends - starts).sum()), len(starts))
            edges = [0, *(int(x) for pair in zip(starts, ends) for x in pair), len(texts[row])]
            kept[row] = b"".join(texts[row][a:b] for a, b in zip(edges[::2], edges[1::2]))
        return pa.Table.from_arrays(
            [
                docs.column("digest"), pa.array([len(t) for t in texts], pa.int64()), pa.array([r[0] for r in removed], pa.int64()),
                pa.array([r[1] for r in removed], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ],
            ["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return step


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    n = blocks_for(docs, target=BLOCK_BYTES)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    texts = blocked.dealt(rows.drop("no_id"), n)
    first = blocked.firsts(classes, n)
    keys = blocked.on_blocks(texts, first, _send_keys(n, length), blocked.MESSAGE, n)
    known = first.unionByName(blocked.on_buckets(keys, _compare_keys(n), n))
    strings = blocked.on_blocks(texts, known, _send_strings(n, length), blocked.MESSAGE, n)
    known = known.unionByName(blocked.on_buckets(strings, _compare_strings(length), n))
    result = blocked.on_blocks(texts, known, _cut(n, length), RESULT, n)
    copy = F.col("doc_id") != F.col("first_id")
    whole = copy & (F.col("n_bytes") >= length)
    return (
        rows.select("doc_id", "no_id", "digest")
        .join(classes.select("digest", F.col("doc_id").alias("first_id")), "digest")
        .join(result, "digest")
        .select(
            F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(whole, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
            F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        )
    )
