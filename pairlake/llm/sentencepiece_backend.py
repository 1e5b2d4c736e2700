"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed here (four wire types, five messages), and rebuilt as
a tokenizers pipeline: normaliser (the precompiled character map, white-space rules,
dummy prefix), metaspace marker, the model (unigram with its scores, or BPE whose
merges follow from the scores) and byte fallback, and a decoder that undoes them.
Batches are encoded by the library's own threads, in a Spark worker as many as its task
has cores.

With ``whole``, as the query and the pipeline ask, each text goes through both libraries
as a whole: its ids are the encoding of the whole text, ``text_parity`` tells whether the
original library gives the same, ``text_round_trip`` whether decoding them gives the text
back. A text is then one word, so ``word_parity`` and ``word_round_trip`` say the same.

Without it: when no piece has a marker after another character, no piece can span the
start of a word, so the encoding of a text is the encodings of its words one after
another. A worker then encodes each distinct word once, and parity with the original
library and decoding are verified on these distinct words (``word_parity`` and
``word_round_trip`` tell whether that holds for all words of a text); only one text in
``SAMPLED``, by a checksum of the text, is verified as a whole (``text_parity``,
``text_round_trip``; null for the others). For other models a text is one word anyway.

A worker remembers words in two generations of ``KNOWN_BYTES`` / 2 each (when the
younger is full, the older goes; a word that is used again is young again), and none of
more than ``LONG_WORD`` characters, so texts without spaces, which are single words, do
not add up. A batch holds about ``BATCH_CHARS`` characters of text, or one longer text.

Defined results: a null text is encoded as the empty text, to no ids, and its null
doc_id is reported as such. Decoding gives the normalised text; a text that has the
marker itself decodes to a space there and does not round-trip. Repeated rows are each
encoded. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
VERIFIED = ("word_parity", "word_round_trip", "text_parity", "text_round_trip")
#: Memory of words that a worker keeps (about ``WORD_BYTES`` for each beside its letters and ids),
#: and the longest word that it keeps.
KNOWN_BYTES, WORD_BYTES, LONG_WORD = 160 << 20, 200, 64
#: Characters and rows that are encoded together, and one in how many texts is verified as a whole.
BATCH_CHARS, BATCH_ROWS, SAMPLED = 1 << 20, 512, 64
#: Kinds of pieces and of models in the protobuf: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers as such, the rest as bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
            yield tag >> 3, value
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size, i = varint(i)
        if size is None:
            raise ValueError(f"wire type {kind} in a SentencePiece model")
        yield tag >> 3, raw[i : i + size]
        i += size


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_suffix: bool = False


def parse(raw: bytes) -> Model:
    """The field numbers are those of the public sentencepiece_model.proto."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.model_type = v
                elif n == 24:
                    model.whitespace_suffix = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    if model.model_type not in (UNIGRAM, BPE) or not model.escape_whitespaces or model.whitespace_suffix:
        raise ValueError("only unigram and BPE models with a leading white-space marker are supported")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """BPE merges, best score first: each way of joining two pieces into a third."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind in (NORMAL, USER_DEFINED):
            ways = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in rank and piece[i:] in rank]
            found += [(-score, rank[piece], rank[a], rank[b], a, b) for a, b in ways]
    return [(a, b) for *_, a, b in sorted(found)]


def splits_at_marks(model: Model) -> bool:
    """Whether no piece has a marker after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _, kind in model.pieces if kind != CONTROL)


def build(model: Model, split: bool = True):
    """The tokenizers pipeline of a model; with ``split``, it takes a text apart where pieces cannot meet."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = model.pieces[model.unk_id][0]
    if model.model_type == BPE:
        core = models.BPE(vocab, merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if split and splits_at_marks(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    undo = [decoders.Metaspace(MARK, "never", False), decoders.ByteFallback(), decoders.Fuse()]
    if model.add_dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(undo)
    return tokenizer


class Backend:
    """Encoder and decoder of one model file, with the original library beside it for parity."""

    def __init__(self, path: str, whole: bool = False) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        self.model = parse(raw)
        self.raw = raw
        self.tokenizer = build(self.model, split=not whole)
        self.by_word = not whole and splits_at_marks(self.model) and not self.model.charsmap and not self.model.remove_extra_whitespaces and self.model.add_dummy_prefix
        self._original = None
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._size = 0  # of the younger words
        self._differ: set[str] = set()
        self._lossy: set[str] = set()

    @property
    def original(self):
        if self._original is None:
            import sentencepiece

            self._original = sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        return self._original

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False) if ids else []

    def words(self, text: str) -> list[str]:
        """The parts that encode independently, without the marker that either library adds to each."""
        if not self.by_word:
            return [text]
        if text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        # a text is a dummy marker and itself; its parts start where spaces do
        return [p[1:] for p in re.findall(r" *[^ ]+(?: +\Z)?| +", " " + text)] if text else []

    def encode_packed(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Of each text: ids as little-endian 32-bit words; whether the original library agrees on
        all its words; whether decoding gives all its words back."""
        words = [self.words(t) for t in texts]
        if self._size > KNOWN_BYTES // 2:
            self._differ -= self._older.keys()
            self._lossy -= self._older.keys()
            self._known, self._older, self._size = {}, self._known, 0
        known, older = self._known, self._older
        unknown = set().union(*words) - known.keys()
        for w in unknown & older.keys():
            known[w] = older.pop(w)
            self._size += WORD_BYTES + 4 * len(w) + len(known[w])
            unknown.discard(w)
        new = list(unknown)
        ids = self.encode(new)
        for w, own, same, back in zip(new, ids, self.original.encode(new, num_threads=1), self.decode(ids)):
            known[w] = np.array(own, "<i4").tobytes()
            self._size += WORD_BYTES + 4 * len(w) + len(known[w])
            if own != same:
                self._differ.add(w)
            if back != w:
                self._lossy.add(w)
        packed = [b"".join([known[w] for w in own]) for own in words]
        free = lambda bad: [not bad or bad.isdisjoint(own) for own in words]
        parity, back = free(self._differ), free(self._lossy)
        for w in (w for w in new if len(w) > LONG_WORD):
            self._size -= WORD_BYTES + 4 * len(w) + len(known.pop(w))
            self._differ.discard(w), self._lossy.discard(w)
        return packed, parity, back

    def encode_words(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text and whether the original library agrees on all its distinct words."""
        packed, parity, _ = self.encode_packed(texts)
        return [np.frombuffer(p, "<i4").tolist() for p in packed], parity

    def whole(self, text: str, packed: bytes) -> tuple[bool, bool]:
        """Whether both libraries give these ids for the whole text, and whether they decode to it."""
        ids = np.frombuffer(packed, "<i4").tolist()
        return self.encode([text])[0] == ids == self.original.encode(text), self.decode([ids])[0] == text


@lru_cache(maxsize=2)
def backend(path: str, whole: bool = False) -> Backend:
    task = TaskContext.get()
    if task:  # read when the library's threads start
        os.environ.setdefault("RAYON_NUM_THREADS", str(task.cpus()))
    return Backend(path, whole)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``BATCH_ROWS`` rows and about ``BATCH_CHARS`` characters."""
    sizes = [x or 0 for x in pc.utf8_length(batch.column("text")).to_pylist()]
    i = 0
    while i < len(sizes):
        j, chars = i + 1, sizes[i]
        while j < len(sizes) and j - i < BATCH_ROWS and chars + sizes[j] <= BATCH_CHARS:
            chars += sizes[j]
            j += 1
        yield batch.slice(i, j - i)
        i = j


def encoded(docs: DataFrame, path: str = MODEL, keep_ids: bool = True, whole: bool = False) -> DataFrame:
    """documents -> doc_id, n_tokens, ids, word_parity, word_round_trip, text_parity, text_round_trip.

    ``path`` must exist on every executor. Without ``keep_ids``, ids_crc32 (of the ids
    as little-endian 32-bit words, unsigned) stands for ids. With ``whole``, every text is
    encoded and verified as a whole.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(path, whole)
        for batch in batches:
            for part in _parts(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                packed, parity, back = own.encode_packed(texts)
                if whole:
                    checked = zip(parity, back)
                else:
                    checked = [own.whole(t, p) if zlib.crc32(t.encode("utf-8", "surrogatepass")) % SAMPLED == 0 else (None, None) for t, p in zip(texts, packed)]
                sizes = np.array([len(x) // 4 for x in packed], np.int32)
                if keep_ids:
                    out = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.frombuffer(b"".join(packed), "<i4"))
                else:
                    out = pa.array([zlib.crc32(x) for x in packed], pa.int64())
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), out, *[pa.array(x, pa.bool_()) for x in (parity, back, *zip(*checked))]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids" if keep_ids else "ids_crc32", *VERIFIED])

    kind = "ids array<int>" if keep_ids else "ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, f"doc_id long, n_tokens long, {kind}, " + ", ".join(f"{c} boolean" for c in VERIFIED))


def decoded(ids: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids -> doc_id, text; null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = backend(path)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            texts = own.decode([x or [] for x in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else t for x, t in zip(rows, texts)], pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")
