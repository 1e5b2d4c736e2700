import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from pairlake.llm import queries
from pairlake.llm import sentencepiece_backend as sp

CASES = ["", " ", "   ", "  a", "a  b ", "a b  ", "tab\there\n\nx", "emoji 😀 漢字", "\x00z", "éé", "x" * 5_000, "<s> </s> <unk>", "<0x0A> a", "ﬁ ½"]


def test_parity_with_the_original():
    own = sp.Backend(sp.MODEL)
    r = random.Random(1)
    texts = CASES + ["".join(r.choice("ab é\n😀 \t漢'.,") for _ in range(r.randrange(60))) for _ in range(300)]
    assert own.encode(texts) == own.original.encode(texts)
    ids, parity = own.encode_words(texts)
    assert ids == own.original.encode(texts) and all(parity)
    assert own.decode(ids) == [t.replace("\u2581", " ") for t in texts]


def message(number, payload):
    size, out = len(payload), b""
    while size >= 128:
        out += bytes([size & 127 | 128])
        size >>= 7
    tag = number << 3 | 2
    return (bytes([tag]) if tag < 128 else bytes([tag & 127 | 128, tag >> 7])) + out + bytes([size]) + payload


def unigram(charsmap=b"", dummy=1, shrink=0):
    """A small unigram model with byte fallback, as a protobuf made by hand."""
    letters = [("\u2581", -2.5, 1), *[(c, -3.0 - i / 7, 1) for i, c in enumerate("abcdeé")]]
    longer = [("\u2581ab", -1.1, 1), ("\u2581a", -2.05, 1), ("abc", -2.23, 1), ("bc", -3.31, 1), ("de", -2.77, 1), ("cde", -4.19, 1), ("é\u2581", -9.0, 1)]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], *letters, *longer]
    raw = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for p, s, k in pieces)
    raw += message(2, bytes([0x18, 1]) + bytes([0x98, 2, 1]))
    return raw + message(3, (message(2, charsmap) if charsmap else b"") + bytes([0x18, dummy, 0x20, shrink, 0x28, 1]))


def nfkc_map():
    """The precompiled character map of the library's own NFKC rule."""
    raw = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    spec = next(v for n, v in sp._fields(raw) if n == 3)
    return next(v for n, v in sp._fields(spec) if n == 2)


@pytest.mark.parametrize(("mapped", "dummy", "shrink"), [(0, 1, 0), (0, 0, 0), (0, 1, 1), (1, 1, 0), (1, 1, 1), (1, 0, 1)])
def test_unigram_and_normaliser_have_parity(tmp_path, mapped, dummy, shrink):
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram(nfkc_map() if mapped else b"", dummy, shrink))
    own = sp.Backend(str(path))
    assert (own.model.model_type, own.model.byte_fallback, bool(own.model.charsmap)) == (sp.UNIGRAM, True, bool(mapped))
    r = random.Random(mapped * 4 + dummy * 2 + shrink)
    texts = ["", " ", "  ", "a", " ab", "ab ", "a  b", "ﬁ ½ Ａb", "e\u0301", "x\u3000y"]
    texts += ["".join(r.choice("aabbccdde  é\u00a0ｅ①\t漢") for _ in range(r.randrange(30))) for _ in range(400)]
    assert own.encode(texts) == own.original.encode(texts)
    assert own.decode(own.encode(texts)) == own.original.decode(own.original.encode(texts))


def test_words_without_spaces_are_not_kept(monkeypatch):
    """Thousands of long texts without a space leave nothing behind, and the memory of words has a bound in bytes."""
    own = sp.Backend(sp.MODEL)
    r = random.Random(2)
    texts = ["".join(chr(0x4E00 + r.randrange(3_000)) for _ in range(400)) for _ in range(2_000)]
    for i in range(0, len(texts), 100):
        packed, parity, back = own.encode_packed(texts[i : i + 100])
        assert all(parity) and all(back) and all(packed)
    assert not own._known and own._size == 0
    monkeypatch.setattr(sp, "KNOWN_BYTES", 10_000)
    for i in range(200):
        own.encode_packed([f"word{i} other{i} often"])
        assert own._size < 6_000 and len(own._known) + len(own._older) < 60 and "often" in own._known
    assert own.encode_words(["word1 often"])[0] == own.original.encode(["word1 often"])


def test_rows(spark, docs_of):
    rows = [(1, "a  b "), (2, None), (3, ""), (1, "a  b "), (4, "word " * 60_000)]
    got = sp.encoded(docs_of(rows)).collect()
    assert len(got) == 5 and all(r["word_parity"] and r["word_round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    back = {r["doc_id"]: r["text"] for r in sp.decoded(sp.encoded(docs_of(rows))).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert sp.encoded(docs_of([]), keep_ids=False).count() == 0
    assert all(sp.backend(sp.MODEL).whole(t or "", b"".join(np.array(x["ids"], "<i4").tobytes() for x in [y])) == (True, True) for i, t in rows for y in got if y["doc_id"] == i)
    parts = [p.num_rows for p in sp._parts(pa.RecordBatch.from_pydict({"text": ["x" * 700_000, None, "y" * 700_000, "z" * 3_000_000, "", "w"]}))]
    assert parts == [2, 1, 1, 2]
    many = [(i, f"text number {i}") for i in range(600)] + [(None, "a")]
    got = sp.encoded(docs_of(many)).collect()
    assert 2 < sum(r["text_parity"] is not None for r in got) < 40 and all(r["text_parity"] in (True, None) and r["text_round_trip"] in (True, None) for r in got)


def test_query_and_pipeline_verify_every_whole_text(spark, docs_of, tmp_path):
    """No text is left to a sample: each has its verdicts, and a text that does not round-trip is always told."""
    rows = [(i, f"text number {i}  of \n many {'é漢 ' * (i % 3)}") for i in range(150)] + [(150, None), (151, ""), (None, "a"), (3, "again 3")]
    rows += [(200 + i, f"mark\u2581{i}") for i in range(50)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    original = sp.backend(sp.MODEL).original
    want = Counter((i, zlib.crc32(np.array(original.encode(t or ""), "<i4").tobytes()), True, "\u2581" not in (t or "")) for i, t in rows)
    got = queries.op3_sentencepiece(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["ids_crc32"], r["text_parity"], r["text_round_trip"]) for r in got) == want
    got = corpus_pipeline.token_ids(spark, docs_of(rows), str(tmp_path)).collect()
    assert Counter((r["doc_id"], zlib.crc32(np.array(r["ids"], "<i4").tobytes()), r["text_parity"], r["text_round_trip"]) for r in got) == want


def test_whole_texts_whose_words_are_not_independent_are_told(monkeypatch):
    """An encoder that goes wrong only across words passes word by word, not as a whole."""
    encode = sp.Backend.encode
    monkeypatch.setattr(sp.Backend, "encode", lambda self, texts: [ids + ids[-1:] if " " in t else ids for t, ids in zip(texts, encode(self, texts))])
    assert sp.Backend(sp.MODEL).encode_packed(["one", "one two"])[1:] == ([True, True], [True, True])
    own = sp.Backend(sp.MODEL, whole=True)
    assert own.encode_packed(["one", "one two", ""])[1:] == ([True, False, True], [True, False, True])
    assert own.words("") == [""] and own.words(" a  b ") == [" a  b "]
