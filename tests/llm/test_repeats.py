import hashlib
import random

import numpy as np
import pytest

from pairlake.llm import repeats


def brute(rows, n=50):
    rows = [(repeats.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(first.get(b[p : p + n], i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((None if i == repeats.NO_ID else i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_equals_brute_force(spark, docs_of, monkeypatch, hot):
    r = random.Random(5)
    words = ["the", "of", "and", "thion", "eréa", "zu", "ß", "ing", "nd\n"]
    p, q = (" ".join(r.choice(words) for _ in range(k)) for k in (40, 20))
    rows = []
    for i in range(100):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        t = t + p[r.randint(0, 20) :] if r.random() < 0.5 else t
        t = q + t if r.random() < 0.3 else t
        rows.append((i, t + "A" * r.randint(40, 160) if r.random() < 0.2 else t))
    rows += [(200 + k, rows[k][1]) for k in range(20)] + [(5, rows[7][1]), (5, "x" * 49), (6, None), (None, p), (None, p + q), (7, rows[7][1]), (300, "q" * 50), (301, "q" * 50), (302, "")]
    if hot:  # so many documents that common grams count as hot
        rows += [(1_000 + i, f"{i} " + p + f" {i * i}") for i in range(150)]
    got = sorted(map(tuple, repeats.repeats(docs_of(rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_long(spark, docs_of):
    assert repeats.repeats(docs_of([])).count() == 0
    long = "".join(chr(97 + x) for x in np.random.RandomState(1).randint(0, 26, 600_000))
    got = {r["doc_id"]: r for r in repeats.repeats(docs_of([(1, long), (2, long[1_000:] + "!")])).collect()}
    assert got[1]["n_removed"] == 0 and (got[2]["n_removed"], got[2]["n_spans"]) == (599_000, 1)


def test_radix_groups():
    strings = [b"aab", b"aaa", b"aab", b"b", b"baa", b"aab", b"b"]
    digits = (np.array([s[i] if i < len(s) else 0 for s in strings], np.uint64) for i in range(3))
    member, group = repeats.radix_groups(digits, len(strings))
    found = {}
    for m, g in zip(member, group):
        found.setdefault(int(g), set()).add(int(m))
    assert sorted(map(sorted, found.values())) == [[0, 2, 5], [3, 6]]


def test_the_greatest_id_is_an_id(spark, docs_of):
    p = "a passage of more than fifty bytes that several documents have in common"
    rows = [(repeats.NO_ID, p + " one"), (None, "two-" + p), (4, "three " + p), (repeats.NO_ID, "lone")]
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.repeats(docs_of(rows)).collect()}
    assert got == {(repeats.NO_ID, len(p) + 4): len(p), (None, len(p) + 4): len(p), (4, len(p) + 6): 0, (repeats.NO_ID, 4): 0}
