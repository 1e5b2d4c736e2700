import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from pairlake.llm import common, outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(i, t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c, covered = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if c[w[k], w[k + 1], w[k + 2]] > 1:
            covered |= {k, k + 1, k + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)


def test_statistics_equal_brute_force(spark, docs_of):
    r = random.Random(1)
    bits = ["a", "b", "c", "é", "😀", "#", "x|y", "\n", "\n\n", " ", "\t", "\x0b", "\xa0", "\x85", "\r\n", "\\n"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(0, 120)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "a a a"), (504, "a a a a"), (505, "w " * 30_000), (506, " ".join(map(str, range(30_000)))), (7, rows[7][1])]
    got = outliers.statistics(docs_of(rows))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(brute(i, t) for i, t in rows)


def make(r, junk=False):
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(80, 500))]
    return " ".join(w + ("%%%" if junk else "") for w in words)


def test_outliers_go_and_clean_texts_stay(spark, docs_of):
    r = random.Random(2)
    rows = [(i, make(r, i % 8 == 0)) for i in range(400)] + [(1_000, "short"), (1_001, None)]
    got = {x["doc_id"]: x for x in outliers.judged(docs_of(rows)).collect()}
    assert len(got) == 402
    assert not any(got[i]["kept"] for i in range(0, 400, 8)) and all(got[i]["kept"] for i in range(400) if i % 8)
    assert not got[1_000]["kept"] and got[1_000]["base_failed"]


def test_distances_equal_numpy(spark):
    """The same starts and concentration steps, written with arrays, and the start of the least determinant."""
    r = np.random.RandomState(3)
    x = np.concatenate([r.multivariate_normal(np.zeros(5), np.diag([1, 0.3, 0.2, 2, 0.5]), 500), r.normal(6, 1, (60, 5))])
    rows = spark.createDataFrame([(i, "g", *map(float, v)) for i, v in enumerate(x)], "doc_id long, g string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {a["doc_id"]: a["d2"] for a in outliers.distances(rows).collect()}
    floors = np.array(outliers.FLOORS)

    def at(values, share):
        return np.sort(values)[int(np.ceil(share * len(values))) - 1]

    m = np.array([(at(np.floor(c * outliers.GRID), 0.5) + 0.5) / outliers.GRID for c in x.T])
    s = np.array([1.4826 * (at(np.floor(np.abs(c - a) * outliers.GRID), 0.5) + 0.5) / outliers.GRID for c, a in zip(x.T, m)])
    s = np.maximum(s, floors)
    z = (x - m) / s
    cell = lambda v: np.floor(np.log2(v + 1e-6) * outliers.LOG_GRID)
    floor = np.diag((floors / s) ** 2)
    norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
    firsts = [np.eye(5), np.cov(np.tanh(z).T, bias=True) + floor, np.cov((z / norm * 5**0.5).T, bias=True) + floor]
    now, best = [(np.zeros(5), first) for first in firsts], [(np.inf, None, None)] * 3
    for step in range(outliers.MOST_STEPS):
        fell = False
        for k, (mean, cov) in enumerate(now):
            centred = z - mean
            d = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(cov), centred)
            near = z[cell(d) <= at(cell(d), outliers.SHARE)]
            now[k] = near.mean(axis=0), np.cov(near.T, bias=True) + floor
            det = np.linalg.slogdet(now[k][1])[1]
            if best[k][0] - det > outliers.FALL:
                best[k], fell = (det, *now[k]), True
        if step >= outliers.FIRST_STEPS and not fell:
            break
    assert step >= 3 and len({round(b[0], 6) for b in best}) > 1  # the starts end at different estimates
    _, mean, cov = min(best, key=lambda x: x[0])
    centred = z - mean
    d = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(cov), centred)
    d /= max(1.0, 2 ** ((at(cell(d), outliers.SHARE) + 0.5) / outliers.LOG_GRID) / outliers.CHI_AT_SHARE)
    assert np.allclose([got[i] for i in range(len(x))], d, rtol=1e-4)
    assert all(got[i] > outliers.CUTOFF for i in range(500, 560)) and np.mean([got[i] <= outliers.CUTOFF for i in range(500)]) > 0.99


def test_small_pools_and_nulls(spark):
    r = random.Random(4)
    rows = [(i, make(r), None if i % 2 else "en", None if i % 3 else f"s{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = outliers.judged(docs).collect()
    assert len(got) == 30 and all(x["kept"] and x["distance"] is None for x in got)
    assert outliers.judged(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(i, make(r), "en" if i % 2 else None, f"s{i % 40}") for i in range(200)], docs.schema)
    assert len(outliers.judged(many).collect()) == 200


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_words(spark, docs_of, n):
    t = " ".join("abc"[:n])
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert tuple(outliers.statistics(docs_of([(1, t)])).select(columns).first()) == brute(1, t)


def test_few_documents_are_judged_by_their_language(spark):
    r = random.Random(5)
    rows = [(i, make(r), "en", "large") for i in range(200)]
    rows += [(1_000 + i, make(r, i < 3), "en", "rare") for i in range(6)] + [(2_000 + i, make(r, i < 3), "xx", None) for i in range(6)]
    got = {x["doc_id"]: x for x in outliers.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(x["distance"] is not None for x in got.values())
    assert {i for i, x in got.items() if not x["kept"]} == {1_000, 1_001, 1_002, 2_000, 2_001, 2_002}


def test_long_white_space_is_linear(spark, docs_of):
    t = "a" + " " * 1_000_000 + "b" + "\t\n" * 500_000 + "c"
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    outliers.statistics(docs_of([(1, "x")])).collect()
    begin = time.monotonic()
    assert tuple(outliers.statistics(docs_of([(1, t)])).select(columns).first()) == (1, 3, 3, 0, 0, 0, True)
    assert time.monotonic() - begin < 10


def test_a_document_at_the_cutoff_stays(spark, docs_of):
    r = random.Random(6)
    docs = docs_of([(i, make(r)) for i in range(60)])
    far = max(x["distance"] for x in outliers.judged(docs).collect())
    assert sum(not x["kept"] for x in outliers.judged(docs, cutoff=far + 1e-4).collect()) == 0
    assert sum(not x["kept"] for x in outliers.judged(docs, cutoff=far - 1e-3).collect()) >= 1


def test_more_groups_than_a_broadcast_holds(spark, docs_of, monkeypatch):
    r = random.Random(7)
    docs = docs_of([(i, make(r, i % 8 == 0)) for i in range(200)])
    key = lambda rows: sorted((x["doc_id"], x["kept"], x["distance"]) for x in rows.collect())
    want = key(outliers.judged(docs))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert key(outliers.judged(docs)) == want
