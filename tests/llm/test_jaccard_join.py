import random

import numpy as np
import pytest

from pairlake.llm import jaccard_join as j
from pairlake.llm.components import components
from pairlake.llm.decontamination import exact_shingles


def brute(rows):
    sets = [exact_shingles(t) for _, t in rows]
    ids = [j.NO_ID if i is None else i for i, _ in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        least[find(a)] = min(least.get(find(a), j.NO_ID), ids[a])
    null = lambda x: None if x == j.NO_ID else x
    return sorted(((null(ids[a]), len(sets[a]), null(least[find(a)]) if sets[a] else null(ids[a])) for a in range(len(rows))), key=str)


def make(seed, n=90):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("rstn")
    rows, bases = [], [[word() for _ in range(r.choice([3, 6, 12, 40, 120]))] for _ in range(6)]
    common = [word() for _ in range(15)]
    for i in range(n):
        words = list(r.choice(bases)) if r.random() < 0.7 else [word() for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(0, 1 + len(words) // 25)):
            words[r.randrange(len(words))] = word()
        if r.random() < 0.2:
            words += common
        rows.append((i, (" ".join(words)).upper() if r.random() < 0.2 else "\n".join(words)))
    return rows + [(500, None), (501, ""), (502, " \t"), (None, rows[0][1]), (None, "lone words here"), (3, rows[4][1]), (3, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, docs_of, seed):
    rows = make(seed)
    assert sorted(map(tuple, j.groups(docs_of(rows)).collect()), key=str) == brute(rows)


def test_without_pivot_rounds_the_full_join_finds_all(spark, docs_of, monkeypatch):
    monkeypatch.setattr(j, "ROUNDS", 0)
    rows = make(3, 60)
    assert sorted(map(tuple, j.groups(docs_of(rows)).collect()), key=str) == brute(rows)


def test_empty_and_long(spark, docs_of):
    assert j.groups(docs_of([])).count() == 0
    words = np.random.RandomState(1).randint(0, 10**6, 40_000).astype(str).tolist()
    got = {r["doc_id"]: r["component_id"] for r in j.groups(docs_of([(4, " ".join(words)), (2, " ".join(words[:-50])), (3, " ".join(words[:25_000]))])).collect()}
    assert got == {4: 2, 2: 2, 3: 3}


def test_suffix_bound_never_undercounts():
    r = np.random.RandomState(0)
    for _ in range(300):
        x, y = (np.unique(r.randint(0, 200, r.randint(1, 80)).astype(np.uint64)) for _ in range(2))
        assert j.suffix_bound(x, y) >= len(np.intersect1d(x, y))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 150: 150, 200: 150, 300: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_greatest_id_is_an_id(spark, docs_of):
    rows = [(j.NO_ID, "some words that are here"), (None, "some words that are here"), (None, "lone words"), (j.NO_ID, "other"), (None, None), (5, "x y z"), (j.NO_ID, "x y z")]
    got = sorted(map(tuple, j.groups(docs_of(rows)).collect()), key=str)
    want = [(j.NO_ID, 1, j.NO_ID), (None, 1, j.NO_ID), (None, 1, None), (j.NO_ID, 1, j.NO_ID), (None, 0, None), (5, 1, 5), (j.NO_ID, 1, 5)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("broadcast_rows", [50_000, 100])
def test_components_of_hubs(spark, monkeypatch, broadcast_rows):
    from pairlake.llm import components as c

    monkeypatch.setattr(c, "BROADCAST_ROWS", broadcast_rows)
    edges = [(10_000, i) for i in range(1, 900)] + [(20_000 + i, 20_001 + i) for i in range(60)] + [(899, 30_000), (30_000, 5)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in [*range(1, 900), 10_000, 30_000]) and all(got[20_000 + i] == 20_000 for i in range(61)) and len(got) == 962
