import random

import numpy as np
from pyspark.sql import functions as F

from pairlake.llm import common
from pairlake.llm import decontamination as d


def brute(docs, items, threshold=0.75):
    out = []
    for i, t in docs:
        have = d.exact_shingles(t)
        for j, s in {(j, s) for j, s in items}:
            want = d.exact_shingles(s)
            n = len(want & have)
            if want and 100 * n >= 100 * threshold * len(want):
                out.append((i, j, n, len(want)))
    return sorted(out, key=str)


def test_equals_brute_force(spark, docs_of):
    r = random.Random(4)
    word = lambda: r.choice("the of and to in was thion ereth oupon ndle".split()) + r.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 4, 5, 8, 30, 36, 80, 200])))) for i in range(40)] + [(90, ""), (91, None), (1, "dup"), (1, "dup")]
    docs = []
    for i in range(150):
        words = [word() for _ in range(r.randrange(0, 300))]
        if r.random() < 0.6:
            item = r.choice(items)[1] or ""
            part = item.upper().split()
            for _ in range(r.randrange(0, 1 + len(part) // 12)):
                part[r.randrange(len(part))] = word()
            at = r.randrange(len(words) + 1)
            words[at:at] = part[: max(1, int(len(part) * r.uniform(0.6, 1)))]
        docs.append((i, "\t".join(words)))
    docs += [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (203, "x " * 50_000 + items[7][1]), (None, items[7][1])]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, digest string")
    got = sorted(map(tuple, d.leaks(docs_of(docs), benchmark).select("doc_id", "item_id", "n_shared", "n_shingles").collect()), key=str)
    assert got == brute(docs, items) and len(got) > 10
    kept = d.clean(docs_of(docs), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {g[0] for g in got}
    assert d.leaks(docs_of([]), benchmark).count() == 0 and d.leaks(docs_of(docs), benchmark.limit(0)).count() == 0


def test_bloom_filter_and_shuffled_joins_change_nothing(spark, docs_of, monkeypatch):
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    items = [(i, text(r.choice([2, 6, 20, 300]))) for i in range(30)]
    docs = [(i, f"{text(r.randrange(50))} {r.choice(items)[1]} {text(20)}") for i in range(60)]
    docs += [(100 + i, docs[0][1]) for i in range(50)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(tuple, d.leaks(docs_of(docs), benchmark).select("doc_id", "item_id", "n_shared", "n_shingles").collect()))
    want = rows()
    assert want == sorted(brute(docs, items)) and len(want) > 80
    monkeypatch.setattr(d, "FILTER_HASHES", 10)
    monkeypatch.setattr(d, "FILTER_BITS", 1 << 12)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert rows() == want


def test_a_phrase_that_all_items_share_pairs_nothing(spark, docs_of):
    items = [(i, "answer the following question about the topic of " + " ".join(f"x{i}y{j}" for j in range(30))) for i in range(50)]
    sketched = d.sketches(spark.createDataFrame([(str(i), t) for i, t in items], "item string, text string"))
    docs = docs_of([(1, "answer the following question about the topic of the day"), (2, items[7][1])])
    found = d.candidates(docs.select(F.md5("text").alias("text_key"), "text"), sketched)
    assert [r["item"] for r in found.collect()] == ["7"]


def test_long_items_are_sketched_in_their_size_partition():
    r = np.random.RandomState(1)
    for n, least, most in ((20, 0, 0), (100, 0, 0), (2_000, 2, 3), (100_000, 5, 6)):
        hashes = np.sort(r.randint(0, 1 << 63, n, np.int64).astype(np.uint64) * np.uint64(2))
        s, sketch = d.partition_of(hashes)
        assert least <= s <= most and (len(sketch) >= d.SKETCH or s == 0) and len(sketch) <= 300


def test_hits_needed_misses_little():
    assert d.hits_needed(4, True) == 3 and d.hits_needed(32, True) == 24 and 1 <= d.hits_needed(32, False) < 16
    draws = np.random.RandomState(2).binomial(40, d.THRESHOLD, 1_000_000)
    assert (draws < d.hits_needed(40, False)).sum() == 0 and d.hits_needed(40, False) >= 12
