"""Results on odd texts, and steps that must stay small on larger tables."""

import hashlib
import re
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from pairlake import queries
from pairlake.functions import sections, text
from pairlake.operators import graph, retrieval, sampling, signals, texts, training

DATA = "/root/testdata/sf0.001"


def test_candidates_of_blank_and_odd_texts(spark, tmp_path):
    edge = ["\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "\n"]
    texts = ["", " ", None, "a", " b \x1c", "y" * 59 + "  z", " " * 61 + "q", *edge, *(e + "x" * 70 + e for e in edge), *(f" {e} k {e} " for e in edge)]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = {tuple(r) for r in queries.candidate_texts(spark, str(tmp_path)).select("doc_id", "candidate").collect()}
    assert got == set(duck.execute(f"select doc_id, candidate from ({queries.ORACLE_SQL['candidate_texts']})").fetchall())


@pytest.mark.parametrize("block", [40, 1_000])
def test_texts_of_cells_are_those_of_joins(spark, monkeypatch, block):
    monkeypatch.setattr(texts, "BLOCK_BYTES", block)
    side = lambda c, t: spark.createDataFrame([(i, f"{t}{i}") for i in range(9)] + [(3, f"{t} again"), (None, "x"), (5, None)], f"{c} long, {t} string")
    rows = spark.createDataFrame([(i % 7, i * i % 11, i % 5) for i in range(40)] + [(1, 0, 0), (None, 1, 1), (1, None, 2)], "a long, b long, c long")
    a, b, c = side("a", "p"), side("b", "q"), side("c", "r")
    known = lambda d: d.dropna()
    for got, want in ((texts.with_texts(rows.select("a", "b"), a, b), rows.select("a", "b").join(known(a), "a").join(known(b), "b")), (texts.with_texts(rows, a, b, c), rows.join(known(a), "a").join(known(b), "b").join(known(c), "c"))):
        assert got.count() and sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(got.columns)).collect()))


@pytest.mark.parametrize(("few", "size"), [(True, 40), (True, 1_000), (False, 40)])
def test_texts_of_cells_keep_other_columns(spark, monkeypatch, few, size):
    for name in ("BLOCK_BYTES", "FEW_BYTES", "GATHERED", "MESSAGE"):
        monkeypatch.setattr(texts, name, size)
    side = lambda c, t: spark.createDataFrame([(i, f"{t}{i} é") for i in range(9)] + [(3, f"{t} again"), (None, "x"), (5, None)], f"{c} long, {t} string")
    edges = [(i % 7, i * i % 11, i, i % 3 == 0) for i in range(40)] + [(1, 0, 5, None), (1, 0, 5, None), (1, 0, None, True), (None, 1, 1, True), (1, None, 2, False)]
    rows = spark.createDataFrame(edges, "a long, b long, number long, flag boolean")
    got, want = texts.with_texts(rows, side("a", "p"), side("b", "q"), few=few), rows.join(side("a", "p").dropna(), "a").join(side("b", "q").dropna(), "b")
    found = got.collect()
    assert found and sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(want.columns)).collect()))
    assert dict(got.dtypes) == dict(want.dtypes)
    empty = texts.with_texts(rows.where("false"), side("a", "p"), side("b", "q"), few=few)
    assert empty.collect() == [] and empty.columns == got.columns


def test_rows_of_a_text_leave_a_cell_side_by_side(spark):
    side = lambda c, t: spark.range(30).selectExpr(f"id {c}", f"'{t}' || id {t}")
    rows = spark.range(300).selectExpr("id % 30 a", "id * 7 % 29 b", "id number")
    where = texts.with_texts(rows, side("a", "p"), side("b", "q"), few=True).rdd.mapPartitions(lambda x: [[r["b"] for r in x]]).collect()
    runs = [b for p in where for i, b in enumerate(p) if i == 0 or p[i - 1] != b]
    assert sorted(runs) == list(range(29)) and sum(map(len, where)) == 300


def test_texts_are_packed_on_their_way(spark):
    words = np.random.default_rng(0).choice([f"word{i}" for i in range(400)], (600, 200))
    ids = pa.array([[{"b": i}] if i % 2 else None for i in range(600)], pa.list_(pa.struct([("b", pa.int64())])))
    sent = pa.table({"cell": pa.array([i % 3 for i in range(600)], pa.int32()), "kind": pa.array([i % 2 for i in range(600)], pa.int32()), "id": range(600), "text": [" ".join(w) for w in words], "ids": ids})
    packed = list(texts._packed(sent, 100_000))
    assert 6 < len(packed) < 30 and sum(b.nbytes for b in packed) < sent.nbytes / 2.5
    back = [(b["cell"][0].as_py(), b["kind"][0].as_py(), *r.values()) for b in packed for r in pa.ipc.open_stream(b["message"][0].as_buffer()).read_all().to_pylist()]
    assert sorted(back, key=lambda r: r[2]) == [tuple(r.values()) for r in sent.to_pylist()]


def test_improved_papers_take_up_texts_packed_and_only_in_pairs(spark):
    assert all(x in plan(queries.improves_over_pairs(spark, DATA)) for x in ("MapInArrow", "LeftSemi"))


def test_cocitation_gets_tasks_by_its_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_PAIRS", 10)
    edges = spark.createDataFrame([(i % 9, i * i % 13, i) for i in range(60)], "citing long, cited long, citationid long")
    pairs = graph.cocitation(edges)
    assert pairs.rdd.getNumPartitions() == 27
    refs = {}
    for r in edges.orderBy("citationid").collect():
        refs.setdefault(r["citing"], []).append(r["cited"])
    assert sorted(map(tuple, pairs.collect())) == sorted({(x, y) for v in refs.values() for x in v[:10] for y in v[:10] if x < y})


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_related_works_and_triplets_meet_in_cells(spark):
    for name in ("similarity_pairs", "citation_triplets"):
        assert "MapInArrow" in plan(queries.QUERIES[name](spark, DATA))


def test_sections_are_counted_in_one_pass(spark):
    found = spark.createDataFrame([(1, "methods"), (1, "results"), (2, "methods"), (None, "results")], "doc_id long, section_type string")
    counts = signals.section_counts(found)
    assert {tuple(r) for r in counts.collect()} == {("methods", 2), ("results", 2), ("papers", 2)}
    assert {tuple(r) for r in signals.section_counts(found.where("false")).collect()} == {("papers", 0)}
    assert plan(counts).count("LogicalRDD") == 1


def test_section_pairs_gather_chosen_documents_only(spark, monkeypatch):
    seen = []
    whole = sampling.numbered
    monkeypatch.setattr(sampling, "numbered", lambda rows, *a: seen.append(plan(rows)) or whole(rows, *a))
    found = spark.createDataFrame([(i, "ab"[i % 2], k, "x") for i in range(9) for k in ("methods", "results")], "doc_id long, source string, section_type string, text string")
    assert signals.section_pairs(found, 5, per_source=2).count() and "LeftSemi" in seen[0]


def test_headings_at_the_start_and_beyond_the_basic_plane(spark):
    body = "x" * 300
    docs = [f"Introduction\n{body}\n# Methods\n{body}", f"\n\nIntroduction\n{body}\n\n 2. Results \n{body}", f"😀😀 {body}\nMethods\n{body}\nDiscussion\n{body}"]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    got = sorted((r["doc_id"], r["section_type"], r["start"]) for r in sections.extract(rows).collect())
    at = lambda i, s: docs[i].index(s) + 1
    assert got == [(0, "introduction", 1), (0, "methods", at(0, "\n# Methods")), (1, "introduction", 1), (1, "results", at(1, "\n\n 2. Results")), (2, "discussion", at(2, "\nDiscussion")), (2, "methods", at(2, "\nMethods"))]


def test_neighbours_of_cells(spark, monkeypatch):
    for name, n in (("QUERIES", 7), ("TILE", 5), ("PAIRS", 3)):
        monkeypatch.setattr(retrieval, name, n)
    monkeypatch.setattr(DataFrame, "toArrow", lambda *_: 1 / 0)  # no vectors on the driver
    v = np.round(np.random.default_rng(0).normal(size=(40, 3)), 1)
    v[7] = v[3]
    v[9] = np.nan
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vector array<double>")
    got = {(r["vec_id"], r["rank"]): r["neighbour"] for r in retrieval.neighbours(rows, 4, block=9).collect()}
    s = np.round(v @ v.T, 9)
    want = {}
    for i in range(40):
        order = sorted((j for j in range(40) if j != i and np.isfinite(s[i, j])), key=lambda j: (-s[i, j], j))
        want |= {(i, r + 1): j for r, j in enumerate(order[:4])}
    assert got == want


def test_bm25_shuffles_no_postings(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    asked = spark.read.parquet(f"{DATA}/benchmark.parquet").selectExpr("item_id query_id", "text query", "item_id gold").limit(20)
    scores = retrieval.bm25(asked, docs)
    assert not any(x in plan(scores) for x in ("Join", "Aggregate"))
    key = lambda rows: sorted(tuple(r) for r in rows.select("query_id", "rank", "pool").collect())
    assert key(retrieval.bm25_ranks(asked, docs)) == key(retrieval.sparse_ranks(asked, scores, docs.count()))
    fields = docs.selectExpr("doc_id doc", "source field")
    assert key(retrieval.bm25_ranks(asked, docs, "source")) == key(retrieval.sparse_ranks(asked, scores, docs.count(), fields))


def test_nfkc_leaves_common_texts_out_of_python():
    every = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000]
    kept = [c for c in every if ok(c)]
    assert all(ok(c) for c in "aéßñœ—“€яλ漢") and not any(ok(c) for c in "ﬁ²ª\u0301\u1161\u212b")
    both = "".join(kept)
    assert unicodedata.normalize("NFKC", both) == both and unicodedata.normalize("NFKC", both[::-1]) == both[::-1]


def ok(c):
    return any(int(a, 16) <= ord(c) <= int(b, 16) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", text.UNCHANGED))


def test_masks_compare_digits(spark):
    ids = spark.createDataFrame([(1, [5] * 50, [1] * 50)], "doc_id long, input_ids array<int>, attention_mask array<int>")
    for share, n in ((0.0, 0), (1.0, 50), (0.3, None)):
        rows = training.masked(ids, "doc_id", 103, 1_000, (), share)
        want = n if n is not None else sum(int(hashlib.md5(f"42:choose:1:{i}".encode()).hexdigest()[:8], 16) / 2**32 < share for i in range(50))
        assert sum(x != training.IGNORED for x in rows.first()["labels"]) == want
    assert plan(training.masked(ids, "doc_id", 103, 1_000, ())).count("conv(") < 4
