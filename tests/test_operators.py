"""Operators on small hand-made tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pairlake.config import Config, override
from pairlake.functions import sections
from pairlake.functions.hashing import draw, uniform
from pairlake.operators import audit, graph, mixer, negatives, retrieval, sampling, scores, signals, training


def tuples(df):
    return sorted(map(tuple, df.collect()))


def test_draws_match_their_definition(spark):
    row = spark.range(1).select(draw(42, "t", F.lit(7)).alias("d"), uniform(42, "t", F.lit(7)).alias("u")).first()
    import hashlib

    h = hashlib.md5(b"42:t:7").hexdigest()
    assert row["d"] == int(h[:15], 16) and row["u"] == int(h[:8], 16) / 2**32


def test_adjacency_and_cocitation(spark):
    edges = spark.createDataFrame([(1, c, i, True) for i, c in enumerate([5, 4, 4, 6])] + [(2, 4, 9, None), (2, 5, 10, False), (3, 3, 11, True)], "citing long, cited long, citationid long, isinfluential boolean")
    assert tuples(graph.forward_adjacency(edges, 3)) == [(1, [4, 4, 5]), (2, [4, 5]), (3, [3])]
    assert tuples(graph.cocitation(edges)) == [(4, 5), (4, 6), (5, 6)]
    assert tuples(graph.cocitation(edges, 2)) == [(4, 5)]
    assert graph.tier(edges, True).count() == 5 and graph.tier(edges, False).count() == 1 and graph.tier(edges, None).count() == 7
    assert tuples(graph.two_hop(spark.createDataFrame([(1, 2)], "citing long, cited long"), spark.createDataFrame([(2, [1, 2, 7, 7])], "citing long, cited_ids array<long>"))) == [(2, 1, 7)]


def test_pool_and_ends(spark):
    papers = spark.createDataFrame([(1, "t", "x" * 50, "f", None), (2, None, "x" * 60, "f", 3), (3, "t", "x" * 49, "f", 3), (4, "t", "y" * 600, None, 7)], "corpusid long, title string, abstract string, field_of_study string, citationcount int")
    pool = graph.paper_pool(papers)
    assert [(r["corpusid"], len(r["abstract_preview"]), r["citationcount"]) for r in pool.orderBy("corpusid").collect()] == [(1, 50, 0), (4, 512, 7)]
    edges = spark.createDataFrame([(1, 4), (4, 1), (4, 4), (1, 2)], "citing long, cited long")
    assert graph.within(edges, pool).count() == 3 and tuples(graph.within(edges, pool, 5)) == [(4, 4)]


def test_negatives_keep_their_promises(spark):
    pool = spark.createDataFrame([(i, "t", "a", "big" if i < 150 else "small" if i < 160 else None, 0) for i in range(200)], "corpusid long, title string, abstract_preview string, field_of_study string, citationcount long")
    pairs = spark.createDataFrame([(i, (i * 7 + 3) % 200) for i in range(200)], "citing long, cited long").where("citing <> cited")
    adjacency = spark.createDataFrame([(i, [(i + 1) % 200, (i + 2) % 200]) for i in range(0, 200, 2)], "citing long, cited_ids array<long>")
    got = negatives.hard_negatives(pairs, pool, adjacency).collect()
    fields = {r["corpusid"]: r["field_of_study"] for r in pool.collect()}
    assert len(got) == pairs.count()
    for r in got:
        assert r["negative"] not in (r["citing"], r["cited"])
        if r["branch"] == "same_field":
            assert fields[r["negative"]] == fields[r["citing"]] == "big"
        if r["branch"] == "two_hop":
            assert r["cited"] % 2 == 0 and r["negative"] in ((r["cited"] + 1) % 200, (r["cited"] + 2) % 200)
    branches = {b: sum(r["branch"] == b for r in got) for b in ("same_field", "two_hop", "random")}
    assert branches["same_field"] > 50 and branches["two_hop"] > 10 and branches["random"] > 20
    again = negatives.hard_negatives(pairs.repartition(7), pool.repartition(5), adjacency.repartition(3))
    assert tuples(again.select("citing", "cited", "negative")) == sorted((r["citing"], r["cited"], r["negative"]) for r in got)
    texts = negatives.triplets(negatives.hard_negatives(pairs, pool, adjacency), pool)
    assert texts.count() == len(got) and texts.first()["anchor"] == "search_query: t. a"


def test_sampling(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 4)
    assert sampling.exact(rows, 10, 1, "id").count() == 10 and sampling.exact(rows, 1_000, 1, "id").count() == 100
    assert tuples(sampling.exact(rows.repartition(9), 10, 1, "id")) == tuples(sampling.exact(rows, 10, 1, "id"))
    assert {r["g"]: r["count"] for r in sampling.stratified(rows, "g", 5, 1, "id").groupBy("g").count().collect()} == {0: 5, 1: 5, 2: 5, 3: 5}
    assert [r["id"] for r in sampling.shuffled(rows, 3, "id").collect()] != list(range(100))
    pairs = sampling.random_pairs(rows, "g", "id", F.lit(30), 5).collect()
    assert len(pairs) == 120 and all(p["first"] != p["second"] and p["first"] % 4 == p["second"] % 4 == p["g"] for p in pairs)
    assert sampling.replicated(rows, F.col("g")).count() == 25 * (0 + 1 + 2 + 3)
    assert sampling.percent_for(30_000_000) == pytest.approx(4.819, abs=1e-3) and sampling.percent_for(1) == 0.1 and sampling.modulus_for(10**12) == 1


def test_intents_shift_unless_kept_together(spark):
    rows = spark.createDataFrame([([["c1"], ["c2"]], [["a", "b"], ["c"]])], "contexts array<array<string>>, intents array<array<string>>")
    flat = rows.select(signals.labelled_contexts(F.flatten("contexts"), F.flatten("intents")).alias("p")).first()["p"]
    assert [tuple(x) for x in flat] == [("c1", "a"), ("c2", "b")]
    own = rows.select(signals.labelled_contexts(F.flatten("contexts"), F.col("intents"), per_context=True).alias("p")).first()["p"]
    assert [tuple(x) for x in own] == [("c1", "a"), ("c1", "b"), ("c2", "c")]


def test_section_pairs(spark):
    body = "word " * 60
    docs = spark.createDataFrame([(i, f"Introduction\n{body}{i}\nMethods\n{body}m{i}\nResults\n{body}r{i}") for i in range(6)], "doc_id long, text string")
    got = signals.section_pairs(sections.extract(docs), 40).collect()
    assert len(got) == 40
    for r in got:
        assert (r["anchor_section"] == r["positive_section"]) == (r["pair_type"] == "same_section")
        assert r["anchor"].startswith("section_")


def test_normalized_layouts(spark):
    make = lambda cols: spark.createDataFrame([tuple("x" for _ in cols)], list(cols))
    for cols, want in ((("anchor", "positive", "negative"), ("x", "x", "x", "s")), (("query", "document", "intent"), ("x", "x", None, "s")), (("text1", "text2"), ("x", "x", None, "s")), (("text", "label"), ("x", "x", None, "s"))):
        assert tuples(mixer.normalized(make(cols), "s")) == [want]
    assert mixer.normalized(make(("other",)), "s").count() == 0


def test_mix_keeps_the_first_signal(spark):
    a = spark.createDataFrame([("q", "d", "n"), ("q", None, "n")], "anchor string, positive string, negative string")
    b = spark.createDataFrame([("q", "d"), ("cluster: x", "y"), ("same", "same"), (None, "z"), ("q", None)], "text1 string, text2 string")
    got = mixer.mix({"a": (a, None), "instruction_pairs": (b, None)})
    assert tuples(got.select(F.coalesce("positive", F.lit("-")), "negative", "signal_type")) == [("-", "n", "a"), ("d", "n", "a")]
    stats = {r["signal_type"]: (r["available"], r["kept"]) for r in mixer.mix_stats({"a": a, "instruction_pairs": b}, got).collect()}
    assert stats == {"a": (2, 2), "instruction_pairs": (5, 0)}


@pytest.mark.parametrize(("n", "lengths"), [(63, []), (64, [64]), (510, [510, 128]), (511, [510, 129]), (445, [445, 63][:1]), (0, [])])
def test_chunks(spark, n, lengths):
    rows = spark.createDataFrame([(1, list(range(1000, 1000 + n)))], "doc_id long, ids array<int>")
    got = training.chunked(rows, 512, 128, 50281, 50282, 50283).orderBy("chunk").collect()
    assert [sum(r["attention_mask"]) - 2 for r in got] == lengths
    for r in got:
        active = sum(r["attention_mask"])
        assert len(r["input_ids"]) == 512 and r["input_ids"][0] == 50281 and r["input_ids"][active - 1] == 50282 and set(r["input_ids"][active:]) <= {50283}
        assert r["input_ids"][1] == 1000 + 382 * r["chunk"]


def test_masking_shares(spark):
    rows = spark.createDataFrame([(i, [1] + list(range(100, 300)) + [0] * 20, [1] * 201 + [0] * 20) for i in range(40)], "id long, input_ids array<int>, attention_mask array<int>")
    got = training.masked(rows, "id", 9_999, 1_000, (1, 0)).collect()
    chosen = masked = kept = 0
    for r in got:
        assert r["labels"][0] == -100 and set(r["labels"][201:]) == {-100} and r["input_ids"][0] == 1
        for x, y, o in zip(r["input_ids"][1:201], r["labels"][1:201], range(100, 300)):
            assert y in (-100, o) and (y != -100 or x == o)
            chosen += y != -100
            masked += x == 9_999
            kept += y != -100 and x == o
    assert abs(chosen / 8_000 - 0.3) < 0.03 and abs(masked / chosen - 0.8) < 0.05 and abs(kept / chosen - 0.1) < 0.04


def test_corpus_with_an_injected_tokenizer(spark):
    docs = spark.createDataFrame([(1, "word " * 100, "pmc"), (2, "short", "pmc"), (3, None, None)], "doc_id long, text string, source string")
    got = training.corpus(docs, lambda: lambda texts: [[len(w) for w in t.split()] for t in texts], 130, 16, 7, 8, 9)
    assert [(r["doc_id"], sum(r["attention_mask"])) for r in got.collect()] == [(1, 102)]


def test_splits_and_routes(spark):
    rows = spark.range(2_000).withColumn("c", F.col("id") % 2)
    share = training.train_eval(rows, 0.05, 1, "id").where("split = 'eval'").count() / 2_000
    assert 0.03 < share < 0.07
    exact = training.train_eval(rows, 0.05, 1, "id", by="c").groupBy("c", "split").count().collect()
    assert {(r["c"], r["split"]): r["count"] for r in exact} == {(c, s): n for c in (0, 1) for s, n in (("eval", 50), ("train", 950))}
    mixed = spark.createDataFrame([("a", "p", "n", "t"), ("a", "q", "", "t"), ("a", "r", "n", "t"), ("a", "p", None, "u"), ("b", "p", "n", "u")], "anchor string, positive string, negative string, signal_type string")
    assert {r["signal_type"]: r["is_triplet"] for r in training.routed(mixed).collect()} == {"t": True, "u": False}
    assert training.training_rows(mixed).groupBy("signal_type").count().orderBy("signal_type").collect()[0]["count"] == 2


def test_ranks_with_ties_and_fields(spark):
    candidates = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y"), (3, [0.8, 0.6], None)], "candidate_id long, vector array<float>, field string")
    queries = spark.createDataFrame([(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0], 3)], "query_id long, vector array<float>, gold long")
    assert tuples(retrieval.dense_ranks(queries, candidates)) == [(10, 1, 4), (11, 4, 4), (12, 3, 4)]
    assert tuples(retrieval.dense_ranks(queries, candidates, same_field=True)) == [(10, 1, 2), (11, 1, 1), (12, 1, 1)]
    m = retrieval.metrics(retrieval.dense_ranks(queries, candidates)).first()
    assert (m["r1"], m["r10"], m["median_rank"]) == (pytest.approx(1 / 3, abs=1e-6), 1.0, 3.0)
    assert m["ndcg10"] == pytest.approx((1 + 1 / math.log2(5) + 0.5) / 3, abs=1e-6) and m["mrr"] == pytest.approx((1 + 0.25 + 1 / 3) / 3, abs=1e-6)


def test_neighbours_and_truncation(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0, 5.0]), (1, [0.9, 0.1, -5.0]), (2, [0.0, 1.0, 0.0])], "vec_id long, v array<float>")
    space = rows.select("vec_id", retrieval.normalized(F.col("v"), 2).alias("vector"))
    assert [(r["vec_id"], r["neighbour"]) for r in retrieval.neighbours(space, 1).orderBy("vec_id").collect()] == [(0, 1), (1, 0), (2, 1)]
    assert retrieval.agreement(space, space, 2).first()["agreement"] == 1.0
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(retrieval.normalized(F.col("v"))).first()[0]
    assert zero == [0.0, 0.0]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "apple banana"), (1, "apple apple pear"), (2, "kiwi"), (3, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "apple apple banana", 0), (1, "plum", 2)], "query_id long, query string, gold long")
    got = {(r["query_id"], r["doc"]): r["score"] for r in retrieval.bm25(queries, docs).collect()}
    n, avgdl = 4, 6 / 4
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in (("apple", 2), ("banana", 1), ("pear", 1), ("kiwi", 1))}
    tf = lambda f, dl: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got[0, 0] == pytest.approx(2 * raw["apple"] * tf(1, 2) + raw["banana"] * tf(1, 2)) and got[0, 1] == pytest.approx(2 * raw["apple"] * tf(2, 3)) and len(got) == 2
    ranks = retrieval.sparse_ranks(queries, retrieval.bm25(queries, docs), 4)
    assert tuples(ranks) == [(0, 1, 4), (1, 1, 4)]


def test_audit(spark):
    papers = spark.createDataFrame([(i, "D/%d" % i, "x" * 60, i) for i in range(10)], "corpusid long, doi string, abstract string, citationcount int")
    universe = audit.candidate_universe(papers)
    assert tuples(universe) == [(i,) for i in range(5, 10)]
    full = spark.createDataFrame([("d/3", True), ("d/3", True), ("d/4", False)], "doi string, has_full_text boolean")
    assert tuples(audit.fulltext_universe(papers, full)) == [(3,)]
    mapping = spark.createDataFrame([("ab" * 20, 7)], "doc_id string, corpus_id long")
    ids = audit.task_ids(spark.createDataFrame([("5",), (" 6 ",), ("ab" * 20,), ("zz",), (None,), ("5",)], "paper_id string"), mapping)
    assert tuples(audit.paper_overlap(ids, universe.unionByName(universe.limit(0)))) == [(3, 1, 3, 100.0)]
    task = spark.createDataFrame([(5, 6), (6, 5), (5, 6), (7, 8), (1, 2)], "src long, dst long")
    cites = spark.createDataFrame([(6, 5), (1, 2), (8, 9)], "citing long, cited long")
    assert tuples(audit.edge_overlap(task, cites, universe)) == [(4, 2, 50.0)]
    assert audit.edge_universe(cites, universe).first()[0] == 2
    rows = spark.createDataFrame([("t", 5, "test"), ("t", 5, "train"), ("t", 1, "test")], "task string, id long, split string")
    assert tuples(audit.apply_cold_filter(rows, audit.cold_filter(rows, universe)).select("id", "split")) == [(1, "test"), (5, "train")]


def test_scores(spark):
    doc = json.dumps({"Biomimicry": {"complete": {"f1": 80.0}, "f1": 1.0}, "RELISH": {"ndcg": 90.0}, "Max hIndex": {"kendalltau": 0.0}, "SciDocs Cite": {"other": 1}, "Paper-Reviewer Matching": {"hard_P_5": 1, "hard_P_10": 2, "soft_P_5": 3, "soft_P_10": 4}})
    results = spark.createDataFrame([("m", doc)], "model string, document string")
    primary = scores.primary_scores(results, scores.dimension(spark))
    assert tuples(primary.select("task", "score")) == [("Biomimicry", 80.0), ("Max hIndex", 0.0), ("RELISH", 90.0)]
    assert scores.macro_average(primary).first()["macro"] == 85.0 and scores.macro_all_categories(primary).first()["macro"] == 42.5
    extra = scores.reviewer_scores(results)
    assert extra.first()["score"] == 2.5
    assert scores.task_mean(primary, extra).first()["macro"] == pytest.approx((80 + 90 + 0 + 2.5) / 4) and scores.macro_with_extra(primary, extra).first()["macro"] == pytest.approx((80 + 90 + 0 + 2.5) / 4)
    rows = spark.createDataFrame([("t", str(m), float(v)) for m, v in enumerate((10, 10.5, 11, 10, 10.2))] + [("u", str(m), float(v)) for m, v in enumerate((1, 9, 2, 8, 5))] + [("few", "0", 1.0)], "task string, model string, score double")
    assert {r["task"]: r["flag"] for r in scores.task_variance(rows).collect()} == {"t": "STUCK", "u": ""} or {r["task"]: r["flag"] for r in scores.task_variance(rows).collect()}["u"] == "DISCRIM"
    assert scores.without_stuck(rows).select("task").distinct().first()["task"] == "u"
    best = {r["task"]: (r["best_model"], r["delta"]) for r in scores.best_baseline(rows, "0").collect()}
    assert best == {"t": ("2", -1.0), "u": ("1", -8.0)}
    assert [(r["model"], r["place"]) for r in scores.ordered(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0)], "model string, macro double")).orderBy("model").collect()] == [("a", 3), ("b", 1), ("c", 1)]
    dims = spark.createDataFrame([("m", 768, 2.0), ("m", 768, 4.0), ("m", 128, 1.5)], "model string, dim int, score double")
    r = scores.seed_pivot(dims, [768, 128], 768).first()
    assert (r["mean_768"], r["std_768"], r["std_128"], r["percent_128"]) == (3.0, pytest.approx(math.sqrt(2)), 0.0, 50.0)


def test_config():
    c = override(Config(), {"mixer": {"seed": 7}}, "mixer.seed=9", "training.dims=[4,2]", "contexts.min_chars=${env:NOT_SET_ANYWHERE,60}")
    assert (c.mixer.seed, c.training.dims, c.contexts.min_chars) == (9, (4, 2), 60)
    with pytest.raises(KeyError):
        override(Config(), "mixer.nothing=1")


def test_numbers_run_from_nought_in_each_group(spark):
    rows = spark.createDataFrame([(i * 7, "a" if i % 3 else "b") for i in range(50)], "k long, g string")
    got = sampling.numbered(rows, "k", "g", block=32).collect()
    for g in "ab":
        own = sorted((r["k"], r["idx"], r["n"]) for r in got if r["g"] == g)
        assert [(i, n) for _, i, n in own] == [(i, len(own)) for i in range(len(own))]
    assert [r["idx"] for r in sampling.numbered(rows.drop("g"), "k", block=8).orderBy("k").collect()] == list(range(50))


def test_large_samples_equal_small_ones(spark, monkeypatch):
    rows = spark.range(3_000)
    want = [tuples(sampling.exact(rows, n, 1, "id")) for n in (0, 1, 700, 2_999, 3_000, 9_000)]
    monkeypatch.setattr(sampling, "HEAD", -1)
    assert [tuples(sampling.exact(rows, n, 1, "id")) for n in (0, 1, 700, 2_999, 3_000, 9_000)] == want


def test_null_parts_of_a_key_have_their_own_draw(spark):
    rows = spark.createDataFrame([(None, "a"), ("a", None), (None, None), ("a", "")], "x string, y string")
    assert len({r[0] for r in rows.select(draw(1, "t", "x", "y")).collect()}) == 4


def test_a_missing_gold_is_an_error(spark):
    candidates = spark.createDataFrame([(1, [1.0, 0.0], "f"), (2, [0.0, 1.0], None)], "candidate_id long, vector array<double>, field string")
    queries = spark.createDataFrame([(7, [1.0, 1.0], 1), (8, [1.0, 0.0], 5)], "query_id long, vector array<double>, gold long")
    with pytest.raises(KeyError):
        retrieval.dense_ranks(queries, candidates)
    assert tuples(retrieval.dense_ranks(queries, candidates, missing="drop")) == [(7, 1, 2)]
    got = retrieval.evaluated({"m": (queries.where("query_id = 7"), candidates)}).collect()
    assert {(r["model"], r["pool"], r["queries"], r["pool_max"]) for r in got} == {("m", "full", 1, 2), ("m", "samefield", 1, 1)}


def test_sparse_ranks_within_a_field(spark):
    queries = spark.createDataFrame([(1, 10), (2, 11), (3, 13)], "query_id long, gold long")
    scores_ = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (1, 12, 3.0), (2, 11, -1.0), (3, 10, 1.0)], "query_id long, doc long, score double")
    fields = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a"), (13, None), (14, "b")], "doc long, field string")
    assert tuples(retrieval.sparse_ranks(queries, scores_, 5)) == [(1, 3, 5), (2, 5, 5), (3, 2, 5)]
    assert tuples(retrieval.sparse_ranks(queries, scores_, 5, fields)) == [(1, 2, 2), (2, 2, 2), (3, 1, 1)]


def test_negatives_that_the_anchor_cites_can_go(spark):
    pool = spark.createDataFrame([(i, "t", "a", "f", 0) for i in range(150)], "corpusid long, title string, abstract_preview string, field_of_study string, citationcount long")
    pairs = spark.createDataFrame([(i, (i + 1) % 150) for i in range(150)], "citing long, cited long")
    adjacency = spark.createDataFrame([(i, [(i + 2) % 150]) for i in range(150)], "citing long, cited_ids array<long>")
    whole = negatives.hard_negatives(pairs, pool, adjacency)
    cites = spark.createDataFrame([(i, j) for i in range(150) for j in range(0, 150, 2)], "citing long, cited long")
    kept = negatives.hard_negatives(pairs, pool, adjacency, cited_by_anchor=cites)
    assert tuples(kept) == [r for r in tuples(whole) if r[1] % 2] or tuples(kept.select("citing", "negative")) == sorted((r["citing"], r["negative"]) for r in whole.collect() if r["negative"] % 2)


def test_edge_tasks(spark):
    rows = spark.createDataFrame([("1", "2", "1"), (" 1 ", "2", "0.5"), ("s", "3", "-1"), ("s", "x", "2"), (None, None, "1"), (None, "4", "1"), ("5", "6", "bad"), ("5", "6", None)], "query_id string, cand_id string, score string")
    mapping = spark.createDataFrame([("s", 9)], "doc_id string, corpus_id long")
    edges = audit.edge_task(rows, mapping)
    assert edges.where("unresolved").count() == 2 and tuples(audit.positives(edges)) == [(1, 2)]
    assert tuples(audit.endpoints(edges)) == [(1,), (2,), (3,), (5,), (6,), (9,)]


def test_impact(spark):
    papers = spark.createDataFrame([(1, 10), (2, None), (3, 1_000)], "corpusid long, citationcount int")
    counts = audit.citation_counts(spark.createDataFrame([(1,), (2,), (3,), (4,), (1,)], "id long"), papers)
    assert tuples(counts) == [(1, 10), (1, 10), (2, 0), (3, 1_000), (4, 0)]
    assert [r["id"] for r in audit.impact(counts).where("is_high").collect()] == [3]
    assert all(r["is_high"] and r["log_count"] == 0 for r in audit.impact(counts.withColumn("count", F.lit(0).cast("long"))).collect())


def test_section_pairs_of_few_documents(spark):
    found = spark.createDataFrame([(1, "introduction", "i1"), (1, "methods", "m1"), (2, "introduction", "i2"), (3, "results", "r3")], "doc_id long, section_type string, text string")
    rows = signals.section_pairs(found, 50).collect()
    assert 0 < len(rows) <= 50
    for r in rows:
        same = r["anchor_section"] == r["positive_section"]
        assert r["pair_type"] == ("same_section" if same else "cross_section_negative") and r["anchor"] != r["positive"]
    assert signals.section_pairs(found.where("doc_id = 1"), 50).count() == 0 and signals.section_pairs(found.limit(0), 50).count() == 0
    assert {r["section_type"]: r["n"] for r in signals.section_counts(found).collect()} == {"introduction": 2, "methods": 1, "results": 1, "papers": 3}
