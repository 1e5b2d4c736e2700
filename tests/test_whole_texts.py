"""Queries over whole texts, against single steps in Python."""

import hashlib
import re

import pytest

from pairlake import queries
from pairlake.operators import signals

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()


def test_mixing_keeps_whole_texts(spark, docs):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect()
    opening = {}
    for t in turns:
        opening.setdefault(t["conv_id"], t["text"])
    triplets, instructions = {}, set()
    for d in docs:
        key, negative = (d["text"][:60], d["text"]), d["lang"] if d["doc_id"] % 2 == 0 else None
        triplets[key] = min(triplets.get(key, negative), negative, key=lambda x: (x is not None, x))
    for t in turns:
        if t["text"] != opening[t["conv_id"]]:
            instructions.add((t["text"], opening[t["conv_id"]]))
    want = {(*k, n, "citation_triplets") for k, n in triplets.items()} | {(*k, None, "instruction_pairs") for k in instructions - set(triplets)}
    got = [tuple(r) for r in queries.mix_dedup(spark, DATA).select("anchor", "positive", "negative", "signal_type").collect()]
    assert len(got) == len(want) and set(got) == want
    routes = {r["signal_type"]: r["n"] for r in queries.route_signals(spark, DATA).collect()}
    assert routes == {s: sum(w[3] == s for w in want) for s in ("citation_triplets", "instruction_pairs")}
    sample = [(r["anchor"], r["positive"]) for r in queries.mix_sample_exact(spark, DATA).collect()]
    assert len(sample) == len(set(sample)) and set(sample) <= {w[:2] for w in want}


def tokens(text):
    return re.findall("[a-z0-9]+", text.lower())


def test_trigrams_of_whole_texts(spark, docs):
    cleaned = {r["doc_id"]: r["cleaned"] for r in queries.clean_boilerplate(spark, DATA).collect()}
    three = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    want = {}
    for d in docs:
        s, u = three(tokens(d["text"])), three(tokens(cleaned[d["doc_id"]]))
        want[d["doc_id"]] = (len(s), round(len(s & u) / len(s), 6) if s else None)
    got = {r["doc_id"]: (r["n"], r["overlap"]) for r in queries.trigram_overlap(spark, DATA).collect()}
    assert got.keys() == want.keys() and any(w[1] not in (None, 1) for w in want.values())
    assert all(got[i][0] == n and got[i][1] == (x if x is None else pytest.approx(x, abs=2e-6)) for i, (n, x) in want.items())


def test_masking_of_whole_texts(spark, docs):
    def u(tag, *key):
        return int(hashlib.md5(":".join(map(str, (f"42:{tag}", *key))).encode()).hexdigest()[:8], 16) / 2**32

    want = set()
    for d in docs:
        ids = [len(t) for t in tokens(d["text"])]
        chosen = masked = total = 0
        for i, x in enumerate(ids):
            key = d["doc_id"], i
            pick = u("choose", *key) < 0.3 and x not in (101, 102, 0)
            y = x if not pick else 103 if u("kind", *key) < 0.8 else int(u("word", *key) * 1_000) if u("half", *key) < 0.5 else x
            chosen, masked, total = chosen + pick, masked + (pick and y == 103), total + y
        if ids:
            want.add((d["doc_id"], chosen, masked, total))
    assert {tuple(r) for r in queries.mask_tokens(spark, DATA).select("doc_id", "n_chosen", "n_masked", "sum_ids").collect()} == want


@pytest.mark.parametrize(("name", "ends"), [("cocitation_pairs", ("x", "y")), ("improves_over_pairs", ("cited", "citing")), ("related_pairs_bernoulli", ("work_id", "related_work_id"))])
def test_pairs_of_whole_abstracts(spark, docs, monkeypatch, name, ends):
    if name == "related_pairs_bernoulli":  # all related works in place of 2 % of them
        whole = signals.related_pairs
        monkeypatch.setattr(signals, "related_pairs", lambda related, works, share, seed: whole(related, works, 1.0, seed))
    text = {d["doc_id"]: f"{d['text'][:60]}. {d['text']}" for d in docs}
    rows = queries.QUERIES[name](spark, DATA).collect()
    assert rows
    for r in rows:
        assert (r["anchor"], r["positive"]) == (f"search_query: {text[r[ends[0]]]}", f"search_document: {text[r[ends[1]]]}")
    if name == "related_pairs_bernoulli":
        fine = {d["doc_id"] for d in docs if d["lang"] == "en" and 50 < len(d["text"]) < 5_000 and d["text"][:60].strip()}
        n, lines = len(docs), spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
        want = {(x["l_orderkey"] % n, x["l_partkey"] % n) for x in lines}
        assert sorted((r["work_id"], r["related_work_id"]) for r in rows) == sorted((a, b) for a, b in want if a in fine and b in fine)


def test_triplets_have_the_pool_preview(spark, docs):
    text = {d["doc_id"]: f"{d['text'][:60]}. {d['text'][:512]}" for d in docs}
    rows = queries.citation_triplets(spark, DATA).collect()
    assert rows
    for r in rows:
        assert (r["anchor"], r["positive"], r["negative"]) == (f"search_query: {text[r['anchor_id']]}", f"search_document: {text[r['positive_id']]}", f"search_document: {text[r['negative_id']]}")
