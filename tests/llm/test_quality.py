import numpy as np
from pyspark.sql import functions as F

from pairlake.llm import quality_model as q

DATA = "/root/testdata/sf0.1"


def test_labels_model_finds_accuracies():
    r = np.random.RandomState(0)
    bad = r.rand(20_000) < 0.3
    votes = np.zeros((20_000, 4), np.int64)
    for j, accuracy in enumerate((0.95, 0.8, 0.9, 0.7)):
        right = r.rand(20_000) < accuracy
        votes[:, j] = np.where(r.rand(20_000) < 0.2, q.NONE, np.where(bad == right, q.BAD, q.GOOD))
    patterns, counts = np.unique(q.pattern_of(votes), return_counts=True)
    model = q.fit_labels(q.votes_in(patterns, 4), counts.astype(float))
    assert abs(model.prior - 0.3) < 0.03 and np.abs(model.accuracies() - [0.95, 0.8, 0.9, 0.7]).max() < 0.04
    assert ((model.posterior(votes) > 0.5) == bad).mean() > 0.93


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = q.fit(docs, labels.where(~held))
    got = q.score(docs, model).join(labels.where(held), "doc_id").toPandas()
    junk, clean = got[got.quality == 0], got[(got.quality == 1) & (got.toxic == 0)]
    toxic = got[got.toxic == 1]
    assert (~junk.kept).mean() > 0.95 and clean.kept.mean() > 0.97
    # the lexicons know English insults only; the rest is what the scorer learnt
    english = docs.where("lang = 'en'").select("doc_id").toPandas().doc_id
    print("toxic", len(toxic), (~toxic.kept).mean(), "others", (~toxic[~toxic.doc_id.isin(english)].kept).mean())
    assert (~toxic.kept).mean() > 0.9 and (~toxic[~toxic.doc_id.isin(english)].kept).mean() > 0.75


def test_sample_bounds_are_exact(spark):
    votes = spark.createDataFrame([(i if i % 7 else None, f"k{i % 500}", 100, i % 9) for i in range(2_000)], "doc_id long, text_key string, size long, pattern long")
    got = q._sample(votes, 60, 10**9).collect()
    assert len(got) == len({r["text_key"] for r in got}) == 60
    assert q._sample(votes, 60, 1_050).count() == 10 and q._sample(votes.limit(0), 60, 10).count() == 0
    assert {r["text_key"] for r in q._sample(votes.repartition(7), 60, 10**9).collect()} == {r["text_key"] for r in got}


def test_edges(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    people = {r["doc_id"]: r["people"] for r in q._people(labels.where("doc_id is not null")).collect()}
    assert people == {1: q.BAD * 3**q.HEURISTICS + q.GOOD * 3 ** (q.HEURISTICS + 1), 2: 0}
    rows = [(1, None), (2, ""), (3, "One sentence here. " * 3_000), (3, "One sentence here. " * 3_000)]
    model = q.fit(docs_of(rows), labels.limit(0))
    assert q.score(docs_of(rows), model).count() == 4 and q.score(docs_of([]), model).count() == 0
    empty = q.fit(docs_of([]), labels.limit(0))
    assert q.score(docs_of(rows), empty).where("kept").count() == 4
