import pytest

import corpus_pipeline as p
from pairlake.llm import common, decontamination, jaccard_join, outliers, secrets
from pairlake.llm import sentencepiece_backend as sp

DATA = "/root/testdata/sf0.001"


def test_run_equals_its_parts(spark):
    """The stages' decisions, taken with plain Python from the operators' verdicts on whole inputs."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in outliers.judged(docs).where("kept").collect()}
    left = docs.where(docs.doc_id.isin(list(kept)))
    groups = {r["doc_id"]: r["component_id"] for r in jaccard_join.groups(left).collect()}
    kept = {i for i in kept if groups[i] == i}
    items = [decontamination.exact_shingles(t) for t in benchmark]
    kept = {i for i in kept if not any(4 * len(s & decontamination.exact_shingles(rows[i])) >= 3 * len(s) for s in items)}
    want = {}
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(docs.where(docs.doc_id.isin(list(kept)))).collect()}
    original = sp.backend(sp.MODEL).original
    for i in kept:
        want[i] = original.encode(secrets.redact(rows[i], spans[i]))
    before = common.written(spark)
    run = p.run(spark, DATA)
    assert common.written(spark) == before + 1  # the last stage's input
    got = run.collect()
    assert common.discard(spark, since=before) == 1 and common.written(spark) == before
    assert {r["doc_id"]: r["ids"] for r in got} == want and len(got) == len(want) and all(r["word_parity"] for r in got)


def test_stages_return_documents(spark, docs_of):
    rows = [(i, f"Text {i} " + " ".join(f"w{i * 7 + k}" for k in range(60))) for i in range(5)] + [(9, None), (10, ""), (3, f"Text 3 " + " ".join(f"w{21 + k}" for k in range(60)))]
    docs = docs_of(rows)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.count() <= len(rows)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert p.near_duplicates(spark, docs, DATA).where("doc_id = 3").count() == 1
    assert p.without_secrets(spark, docs, DATA).count() == len(rows)
    secret = docs_of([(1, "token = abcdefgh1234 x"), (2, "plain")])
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["spans"]) for r in p.without_secrets(spark, secret, DATA).collect()} == {1: ("[SECRET] x", 10, "y"), 2: ("plain", 5, "y")}


def test_rows_have_their_own_verdicts(spark, docs_of):
    """Null and repeated doc_ids: no row gets another's verdict, spans or place."""
    clean = lambda k: f"Text {k} " + " ".join(f"w{k}x{j}" for j in range(60))
    texts = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.collect())
    rows = [(None, clean(1)), (None, clean(2)), (3, clean(3)), (3, "short"), (3, clean(4)), (None, "short"), (5, clean(5))]
    want = sorted((i is None, i or 0, t) for i, t in rows if t != "short")
    assert texts(p.quality_rules(spark, docs_of(rows), DATA)) == want
    copies = [(None, clean(1)), (4, clean(3) + " end"), (5, clean(3))]
    assert texts(p.near_duplicates(spark, docs_of([r for r in rows if r[1] != "short"] + copies), DATA)) == want
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    leaky = docs_of([(3, clean(3)), (3, f"{clean(6)} {item}"), (None, f"{clean(7)} {item}"), (None, clean(1))])
    assert texts(p.decontaminated(spark, leaky, DATA)) == [(False, 3, clean(3)), (True, 0, clean(1))]
    secret = docs_of([(None, "a token = abcdefgh1234 x"), (3, "password=abcdefgh99"), (3, "bb cc api_key: zyxwvuts12"), (3, "plain"), (None, None)])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in p.without_secrets(spark, secret, DATA).collect())
    assert got == [(False, 3, "[SECRET]"), (False, 3, "bb cc [SECRET]"), (False, 3, "plain"), (True, 0, ""), (True, 0, "a [SECRET] x")]


def test_names_that_clash(spark, docs_of):
    docs = docs_of([(1, "token = abcdefgh1234 " + " ".join(f"w{i}" for i in range(60))), (2, None)])
    for name in ("_row", "_key", "_found_spans", "g", "comp", "text_key", "item", "kept", "distance"):
        docs = docs.withColumn(name, docs["lang"])
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert [(r["doc_id"], r["_row"], r["comp"], r["kept"]) for r in out.where("doc_id = 1").collect()] == [(1, "en", "en", "en")], name


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default: default})()

    with pytest.raises(RuntimeError):
        common.checkpoint_dir(Session())
