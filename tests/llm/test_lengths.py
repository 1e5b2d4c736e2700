from pairlake.llm import length_histogram as lh


def test_histogram_equals_brute_force(spark):
    lengths = [0, 0, 3, 5, 5, 5, 9, 1024, 1025, 5000]
    hist = lh.histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"), block=4)
    rows = {r["n_tokens"]: r for r in hist.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        kept = sum(min(x, n) for x in lengths)
        assert (r["n_docs"], r["docs_longer"], r["truncated_total"], r["tokens_lost"], r["docs_total"], r["tokens_total"]) == (lengths.count(n), sum(x > n for x in lengths), kept, sum(lengths) - kept, len(lengths), sum(lengths))
    cut = {r["context_limit"]: (r["truncated_total"], r["docs_truncated"]) for r in lh.truncated_totals(hist, [4, 100, 10**6]).collect()}
    assert cut == {x: (sum(min(n, x) for n in lengths), sum(n > x for n in lengths)) for x in (4, 100, 10**6)}
    assert tuple(lh.quantiles(hist, [0.5, 0.9, 1.0]).first()) == (5, 1025, 5000)
    assert lh.histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_counts(spark, docs_of):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "é😀\n" * 1000), (1, "Hello world"), (6, " " * 300_000 + "x"), (7, "a" * 50_000)]
    got = lh.counted(docs_of(rows))
    by_id = {r["doc_id"]: r["n_tokens"] for r in got.collect()}
    encoding = lh._encoding(lh.RANKS)
    assert got.count() == 8 and by_id[2] == by_id[3] == 0
    for i, t in rows:
        if t and i != 6:
            assert by_id[i] == len(encoding.encode_ordinary(t))
    # the long way must agree with the encoder where that can still go
    assert sum(len(encoding._encode_single_piece(p)) for p in __import__("regex").findall(lh.PATTERN, rows[6][1])) == by_id[6] == len(encoding.encode_ordinary(rows[6][1]))
    assert lh.token_count(" " * 2_000_000) > 0
