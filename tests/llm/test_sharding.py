import zlib

import pytest

from pairlake.llm import sharding


def check(rows, got, shards=24):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    slots = {}
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)]
    largest = max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= 2 * largest
    return slots


def test_even_bytes_with_a_hot_group(spark, docs_of):
    rows = [(i, "hot text " * 20) for i in range(1_500)] + [(2_000 + i, "é" * (i % 400)) for i in range(2_500)] + [(9_000, None), (None, "x"), (9_001, ""), (9_002, "long " * 500), (7, "again"), (7, "again")]
    check(rows, sharding.sharded(docs_of(rows)).collect())


def test_many_ranges_and_subdivision(spark, docs_of):
    rows = [(i, f"text {i % 50}") for i in range(3_000)]
    prepared = sharding.prepared(docs_of(rows))
    got = sharding.shard(prepared, 24, range_bytes=512, max_ranges=96, per_range=2).collect()
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(24)]
    assert max(sizes) - min(sizes) <= 40 and len(got) == 3_000


def test_few_rows(spark, docs_of):
    assert sharding.sharded(docs_of([])).count() == 0
    rows = [(1, "a"), (2, "a")]
    assert len(sharding.sharded(docs_of(rows)).collect()) == 2


def test_written_shards_hold_whole_rows(spark, docs_of, tmp_path):
    rows = [(i, f"text {i}") for i in range(200)]
    sharding.write_shards(docs_of(rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == rows and back.select("shard").distinct().count() == 4


def test_written_shards_have_every_row_once(spark, tmp_path):
    rows = [(1, "a", "x", 5), (1, "b", "y", None), (None, "c", None, 7), (2, None, "x", 8), (2, None, "x", 8), (3, "", "z", 1)]
    rows += [(10 + i, "hot " * 50, "h", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `key` string, size long")
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(((r["doc_id"], r["text"], r["key"], r["size"]) for r in back), key=str) == sorted(rows, key=str)
    for s in {r["shard"] for r in back}:
        assert sorted(r["slot"] for r in back if r["shard"] == s) == list(range(sum(r["shard"] == s for r in back)))
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("slot", docs["size"]), str(tmp_path / "other"))
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"))
