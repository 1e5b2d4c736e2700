"""Catalog, shards, indexes and the streaming extension."""

import json

from pairlake.sources import sinks
from pairlake.sources.catalog import Catalog, find_task_results, read_results, read_shards
from pairlake.streaming.dedup import deduplicated


def test_catalog(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "s2ag/papers/part=1"))
    c = Catalog(spark, str(tmp_path))
    assert c.register() == ["s2ag_papers"]
    assert spark.table("s2ag_papers").columns == ["id"]
    assert c.query("select id from s2ag_papers where id > ? order by id", [1]).collect()[0]["id"] == 2
    c.register_frame("probe", [(1,), (5,)], "id long")
    assert spark.sql("select * from probe join s2ag_papers using (id)").count() == 1
    kept = c.table("kept", spark.range(4), str(tmp_path / "kept"))
    assert kept.count() == 4 and c.table("kept", spark.range(9), str(tmp_path / "kept")).count() == 4
    assert c.table("kept", spark.range(9), str(tmp_path / "kept"), fresh=True).count() == 9


def test_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_shards(spark.range(10).coalesce(1), path, 4)
    assert sorted(r["samples"] for r in sinks.index(spark, path).collect()) == [2, 4, 4]
    spark.range(2).withColumnRenamed("id", "other").write.mode("append").parquet(path)
    assert set(read_shards(spark, path).columns) == {"id", "other"} and read_shards(spark, str(tmp_path / "none")) is None
    assert sinks.merged(spark.range(1), spark.range(2).withColumnRenamed("id", "other")).count() == 3
    sinks.write_stats(spark.range(1), str(tmp_path / "stats"))
    assert "| id |" in sinks.report(spark.range(2), str(tmp_path / "report"), "Title")
    tokens = spark.createDataFrame([([1, 2], [1, 1])], "input_ids array<int>, attention_mask array<int>")
    sinks.write_tokens(tokens, str(tmp_path / "tokens"))
    assert spark.read.parquet(str(tmp_path / "tokens")).count() == 1


def test_index_names_shards_that_cannot_be_read(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_shards(spark.range(6).coalesce(1), path, 3)
    (tmp_path / "out/zz.parquet").write_bytes(b"no shard")
    found = sinks.index(spark, path).collect()
    assert [r["samples"] for r in found] == [3, 3, None] and found[-1]["file"] == "zz.parquet" and all(r["bytes"] > 0 for r in found)
    index = json.loads(sinks.shard_index(sinks.index(spark, path)))
    assert index["version"] == 2 and [x["samples"] for x in index["shards"]] == [3, 3]


def test_results(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": 1}))
    (tmp_path / "baseline_results.json").write_text("{}")
    assert [(r["model"], json.loads(r["document"])) for r in read_results(spark, str(tmp_path)).collect()] == [("a", {"x": 1})]
    for i in (1, 2):
        (tmp_path / f"m/{i}").mkdir(parents=True)
        (tmp_path / f"m/{i}/T.json").write_text(str(i))
    assert [(r["model"], r["document"]) for r in find_task_results(spark, str(tmp_path), "T").collect()] == [("m", "1")]


def test_stream_keeps_the_first(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:01")], "k string, t string").selectExpr("k", "to_timestamp(t) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = deduplicated(stream, "ts", "1 hour", "k").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["k"] for r in spark.table("firsts").collect()) == ["a", "b"]
