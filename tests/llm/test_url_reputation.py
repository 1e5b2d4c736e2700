import duckdb
import pytest
from pyspark.sql import functions as F

from pairlake.llm import queries, url_reputation as u


def test_rules_and_parts(spark):
    cases = [
        ("http://a.example.org/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("HTTPS://EXAMPLE.ORG/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
        ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("http://xcom/de/", "xcom", "/de/", None, "allow"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b?c://d/e", "b", "", None, "allow"),
        ("x\n://h.net\n/p", "h.net\n", "/p", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = u.judge(pages, pages.select("url", F.lit(None).cast("int").alias("bad"))).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [c[1:] for c in cases]


def test_reputation_shrinks(spark):
    rows = [(f"http://bad.spam.net/{i}", 1) for i in range(40)] + [(f"http://other.spam.net/{i}", 1) for i in range(40)] + [(f"http://h{i % 60}.good{i % 30}.net/x", int(i % 20 == 0)) for i in range(600)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    pages = spark.createDataFrame([(0, "http://bad.spam.net/new"), (1, "http://new.spam.net/"), (2, "http://h1.good1.net/"), (3, "http://new.unknown.net/"), (4, "http://x.zz/"), (0, "http://bad.spam.net/new")], "page_id long, url string")
    got = u.judge(pages, outcomes).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block", "block", "block", "allow", "allow", "allow"]
    assert got[0]["bad_rate"] > got[2]["bad_rate"] > got[4]["bad_rate"] and got[5]["bad_rate"] is None
    assert u.judge(pages.limit(0), outcomes).count() == 0 and u.judge(pages, outcomes.limit(0)).where("verdict = 'block'").count() == 0


def test_names_domains_and_suffixes(spark):
    cases = {
        "a.b.example.org": ("a.b.example.org", "example.org", "org"), "x.co.uk": ("x.co.uk", "x.co.uk", "co.uk"), "www.x.co.uk:8080": ("www.x.co.uk", "x.co.uk", "co.uk"),
        "user:pw@h.example.com:80": ("h.example.com", "example.com", "com"), "example.org.": ("example.org", "example.org", "org"), "10.0.0.7:99": ("10.0.0.7", "10.0.0.7", "(address)"),
        "localhost": ("localhost", "localhost", "localhost"), "co.uk": ("co.uk", "co.uk", "co.uk"), "": ("", "", ""), "h" * 100_000 + ".net": ("h" * 100_000 + ".net", "h" * 100_000 + ".net", "net"),
    }
    rows = spark.createDataFrame([(h,) for h in cases], "host string").withColumn("name", u.name_of(F.col("host")))
    got = {r["host"]: (r["name"], r["d"], r["s"]) for r in rows.select("host", "name", u.registered_domain(F.col("name")).alias("d"), u.suffix(F.col("name")).alias("s")).collect()}
    assert got == cases


def test_the_plan_does_not_grow_with_the_levels(spark):
    plan = queries.QUERIES["op8_url_reputation"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracles(spark, name):
    import glob
    import os

    data, c = "/root/testdata/sf0.001", duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, want = queries.QUERIES[name](spark, data).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    cell = lambda v: None if v is None or v != v else v if isinstance(v, str) else round(float(v), 5)
    rows = lambda frame: sorted(repr([cell(v) for v in r]) for r in frame[columns].itertuples(index=False))
    assert rows(got) == rows(want)
