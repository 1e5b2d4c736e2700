"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    jaccard_join,
    length_histogram,
    outliers,
    quality_model,
    repeats,
    secrets,
    sentencepiece_backend,
    sharding,
    url_reputation,
)
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.histogram(length_histogram.counted(table(spark, sf_dir, "documents")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_backend.encoded(table(spark, sf_dir, "documents"), keep_ids=False, whole=True)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_model.score(documents, quality_model.fit(documents, table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a page: its document (the number in its path) is labelled toxic or of low quality."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels")
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), r"^/[a-z]+/([0-9]{1,18})", 1)
    bad = labels.groupBy("doc_id").agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    outcomes = pages.select("url", number.try_cast("bigint").alias("doc_id")).join(bad, "doc_id").select("url", "bad")
    return url_reputation.judge(pages, outcomes)


def op9_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    rules = sorted(url_reputation.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in rules) + " end"
    verdict = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in rules) + " end"
    strength = (
        "greatest(2.0, least(1000.0, case when {u} > 0 and {o} / {u} > 0 then {u} / {o} - 1 else 1000.0 end))"
    ).format(
        u="sum(case when n_all > 1 then n_all::double * (n_all - 1) * prior * (1 - prior) else 0.0 end)",
        o="sum(case when n_all > 1 then (n_bad - n_all * prior) ** 2 - n_all * prior * (1 - prior) else 0.0 end)",
    )

    name = "regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '[.]+$', '')"
    address, two = (f"regexp_matches(name, '{p}')" for p in (url_reputation.ADDRESS, url_reputation.TWO_LABELS))
    domain = f"case when {address} then name when {two} then regexp_extract(name, '([^.]*[.])?[^.]*[.][^.]*$') else regexp_extract(name, '([^.]*[.])?[^.]*$') end"
    suffix = f"case when {address} then '{url_reputation.ADDRESSES}' when {two} then regexp_extract(name, '[^.]*[.][^.]*$') else regexp_extract(name, '[^.]*$') end"

    def level(name: str, children: str, parents: str, key: str) -> str:
        return f"""
  {name}_p as (select c.*, p.prior from {children} c join {parents} p using ({key})),
  {name}_s as (select {key}, {strength} as strength from {name}_p group by {key}),
  {name}_r as (select x.*, s.strength, (n_bad + strength * prior) / (n_all + strength) as rate, n_all + strength as weight
    from {name}_p x join {name}_s s using ({key})),
  {name} as (select *, rate - 2.0 * sqrt(rate * (1 - rate) / (weight + 1)) as bound from {name}_r)"""

    return f"""
with seen as (select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_reputation.UPPER}', '{url_reputation.LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
  bads as (select doc_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels group by doc_id),
  outcomes as (select {name} as name, b.bad from seen s join bads b
    on try_cast(regexp_extract(s.path, '^/[a-z]+/([0-9]{{1,18}})', 1) as bigint) = b.doc_id where {name} <> ''),
  hosts as (select name, {domain} as domain, {suffix} as suffix, count(*) as n_all, sum(bad) as n_bad from outcomes group by name),
  domains as (select domain, suffix, sum(n_all) as n_all, sum(n_bad) as n_bad from hosts group by domain, suffix),
  suffixes as (select suffix, '' as root, sum(n_all) as n_all, sum(n_bad) as n_bad from domains group by suffix),
  world as (select '' as root, (sum(n_bad) + 1) / (sum(n_all) + 2) as prior from suffixes),
  {level("s", "suffixes", "world", "root")},
  s_prior as (select suffix, rate as prior from s),
  {level("d", "domains", "s_prior", "suffix")},
  d_prior as (select domain, rate as prior from d),
  {level("h", "hosts", "d_prior", "domain")},
  named as (select *, {name} as name from seen),
  split as (select *, {domain} as domain, {suffix} as suffix, {rule} as rule, {verdict} as ruled from named),
  judged as (select x.*, coalesce(h.rate, d.rate, s.rate) as r, coalesce(h.bound, d.bound, s.bound) as b from split x
    left join h on x.name = h.name left join d on x.domain = d.domain left join s on x.suffix = s.suffix)
select page_id, host, path, rule, coalesce(ruled, case when b > 0.3 then 'block' else 'allow' end) as verdict,
  round(r, 6) as bad_rate, round(b, 6) as bad_bound from judged
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_length_histogram": op2_length_histogram,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_model": op4_quality_model,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_repeats": op7_repeats,
    "op8_url_reputation": op8_url_reputation,
    "op9_outliers": op9_outliers,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontamination.leaks_sql(),
    "op8_url_reputation": _op8_sql(),
    "op10_jaccard_join": jaccard_join.groups_sql(),
}
