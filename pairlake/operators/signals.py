"""Builders of training pairs: one function per signal.

Each takes source tables by the columns it uses and returns pairs; ``limited`` cuts
to a target in key order where a target is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sections as sec
from ..functions import text
from ..functions.hashing import digest, draw, uniform
from . import graph, sampling, texts


def limited(pairs: DataFrame, target: int | None, *keys: str) -> DataFrame:
    return pairs if target is None else pairs.orderBy(*keys).limit(target)


def _typed(pairs: DataFrame, name: str) -> DataFrame:
    """anchor, positive, a null negative and the signal's name, beside the key columns."""
    return pairs.withColumns({"negative": F.lit(None).cast("string"), "signal_type": F.lit(name)})


def context_pairs(citations: DataFrame, papers: DataFrame, influential_only: bool = False, rate: float = 1.0, seed: int = 42, least: int = 50, most: int = 1_000) -> DataFrame:
    """query (a citation context), document (the cited paper), citing_id, cited_id.

    The rate samples citation rows, before their contexts are unnested.
    """
    rows = graph.tier(citations, True if influential_only else None).where(F.col("contexts").isNotNull() & (F.size("contexts") > 0))
    if rate < 1:
        rows = rows.where(uniform(seed, "contexts", "citationid") < rate)
    rows = rows.select("citing", "cited", F.explode("contexts").alias("raw")).withColumn("context", text.filter_context(F.col("raw"), least, most)).where("context is not null")
    cited = papers.where(F.col("title").isNotNull() & (F.length("abstract") >= 50)).select(F.col("corpusid").alias("cited"), text.prefixed("search_document", F.col("title"), F.col("abstract")).alias("document"))
    return rows.join(cited, "cited").select(F.concat(F.lit("search_query: "), "context").alias("query"), "document", F.col("citing").alias("citing_id"), F.col("cited").alias("cited_id"))


def labelled_contexts(contexts: Column, intents: Column, per_context: bool = False) -> Column:
    """array<struct<context, intent>>: members at the same place, to the shorter list's end.

    Lists of lists are flattened before they are put together, which shifts contexts
    against labels where one has several; ``per_context`` keeps each with its own.
    """
    if per_context:
        pairs = F.transform(F.arrays_zip(contexts.alias("c"), intents.alias("i")), lambda z: F.transform(F.coalesce(z["i"], F.array().cast("array<string>")), lambda i: F.struct(z["c"].alias("context"), i.alias("intent"))))
        return F.flatten(pairs)
    n = F.least(F.size(contexts), F.size(intents))
    return F.transform(F.slice(F.arrays_zip(contexts.alias("c"), intents.alias("i")), F.lit(1), n), lambda z: F.struct(z["c"].alias("context"), z["i"].alias("intent")))


def intent_pairs(citations: DataFrame, papers: DataFrame, oversample: dict[str, int] | None = None, least: int = 50, most: int = 1_000) -> DataFrame:
    """query, document, intent, citing_id, cited_id; rarer intents repeated."""
    oversample = {"background": 1, "methodology": 3, "result": 10} if oversample is None else oversample
    rows = citations.where((F.size("contexts") > 0) & (F.size("intents") > 0))
    rows = rows.select("citing", "cited", F.explode(labelled_contexts(F.col("contexts"), text.intents_of(F.col("intents")))).alias("p")).select("citing", "cited", "p.*")
    prefix = F.create_map(*[F.lit(x) for kv in text.INTENT_PREFIXES.items() for x in kv])
    times = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in oversample.items() for x in kv]), F.col("intent")), F.lit(1)) if oversample else F.lit(1)
    rows = rows.withColumns({"prefix": F.try_element_at(prefix, F.col("intent")), "context": text.filter_context(F.col("context"), least, most)})
    rows = rows.where(F.col("prefix").isNotNull() & F.col("context").isNotNull())
    cited = papers.where(F.col("title").isNotNull() & (F.length("abstract") >= 50)).select(F.col("corpusid").alias("cited"), text.prefixed("search_document", F.col("title"), F.col("abstract")).alias("document"))
    found = sampling.replicated(rows.join(cited, "cited"), times)
    return found.select(F.concat("prefix", F.lit(": "), "context").alias("query"), "document", "intent", F.col("citing").alias("citing_id"), F.col("cited").alias("cited_id"), "copy")


def search_pairs(tldrs: DataFrame, papers: DataFrame, least: int = 20) -> DataFrame:
    """text1 (short summary), text2 (title only), task."""
    rows = tldrs.join(papers.select("corpusid", "title"), "corpusid").where((F.length("text") >= least) & (F.col("title") != ""))
    return rows.select("corpusid", F.concat(F.lit("search_query: "), "text").alias("text1"), F.concat(F.lit("search_document: "), "title").alias("text2"), F.lit("search").alias("task"))


def summary_pairs(tldrs: DataFrame, papers: DataFrame, least: int = 30, most: int = 600) -> DataFrame:
    """anchor (short summary), positive (abstract) of the same paper."""
    rows = tldrs.where(F.length("text").between(least, most)).join(papers.where(F.length("abstract").between(50, 5_000)), "corpusid")
    pairs = rows.select("corpusid", F.concat(F.lit("search_query: "), "text").alias("anchor"), text.prefixed("search_document", F.col("title"), F.col("abstract")).alias("positive"))
    return _typed(pairs, "tldr")


def improves_over(edges: DataFrame, papers: DataFrame, modulus: int = 1, preview: int | None = None) -> DataFrame:
    """Reversed influential edges of a modular sample: anchor is the cited paper."""
    rows = graph.tier(edges, True).where(F.col("citationid") % modulus == 0)
    found = graph.enriched(rows, papers, "cited", "citing", preview)
    return _typed(found.select("citing", "cited", *[c for c in rows.columns if c not in ("citing", "cited")], "anchor", "positive"), "improves_over")


def related_pairs(related: DataFrame, works: DataFrame, share: float, seed: int) -> DataFrame:
    """Related works, sampled before the filters: valid, English, abstracts of over 50 and under 5 000 characters."""
    fine = works.where(F.col("valid_title_abstract") & (F.col("language") == "en") & (F.length("abstract") > 50) & (F.length("abstract") < 5_000))
    one = fine.select(F.col("id").alias("work_id"), text.prefixed("search_query", F.col("title"), F.col("abstract")).alias("anchor"))
    two = fine.select(F.col("id").alias("related_work_id"), text.prefixed("search_document", F.col("title"), F.col("abstract")).alias("positive"))
    return _typed(sampling.bernoulli(related, share, seed, "work_id", "related_work_id").join(one, "work_id").join(two, "related_work_id"), "related_works")


def classification_pairs(papers: DataFrame, topics: DataFrame) -> DataFrame:
    """text1 (paper), text2 ("field > topic", or the topic alone), task; ``topics`` has corpusid, topic, field."""
    label = F.when(F.coalesce(F.col("field"), F.lit("")) == "", F.col("topic")).otherwise(F.concat("field", F.lit(" > "), "topic"))
    return papers.join(topics, "corpusid").select("corpusid", text.prefixed("classify", F.col("title"), F.col("abstract")).alias("text1"), F.concat(F.lit("classify: "), label).alias("text2"), F.lit("classification").alias("task"))


def clustering_pairs(papers: DataFrame, by: str, target: int, seed: int, cap: int = 50_000) -> DataFrame:
    """Pairs of papers of one group: an even share of the target for each, at most all its pairs."""
    capped = graph.first_k(papers.select("corpusid", by), by, ["corpusid"], cap)
    share = target // max(1, capped.select(by).distinct().count())
    draws = F.least(F.lit(share), F.floor(F.col("n") * (F.col("n") - 1) / 2)).cast("long")
    return sampling.random_pairs(capped, by, "corpusid", draws, seed).withColumn("task", F.lit("clustering"))


def clustering_texts(pairs: DataFrame, papers: DataFrame) -> DataFrame:
    """Pairs of ids with their texts: text1, text2, task."""
    side = lambda key, name: papers.select(F.col("corpusid").alias(key), text.prefixed("cluster", F.col("title"), F.col("abstract")).alias(name))
    return pairs.join(side("first", "text1"), "first").join(side("second", "text2"), "second").select("text1", "text2", "task")


def similarity_pairs(related: DataFrame, works: DataFrame, papers: DataFrame, abstracts: DataFrame, target: int | None = None, preview: int = 512, least: int = 50) -> DataFrame:
    """text1, text2, task: related works whose DOIs lead to titled papers with an abstract.

    ``related`` has work_id, related_work_id; ``works`` id, doi (as an address); ``papers``
    corpusid, title, doi; ``abstracts`` corpusid, abstract.
    """
    bodies = abstracts.where(F.length("abstract") >= least).select("corpusid", F.substring("abstract", 1, preview).alias("abstract"))
    named = papers.where(F.col("doi").isNotNull() & (F.col("title") != "")).select("corpusid", "title", text.doi_key(F.col("doi")).alias("doi")).join(bodies, "corpusid")
    sides = works.select("id", "doi").join(named, "doi").select("id", text.prefixed("similarity", F.col("title"), F.col("abstract")).alias("side"))
    one, two = sides.select(F.col("id").alias("work_id"), F.col("side").alias("text1")), sides.select(F.col("id").alias("related_work_id"), F.col("side").alias("text2"))
    pairs = texts.with_texts(related.select("work_id", "related_work_id"), one, two).withColumn("task", F.lit("similarity"))
    return limited(pairs, target, "work_id", "related_work_id")


def instruction_pairs(parts: dict[str, DataFrame]) -> DataFrame:
    """text1, text2, task of all builders together."""
    out = None
    for name, rows in parts.items():
        part = rows.select("text1", "text2", F.lit(name).alias("task"))
        out = part if out is None else out.unionByName(part)
    return out


def instruction_stats(pairs: DataFrame) -> DataFrame:
    """task, n: pairs of each task, and "total" of all."""
    return pairs.rollup("task").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("task", F.lit("total")).alias("task"), "n")


def section_counts(found: DataFrame) -> DataFrame:
    """section_type, n: sections of each type, and "papers" with any; sections are extracted once."""
    papers = found.groupBy("doc_id").agg(F.collect_list(F.struct("section_type")).alias("types"))
    one = lambda c: F.struct(c.alias("section_type"))
    names = F.when(F.col("doc_id").isNotNull(), F.concat("types", F.array(one(F.lit("papers"))))).otherwise(F.col("types"))
    types = papers.select(F.explode(names).alias("s")).select("s.section_type", F.lit(1).alias("n"))
    none = found.sparkSession.range(1).select(F.lit("papers").alias("section_type"), F.lit(0).alias("n"))
    return types.unionByName(none).groupBy("section_type").agg(F.sum("n").alias("n"))


def section_pairs(found: DataFrame, target: int, seed: int = 42, positive_ratio: float = 0.6, per_source: int | None = None) -> DataFrame:
    """Pairs of sections from two documents: of one type (positive) or of two types (negative).

    ``found`` has doc_id, section_type, text, and source where at most ``per_source``
    documents of each are used. A draw picks two documents and types by hash; draws
    that the documents can't meet are lost, so five times the target is drawn and cut
    in draw order.
    """
    by = ["doc_id"] if per_source is None else ["doc_id", "source"]
    if per_source is not None:  # texts of the chosen documents only
        chosen = graph.first_k(found.select(*by).distinct(), "source", ["doc_id"], per_source).select(F.col("doc_id").alias("id"), F.col("source").alias("of"))
        found = found.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & F.col("source").eqNullSafe(F.col("of")), "left_semi")
    maps = found.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section_type", "text")))).alias("sections"))
    members = sampling.numbered(maps.drop("source"), "doc_id").persist()  # sections are extracted once; the caller's session keeps them
    n = members.agg(F.max("n").alias("n")).where(F.col("n") > 1)  # one row
    drawn = found.sparkSession.range(1, 5 * target + 1).select(F.col("id").alias("draw")).join(F.broadcast(n))
    i, j = draw(seed, "first", "draw") % F.col("n"), draw(seed, "second", "draw") % (F.col("n") - 1)
    drawn = drawn.withColumn("i", i).withColumn("j", F.when(j >= F.col("i"), j + 1).otherwise(j)).withColumn("same", uniform(seed, "same", "draw") < positive_ratio)
    one, two = members.select(F.col("idx").alias("i"), F.col("sections").alias("a")), members.select(F.col("idx").alias("j"), F.col("sections").alias("b"))
    rows = drawn.join(one, "i").join(two, "j")
    pick = lambda of, tag: F.get(of, (draw(seed, tag, "draw") % F.greatest(F.size(of), F.lit(1))).cast("int"))
    mine, both = F.array_sort(F.map_keys("a")), F.array_sort(F.array_intersect(F.map_keys("a"), F.map_keys("b")))
    rows = rows.withColumn("kind", F.when(F.col("same"), pick(both, "kind")).otherwise(pick(mine, "kind")))
    others = F.array_sort(F.filter(F.map_keys("b"), lambda k: k != F.col("kind")))
    rows = rows.withColumn("other", F.when(F.col("same"), F.col("kind")).otherwise(pick(others, "other"))).where(F.col("kind").isNotNull() & F.col("other").isNotNull())
    prefix = F.create_map(*[F.lit(x) for kv in sec.PREFIXES.items() for x in kv])
    side = lambda m, k: F.concat(F.try_element_at(prefix, F.col(k)), F.lit(": "), F.try_element_at(F.col(m), F.col(k)))
    pairs = rows.select("draw", side("a", "kind").alias("anchor"), side("b", "other").alias("positive"), F.col("kind").alias("anchor_section"), F.col("other").alias("positive_section"), F.when(F.col("same"), "same_section").otherwise("cross_section_negative").alias("pair_type"))
    return limited(pairs, target, "draw")


def body_queries(docs: DataFrame, seed: int = 42, least: int = 80, most: int = 400, overlap: float = 0.2) -> DataFrame:
    """doc_id, query_text: the first sentence, in hashed order, of the body's middle third that says something the abstract does not."""
    rows = docs.select("doc_id", text.trigrams(F.col("abstract")).alias("known"), F.posexplode(text.sentences(text.middle_third(F.col("body")))).alias("i", "s"))
    rows = rows.where(F.length("s").between(least, most) & ~text.is_noise(F.col("s")))
    ratio = text.overlap_ratio(text.trigrams(F.col("s")), F.col("known"))
    rows = rows.where(ratio <= overlap)
    return rows.groupBy("doc_id").agg(F.min_by("s", F.struct(digest(seed, "sentence", "doc_id", "i"), F.col("i"))).alias("query_text"))


def retrieval_candidates(papers: DataFrame, n: int, seed: int, citations: tuple[int, int] = (1, 4), body: tuple[int, int] = (8_000, 80_000)) -> DataFrame:
    """A field-stratified sample of candidate ids; wide texts are joined to it afterwards."""
    rows = papers.where(F.col("citationcount").between(*citations) & (F.length("abstract") >= 50) & F.col("body_len").between(*body)).select("corpusid", "field_of_study")
    w = Window.partitionBy("field_of_study").orderBy(digest(seed, "field", "corpusid"), "corpusid")
    rows = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(1.0, n / 25)).drop("rn")
    return sampling.exact(rows, n, seed + 1, "corpusid")


#: Most characters of a body that a retrieval dataset keeps.
MOST_BODY = 80_000


def retrieval_dataset(papers: DataFrame, bodies: DataFrame, n_candidates: int, n_queries: int, seed: int = 42, **ranges: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(candidates, queries) of a retrieval task.

    ``papers`` has corpusid, title, abstract, field_of_study, citationcount, body_len;
    ``bodies`` corpusid, body. Bodies are fetched for the sampled candidates only. One and
    a half times the queries are tried, in hashed order, and as many kept as are wanted.
    """
    sampled = retrieval_candidates(papers, n_candidates, seed, **ranges).select("corpusid")
    rows = papers.join(F.broadcast(sampled), "corpusid").join(bodies.select("corpusid", "body"), "corpusid")
    candidates = rows.select(F.col("corpusid").alias("candidate_id"), "title", "abstract", "field_of_study", "citationcount", "body")
    tried = sampling.exact(candidates.select(F.col("candidate_id").alias("doc_id"), "abstract", "body"), int(n_queries * 1.5), seed, "doc_id")
    found = sampling.exact(body_queries(tried, seed), n_queries, seed, "doc_id")
    order = Window.orderBy(digest(seed, "exact", "doc_id"), "doc_id")  # over the few queries that are wanted
    queries = found.select((F.row_number().over(order) - 1).cast("long").alias("query_id"), "query_text", F.col("doc_id").alias("gold_candidate_id"))
    return candidates.withColumn("body", F.substring("body", 1, MOST_BODY)), queries


def citation_examples(citations: DataFrame, papers: DataFrame, n: int = 20, pool: int | None = None, seed: int = 42) -> DataFrame:
    """First contexts of influential citations that share least with the cited title, with their labels.

    Titles have 30 to 200 characters, abstracts 200 to 1 500, contexts 80 to 350; with ``pool``,
    only that many citations are looked at.
    """
    rows = citations.where(F.col("isinfluential") & (F.size("contexts") > 0)).select("citing", "cited", F.get("contexts", F.lit(0)).alias("context"), "intents")
    rows = rows if pool is None else sampling.exact(rows, pool, seed, "citing", "cited")
    cited = papers.where(F.length("title").between(30, 200) & F.length("abstract").between(200, 1_500)).select(F.col("corpusid").alias("cited"), F.col("title").alias("cited_title"), F.concat(F.substring("abstract", 1, 300), F.lit("...")).alias("cited_abstract"))
    citing = papers.where(F.col("title").isNotNull()).select(F.col("corpusid").alias("citing"), F.col("title").alias("citing_title"))
    rows = rows.where(F.length("context").between(80, 350)).join(cited, "cited").join(citing, "citing")
    rows = rows.withColumns({"overlap": text.title_overlap(F.col("context"), F.col("cited_title")), "labels": text.label_list(F.array("intents"))})
    return rows.orderBy("overlap", "citing", "cited", "context").limit(n)
