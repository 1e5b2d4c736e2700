"""Queries of the library, by name, and their oracle SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sections, text
from .functions.hashing import digest_sql, draw, draw_sql, uniform_sql
from .operators import audit, graph, mixer, negatives, retrieval, sampling, scores, signals, training
from .plans import views
from .plans.views import DIGRAPH, EDGES, PAPERS, SCORES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle if there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cocitation_pairs(spark, sf_dir)


# --- SQL pieces ---------------------------------------------------------------------------------

SPACE = r"[\t\n\x0B\x0C\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def context_sql(c: str, least: int = 50, most: int = 1_000) -> str:
    """The stripped text where the context filter passes, else null."""
    s = strip_sql(c)
    return (
        f"case when length({s}) between {least} and {most} and len(regexp_split_to_array({s}, '{SPACE}+')) >= 3 "
        f"and 2 * length(regexp_replace({s}, '[^\\p{{L}}]', '', 'g')) >= length({s}) then {s} end"
    )


def boilerplate_sql(c: str) -> str:
    phrases = r"(?i)(?:This article has been cited by other articles in PMC|Articles from [^\n]* are provided here courtesy of|External link\. Please review our privacy policy|Go to:)"
    lines = r"(?i)(?:©|Copyright|All rights reserved|Licensed under|Published by)[^\n]*(?:\n|$)"
    return f"regexp_replace(regexp_replace({c}, '{phrases}', '', 'g'), '{lines}', '', 'g')"


def clean_sql(c: str, latex: bool = False) -> str:
    """The cleaning chain; ``nfc_normalize`` stands for NFKC, which is the same on the supplied tables."""
    c = f"regexp_replace(coalesce({c}, ''), '(?s){text.REFERENCES.replace('++', '*').replace('*+', '*').replace(chr(92) + 's', SPACE)}', '')"
    if latex:
        for pattern, by in (
            (text.LATEX_CITATIONS, "''"), (text.LATEX_REFERENCES, "''"), (text.LATEX_ENVIRONMENTS, "''"),
            (text.LATEX_FORMATS, r"'\1'"), (text.LATEX_SECTIONS, r"E'\n\\1\n'"), (text.LATEX_STRAY, "''"),
        ):
            c = f"regexp_replace({c}, '{pattern}', {by}, 'g')"
    other = "[^" + SPACE[1:]
    c = boilerplate_sql(f"regexp_replace({c}, '<[^>]+>', '', 'g')")
    c = f"regexp_replace(regexp_replace({c}, 'https?://{other}+', '', 'g'), '{other}+@{other}+[.]{other}+', '', 'g')"
    return collapse_sql(f"nfc_normalize({c})")


def collapse_sql(c: str) -> str:
    space = SPACE.replace(r"\n", "").replace(r"\x0B", r"\x0B")
    return strip_sql(f"regexp_replace(regexp_replace({c}, '{space}+', ' ', 'g'), '\\n{{3,}}', E'\\n\\n', 'g')")


CONVS = f"""turns as (select conv_id, list(text order by turn) as contexts,
  list(case role when 'user' then 'background' when 'assistant' then 'methodology' when 'system' then 'result' end order by turn) as intents
  from conversations group by conv_id),
convs as (select conv_id as citing, conv_id % (select count(*) from documents) as cited, conv_id % 2 = 0 as isinfluential, contexts, intents from turns)"""
CITED = "cited_docs as (select corpusid, 'search_document: ' || title || '. ' || abstract as document from papers where title is not null and length(abstract) >= 50)"
TOKENS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"


# --- graph --------------------------------------------------------------------------------------


@query(f"with {PAPERS} select corpusid, title, substr(abstract, 1, 512) as abstract_preview, field_of_study, coalesce(citationcount, 0)::bigint as citationcount from papers where title is not null and length(abstract) >= 50")
def paper_pool(spark, sf_dir):
    return graph.paper_pool(views.papers(spark, sf_dir))


@query(f"""with {EDGES}, e as (select *, row_number() over (partition by citing order by cited, citationid) as rn from edges where isinfluential)
select citing, count(*) as n, string_agg(cast(cited as varchar), ',' order by cited, citationid) as cited_ids from e where rn <= 20 group by citing""")
def forward_adjacency(spark, sf_dir):
    rows = graph.forward_adjacency(graph.tier(views.edges(spark, sf_dir), True))
    return rows.select("citing", F.size("cited_ids").cast("long").alias("n"), F.array_join(F.transform("cited_ids", lambda x: x.cast("string")), ",").alias("cited_ids"))


@query(f"""with {EDGES}, {PAPERS}, r as (select *, row_number() over (partition by citing order by citationid, cited) as rn from edges),
p as (select distinct a.cited as x, b.cited as y from r a join r b on a.citing = b.citing and a.cited < b.cited where a.rn <= 10 and b.rn <= 10),
s as (select corpusid, title || '. ' || abstract as t from papers where title is not null and length(abstract) between 50 and 5000)
select x, y, 'search_query: ' || a.t as anchor, 'search_document: ' || b.t as positive, cast(null as varchar) as negative, 'co_citation' as signal_type
from p join s a on a.corpusid = x join s b on b.corpusid = y""")
def cocitation_pairs(spark, sf_dir):
    pairs = graph.cocitation(views.edges(spark, sf_dir))
    found = graph.enriched(pairs, views.papers(spark, sf_dir), "x", "y", many=True)
    return found.select("x", "y", "anchor", "positive", F.lit(None).cast("string").alias("negative"), F.lit("co_citation").alias("signal_type"))


@query(f"""with {EDGES}, r as (select *, row_number() over (partition by citing order by citationid, cited) as rn from edges)
select count(*) as pairs, sum(x)::bigint as sum_x, sum(y)::bigint as sum_y from (select distinct a.cited as x, b.cited as y from r a join r b on a.citing = b.citing and a.cited < b.cited where a.rn <= 10 and b.rn <= 10)""")
def cocitation_totals(spark, sf_dir):
    return graph.cocitation(views.edges(spark, sf_dir)).agg(F.count(F.lit(1)).alias("pairs"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query(f"""with {EDGES}, pool as (select citing from (select distinct citing from edges) order by {digest_sql(42, 'exact', 'citing')}, citing limit 500),
r as (select *, row_number() over (partition by citing order by citationid, cited) as rn from edges where citing in (select citing from pool))
select distinct a.cited as x, b.cited as y from r a join r b on a.citing = b.citing and a.cited < b.cited where a.rn <= 10 and b.rn <= 10""")
def cocitation_sampled(spark, sf_dir):
    edges = views.edges(spark, sf_dir)
    return graph.cocitation(edges, pool=graph.citing_pool(edges, 500, 42))


@query(f"""with {DIGRAPH}, {PAPERS}, pool as (select corpusid from papers where title is not null and length(abstract) >= 50 and citationcount >= 5)
select distinct citing, cited from digraph where citing in (select corpusid from pool) and cited in (select corpusid from pool)""")
def cited_often_edges(spark, sf_dir):
    """Edges between papers cited five times or more, from papers and abstracts in two tables."""
    papers = views.papers(spark, sf_dir)
    pool = graph.paper_pool(papers.drop("abstract"), abstracts=papers.select("corpusid", "abstract"))
    return graph.within(views.digraph(spark, sf_dir).select("citing", "cited").distinct(), pool, least_citations=5)


@query(f"""with {DIGRAPH}, i as (select * from digraph where isinfluential),
r as (select *, row_number() over (partition by citing order by cited, citationid) as rn from i),
h as (select distinct e.citing, e.cited, r.cited as hop from (select distinct citing, cited from i) e join r on r.citing = e.cited and r.rn <= 20 where r.cited <> e.citing and r.cited <> e.cited)
select citing, count(*) as n, sum(hop)::bigint as sum_hop, count(distinct hop) as hops from h group by citing""")
def two_hop_candidates(spark, sf_dir):
    edges = graph.tier(views.digraph(spark, sf_dir), True)
    rows = graph.hop_lists(edges, graph.forward_adjacency(edges)).where(F.size("hops") > 0)
    n = graph.tasks_for(rows, edges.count(), 250_000)  # an edge has up to 20 hops
    total = F.aggregate("hops", F.lit(0).cast("long"), lambda a, x: a + x)
    lists = rows.select("citing", F.size("hops").cast("long").alias("n"), total.alias("sum"), "hops").repartition(n, "citing")
    found = lists.groupBy("citing").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum_hop"), F.collect_list("hops").alias("hops"))
    return found.withColumn("hops", F.size(F.array_distinct(F.flatten("hops"))).cast("long"))


#: Hard negatives: citing, cited, negative, branch.
_NEGATIVES = f"""{DIGRAPH}, {PAPERS}, pool as (select * from papers where title is not null and length(abstract) >= 50),
pairs as (select distinct citing, cited from digraph where isinfluential and citing in (select corpusid from pool) and cited in (select corpusid from pool)),
adj as (select citing, list(cited order by cited, citationid) as ids from (select *, row_number() over (partition by citing order by cited, citationid) as rn from digraph where isinfluential) where rn <= 20 group by citing),
fields as (select field_of_study as field, row_number() over (partition by field_of_study order by corpusid) - 1 as idx, corpusid as neg, count(*) over (partition by field_of_study) as n from pool where field_of_study is not null),
everyone as (select row_number() over (order by corpusid) - 1 as idx, corpusid as neg, count(*) over () as n from pool),
base as (select citing, cited, field_of_study as field, {uniform_sql(42, 'roll', 'citing', 'cited')} as roll from pairs join pool on corpusid = citing),
ks as (select unnest(range(20)) as k),
f as (select b.citing, b.cited, arg_min(x.neg, k) as same_field from base b join (select distinct field, n from fields where n > 100) c on c.field = b.field cross join ks
  join fields x on x.field = b.field and x.idx = {draw_sql(42, 'field', 'b.citing', 'b.cited', 'k')} % c.n
  where roll < 0.5 and x.neg <> b.citing and x.neg <> b.cited group by 1, 2),
h as (select citing, cited, arg_min(neg, k) as two_hop from (select b.citing, b.cited, k, ids[1 + {draw_sql(42, 'hop', 'b.citing', 'b.cited', 'k')} % len(ids)] as neg
  from base b join adj a on a.citing = b.cited cross join ks where not (roll < 0.5 and field is not null) and roll < 0.8 and k < least(10, len(ids)))
  where neg <> citing and neg <> cited and neg in (select corpusid from pool) group by 1, 2),
m as (select b.citing, b.cited, same_field, two_hop from base b left join f using (citing, cited) left join h using (citing, cited)),
r as (select m.citing, m.cited, arg_min(e.neg, k) as anyone from m cross join ks join everyone e on e.idx = {draw_sql(42, 'pool', 'm.citing', 'm.cited', 'k')} % (select count(*) from pool)
  where coalesce(same_field, two_hop) is null and k < 10 and e.neg <> m.citing and e.neg <> m.cited group by 1, 2),
negs as (select citing, cited, coalesce(same_field, two_hop, anyone) as negative,
  case when same_field is not null then 'same_field' when two_hop is not null then 'two_hop' else 'random' end as branch
  from m left join r using (citing, cited) where coalesce(same_field, two_hop, anyone) is not null)"""


@query(f"with {_NEGATIVES} select citing as anchor_id, cited as positive_id, negative as negative_id, branch from negs")
def hard_negatives(spark, sf_dir):
    pool = graph.paper_pool(views.papers(spark, sf_dir))
    edges = graph.tier(views.digraph(spark, sf_dir), True)
    pairs = graph.within(edges.select("citing", "cited").distinct(), pool)
    rows = negatives.hard_negatives(pairs, pool, graph.forward_adjacency(edges))
    return rows.select(F.col("citing").alias("anchor_id"), F.col("cited").alias("positive_id"), F.col("negative").alias("negative_id"), "branch")


@query(f"""with {_NEGATIVES}, s as (select corpusid, title || '. ' || substr(abstract, 1, 512) as t from pool where title <> '')
select 'search_query: ' || a.t as anchor, 'search_document: ' || p.t as positive, 'search_document: ' || n.t as negative, citing as anchor_id, cited as positive_id, negs.negative as negative_id
from negs join s a on a.corpusid = citing join s p on p.corpusid = cited join s n on n.corpusid = negs.negative""")
def citation_triplets(spark, sf_dir):
    pool = graph.paper_pool(views.papers(spark, sf_dir))
    edges = graph.tier(views.digraph(spark, sf_dir), True)
    pairs = graph.within(edges.select("citing", "cited").distinct(), pool)
    return negatives.triplets(negatives.hard_negatives(pairs, pool, graph.forward_adjacency(edges)), pool)


@query(f"with {EDGES} select citing % 4 as worker, count(*) as n, sum(cited)::bigint as sum_cited from edges group by 1")
def worker_partitions(spark, sf_dir):
    edges = views.edges(spark, sf_dir)
    parts = [graph.partitioned(edges, 4, w).select(F.lit(w).cast("long").alias("worker"), "cited") for w in range(4)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.sum("cited").alias("sum_cited"))


# --- signals ------------------------------------------------------------------------------------


@query(f"""with {CONVS}, {PAPERS}, {CITED}, e as (select citing, cited, unnest(contexts) as raw from convs), f as (select citing, cited, {context_sql('raw')} as c from e)
select 'search_query: ' || c as query, document, citing as citing_id, cited as cited_id from f join cited_docs on corpusid = cited where c is not null""")
def context_pairs(spark, sf_dir):
    return signals.context_pairs(views.conversations(spark, sf_dir), views.papers(spark, sf_dir))


@query(f"""with {CONVS}, {PAPERS}, {CITED}, e as (select citing, cited, unnest(contexts) as raw from convs where isinfluential and {uniform_sql(42, 'contexts', 'citing')} < 0.6), f as (select citing, cited, {context_sql('raw')} as c from e)
select 'search_query: ' || c as query, document, citing as citing_id, cited as cited_id from f join cited_docs on corpusid = cited where c is not null order by citing, cited, query limit 50""")
def context_pairs_limited(spark, sf_dir):
    """A share of the influential citations, and of their contexts the target."""
    pairs = signals.context_pairs(views.conversations(spark, sf_dir), views.papers(spark, sf_dir), influential_only=True, rate=0.6)
    return signals.limited(pairs, 50, "citing_id", "cited_id", "query")


@query(f"""with {CONVS}, {PAPERS}, {CITED}, e as (select citing, cited, unnest(contexts) as raw, unnest(intents) as intent from convs),
f as (select citing, cited, intent, {context_sql('raw')} as c from e),
g as (select *, case intent when 'background' then 'cite_background' when 'methodology' then 'cite_method' when 'result' then 'cite_result' end as prefix,
  unnest(range(1, 1 + case intent when 'background' then 1 when 'methodology' then 3 when 'result' then 10 end)) as copy from f where c is not null)
select intent, citing as citing_id, cited as cited_id, prefix || ': ' || c as query, document, copy from g join cited_docs on corpusid = cited where prefix is not null""")
def intent_pairs(spark, sf_dir):
    return signals.intent_pairs(views.conversations(spark, sf_dir), views.papers(spark, sf_dir)).withColumn("copy", F.col("copy").cast("long"))


@query("""select case role when 'user' then 'background' when 'assistant' then 'methodology' when 'system' then 'result' end as intent, count(*) as n from conversations group by 1""")
def intent_distribution(spark, sf_dir):
    rows = views.conversations(spark, sf_dir).select(F.explode(text.intents_of(F.col("intents"))).alias("intent"))
    return rows.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {PAPERS}, t as (select conv_id % (select count(*) from documents) as corpusid, text from conversations where turn = 0)
select corpusid, 'search_query: ' || text as text1, 'search_document: ' || title as text2, 'search' as task from t join papers using (corpusid) where length(text) >= 20 and title <> ''""")
def search_pairs(spark, sf_dir):
    return signals.search_pairs(views.tldrs(spark, sf_dir), views.papers(spark, sf_dir))


@query(f"""with {PAPERS}, t as (select conv_id % (select count(*) from documents) as corpusid, text from conversations where turn = 0)
select corpusid, 'search_query: ' || text as anchor, 'search_document: ' || title || '. ' || abstract as positive, cast(null as varchar) as negative, 'tldr' as signal_type
from t join papers using (corpusid) where length(text) between 30 and 600 and length(abstract) between 50 and 5000""")
def tldr_pairs(spark, sf_dir):
    return signals.summary_pairs(views.tldrs(spark, sf_dir), views.papers(spark, sf_dir))


@query(f"""with {DIGRAPH}, {PAPERS}, s as (select corpusid, title || '. ' || abstract as t from papers where title is not null and length(abstract) between 50 and 5000)
select citing, cited, citationid, isinfluential, 'search_query: ' || a.t as anchor, 'search_document: ' || b.t as positive, cast(null as varchar) as negative, 'improves_over' as signal_type
from digraph join s a on a.corpusid = cited join s b on b.corpusid = citing where isinfluential and citationid % 3 = 0""")
def improves_over_pairs(spark, sf_dir):
    return signals.improves_over(views.digraph(spark, sf_dir), views.papers(spark, sf_dir), modulus=3)


def _similarity(spark, sf_dir):
    """Works of every document, whose DOIs lead to its paper."""
    docs = views.papers(spark, sf_dir).withColumn("doi", F.concat(F.lit("10.1/"), F.col("corpusid").cast("string")))
    related = views.digraph(spark, sf_dir).select(F.col("citing").alias("work_id"), F.col("cited").alias("related_work_id")).distinct()
    works = docs.select(F.col("corpusid").alias("id"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"))
    return signals.similarity_pairs(related, works, docs.select("corpusid", "title", "doi"), docs.select("corpusid", "abstract"))


@query(f"""with {DIGRAPH}, {PAPERS}, s as (select corpusid, 'similarity: ' || title || '. ' || substr(abstract, 1, 512) as side from papers where title <> '' and length(abstract) >= 50)
select citing as work_id, cited as related_work_id, a.side as text1, b.side as text2, 'similarity' as task from (select distinct citing, cited from digraph) join s a on a.corpusid = citing join s b on b.corpusid = cited""")
def similarity_pairs(spark, sf_dir):
    return _similarity(spark, sf_dir).select("work_id", "related_work_id", "text1", "text2", "task")


def _works(spark, sf_dir):
    """papers as works: valid where title and abstract are more than white space."""
    valid = (text.strip(F.col("title")) != "") & (text.strip(F.col("abstract")) != "")
    return views.papers(spark, sf_dir).select(F.col("corpusid").alias("id"), "title", "abstract", F.col("lang").alias("language"), F.coalesce(valid, F.lit(False)).alias("valid_title_abstract"))


@query(f"""with {DIGRAPH}, {PAPERS}, w as (select corpusid as id, title, abstract from papers where lang = 'en' and {strip_sql('title')} <> '' and {strip_sql('abstract')} <> '' and length(abstract) between 51 and 4999)
select work_id, related_work_id, 'search_query: ' || a.title || '. ' || a.abstract as anchor, 'search_document: ' || b.title || '. ' || b.abstract as positive, cast(null as varchar) as negative, 'related_works' as signal_type
from (select distinct citing as work_id, cited as related_work_id from digraph) r join w a on a.id = work_id join w b on b.id = related_work_id where {uniform_sql(7, 'bernoulli', 'work_id', 'related_work_id')} < 0.02""")
def related_pairs_bernoulli(spark, sf_dir):
    related = views.digraph(spark, sf_dir).select(F.col("citing").alias("work_id"), F.col("cited").alias("related_work_id")).distinct()
    return signals.related_pairs(related, _works(spark, sf_dir), 0.02, 7)


@query(f"""with {PAPERS}, t as (select c_custkey as corpusid, n_name as topic, case when r_name = 'ASIA' then '' else r_name end as field from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select corpusid, 'classify: ' || title || '. ' || abstract as text1, 'classify: ' || case when coalesce(field, '') = '' then topic else field || ' > ' || topic end as text2, 'classification' as task from papers join t using (corpusid)""")
def topic_classification_pairs(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    topics = joined.select(F.col("c_custkey").alias("corpusid"), F.col("n_name").alias("topic"), F.when(F.col("r_name") == "ASIA", "").otherwise(F.col("r_name")).alias("field"))
    return signals.classification_pairs(views.papers(spark, sf_dir), topics)


@query(f"""with {PAPERS}, m as (select field_of_study, corpusid, row_number() over (partition by field_of_study order by corpusid) - 1 as idx, count(*) over (partition by field_of_study) as n from papers),
g as (select distinct field_of_study, n from m where n > 1),
d as (select field_of_study, n, unnest(range(1, 1 + least(1000 // (select count(distinct field_of_study) from papers), n * (n - 1) // 2))) as draw from g),
x as (select *, {draw_sql(42, 'first', 'field_of_study', 'draw')} % n as i, {draw_sql(42, 'second', 'field_of_study', 'draw')} % (n - 1) as j0 from d),
y as (select *, case when j0 >= i then j0 + 1 else j0 end as j from x)
select y.field_of_study, draw, a.corpusid as first, b.corpusid as second, 'clustering' as task from y join m a on a.field_of_study = y.field_of_study and a.idx = i join m b on b.field_of_study = y.field_of_study and b.idx = j""")
def clustering_pairs(spark, sf_dir):
    return signals.clustering_pairs(views.papers(spark, sf_dir), "field_of_study", 1_000, 42)


def _body_sql(docs: str) -> str:
    """best: doc_id, query_text of ``docs`` (doc_id, abstract, body)."""
    tri = lambda t: f"case when len({t}) >= 3 then list_distinct(list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i+1] || ' ' || {t}[i+2])) else [] end"
    noise = text.NOISE.replace("++", "+").replace("*+", "*").replace(r"\s", SPACE).replace(r"\d", "[0-9]")
    return f"""bodies as (select doc_id, {TOKENS.format(c='abstract')} as t, substr(body, length(body) // 3 + 1, 2 * length(body) // 3 - length(body) // 3) as mid from {docs}),
known as (select doc_id, {tri('t')} as known, regexp_replace(mid, '([.!?]){SPACE}+([A-Z(])', '\\1' || chr(31) || '\\2', 'g') as mid from bodies),
sents as (select doc_id, known, list_filter(list_transform(string_split(mid, chr(31)), lambda x: {strip_sql('x')}), lambda x: x <> '') as ss from known),
sent as (select doc_id, known, unnest(ss) as s, unnest(range(len(ss))) as i from sents),
fine as (select doc_id, known, s, i, {TOKENS.format(c='s')} as t from sent where length(s) between 80 and 400 and not regexp_matches(s, '{noise}')),
rated as (select doc_id, s, i, {tri('t')} as g, known from fine),
best as (select doc_id, arg_min(s, {digest_sql(42, 'sentence', 'doc_id', 'i')} || lpad(cast(i as varchar), 9, '0')) as query_text from rated where len(g) > 0 and len(list_intersect(g, known)) / len(g) <= 0.2 group by doc_id)"""


@query(f"with docs as (select doc_id, substr(text, 1, 300) as abstract, text as body from documents), {_body_sql('docs')} select doc_id, query_text from best")
def body_queries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 300).alias("abstract"), F.col("text").alias("body"))
    return signals.body_queries(docs)


_FOUR = ("search", "classification", "clustering", "similarity")
_FOUR_SQL = " union all ".join(f"select '{t}' as task, count(*) as n from ({ORACLE_SQL[q]})" for t, q in zip(_FOUR, ("search_pairs", "topic_classification_pairs", "clustering_pairs", "similarity_pairs")))


@query(f"with c as ({_FOUR_SQL}) select task, n::bigint as n from c union all select 'total', sum(n)::bigint from c")
def instruction_pair_stats(spark, sf_dir):
    papers = views.papers(spark, sf_dir)
    clusters = signals.clustering_texts(clustering_pairs(spark, sf_dir), papers)
    parts = dict(zip(_FOUR, (search_pairs(spark, sf_dir), topic_classification_pairs(spark, sf_dir), clusters, _similarity(spark, sf_dir))))
    return signals.instruction_stats(signals.instruction_pairs(parts))


def _retrieval(spark, sf_dir):
    """Papers whose abstract is the first 300 characters, and bodies that are the whole text."""
    papers = views.papers(spark, sf_dir).withColumn("abstract", F.substring("abstract", 1, 300))
    bodies = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("corpusid"), F.col("text").alias("body"))
    return signals.retrieval_dataset(papers, bodies, 200, 40, body=(1_000, 80_000))


_CANDIDATES = f"""e as (select corpusid, title, substr(abstract, 1, 300) as abstract, abstract as body, field_of_study, citationcount from papers where citationcount between 1 and 4 and length(substr(abstract, 1, 300)) >= 50 and body_len between 1000 and 80000),
r as (select *, row_number() over (partition by field_of_study order by {digest_sql(42, 'field', 'corpusid')}, corpusid) as rn from e),
cand as (select * from r where rn <= greatest(1.0, 200 / 25.0) order by {digest_sql(43, 'exact', 'corpusid')}, corpusid limit 200)"""


@query(f"with {PAPERS}, {_CANDIDATES} select corpusid as candidate_id, title, abstract, field_of_study, citationcount, substr(body, 1, 80000) as body from cand")
def retrieval_corpus(spark, sf_dir):
    return _retrieval(spark, sf_dir)[0]


@query(f"""with {PAPERS}, {_CANDIDATES}, tried as (select corpusid as doc_id, abstract, body from cand order by {digest_sql(42, 'exact', 'corpusid')}, corpusid limit 60), {_body_sql('tried')},
kept as (select *, row_number() over (order by {digest_sql(42, 'exact', 'doc_id')}, doc_id) - 1 as query_id from best)
select query_id, query_text, doc_id as gold_candidate_id from kept where query_id < 40""")
def retrieval_queries(spark, sf_dir):
    return _retrieval(spark, sf_dir)[1]


@query(f"""with {CONVS}, {PAPERS}, c as (select citing, cited, contexts[1] as context, intents from convs where isinfluential and len(contexts) > 0),
f as (select c.*, a.title as cited_title, substr(a.abstract, 1, 300) || '...' as cited_abstract, b.title as citing_title from c join papers a on a.corpusid = cited join papers b on b.corpusid = citing
  where b.title is not null and length(a.title) between 30 and 200 and length(a.abstract) between 200 and 1500 and length(context) between 80 and 350),
w as (select *, list_distinct(list_transform(list_filter(regexp_split_to_array(lower({strip_sql('context')}), '{SPACE}+'), lambda x: length(x) > 3), lambda x: regexp_replace(x, '^[.,;:()\\[\\]]+|[.,;:()\\[\\]]+$', '', 'g'))) as cw,
  list_distinct(list_transform(list_filter(regexp_split_to_array(lower({strip_sql('cited_title')}), '{SPACE}+'), lambda x: length(x) > 3), lambda x: regexp_replace(x, '^[.,;:()\\[\\]]+|[.,;:()\\[\\]]+$', '', 'g'))) as tw from f)
select citing, cited, context, citing_title, cited_title, cited_abstract, round(case when len(tw) > 0 then len(list_intersect(tw, cw)) / len(tw) else 0 end, 6) as overlap,
  coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(intents, lambda x: x is not null))), ','), ''), '—') as labels
from w order by case when len(tw) > 0 then len(list_intersect(tw, cw)) / len(tw) else 0 end, citing, cited, context limit 20""")
def citation_examples(spark, sf_dir):
    rows = signals.citation_examples(views.conversations(spark, sf_dir), views.papers(spark, sf_dir))
    return rows.select("citing", "cited", "context", "citing_title", "cited_title", "cited_abstract", F.round("overlap", 6).alias("overlap"), "labels")


@query(f"""with {PAPERS}, e as (select * from papers where citationcount between 1 and 4 and length(abstract) >= 50 and body_len between 1000 and 80000),
r as (select *, row_number() over (partition by field_of_study order by {digest_sql(42, 'field', 'corpusid')}, corpusid) as rn from e)
select corpusid, field_of_study from (select * from r where rn <= greatest(1.0, 200 / 25.0) order by {digest_sql(43, 'exact', 'corpusid')}, corpusid limit 200)""")
def retrieval_candidates(spark, sf_dir):
    return signals.retrieval_candidates(views.papers(spark, sf_dir), 200, 42, body=(1_000, 80_000))


# --- text ---------------------------------------------------------------------------------------


@query(f"select doc_id, {context_sql('text', 50, 5000)} as context from documents")
def context_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.filter_context(F.col("text"), 50, 5_000).alias("context"))


@query(f"select doc_id, {boilerplate_sql('text')} as cleaned from documents")
def clean_boilerplate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.remove_boilerplate(F.col("text")).alias("cleaned"))


@query("select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as cleaned from pages")
def clean_xml_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_xml(F.col("html")).alias("cleaned"))


@query(f"select doc_id, {clean_sql('text')} as cleaned from documents")
def clean_text(spark, sf_dir):
    return text.with_clean_text(table(spark, sf_dir, "documents"), "text", "source").select("doc_id", "cleaned")


_LATEX = r"'\section{' || substr(text, 1, 60) || '} \citep{x1} \textbf{' || text || '} see \ref{y}, https://a.b/c or me@x.org\noindent' || E'\n\nReferences\n[1] ' || text"


@query(f"select doc_id, {clean_sql(_LATEX, latex=True)} as cleaned from documents")
def clean_latex_documents(spark, sf_dir):
    """Documents dressed as LaTeX sources with addresses and references, cleaned again."""
    t = F.col("text")
    dressed = F.concat(F.lit("\\section{"), F.substring(t, 1, 60), F.lit("} \\citep{x1} \\textbf{"), t, F.lit("} see \\ref{y}, https://a.b/c or me@x.org\\noindent\n\nReferences\n[1] "), t)
    rows = table(spark, sf_dir, "documents").select("doc_id", dressed.alias("text"), F.lit("arxiv").alias("source"))
    return text.with_clean_text(rows, "text", "source").select("doc_id", "cleaned")


@query(f"select doc_id, {collapse_sql('nfc_normalize(text)')} as cleaned from documents")
def nfkc_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_space(F.col("text")).alias("cleaned"))


@query(f"""select doc_id, concat_ws(' ', {strip_sql("coalesce(substr(text, 1, 60), '')")} || '.', {strip_sql("coalesce(text, '')")}) as candidate from documents""")
def candidate_texts(spark, sf_dir):
    return views.papers(spark, sf_dir).select(F.col("corpusid").alias("doc_id"), text.candidate_text(F.col("title"), F.col("abstract"), whole=False).alias("candidate"))


@query(f"""select conv_id, turn, regexp_replace({strip_sql('text')}, '^"+|"+$', '', 'g') as line from conversations where not contains(text, chr(10))
union all select conv_id, turn, regexp_replace({strip_sql('string_split(' + strip_sql('text') + ', chr(10))[1]')}, '^"+|"+$', '', 'g') from conversations where contains(text, chr(10))""")
def paraphrases(spark, sf_dir):
    """Turns as generated answers in quotes."""
    quoted = F.concat(F.lit(' "'), F.get(F.split("text", "\n"), F.lit(0)), F.lit('"\nand so on'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.paraphrase(quoted).alias("line"))


@query("select conv_id, turn, case role when 'user' then 'search_query: ' when 'assistant' then 'search_document: ' else '' end || text as prefixed from conversations")
def task_prefixes(spark, sf_dir):
    task = F.when(F.col("role") == "user", "search_query").when(F.col("role") == "assistant", "search_document").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.task_prefixed(task, F.col("text")).alias("prefixed"))


def _sectioned(spark, sf_dir):
    """Headings put before the lines of documents, as none of them has any."""
    whole = F.concat(F.lit("Introduction\n"), F.col("text"), F.lit("\n# Methods\n"), F.col("text"), F.lit("\n2. Results\n"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", whole.alias("text"))


def _sections_sql() -> str:
    heads = []
    for i, (kind, names) in enumerate(sections.NAMES.items()):
        pattern = f"{sections.HEAD}(?:{names}){sections.TAIL}".replace(r"\s", SPACE)
        heads.append(f"{{'at': case when regexp_matches(text, '(?im){pattern}') then length(regexp_extract(text, '(?im)\\A((?s:.*?)){pattern}', 1)) + 1 end, 'o': {i}, 'kind': '{kind}'}}")
    body = f"case when strpos(w, chr(10)) > 1 then {strip_sql('substr(w, strpos(w, chr(10)))')} else w end"
    return f"""whole as (select doc_id, source, E'Introduction\\n' || text || E'\\n# Methods\\n' || text || E'\\n2. Results\\n' || text as text from documents),
found as (select *, list_sort(list_filter([{', '.join(heads)}], lambda h: h.at is not null)) as hs from whole where length(text) >= {sections.LEAST_TEXT}),
cuts as (select doc_id, source, text, hs, unnest(range(1, len(hs) + 1)) as i from found),
parts as (select doc_id, source, hs[i].kind as section_type, hs[i].at as start, coalesce(hs[i + 1].at, length(text) + 1) as stop, {strip_sql("substr(text, hs[i].at, coalesce(hs[i + 1].at, length(text) + 1) - hs[i].at)")} as w from cuts),
sec as (select doc_id, source, section_type, substr({body}, 1, {sections.MOST_SECTION}) as text, start, stop from parts where length(substr({body}, 1, {sections.MOST_SECTION})) >= {sections.LEAST_SECTION})"""


@query(f'with {_sections_sql()} select doc_id, section_type, text, start, stop as "end" from sec')
def document_sections(spark, sf_dir):
    return sections.extract(_sectioned(spark, sf_dir))


@query(f"with {_sections_sql()} select section_type, count(*) as n from sec group by 1 union all select 'papers', count(distinct doc_id) from sec")
def section_counts(spark, sf_dir):
    return signals.section_counts(sections.extract(_sectioned(spark, sf_dir)))


_PREFIX = "case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in sections.PREFIXES.items()) + " end"


@query(f"""with {_sections_sql()}, m as (select doc_id, source, list_sort(list(section_type)) as types from sec group by 1, 2),
k as (select *, row_number() over (partition by source order by doc_id) as rn from m),
ids as (select doc_id, types, row_number() over (order by doc_id) - 1 as idx, count(*) over () as n from k where rn <= 20),
d as (select unnest(range(1, 1501)) as draw), x as (select draw, n, {draw_sql(42, 'first', 'draw')} % n as i, {draw_sql(42, 'second', 'draw')} % (n - 1) as j0, {uniform_sql(42, 'same', 'draw')} < 0.6 as same from d, (select max(n) as n from ids) where n > 1),
y as (select x.*, a.doc_id as da, b.doc_id as db, a.types as ta, b.types as tb, list_sort(list_intersect(a.types, b.types)) as common from x join ids a on a.idx = i join ids b on b.idx = case when j0 >= i then j0 + 1 else j0 end),
z as (select *, case when same then common[1 + {draw_sql(42, 'kind', 'draw')} % greatest(len(common), 1)] else ta[1 + {draw_sql(42, 'kind', 'draw')} % len(ta)] end as kind from y),
u as (select *, list_filter(tb, lambda t: t <> kind) as others from z),
v as (select *, case when same then kind else others[1 + {draw_sql(42, 'other', 'draw')} % greatest(len(others), 1)] end as other from u)
select draw, {_PREFIX.format(c='kind')} || ': ' || a.text as anchor, {_PREFIX.format(c='other')} || ': ' || b.text as positive, kind as anchor_section, other as positive_section,
  case when same then 'same_section' else 'cross_section_negative' end as pair_type
from v join sec a on a.doc_id = da and a.section_type = kind join sec b on b.doc_id = db and b.section_type = other order by draw limit 300""")
def section_pairs(spark, sf_dir):
    rows = _sectioned(spark, sf_dir).select("doc_id", "source", F.explode(sections.sections(F.col("text"))).alias("s"))
    return signals.section_pairs(rows.select("doc_id", "source", "s.section_type", "s.text"), 300, per_source=20)


@query(f"""with t as (select doc_id, {TOKENS.format(c='text')} as a, {TOKENS.format(c=boilerplate_sql('text'))} as b from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i+1] || ' ' || a[i+2])) as g from t),
u as (select distinct doc_id, unnest(list_transform(range(1, len(b) - 1), lambda i: b[i] || ' ' || b[i+1] || ' ' || b[i+2])) as g from t),
n as (select s.doc_id, count(*) as n, count(u.g) as both_have from s left join u on s.doc_id = u.doc_id and s.g = u.g group by s.doc_id)
select doc_id, coalesce(n, 0)::bigint as n, round(both_have / n, 6) as overlap from t left join n using (doc_id)""")
def trigram_overlap(spark, sf_dir):
    """Trigrams of the whole text, and the share that boilerplate removal leaves."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.trigrams(F.col("text")).alias("s"), text.trigrams(text.remove_boilerplate(F.col("text"))).alias("u"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.round(text.overlap_ratio(F.col("s"), F.col("u")), 6).alias("overlap"))


# --- statistics and sampling --------------------------------------------------------------------


@query("""select source, count(*) as n, quantile_cont(n_chars, 0.5) as p50, quantile_cont(n_chars, 0.9) as p90, quantile_cont(n_chars, 0.95) as p95, quantile_cont(n_chars, 0.99) as p99, max(n_chars) as max,
round(avg((n_chars > 512)::double), 6) as over_512, round(avg((n_chars > 2048)::double), 6) as over_2048, round(avg((n_chars > 8192)::double), 6) as over_8192 from documents group by source""")
def length_stats(spark, sf_dir):
    return scores.length_stats(table(spark, sf_dir, "documents"), "n_chars", (512, 2_048, 8_192), "source")


@query("""select cast(quantile_cont(n_chars, 0.05) as bigint) as p5, cast(floor(quantile_cont(n_chars, 0.25)) as bigint) as p25, cast(floor(quantile_cont(n_chars, 0.5)) as bigint) as p50,
cast(floor(quantile_cont(n_chars, 0.75)) as bigint) as p75, cast(floor(quantile_cont(n_chars, 0.95)) as bigint) as p95 from documents""".replace("cast(quantile_cont(n_chars, 0.05) as bigint)", "cast(floor(quantile_cont(n_chars, 0.05)) as bigint)"))
def length_quantiles(spark, sf_dir):
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    rows = table(spark, sf_dir, "documents").agg(F.percentile("n_chars", F.array(*[F.lit(s) for s in shares])).alias("q"))
    return rows.select(*[F.floor(F.get("q", F.lit(i))).alias(f"p{round(100 * s)}") for i, s in enumerate(shares)])


@query("select source, lang, count(*) as n, sum(n_chars)::bigint as chars, sum(case when n_chars between 1000 and 500000 then 1 else 0 end)::bigint as in_range from documents group by source, lang")
def source_counts(spark, sf_dir):
    in_range = F.sum(F.when(F.col("n_chars").between(1_000, 500_000), 1).otherwise(0))
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), in_range.alias("in_range"))


@query(f"select doc_id, source from (select *, row_number() over (partition by source order by {digest_sql(42, 'stratum', 'doc_id')}, doc_id) as rn from documents) where rn <= 5")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, 42, "doc_id")


@query(f"select doc_id, lang from documents order by {digest_sql(42, 'exact', 'doc_id')}, doc_id limit 100")
def exact_sample(spark, sf_dir):
    return sampling.exact(table(spark, sf_dir, "documents").select("doc_id", "lang"), 100, 42, "doc_id")


@query(f"select {draw_sql(42, 'shard', 'doc_id')} % 16 as shard, count(*) as n, sum(doc_id)::bigint as ids from documents group by 1")
def shuffle_shards(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((draw(42, "shard", "doc_id") % 16).alias("shard"), "doc_id")
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("select n_chars, round(cume_dist() over (order by n_chars), 9) as share from (select distinct n_chars from documents) where false union all select n_chars, round(sum(count(*)) over (order by n_chars) / (select count(*) from documents), 9) from documents group by n_chars")
def length_distribution(spark, sf_dir):
    return scores.distribution(table(spark, sf_dir, "documents"), "n_chars").withColumn("share", F.round("share", 9))


@query("select source, count(*) as n from documents group by source order by n desc, source limit 8")
def top_sources(spark, sf_dir):
    return scores.top_labels(table(spark, sf_dir, "documents"), "source")


# --- mixing and training ------------------------------------------------------------------------


def _signals(spark, sf_dir):
    """Titles with whole documents, whole turns with the first turn of their conversation."""
    docs, convs = views.papers(spark, sf_dir), table(spark, sf_dir, "conversations")
    triplets = docs.select(F.col("title").alias("anchor"), F.col("abstract").alias("positive"), F.when(F.col("corpusid") % 2 == 0, F.col("lang")).alias("negative"))
    opening = convs.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text2"))
    instructions = convs.join(opening, "conv_id").select(F.col("text").alias("text1"), "text2")
    contexts = docs.select(F.col("title").alias("query"), F.col("abstract").alias("document"))
    return {"citation_triplets": triplets, "instruction_pairs": instructions, "context_pairs": contexts}


def _parts_sql(samples: tuple[int | None, ...]) -> str:
    bodies = (
        "select substr(text, 1, 60) as anchor, text as positive, case when doc_id % 2 = 0 then lang end as negative, 'citation_triplets' as signal_type, 0 as o from documents",
        "select * from (select c.text as anchor, o.text as positive, cast(null as varchar) as negative, 'instruction_pairs' as signal_type, 1 as o from conversations c join (select conv_id, arg_min(text, turn) as text from conversations group by conv_id) o using (conv_id)) where anchor is not null and not starts_with(anchor, 'cluster:') and anchor is distinct from positive",
        "select substr(text, 1, 60) as anchor, text as positive, cast(null as varchar) as negative, 'context_pairs' as signal_type, 2 as o from documents",
    )
    cut = lambda s, n: f"({s})" if n is None else f"(select * from ({s}) order by {digest_sql(42, 'exact', 'anchor', 'positive')}, anchor, positive limit {n})"
    return " union all ".join(f"select * from {cut(s, n)}" for s, n in zip(bodies, samples))


@query(f"select anchor, positive, negative, signal_type from (select *, row_number() over (partition by anchor, positive order by o, negative nulls first) as rn from ({_parts_sql((None, None, None))})) where rn = 1")
def mix_dedup(spark, sf_dir):
    return mixer.mix({k: (v, None) for k, v in _signals(spark, sf_dir).items()})


@query(f"select anchor, positive, signal_type from (select *, row_number() over (partition by anchor, positive order by o) as rn from ({_parts_sql((50, 40, 30))})) where rn = 1")
def mix_sample_exact(spark, sf_dir):
    parts = _signals(spark, sf_dir)
    return mixer.mix({k: (v, n) for (k, v), n in zip(parts.items(), (50, 40, 30))}).drop("negative")


@query(f"""with m as (select * from (select *, row_number() over (partition by anchor, positive order by o, negative nulls first) as rn from ({_parts_sql((None, None, None))})) where rn = 1)
select signal_type, count(*) as n, sum(case when coalesce(negative, '') <> '' then 1 else 0 end)::bigint as n_negatives, sum(case when coalesce(negative, '') <> '' then 1 else 0 end) > 0.5 * count(*) as is_triplet from m group by signal_type""")
def route_signals(spark, sf_dir):
    return training.routed(mixer.mix({k: (v, None) for k, v in _signals(spark, sf_dir).items()}))


@query(f"select doc_id, case when {uniform_sql(42, 'split', 'doc_id')} < 0.05 then 'eval' else 'train' end as split from documents")
def train_eval_split(spark, sf_dir):
    return training.train_eval(table(spark, sf_dir, "documents").select("doc_id"), 0.05, 42, "doc_id")


@query(f"select doc_id, quality, case when row_number() over (partition by quality order by {digest_sql(42, 'split', 'doc_id')}, doc_id) <= ceil(count(*) over (partition by quality) * 0.05) then 'eval' else 'train' end as split from labels")
def stratified_split(spark, sf_dir):
    return training.train_eval(table(spark, sf_dir, "labels").select("doc_id", "quality"), 0.05, 42, "doc_id", by="quality")


_IDS = f"ids as (select doc_id, list_transform({TOKENS.format(c='text')}, lambda t: length(t)) as ids from documents)"


@query(f"""with {_IDS}, s as (select doc_id, ids, unnest(list_filter(range(0, greatest(len(ids), 1), 110), lambda s: least(len(ids) - s, 126) >= 64)) as start from ids),
c as (select *, row_number() over (partition by doc_id order by start) - 1 as chunk, ids[start + 1:start + 126] as body from s)
select doc_id, chunk, array_to_string(list_concat(list_concat([101], body), list_concat([102], list_transform(range(126 - len(body)), lambda x: 0))), ' ') as input_ids, len(body) + 2 as active from c""")
def chunk_tokens(spark, sf_dir):
    """Token ids here are the lengths of tokens."""
    ids = table(spark, sf_dir, "documents").select("doc_id", F.transform(text.tokens(F.col("text")), lambda t: F.length(t)).alias("ids"))
    rows = training.chunked(ids, 128, 16, 101, 102, 0)
    active = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x.cast("int"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"), active.cast("long").alias("active"))


@query(f"""with {_IDS}, t as (select doc_id, unnest(ids) as x, unnest(range(len(ids))) as i from ids),
u as (select *, {uniform_sql(42, 'choose', 'doc_id', 'i')} < 0.3 and x not in (101, 102, 0) as chosen from t),
v as (select *, case when not chosen then x when {uniform_sql(42, 'kind', 'doc_id', 'i')} < 0.8 then 103 when {uniform_sql(42, 'half', 'doc_id', 'i')} < 0.5 then floor({uniform_sql(42, 'word', 'doc_id', 'i')} * 1000)::bigint else x end as y from u)
select doc_id, sum(case when chosen then 1 else 0 end)::bigint as n_chosen, sum(case when chosen and y = 103 then 1 else 0 end)::bigint as n_masked, sum(y)::bigint as sum_ids from v group by doc_id""")
def mask_tokens(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id", F.transform(text.tokens(F.col("text")), lambda t: F.length(t)).alias("input_ids")).where(F.size("input_ids") > 0)
    rows = training.masked(ids.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))), "doc_id", 103, 1_000, (101, 102, 0))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    chosen = F.transform("labels", lambda x: (x != training.IGNORED).cast("int"))
    mask = F.transform(F.arrays_zip("labels", "input_ids"), lambda z: ((z["labels"] != training.IGNORED) & (z["input_ids"] == 103)).cast("int"))
    return rows.select("doc_id", total(chosen).alias("n_chosen"), total(mask).alias("n_masked"), total(F.col("input_ids")).alias("sum_ids"))


# --- retrieval ----------------------------------------------------------------------------------

_METRICS = """select count(*) as queries, round(avg((rank <= 1)::double), 6) as r1, round(avg((rank <= 10)::double), 6) as r10, round(avg((rank <= 100)::double), 6) as r100,
round(avg(case when rank <= 10 then 1 / log2(rank + 1) else 0 end), 6) as ndcg10, round(avg(1 / rank), 6) as mrr, quantile_cont(rank, 0.5) as median_rank, min(pool) as pool_min, max(pool) as pool_max from ranks"""
_VECTORS = """q as (select vec_id as query_id, embedding::double[] as v, vec_id + 1 as gold from embeddings where vec_id % 20 = 0 and vec_id + 1 in (select vec_id from embeddings)),
s as (select query_id, gold, c.vec_id as cand, c.label, g.label as gold_label, round(list_inner_product(v, c.embedding::double[]), 9) as score, round(list_inner_product(v, g.embedding::double[]), 9) as gold_score
  from q cross join embeddings c join embeddings g on g.vec_id = gold)"""


def _dense(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    candidates = rows.select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("field"))
    queries = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), (F.col("vec_id") + 1).alias("gold"))
    return queries, candidates


@query(f"with {_VECTORS}, ranks as (select query_id, 1 + sum(case when cand <> gold and score > gold_score then 1 else 0 end) as rank, count(*) as pool from s group by query_id) {_METRICS}")
def dense_rank_metrics(spark, sf_dir):
    return retrieval.metrics(retrieval.dense_ranks(*_dense(spark, sf_dir)))


@query(f"with {_VECTORS}, ranks as (select query_id, 1 + sum(case when cand <> gold and score > gold_score then 1 else 0 end) as rank, count(*) as pool from s where cand = gold or label = gold_label group by query_id) {_METRICS}")
def samefield_rank_metrics(spark, sf_dir):
    return retrieval.metrics(retrieval.dense_ranks(*_dense(spark, sf_dir), same_field=True))


@query("""select vec_id, i - 1 as dim, round(e[i] / greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12), 6) as value from (select vec_id, e, unnest(range(1, 17)) as i from (select vec_id, (embedding::double[])[1:16] as e from embeddings))""")
def matryoshka_truncate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(retrieval.normalized(F.col("embedding"), 16)).alias("dim", "value"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def _neighbours_sql(cut: str) -> str:
    e = f"(embedding::double[]){cut}"
    unit = f"list_transform({e}, lambda x: x / greatest(sqrt(list_sum(list_transform({e}, lambda y: y * y))), 1e-12))"
    return f"""(select a, b from (select a, b, row_number() over (partition by a order by s desc, b) as rn from
(select x.vec_id as a, y.vec_id as b, round(list_inner_product(x.u, y.u), 9) as s from (select vec_id, {unit} as u from embeddings) x join (select vec_id, {unit} as u from embeddings) y on x.vec_id <> y.vec_id)) where rn <= 10)"""


@query(f"""select (select count(*) from embeddings) as n, count(*) as common, round(count(*) / ((select count(*) from embeddings) * 10), 6) as agreement
from {_neighbours_sql('')} p join {_neighbours_sql('[1:32]')} q on p.a = q.a and p.b = q.b""")
def nn_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    space = lambda d: rows.select("vec_id", retrieval.normalized(F.col("embedding"), d).alias("vector"))
    return retrieval.agreement(space(64), space(32), 10)


def _model_sql(dim: int) -> str:
    unit = f"list_transform((embedding::double[])[1:{dim}], lambda x: x / greatest(sqrt(list_sum(list_transform((embedding::double[])[1:{dim}], lambda y: y * y))), 1e-12))"
    rank = "1 + sum(case when c.vec_id <> q.vec_id + 1 and round(list_inner_product(q.u, c.u), 9) > round(list_inner_product(q.u, g.u), 9) then 1 else 0 end) as rank, count(*) as pool"
    pairs = f"from e{dim} q join e{dim} g on g.vec_id = q.vec_id + 1 cross join e{dim} c where q.vec_id % 20 = 0"
    parts = [f"select 'd{dim}' as model, '{p}' as pl, q.vec_id as query_id, {rank} {pairs} {where} group by q.vec_id" for p, where in (("full", ""), ("samefield", "and (c.vec_id = g.vec_id or c.label = g.label)"))]
    return f"e{dim} as (select vec_id, label, {unit} as u from embeddings), r{dim} as ({' union all '.join(parts)})"


@query(f"""with {_model_sql(64)}, {_model_sql(16)}, ranks as (select * from r64 union all select * from r16)
{_METRICS.replace('select count(*) as queries', 'select model, pl as pool, count(*) as queries').replace(' from ranks', ' from ranks group by model, pl')}""")
def model_metrics(spark, sf_dir):
    """Two models, the vectors whole and their first 16 numbers, in either pool."""
    queries, candidates = _dense(spark, sf_dir)
    cut = lambda rows, d: rows.withColumn("vector", retrieval.normalized(F.col("vector"), d))
    return retrieval.evaluated({f"d{d}": (cut(queries, d), cut(candidates, d)) for d in (64, 16)})


_BM25 = f"""toks as (select doc_id, {TOKENS.format(c='text')} as t from documents),
stats as (select count(*) as n, avg(len(t)) as avgdl from toks),
post as (select doc_id, token, len(any_value(t)) as dl, count(*) as tf from (select doc_id, t, unnest(t) as token from toks) group by doc_id, token),
raw as (select token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as r from post, stats group by token, n),
idf as (select token, case when r < 0 then (select 0.25 * avg(r) from raw) else r end as idf from raw),
qt as (select item_id as query_id, token, count(*) as times from (select item_id, unnest({TOKENS.format(c='text')}) as token from benchmark) group by 1, 2),
scores as (select query_id, doc_id as doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qt join idf using (token) join post using (token), stats group by 1, 2)"""


def _bm25_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("item_id").alias("gold"))


@query(f"with {_BM25} select query_id, doc, round(score, 4) as score from scores")
def bm25_scores(spark, sf_dir):
    return retrieval.bm25(_bm25_queries(spark, sf_dir), table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 4))


@query(f"""with {_BM25}, g as (select item_id as query_id, item_id as gold, round(coalesce(score, 0), 9) as gold_score from benchmark left join scores on query_id = item_id and doc = item_id),
ranks as (select g.query_id, 1 + sum(case when d.doc_id <> gold and round(coalesce(score, 0), 9) > gold_score then 1 else 0 end) as rank, count(*) as pool from g cross join documents d left join scores s on s.query_id = g.query_id and s.doc = d.doc_id group by 1) {_METRICS}""")
def bm25_rank_metrics(spark, sf_dir):
    return retrieval.metrics(retrieval.bm25_ranks(_bm25_queries(spark, sf_dir), table(spark, sf_dir, "documents")))


@query(f"""with {_BM25}, g as (select item_id as query_id, item_id as gold, source as field, round(coalesce(score, 0), 9) as gold_score from benchmark join documents on doc_id = item_id left join scores on query_id = item_id and doc = item_id),
ranks as (select g.query_id, 1 + sum(case when d.doc_id <> gold and round(coalesce(score, 0), 9) > gold_score then 1 else 0 end) as rank, count(*) as pool from g join documents d on d.source = g.field left join scores s on s.query_id = g.query_id and s.doc = d.doc_id group by 1) {_METRICS}""")
def bm25_samefield_metrics(spark, sf_dir):
    return retrieval.metrics(retrieval.bm25_ranks(_bm25_queries(spark, sf_dir), table(spark, sf_dir, "documents"), "source"))


# --- audit --------------------------------------------------------------------------------------


@query(f"""with {PAPERS}, u as (select corpusid from papers where length(abstract) >= 50 and citationcount >= 5), t as (select distinct l_partkey as id from lineitem)
select (select count(*) from t) as n, 0::bigint as unresolved, count(*) as overlap, round(100.0 * count(*) / greatest((select count(*) from t), 1), 2) as percent from t join u on corpusid = id""")
def paper_overlap(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("id"))
    return audit.paper_overlap(ids, audit.candidate_universe(views.papers(spark, sf_dir)))


@query(f"""with {DIGRAPH}, {PAPERS}, u as (select corpusid from papers where length(abstract) >= 50 and citationcount >= 5),
t as (select distinct o_custkey % (select count(*) from documents) as src, o_orderkey % (select count(*) from documents) as dst from orders),
e as (select citing, cited from digraph where citing in (select corpusid from u) and cited in (select corpusid from u)),
h as (select distinct src, dst from t where exists (select 1 from e where citing = src and cited = dst) or exists (select 1 from e where citing = dst and cited = src))
select (select count(*) from t) as n, count(*) as overlap, round(100.0 * count(*) / greatest((select count(*) from t), 1), 2) as percent from h""")
def edge_overlap_undirected(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    task = table(spark, sf_dir, "orders").select((F.col("o_custkey") % n).alias("src"), (F.col("o_orderkey") % n).alias("dst"))
    return audit.edge_overlap(task, views.digraph(spark, sf_dir), audit.candidate_universe(views.papers(spark, sf_dir)))


@query(f"with {DIGRAPH}, {PAPERS}, u as (select corpusid from papers where length(abstract) >= 50 and citationcount >= 5) select count(*) as edges from digraph where citing in (select corpusid from u) and cited in (select corpusid from u)")
def edge_universe(spark, sf_dir):
    return audit.edge_universe(views.digraph(spark, sf_dir), audit.candidate_universe(views.papers(spark, sf_dir)))


@query(f"""with {PAPERS}, u as (select corpusid from papers where length(abstract) >= 50 and citationcount >= 5),
r as (select doc_id as id, case when quality = 1 then 'quality' else 'junk' end as task, case when doc_id % 3 = 0 then 'test' else 'train' end as split from labels)
select id, task, split from r where not (split = 'test' and id in (select corpusid from u))""")
def cold_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "quality").otherwise("junk").alias("task"), F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"))
    cold = audit.cold_filter(rows, audit.candidate_universe(views.papers(spark, sf_dir)))
    return audit.apply_cold_filter(rows, cold).select("id", "task", "split")


_TASK = """task as (select case when o_orderkey % 5 = 0 then 'sha' || o_custkey when o_orderkey % 11 = 1 then null else ' ' || o_custkey end as query_id,
  case when o_orderkey % 7 = 0 then 'x' || o_orderkey when o_orderkey % 11 = 1 then null else cast(o_orderkey % 1000 as varchar) end as cand_id,
  case o_orderkey % 4 when 0 then '1' when 1 then '0' when 2 then ' 2.5' else 'bad' end as score from orders),
mapping as (select 'sha' || c_custkey as doc_id, c_custkey as corpus_id from customer where c_nationkey < 12)"""


def _task(spark, sf_dir):
    """orders as rows of an evaluation task with ids of several kinds, and the map of some of them."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(
        F.when(key % 5 == 0, F.concat(F.lit("sha"), cust)).when(key % 11 == 1, None).otherwise(F.concat(F.lit(" "), cust)).alias("query_id"),
        F.when(key % 7 == 0, F.concat(F.lit("x"), key.cast("string"))).when(key % 11 == 1, None).otherwise((key % 1000).cast("string")).alias("cand_id"),
        F.when(key % 4 == 0, "1").when(key % 4 == 1, "0").when(key % 4 == 2, " 2.5").otherwise("bad").alias("score"),
    )
    mapping = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.concat(F.lit("sha"), F.col("c_custkey").cast("string")).alias("doc_id"), F.col("c_custkey").alias("corpus_id"))
    return rows, mapping


@query(f"""with {_TASK}, r as (select coalesce(try_cast(trim(query_id) as bigint), a.corpus_id) as src, coalesce(try_cast(trim(cand_id) as bigint), b.corpus_id) as dst, try_cast(trim(score) as double) as score, query_id, cand_id
  from task left join mapping a on a.doc_id = query_id left join mapping b on b.doc_id = cand_id), fine as (select * from r where src is not null and dst is not null)
select (select count(distinct id) from (select src as id from fine union all select dst from fine)) as n_ids, (select count(*) from (select distinct src, dst from fine where score > 0)) as n_positive,
  (select count(*) from r where (src is null or dst is null) and (query_id is not null or cand_id is not null)) as unresolved""")
def edge_task(spark, sf_dir):
    edges = audit.edge_task(*_task(spark, sf_dir))
    lost = edges.agg(F.sum(F.col("unresolved").cast("long")).alias("unresolved"))
    ids, pairs = audit.endpoints(edges).agg(F.count(F.lit(1)).alias("n_ids")), audit.positives(edges).agg(F.count(F.lit(1)).alias("n_positive"))
    return ids.join(F.broadcast(pairs)).join(F.broadcast(lost))


@query(f"""with {_TASK}, {PAPERS}, i as (select coalesce(try_cast(trim(query_id) as bigint), corpus_id) as id from task left join mapping on doc_id = query_id where query_id is not null),
u as (select corpusid from papers where length(abstract) >= 50 and citationcount >= 5), h as (select count(*) as overlap from (select distinct id from i) join u on corpusid = id)
select count(distinct id) as n, sum(case when id is null then 1 else 0 end)::bigint as unresolved, (select overlap from h) as overlap, round(100.0 * (select overlap from h) / greatest(count(distinct id), 1), 2) as percent from i""")
def task_overlap(spark, sf_dir):
    rows, mapping = _task(spark, sf_dir)
    return audit.paper_overlap(audit.task_ids(rows, mapping, "query_id"), audit.candidate_universe(views.papers(spark, sf_dir)))


@query("select d.doc_id as corpusid from documents d join labels l on l.doc_id = d.doc_id and l.quality = 1")
def fulltext_universe(spark, sf_dir):
    """Papers whose DOI a good label has, in other case."""
    papers = views.papers(spark, sf_dir).select("corpusid", F.concat(F.lit("10.1/Doc"), F.col("corpusid").cast("string")).alias("doi"))
    fulltext = table(spark, sf_dir, "labels").select(F.concat(F.lit("10.1/dOC"), F.col("doc_id").cast("string")).alias("doi"), (F.col("quality") == 1).alias("has_full_text"))
    return audit.fulltext_universe(papers, fulltext)


@query(f"""with {PAPERS}, i as (select l_partkey as id from lineitem), c as (select id, coalesce(citationcount, 0)::bigint as count from i left join papers on corpusid = id),
l as (select quantile_cont(count, 0.99) as cap, coalesce(quantile_cont(case when count > 0 then count end, 0.9), 0) as high from c)
select id, count, round(ln(1 + least(count, cap)), 9) as log_count, count >= high as is_high from c, l""")
def citation_impact(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    rows = audit.impact(audit.citation_counts(ids, views.papers(spark, sf_dir)))
    return rows.withColumn("log_count", F.round("log_count", 9))


# --- scores -------------------------------------------------------------------------------------


@query(f"with {SCORES} select model, round(avg(mean), 6) as macro from (select model, task, avg(score) as mean from scores group by 1, 2) where mean > 0 group by model")
def macro_average(spark, sf_dir):
    rows = views.scores(spark, sf_dir).withColumn("category", F.col("task"))
    return scores.macro_average(rows).withColumn("macro", F.round("macro", 6))


@query(f"""with {SCORES}, m as (select model, task, avg(score) as score from scores group by 1, 2)
select task, count(*) as n, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, round(max(score) - min(score), 6) as spread, case when stddev_pop(score) < 1 then 'STUCK' when stddev_pop(score) > 3 then 'DISCRIM' else '' end as flag from m group by task having count(*) >= 5""")
def task_variance(spark, sf_dir):
    rows = views.scores(spark, sf_dir).groupBy("task", "model").agg(F.avg("score").alias("score"))
    return scores.task_variance(rows).withColumns({c: F.round(c, 6) for c in ("mean", "std", "spread")})


@query(f"""with {SCORES}, a as (select model, seed, avg(score) as mean, coalesce(stddev_samp(score), 0) as std from scores group by 1, 2)
select model, {', '.join(f"round(max(case when seed = {d} then {c} end), 6) as {c}_{d}" for d in (0, 1, 2) for c in ('mean', 'std'))},
{', '.join(f"round(100 * max(case when seed = {d} then mean end) / max(case when seed = 0 then mean end), 6) as percent_{d}" for d in (0, 1, 2))} from a group by model""")
def seed_pivot(spark, sf_dir):
    rows = scores.seed_pivot(views.scores(spark, sf_dir).withColumn("dim", F.col("seed")), [0, 1, 2], 0)
    return rows.select("model", *[F.round(c, 6).alias(c) for c in rows.columns if c != "model"])


@query(f"""with {SCORES}, m as (select model, task, avg(score) as score from scores group by 1, 2),
b as (select *, row_number() over (partition by task order by score desc, model) as rn from m where model <> '0')
select m.task, round(m.score, 6) as own, b.model as best_model, round(b.score, 6) as best, round(m.score - b.score, 6) as delta from m join b on b.task = m.task and rn = 1 where m.model = '0'""")
def best_baseline(spark, sf_dir):
    rows = views.scores(spark, sf_dir).groupBy("task", "model").agg(F.avg("score").alias("score"))
    return scores.best_baseline(rows, "0").withColumns({c: F.round(c, 6) for c in ("own", "best", "delta")})


@query(f"""with {SCORES}, m as (select task, model, avg(score) as mean, stddev_pop(score) as std from scores group by 1, 2)
select a.task, round(a.mean, 6) as own_mean, round(a.std, 6) as own_std, round(b.mean, 6) as base_mean, round(b.std, 6) as base_std, round(a.mean - b.mean, 6) as delta from m a join m b on a.task = b.task where a.model = '0' and b.model = '1'""")
def seed_decomposition(spark, sf_dir):
    rows = scores.seed_decomposition(views.scores(spark, sf_dir), "0", "1")
    return rows.select("task", *[F.round(c, 6).alias(c) for c in rows.columns if c != "task"])


@query(f"""with recursive {SCORES}, s as (select model, cast(row_number() over (partition by model order by task, seed) as bigint) as step, score as v from scores),
e as (select model, step, v, v as ema from s where step = 1 union all select s.model, s.step, s.v, 0.9 * e.ema + (1 - 0.9) * s.v from e join s on s.model = e.model and s.step = e.step + 1)
select model, step, round(v, 6) as v, round(ema, 6) as ema from e""")
def smoothed_scores(spark, sf_dir):
    from pyspark.sql import Window

    rows = views.scores(spark, sf_dir).select("model", F.row_number().over(Window.partitionBy("model").orderBy("task", "seed")).cast("long").alias("step"), F.col("score").alias("v"))
    return scores.smoothed(rows, "model", "step", "v", 0.9).withColumns({"v": F.round("v", 6), "ema": F.round("ema", 6)})


@query(f"with {SCORES}, m as (select task, model, avg(score) as score from scores group by 1, 2) select task, {', '.join(f'''round(100 * max(case when model = '{i}' then score end), 2) as m{i}''' for i in range(8))} from m group by task")
def task_by_model(spark, sf_dir):
    rows = views.scores(spark, sf_dir).groupBy("task", "model").agg(F.avg("score").alias("score"))
    wide = scores.task_by_model(rows, [str(i) for i in range(8)])
    return wide.select("task", *[F.col(str(i)).alias(f"m{i}") for i in range(8)])


_TASKS = [(t, c) for c, tasks in scores.CATEGORIES.items() for t in tasks]
_RESULTS = f"""dim(i, task, category) as (values {', '.join(f"({i}, '{t}', '{c}')" for i, (t, c) in enumerate(_TASKS))}),
raw as (select cast(user_id % 8 as varchar) as model, event_id % {len(_TASKS)} as i, avg(value) as score from events group by 1, 2),
res as (select model, task, category, score from raw join dim using (i) where not (model = '3' and category = 'search')),
prm as (select model, avg(score) as score from res where category = 'search' group by model having model <> '5'),
cats as (select model, category, avg(score) as mean from res group by 1, 2)"""


def _results(spark, sf_dir):
    """events as result documents of eight models: every other task has its metrics under "complete"; one model lacks a category, one the reviewers' task."""
    dim = spark.createDataFrame([(i, t, c, scores.METRICS[t]) for i, (t, c) in enumerate(_TASKS)], "i long, task string, category string, metric string")
    events = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).cast("string").alias("model"), (F.col("event_id") % len(_TASKS)).alias("i")).agg(F.avg("value").alias("score"))
    rows = events.join(F.broadcast(dim), "i").where(~((F.col("model") == "3") & (F.col("category") == "search")))
    metric = F.create_map("metric", "score")
    entry = F.when(F.col("i") % 2 == 0, F.to_json(F.create_map(F.lit("complete"), metric))).otherwise(F.to_json(metric))
    entry = F.concat(F.lit('"'), "task", F.lit('": '), entry)
    docs = rows.groupBy("model").agg(F.collect_list(entry).alias("entries"), F.avg(F.when(F.col("category") == "search", F.col("score"))).alias("r"))
    reviewed = F.map_from_arrays(F.array(*map(F.lit, scores.REVIEWER_METRICS)), F.array_repeat("r", len(scores.REVIEWER_METRICS)))
    last = F.when(F.col("r").isNotNull() & (F.col("model") != "5"), F.array(F.concat(F.lit(f'"{scores.REVIEWERS}": '), F.to_json(reviewed)))).otherwise(F.array().cast("array<string>"))
    return docs.select("model", F.concat(F.lit("{"), F.array_join(F.concat("entries", last), ", "), F.lit("}")).alias("document"))


@query(f"with {_RESULTS} select model, task, category, round(score, 6) as score from res")
def primary_scores(spark, sf_dir):
    return scores.primary_scores(_results(spark, sf_dir), scores.dimension(spark)).withColumn("score", F.round("score", 6))


@query(f"""with {_RESULTS}, v as (select model, 'categories' as variant, sum(mean) / 4 as macro from cats group by model
  union all select model, 'tasks', avg(score) from (select model, score from res union all select model, score from prm) group by model
  union all select model, 'formats', avg(mean) from (select model, mean from cats union all select model, score from prm) group by model)
select model, variant, round(macro, 6) as macro, rank() over (partition by variant order by round(macro, 9) desc) as place from v""")
def score_variants(spark, sf_dir):
    """Three ways to one number for each model, and the order that each gives."""
    results = _results(spark, sf_dir)
    own, extra = scores.primary_scores(results, scores.dimension(spark)), scores.reviewer_scores(results).where("score is not null")
    out = None
    for name, rows in (("categories", scores.macro_all_categories(own)), ("tasks", scores.task_mean(own, extra)), ("formats", scores.macro_with_extra(own, extra))):
        part = scores.ordered(rows.withColumn("macro", F.round("macro", 9))).select("model", F.lit(name).alias("variant"), F.round("macro", 6).alias("macro"), F.col("place").cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"with {_RESULTS} select model, round(avg(mean), 6) as macro from cats where mean > 0 group by model")
def category_macro(spark, sf_dir):
    own = scores.primary_scores(_results(spark, sf_dir), scores.dimension(spark))
    return scores.macro_average(own).withColumn("macro", F.round("macro", 6))


@query(f"""with {SCORES}, m as (select model, task, avg(score) as score from scores group by 1, 2), f as (select task from m group by task having count(*) >= 5 and stddev_pop(score) >= 1)
select model, round(avg(score), 6) as macro from m where task in (select task from f) group by model""")
def macro_without_stuck(spark, sf_dir):
    rows = views.scores(spark, sf_dir).groupBy("task", "model").agg(F.avg("score").alias("score"))
    return scores.task_mean(scores.without_stuck(rows)).withColumn("macro", F.round("macro", 6))


@query(f"""with {SCORES}, m as (select model, task, avg(score) as score from scores group by 1, 2),
b as (select *, row_number() over (partition by task order by score desc, model) as rn from m where model <> '0')
select m.task, round(m.score, 6) as own, b.model as best_model, round(b.score, 6) as best, round(m.score - b.score, 6) as delta from m join b on b.task = m.task and rn = 1 where m.model = '0' and m.score < b.score order by m.score - b.score, m.task limit 5""")
def greatest_losses(spark, sf_dir):
    rows = views.scores(spark, sf_dir).groupBy("task", "model").agg(F.avg("score").alias("score"))
    return scores.losses(scores.best_baseline(rows, "0")).withColumns({c: F.round(c, 6) for c in ("own", "best", "delta")})
