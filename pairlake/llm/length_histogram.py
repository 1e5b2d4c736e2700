"""Token counts as an exact length histogram.

Each text is encoded once; after that only its length is kept. Documents are
aggregated by length, and suffix sums over the histogram give, for every context
limit L, how many documents are longer, how many tokens there are in all and how
many remain when every document is cut to L. Quantiles are read off the same sums.

The suffix sums work in two levels (sums by block of lengths, then inside blocks),
so no task sees the whole histogram; its size depends on the longest text, not on
the number of documents.

Defined results: a null or empty text has length 0 and counts as a document; a null
doc_id is reported as such. An empty table gives an empty histogram. Any code point is
encoded; strings of special tokens are ordinary text. A text with a run of white space of
``LONG_RUN`` characters or more, on which the encoder's own splitter overflows its stack, is
split by the same pattern here and its pieces encoded one by one, with the same ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of this vocabulary: a fixed value, published with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("pairlake", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The encoder's own splitter overflows its stack on a run of white space of about a million.
LONG_RUN = 100_000


def token_count(text: str | None, path: str = RANKS) -> int:
    """Length of one text's encoding."""
    if not text:
        return 0
    import regex

    encoding = _encoding(path)
    if len(text) < LONG_RUN or not regex.search(rf"\s{{{LONG_RUN}}}", text):
        return len(encoding.encode_to_numpy(text, disallowed_special=()))
    return sum(len(encoding._encode_single_piece(piece)) for piece in regex.findall(PATTERN, text))


def counted(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """documents -> doc_id, n_tokens. ``path`` must exist on every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [token_count(t.as_py(), path) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """n_tokens column -> a row for each length that occurs, with its suffix sums.

    n_tokens, n_docs, docs_longer (strictly), docs_total, tokens_total,
    truncated_total (tokens left when every text is cut to n_tokens),
    tokens_lost, share_at_most (documents no longer than this).
    """
    counts = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / block))
    counts = cut(counts)  # small, read twice below, and made by encoding every text
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        *[F.coalesce(F.sum(f"b_{x}").over(later), F.lit(0)).alias(f"later_{x}") for x in ("docs", "tokens")],
        *[F.sum(f"b_{x}").over(everything).alias(f"{x}_total") for x in ("docs", "tokens")],
    )
    longer = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.join(blocks, "block").select(
        "n_tokens", "n_docs", "docs_total", "tokens_total",
        (F.col("later_docs") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).alias("docs_longer"),
        (F.col("later_tokens") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(longer), F.lit(0))).alias("tokens_longer"),
    )
    lost = F.col("tokens_longer") - F.col("docs_longer") * F.col("n_tokens")
    return rows.select(
        "n_tokens", "n_docs", "docs_longer", "docs_total", "tokens_total",
        (F.col("tokens_total") - lost).alias("truncated_total"), lost.alias("tokens_lost"),
        F.round(1 - F.col("docs_longer") / F.col("docs_total"), 9).alias("share_at_most"),
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, kept tokens and truncated documents for any limits, also ones no text has."""
    spark = hist.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    cut = F.least(F.col("n_tokens"), F.col("context_limit")) * F.col("n_docs")
    joined = hist.select("n_tokens", "n_docs").withColumn("one", F.lit(1)).join(F.broadcast(wanted.withColumn("one", F.lit(1))), "one")
    return joined.groupBy("context_limit").agg(
        F.sum(cut).alias("truncated_total"),
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_truncated"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """share -> the least length such that at least that share of documents is no longer."""
    at_most = (F.col("docs_total") - F.col("docs_longer")).cast("double")
    return hist.agg(*[F.min(F.when(at_most >= F.lit(float(s)) * F.col("docs_total"), F.col("n_tokens"))).alias(f"q{s}") for s in shares])
