"""Exact token counts: a histogram of encoded lengths, whose suffix sums answer every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import count_tokens
from .common import written

#: Lengths of one block of the histogram; suffix sums are taken within blocks and over the blocks' totals.
BLOCK = 64


def length_histogram(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length; a null or empty text has length 0, repeated rows count as often as
    they come, texts of any length are encoded whole, other columns are ignored.  No rows for an empty table."""
    return count_tokens(docs, vocabulary, text_col).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row per length L that occurs, with exact answers for the context limit L:

    n_docs (documents of length L), docs_at_least and tokens_at_least (documents of length L or more, their tokens),
    tokens_kept (tokens left when each document is cut to L), tokens_cut, share_within (share of documents of length L
    or less: the quantile that L is), total_docs and total_tokens.  Between two rows the sums are linear in L.  No rows
    for an empty table.  One task sums over the blocks: a row for each BLOCK lengths up to the longest, however many
    documents there are."""
    h = written(histogram.select("n_tokens", "n_docs", F.expr("n_tokens * n_docs").alias("tokens"), F.expr(f"n_tokens div {BLOCK}").alias("block")), "lengths")
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    beyond = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = sums.select(F.col("block").alias("of"), *(F.coalesce(F.sum(c).over(beyond), F.lit(0)).alias(f"{c}_beyond") for c in "dt"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    at = h.join(later, h["block"] == later["of"]).withColumns({"docs_at_least": F.col("d_beyond") + F.sum("n_docs").over(own), "tokens_at_least": F.col("t_beyond") + F.sum("tokens").over(own)})
    kept = F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return at.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", kept.alias("tokens_kept"), (F.col("total_tokens") - kept).alias("tokens_cut"), ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("share_within"), "total_docs", "total_tokens")
