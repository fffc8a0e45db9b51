"""Fusing ranked lists (R1, R3, R4, R6-R8, W1, W2, W7, T9, U2). Lists are rows (query_id, channel, pos, chunk_id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def ranks(hits: DataFrame) -> DataFrame:
    """Ranks within a channel; a repeated chunk keeps its first place and later ones take no rank."""
    once = hits.groupBy("query_id", "channel", "chunk_id").agg(F.min("pos").alias("pos"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("pos", "chunk_id")))


def checked(hits: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, text, score) as they are; one chunk with different texts, or a score that is not finite, is an
    error."""
    texts = hits.groupBy("chunk_id").agg(F.min("text").alias("_lo"), F.max("text").alias("_hi"))
    odd = F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull()
    j = hits.join(texts, "chunk_id")
    wrong = F.when(F.col("_lo") != F.col("_hi"), F.concat(F.lit("CONFLICTING_TEXT "), F.col("chunk_id"))).when(odd, F.concat(F.lit("SCORE_NOT_FINITE "), F.col("chunk_id")))
    return j.withColumn("score", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).otherwise(F.col("score"))).drop("_lo", "_hi")


def rrf(ranked: DataFrame) -> DataFrame:
    """Reciprocal ranks summed over channels, with the channels that found it; order by score, then chunk."""
    f = ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0).cast("double") / (K + F.col("rank"))), 12).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    return f.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")))


def drop_repeated(fused: DataFrame, content: list[str]) -> DataFrame:
    """Of equal content the first in fused order; required rows stay."""
    n = F.row_number().over(Window.partitionBy("query_id", *content).orderBy("fused_rank"))
    return fused.withColumn("_n", n).where("_n = 1 or required").drop("_n")


def consensus(fused: DataFrame, facet: DataFrame) -> DataFrame:
    """Order by both ranks' reciprocals; facet has (query_id, chunk_id, facet_rank)."""
    j = fused.join(facet, ["query_id", "chunk_id"])
    score = F.lit(1.0).cast("double") / (K + F.col("fused_rank")) + F.lit(1.0).cast("double") / (K + F.col("facet_rank"))
    j = j.withColumn("consensus", F.round(score, 12))
    return j.withColumn("consensus_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("consensus").desc(), "fused_rank", "chunk_id")))


def cover(ranked: DataFrame, facets: DataFrame, limit: int) -> DataFrame:
    """The best of the original, each facet's best, facets in turn, then the rest; each chunk at its first place.

    ranked: (query_id, chunk_id, rank); facets: (query_id, facet_no, chunk_id, facet_rank) over the same chunks.
    """
    p = facets.select("query_id", "chunk_id", F.struct(F.lit(2).alias("p"), F.col("facet_rank").alias("x"), F.col("facet_no").alias("y")).alias("at"))
    anchors = facets.where("facet_rank = 1").select("query_id", "chunk_id", F.struct(F.lit(1).alias("p"), F.col("facet_no").alias("x"), F.lit(0).alias("y")).alias("at"))
    own = ranked.select("query_id", "chunk_id", F.struct(F.when(F.col("rank") == 1, 0).otherwise(3).alias("p"), F.col("rank").alias("x"), F.lit(0).alias("y")).alias("at"))
    first = own.unionByName(anchors).unionByName(p).groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
    first = first.join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id"))).where(F.col("place") <= limit).drop("at")


def merge_rerank(fused: DataFrame, scores: DataFrame) -> DataFrame:
    """Order by the reranker's scores where it scored every candidate of a query, else the fused order, degraded.
    Adds the evidence number."""
    j = fused.join(scores, ["query_id", "chunk_id"], "left")
    whole = F.count("rerank_score").over(Window.partitionBy("query_id")) == F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    j = j.withColumn("_whole", whole)
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("_whole"), F.col("rerank_score")).desc_nulls_last(), "fused_rank")
    j = j.withColumn("final_rank", F.row_number().over(order))
    return j.select("query_id", "chunk_id", "final_rank", F.when(F.col("_whole"), "ok").otherwise("degraded").alias("status"), F.concat(F.lit("E"), F.col("final_rank").cast("string")).alias("evidence_id"))


def revalidate(candidates: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose revision, content and hash are still the current ones; with a column pos, in its order."""
    left = candidates.join(current.select(*keys).distinct(), keys, "left_semi")
    return left.orderBy("pos") if "pos" in candidates.columns else left


def sources(rows: DataFrame, readable: DataFrame, keys: list[str], version: str) -> DataFrame:
    """U8: current and past sources by key, the last version of each, and whether it may still be read."""
    ok = readable.select(*keys).distinct().withColumn("_ok", F.lit(True))
    return rows.groupBy(*keys).agg(F.max(version).alias(version)).join(ok, keys, "left").select(*keys, version, F.coalesce("_ok", F.lit(False)).alias("authorised"))
