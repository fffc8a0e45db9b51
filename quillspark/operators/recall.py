"""Recall channels (T1-T3, A11, D11, S15). A query is a parameter; rows are those that a scope lets through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import bigrams

K1, B = 1.2, 0.75


def top_k(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k highest scores, ties by the smaller key; one TakeOrderedAndProject."""
    if not 1 <= k <= 100:
        raise ValueError("k lies between 1 and 100")
    return rows.orderBy(F.col(score).desc(), F.col(key)).limit(k)


def dense(rows: DataFrame, query: list[float], vector: str, key: str, k: int) -> DataFrame:
    """Exact cosine over all rows in scope; no index, as the scope changes with the user."""
    scored = rows.where(vectors.vector_issue(F.col(vector), len(query)).isNull())
    return top_k(scored.select(key, F.round(vectors.cosine(F.col(vector), vectors.literal(query)), 9).alias("score")), "score", key, k)


def terms(text: Column) -> Column:
    """Lower-cased runs of a-z."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def _count(terms: str, word: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == word))


def bm25(rows: DataFrame, query: list[str], text: str, key: str, k: int) -> DataFrame:
    """BM25 with the statistics of the rows in scope. Only the query's terms are counted, and a row carries a count for each,
    so nothing is exploded and the only shuffles are one row of totals and the top k. The text is read twice: for the totals,
    and for the scores that need them."""
    words = sorted(set(query))
    t = rows.select(key, terms(F.col(text)).alias("_t"))
    t = t.select(key, F.size("_t").alias("_n"), *[_count("_t", w).alias(f"_f{i}") for i, w in enumerate(words)])
    totals = t.agg(F.count(F.lit(1)).alias("_rows"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(words))])
    j = t.join(F.broadcast(totals), how="inner")  # one row
    score = sum((F.log(1 + (F.col("_rows") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)) * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_n") / F.col("_mean"))) for i in range(len(words))), F.lit(0.0))
    return top_k(j.select(key, F.round(score, 6).alias("score")).where("score > 0"), "score", key, k)


def bigram(rows: DataFrame, query: str, text: str, key: str, k: int) -> DataFrame:
    """How many of the query's distinct character pairs a row has."""
    score = sum((F.contains(F.col(text), F.lit(b)).cast("int") for b in bigrams(query)), F.lit(0))
    return top_k(rows.select(key, score.alias("score")).where("score > 0"), "score", key, k)


def cached(chunks: DataFrame, cache: DataFrame, text: str, spec: str, dimension: int) -> DataFrame:
    """Rows of chunks with key (of the specification and the text), the vector that the cache (key, vector) has for it, and hit; a
    vector that is not valid is a miss."""
    good = cache.where(vectors.vector_issue(F.col("vector"), dimension).isNull()).groupBy("key").agg(F.first("vector").alias("vector"))
    keyed = chunks.withColumn("key", F.sha2(F.concat(F.lit(f"{spec}\n"), F.col(text)), 256))
    return keyed.join(good, "key", "left").withColumn("hit", F.col("vector").isNotNull())


def stored(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache (key, vector) after vectors were made: a fresh one takes the place of what was there."""
    return cache.join(fresh.select("key"), "key", "left_anti").select("key", "vector").unionByName(fresh.select("key", "vector").dropDuplicates(["key"]))


def numbered_batches(misses: DataFrame, size: int = 10) -> DataFrame:
    """(key, batch): distinct keys in order, `size` to a batch. Keys are dealt by range first, so only a row for each range
    meets in one task."""
    ranged = misses.select("key").distinct().repartitionByRange("key").withColumn("_range", F.spark_partition_id())
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.row_number().over(Window.partitionBy("_range").orderBy("key")) - 1
    return ranged.withColumn("_at", n).join(before.drop("_n"), "_range").select("key", F.floor((F.col("_base") + F.col("_at")) / size).cast("long").alias("batch"))


def embedding_batches(chunks: DataFrame, cache: DataFrame, text: str, size: int = 10) -> DataFrame:
    """(texts, distinct_texts, hits, misses, batches): each distinct text is embedded once, unless the cache has it."""
    keys = chunks.select(F.sha2(text, 256).alias("key"))
    one = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(cache.select("key", F.lit(1).alias("hit")).distinct(), "key", "left")
    return one.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.count(F.lit(1)).alias("distinct_texts"), F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"), F.ceil(F.count_if(F.col("hit").isNull()) / size).cast("long").alias("batches")
    )
