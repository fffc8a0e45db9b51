"""Catalog questions: exact counts and pages with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 10_000


def count_documents(documents: DataFrame) -> DataFrame:
    """A1: one row (total, over_limit); documents have one row each, so chunks or revisions never multiply."""
    return documents.agg(F.count(F.lit(1)).alias("total")).withColumn("over_limit", F.col("total") > MOST_ROWS)


def exact_count(documents: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """A1: the total alone; more than `most` is an error, as the answer to a question must be exact."""
    n = F.count(F.lit(1))
    return documents.agg(F.when(n <= most, n).otherwise(F.raise_error(F.concat(F.lit("STRUCTURED_SCOPE_LIMIT "), n.cast("string"))).cast("long")).alias("total"))


def ordered_json(order: str, value: str) -> Column:
    """An aggregate: the values of a group as a JSON array in an order."""
    return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value]))


def revocations(rows: DataFrame, key: str, revoked: Column, at: str) -> DataFrame:
    """(key, revoked_at, revocations): the last time and the number of rows that revoke."""
    return rows.groupBy(key).agg(F.max(F.when(revoked, F.col(at))).alias("revoked_at"), F.count_if(revoked).alias("revocations"))


def union_all(*views: DataFrame) -> DataFrame:
    """All rows of views with the same columns, by name."""
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out


def with_overall(rows: DataFrame, wanted: Column, size: str) -> DataFrame:
    """A2: (total, total_size, overall_total, overall_size): of the rows that are wanted next to all, in one pass."""
    some = F.when(wanted, F.col(size))
    return rows.agg(F.count_if(wanted).alias("total"), F.coalesce(F.sum(some), F.lit(0)).alias("total_size"), F.count(F.lit(1)).alias("overall_total"), F.coalesce(F.sum(size), F.lit(0)).alias("overall_size"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page in a total order; it plans as one top-k."""
    if not 0 <= offset <= 100_000 or not 1 <= limit <= 100:
        raise ValueError("offset lies between 0 and 100000, limit between 1 and 100")
    return rows.orderBy(*order).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, key: str, before: int | None, limit: int) -> DataFrame:
    """The next rows below a key, newest first, each with whether more follow."""
    some = rows if before is None else rows.where(F.col(key) < before)
    top = some.orderBy(F.col(key).desc()).limit(limit + 1)
    more = top.agg((F.count(F.lit(1)) > limit).alias("has_more"))
    return top.orderBy(F.col(key).desc()).limit(limit).join(F.broadcast(more), how="inner")  # one row


def document_fingerprint(columns: list[str]) -> Column:
    """One hash of the columns, nulls told from empty strings."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)


def counts_by_status(rows: DataFrame, status: str, size: str, buckets: dict[str, list[str]]) -> DataFrame:
    """Total, size and filtered counts of status buckets in one pass."""
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.round(F.sum(size), 2), F.lit(0.0)).alias("total_size"),
        *[F.count_if(F.col(status).isin(*v)).alias(k) for k, v in buckets.items()],
    )


def next_sequence(rows: DataFrame, key: str, number: str) -> DataFrame:
    """A5: the number that the next row of each key gets."""
    return rows.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def sentence(total: Column) -> Column:
    """The fixed answer to a count question."""
    return F.format_string("当前可读的已发布文档中，符合条件的共有 %d 份。", total)


def unique_match(rows: DataFrame, value: str, columns: list[str], key: str) -> DataFrame:
    """P10: the one row whose name or code is the value; none if there is no such row or several."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | (F.col(c) == value)
    some = rows.where(hit).select(key).distinct().limit(2)
    return some.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias(key)).where("n = 1").select(key)


def prefixes(statements: DataFrame, key: str, items: str) -> DataFrame:
    """What a reader has seen after each statement: (key, n, shown)."""
    return statements.select(key, F.explode(F.sequence(F.lit(1), F.size(items))).alias("n"), items).select(key, "n", F.array_join(F.slice(items, F.lit(1), F.col("n")), " ").alias("shown"))


def frozen_issues(rows: DataFrame, group: str, number: str, text: str, digest: str) -> DataFrame:
    """What keeps a frozen set from being used: (code, n) for hashes that do not fit and numbers with gaps or repeats."""
    bad = rows.where(F.sha2(text, 256) != F.col(digest)).select(F.lit("HASH").alias("code"))
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(number).alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    gaps = g.where("lo <> 0 or hi <> n - 1 or d <> n").select(F.lit("INDEX").alias("code"))
    return bad.unionByName(gaps).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
