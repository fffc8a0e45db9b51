"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in the order of a seeded hash, and the queue repeats: a source that runs dry is queued again, at
most `repeats` times in all. A document's virtual finish time is the sum of its source's words up to its end, over the
source's target weight. The mix is the stream of all documents, range-sorted by that time over all sources, and prefix sums
over the ranges cut it where it has the total budget. Documents go in packets of at most a PACKETS-th of their source's
target, so that one long document does not hold up the others: the cut misses no source's target by more than such a packet.

Both prefix sums (in a source, and of the whole stream) are sums of ranges that were sorted and written once; only a row for
each range meets in one task. A hot source is many ranges. All of it are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop

#: Parts of a source's target that a packet may be as long as.
PACKETS = 1024


def targets(sources: DataFrame, weights: tuple[float, ...], repeats: int, share: float = 1.0) -> DataFrame:
    """(source, source_size, source_no, target, packet, latest) from (source, source_size): water-filling. Targets divide the
    budget (share of all sizes) by weight; a source stops at repeats * source_size and the excess is shared again by weight.
    Sources in order of code points, null last, take the weights in turn. packet is the most words that go at once; by the
    time latest the stream has its budget. Works on a row for each source."""
    one = Window.partitionBy(F.lit(0))
    s = sources.withColumn("source_no", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", (F.col("source_size") * repeats).cast("double")).withColumn("_budget", F.sum("source_size").over(one) * F.lit(float(share)))
    # Sources fill up in the order of cap over weight. With those before a source full, the level is (budget - their caps)
    # over the weights that are left; the first source whose cap lies above that level is not full, nor are those after.
    fill = one.orderBy(F.col("_cap") / F.col("_w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_caps", F.coalesce(F.sum("_cap").over(fill), F.lit(0.0))).withColumn("_left", F.sum("_w").over(one) - F.coalesce(F.sum("_w").over(fill), F.lit(0.0)))
    s = s.withColumn("_level", (F.col("_budget") - F.col("_caps")) / F.col("_left"))
    level = F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.struct("_caps", "_level"))).over(one).getField("_level")
    s = s.withColumn("_at", level)
    s = s.withColumn("target", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_w"))))
    s = s.withColumn("packet", F.greatest(F.lit(1), F.floor(F.col("target") / PACKETS)).cast("long"))
    # At time 1 each source lacks less than a packet. In the next unit of time each adds its target or what its cap leaves, and
    # in a part of that unit at least as large a part of that.
    late = F.try_divide(F.sum("packet").over(one) + 1, F.sum(F.least("target", F.col("_cap") - F.col("target"))).over(one))
    return s.select("source", "source_size", "source_no", "target", "packet", F.when(late <= 1, 1 + late).otherwise(F.lit(1e9)).alias("latest"))


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds size: the words of the text, 0 for a null."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))


def before(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows, range-sorted by order, with `name`: the sum of value over all rows that come earlier. order tells all rows apart
    that must not be taken for one another, and equal rows come as they are read; nulls come first. Rows are written once,
    each with the number of its range."""
    order = [*order, "_tie"]
    ranged = cut(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(base, "_range")
    return out.withColumn(name, F.col("_base") + F.col("_in")).drop("_range", "_base", "_in", "_tie")


def queue(rows: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), repeats: int = 3, seed: int = 17) -> DataFrame:
    """Rows (doc_id, source, size, ...) with source_size, source_no, target, packet, latest and start: the words of its source
    queued before it.

    The order in a source is the MD5 of the seed and doc_id, then doc_id, then size; rows equal in all are interchangeable.
    """
    r = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    r = before(r, ["source", "_h", "doc_id", "size"], "size", "_start")
    told = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    earlier = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    per = cut(told.withColumn("_first", F.coalesce(F.sum("source_size").over(earlier), F.lit(0))).withColumnRenamed("source", "_s"), "mix-sources")
    out = r.join(per, F.col("source").eqNullSafe(F.col("_s")))
    return out.select(*rows.columns, "source_size", "source_no", "target", "packet", "latest", (F.col("_start") - F.col("_first")).alias("start"))


def stream(queued: DataFrame, repeats: int = 3) -> DataFrame:
    """The mix itself: a row for each packet that it takes: queued's columns, copy (0 for the first), at (words of the document
    before the packet), finish (the virtual time) and take (the words that it takes).

    finish has the target as the weight, so a source has had its target at about time 1. The stream is sorted by finish,
    source and place in the source over all sources; what comes when it has the sum of all targets is not taken, and the
    packet on that border is cut. Later packets than that could ever be are not queued.
    """
    budget = queued.groupBy("source_no").agg(F.first("target").alias("target")).agg(F.coalesce(F.round(F.sum("target")), F.lit(0.0)).cast("long").alias("budget"))
    q = queued.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    q = q.withColumn("begin", F.col("copy") * F.col("source_size") + F.col("start"))
    within = F.ceil((F.col("latest") * F.col("target") - F.col("begin")) / F.col("packet")) + 1
    n = F.least(F.ceil(F.col("size") / F.col("packet")), within)
    q = q.where(F.col("begin") <= F.col("latest") * F.col("target")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    q = q.withColumn("at", F.col("_k") * F.col("packet")).withColumn("words", F.least(F.col("packet"), F.col("size") - F.col("at"))).withColumn("begin", F.col("begin") + F.col("at"))
    q = q.withColumn("finish", (F.col("begin") + F.col("words")) / F.col("target")).drop("_k")
    sums = before(q, ["finish", "source_no", "begin"], "words", "_before").join(F.broadcast(budget))  # one row
    take = F.least(F.col("words"), F.col("budget") - F.col("_before"))
    return sums.withColumn("take", take).where("take > 0").drop("_before", "budget", "words", "begin")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), repeats: int = 3, seed: int = 17, text_col: str = "text") -> DataFrame:
    """The mix of docs (doc_id, source, text_col) in its order: packets range-sorted by finish; see stream() for the columns.

    A null text has size 0 and is never taken; null sources are one source, the last. Repeated rows count one by one.
    """
    s = stream(queue(sized(docs.select("doc_id", "source", text_col), text_col).drop(text_col), weights, repeats, seed), repeats)
    order = ["finish", "source_no", "copy", "start", "at"]
    return s.repartitionByRange(*order).sortWithinPartitions(*order)


def taken(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), repeats: int = 3, seed: int = 17, text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, size, source_size, target (of its source), taken: words that the mix takes of it, copies
    counted. A very long text is as many packets as its source's target allows; a null or empty one has size 0 and nothing is
    taken. Null ids and repeated rows are documents like others. Columns of docs other than doc_id, source and the text are
    left out; empty docs give no rows."""
    rows = cut(sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(text_col).alias("text")), "text").select("doc_id", "source", "size").withColumn("row_id", F.monotonically_increasing_id()), "mix-sizes")
    queued = cut(queue(rows, weights, repeats, seed), "mix-queue")
    drop(rows)
    got = cut(stream(queued, repeats).groupBy("row_id").agg(F.sum("take").alias("taken")), "mix-taken")
    return queued.join(got, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
