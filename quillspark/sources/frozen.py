"""Frozen sets of rows (S14): sorted text files with a manifest that does not depend on how the rows were dealt, and a reader that
says which file is not what was frozen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "frozen-1"
MANIFEST = "part int, rows long, ends string, total string"


def _summed(lines: DataFrame) -> DataFrame:
    """A row for each part: its rows, and a hash of the set of its lines in two parts: lines may come in any order, and one that
    differs, is missing or is there twice gives another one."""
    h = F.conv(F.substring(F.sha2("line", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.hex(F.bit_xor(F.xxhash64("line"))).alias("ends"), F.sum(h).cast("string").alias("total"))


def freeze(df: DataFrame, path: str, keys: list[str], parts: int = 16) -> DataFrame:
    """Writes df as JSON lines under path/data, in parts by a hash of the keys, sorted by line within a part, and the manifest under
    path/manifest; returns the manifest. Columns come in the order of their names and nulls are written, so equal rows are equal
    lines whatever order columns, rows and partitions had. Repeated rows stay; a set without rows has an empty manifest. A path
    that holds a set is never overwritten."""
    columns = sorted(df.columns)
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    part = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(parts)).cast("int")
    lines = df.select(part.alias("part"), line.alias("line")).repartition(parts, "part").sortWithinPartitions("part", "line")
    lines.write.partitionBy("part").text(f"{path}/data")
    stored = _read(df.sparkSession, path)
    manifest = _summed(stored).orderBy("part").coalesce(1)  # `parts` rows
    manifest.write.option("version", VERSION).json(f"{path}/manifest")
    return df.sparkSession.read.schema(MANIFEST).json(f"{path}/manifest")


def _read(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.text(f"{path}/data")
    part = F.col("part").cast("int") if "part" in stored.columns else F.lit(None).cast("int")  # a set without rows has no parts
    return stored.select(F.col("value").alias("line"), part.alias("part"))


def problems(spark: SparkSession, path: str) -> DataFrame:
    """(part, code) of parts that differ from the manifest: MISSING, EXTRA, ROWS or CONTENT."""
    was = spark.read.schema(MANIFEST).json(f"{path}/manifest").toDF("part", "_rows", "_ends", "_total")
    j = _summed(_read(spark, path)).join(was, "part", "full_outer")
    code = F.when(F.col("rows").isNull(), "MISSING").when(F.col("_rows").isNull(), "EXTRA").when(F.col("rows") != F.col("_rows"), "ROWS").when((F.col("ends") != F.col("_ends")) | (F.col("total") != F.col("_total")), "CONTENT")
    return j.select("part", code.alias("code")).where("code is not null")


def thawed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a frozen set; an error names the parts that are not what was frozen."""
    bad = problems(spark, path).collect()  # a row a part
    if bad:
        raise ValueError("not what was frozen: " + ", ".join(f"part {r.part} {r.code}" for r in sorted(bad, key=lambda r: r.part)))
    return _read(spark, path).select(F.from_json("line", schema).alias("r")).select("r.*")
