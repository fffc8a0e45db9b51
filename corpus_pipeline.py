"""The corpus pipeline: quality classifier, MinHash near-dedup, suffix-array dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. In every stage, columns of
docs besides these are left out, whatever they are called, and an empty table gives an empty one; the operators' docstrings say
what becomes of very long texts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import minhash, mixing, packing, quality, suffixes
from quillspark.llm.common import cut
from quillspark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects: bad, toxic and wordless documents, so null and empty texts go. Null ids, sources and
    languages stay as they are, repeated rows share their fate. Without labels, no toxic words are learnt."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked at 0.8 on five-word shingles. Documents without words are
    linked with nothing and stay. Of rows that agree in id and text one stays, the first by language, source and n_chars; a
    document without an id yields to copies that have one. Texts are shuffled once, to meet the verdict on their ids."""
    # a null id is stood in for by one made of the text, larger than real ones, so that it yields to them
    own = F.coalesce("doc_id", F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))
    rows = docs.select(*COLUMNS, own.alias("_id"))
    near = minhash.near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"), words=5, percent=80)
    kept = cut(near.where("kept").select(F.col("doc_id").alias("_id")).distinct(), "kept-ids")
    first = F.row_number().over(Window.partitionBy("_id", "text").orderBy("lang", "source", "n_chars", "doc_id"))
    return rows.join(kept, "_id", "left_semi").withColumn("_n", first).where("_n = 1").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every 100-byte string that starts earlier too. A character of which only some bytes go, goes. All rows stay, a null
    text as an empty one; null ids come before all others."""
    out = suffixes.remove_repeats(docs, carry=("lang", "source"), as_text=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it and in the order of the mix; one on the border of the
    budget is cut there. Documents without words go; null sources are one source, null ids and repeated rows are documents
    like others."""
    rows = cut(docs.select(*COLUMNS).withColumn("row_id", F.monotonically_increasing_id()), "mix-docs")
    sized = mixing.sized(rows).select("doc_id", "source", "size", "row_id")
    packets = mixing.stream(mixing.queue(cut(sized, "mix-sizes")))
    copies = packets.groupBy("row_id", "copy").agg(F.min("finish").alias("_finish"), F.min("source_no").alias("_no"), F.min("size").alias("_size"), F.sum("take").alias("_take"))
    out = rows.join(cut(copies, "mix-copies"), "row_id")
    head = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    part = F.expr(r"array_join(slice(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0), 1, cast(_take as int)), '')")
    text = F.when(F.col("_take") < F.col("_size"), F.concat(head, part)).otherwise(F.col("text"))
    order = ["_finish", "_no", "copy", "row_id"]
    out = out.withColumn("text", text).repartitionByRange(*order).sortWithinPartitions(*order)
    return out.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def file_order(docs: DataFrame) -> tuple[Column, Column] | None:
    """(file, row) of documents read from files that Spark wrote: files sort by the number of the partition that they hold, which
    a reader that deals out files by size does not keep. None for documents that are not read from files."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    name = F.col("_metadata.file_name")
    return F.concat(F.lpad(F.regexp_extract(name, r"part-(\d+)", 1), 12, "0"), F.lit("/"), name), F.col("_metadata.row_index")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go in sequences of 4096, which follow the order that the documents were written in; null and
    empty texts, null ids and repeated rows are documents too."""
    return packing.pieces(docs, tokenizer_path(), place=file_order(docs)).drop("ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing to target weights", source_mixing),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage-{i}")
    return docs
