"""Deterministic views of the driver's tables in the terms of the operators, once in Spark and once as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scope import Identity

WHO = Identity(tenant_id=1, user_id=42, department_id=3, clearance=1, member_id=77)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("document_id"),
        F.substring("source", 4, 9).cast("int").alias("kb_id"),
        (1 + i % 2).cast("int").alias("tenant_id"),
        F.col("lang").alias("file_type"),
        (i % 3).cast("int").alias("confidentiality"),
        F.when(i % 7 != 0, (i % 25).cast("int")).alias("department_id"),
        (i % 1500).alias("creator_id"),
        F.when(i % 23 == 0, "DELETED").when(i % 10 == 0, "DRAFT").otherwise("PUBLISHED").alias("status"),
        F.when((i % 23 == 0) | (i % 29 == 0), F.lit("2024-06-01").cast("date")).alias("deleted_at"),
        F.when(i % 19 != 0, i).alias("active_generation_id"),
        F.col("n_chars").alias("size"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 730).cast("int")).alias("uploaded_on"),
        *more,
    )


D = """d AS (SELECT doc_id AS document_id, CAST(substr(source, 4) AS INTEGER) AS kb_id, CAST(1 + doc_id % 2 AS INTEGER) AS tenant_id, lang AS file_type, CAST(doc_id % 3 AS INTEGER) AS confidentiality,
 CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 25 AS INTEGER) END AS department_id, doc_id % 1500 AS creator_id, CASE WHEN doc_id % 23 = 0 THEN 'DELETED' WHEN doc_id % 10 = 0 THEN 'DRAFT' ELSE 'PUBLISHED' END AS status,
 CASE WHEN doc_id % 23 = 0 OR doc_id % 29 = 0 THEN DATE '2024-06-01' END AS deleted_at, CASE WHEN doc_id % 19 <> 0 THEN doc_id END AS active_generation_id, n_chars AS size,
 CAST(DATE '2024-01-01' + CAST(doc_id % 730 AS INTEGER) AS DATE) AS uploaded_on, text FROM documents)"""


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge base of each number in each of two tenants."""
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").withColumn("tenant_id", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.select(k.cast("int").alias("kb_id"), "tenant_id", F.when(k % 9 == 4, "ARCHIVED").otherwise("ACTIVE").alias("status"), F.when(k % 11 == 7, F.lit("2024-06-01").cast("date")).alias("deleted_at"))


B = "b AS (SELECT CAST(n_nationkey AS INTEGER) AS kb_id, unnest([1, 2]) AS tenant_id, CASE WHEN n_nationkey % 9 = 4 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status, CASE WHEN n_nationkey % 11 = 7 THEN DATE '2024-06-01' END AS deleted_at FROM nation)"


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To a department, or every fourth to a user."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((k % 20).cast("int").alias("kb_id"), F.when(k % 4 != 2, F.col("s_nationkey")).alias("department_id"), F.when(k % 4 == 2, F.when(k % 8 == 2, 42).otherwise(k)).cast("long").alias("user_id"), (1 + k % 2).cast("int").alias("tenant_id"), F.when(k % 3 == 0, "READ").when(k % 3 == 1, "WRITE").otherwise("ADMIN").alias("permission"))


G = """g AS (SELECT CAST(s_suppkey % 20 AS INTEGER) AS kb_id, CASE WHEN s_suppkey % 4 <> 2 THEN s_nationkey END AS department_id, CAST(CASE WHEN s_suppkey % 8 = 2 THEN 42 WHEN s_suppkey % 4 = 2 THEN s_suppkey END AS BIGINT) AS user_id,
 CAST(1 + s_suppkey % 2 AS INTEGER) AS tenant_id, CASE s_suppkey % 3 WHEN 0 THEN 'READ' WHEN 1 THEN 'WRITE' ELSE 'ADMIN' END AS permission FROM supplier)"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a department or, every sixth, with a user; some by the other tenant, which do not count."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").where("quality = 1").select(i.alias("document_id"), F.when(i % 6 != 5, (i * 7 % 25).cast("int")).alias("department_id"), F.when(i % 6 == 5, 42).cast("long").alias("user_id"), (1 + (i + F.when(i % 13 == 0, 1).otherwise(0)) % 2).cast("int").alias("tenant_id"), F.when(i % 4 < 2, "READ").otherwise("WRITE").alias("permission"))


S = """sh AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 6 <> 5 THEN CAST(doc_id * 7 % 25 AS INTEGER) END AS department_id, CAST(CASE WHEN doc_id % 6 = 5 THEN 42 END AS BIGINT) AS user_id,
 CAST(1 + (doc_id + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END) % 2 AS INTEGER) AS tenant_id, CASE WHEN doc_id % 4 < 2 THEN 'READ' ELSE 'WRITE' END AS permission FROM labels WHERE quality = 1)"""


def _allowed(name: str, state: str, grant: str, share: str) -> str:
    return f"""{name} AS (SELECT d.* FROM d JOIN b ON b.kb_id = d.kb_id AND b.tenant_id = d.tenant_id WHERE d.tenant_id = 1 AND b.status = 'ACTIVE' AND b.deleted_at IS NULL AND d.confidentiality <= 1 AND {state}
 AND EXISTS (SELECT 1 FROM g WHERE g.kb_id = b.kb_id AND g.tenant_id = b.tenant_id AND g.permission IN ({grant}) AND (g.user_id = 42 OR g.department_id = 3))
 AND (d.confidentiality = 0 OR d.department_id = 3 OR (d.department_id IS NULL AND d.creator_id = 77)
  OR EXISTS (SELECT 1 FROM sh WHERE sh.tenant_id = d.tenant_id AND sh.document_id = d.document_id AND sh.permission IN ({share}) AND (sh.user_id = 42 OR sh.department_id = 3))))"""


#: Documents that WHO may read, for the oracles: published ones, and those that may be written, deleted ones too.
R = f"""{D}, {B}, {G}, {S}, {_allowed("r", "d.status = 'PUBLISHED' AND d.deleted_at IS NULL AND d.active_generation_id IS NOT NULL", "'READ', 'WRITE', 'ADMIN'", "'READ', 'WRITE'")}"""
RW = f"""{D}, {B}, {G}, {S}, {_allowed("r", "d.status IN ('DRAFT', 'PUBLISHED') AND d.deleted_at IS NULL", "'WRITE', 'ADMIN'", "'WRITE'")}"""
RA = f"""{D}, {B}, {G}, {S}, {_allowed("r", "d.status IN ('DRAFT', 'PUBLISHED', 'DELETED')", "'ADMIN'", "'WRITE'")}"""


def readable(spark: SparkSession, sf_dir: str, *more: str, **how: str) -> DataFrame:
    from ..operators.scope import readable_documents

    return readable_documents(documents(spark, sf_dir, *more), bases(spark, sf_dir), grants(spark, sf_dir), shares(spark, sf_dir), WHO, **how)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), (1 + k % 2).cast("int").alias("tenant_id"), F.when(k % 11 != 0, F.col("c_nationkey")).alias("department_id"), F.when(k % 5 == 0, "DISABLED").otherwise("ACTIVE").alias("status"))


M = "mem AS (SELECT c_custkey AS user_id, CAST(1 + c_custkey % 2 AS INTEGER) AS tenant_id, CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END AS department_id, CASE WHEN c_custkey % 5 = 0 THEN 'DISABLED' ELSE 'ACTIVE' END AS status FROM customer)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not blank, numbered from 0 in their document."""
    lines = F.filter(F.split("text", "\n"), lambda c: F.trim(c) != "")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(lines).alias("chunk_index", "content"))
    return chunks.select("document_id", "chunk_index", (F.col("document_id") * 100_000 + F.col("chunk_index")).alias("chunk_id"), "content")


C = """ln AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
c AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY line) - 1 AS INTEGER) AS chunk_index, document_id * 100000 + row_number() OVER (PARTITION BY document_id ORDER BY line) - 1 AS chunk_id, content FROM ln WHERE trim(content) <> '')"""


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as subjects, suppliers as objects, orders as evidence; each combination once."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("assertion_id"), F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object"), F.col("l_orderkey").alias("evidence_id")).distinct()


A = "a AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS assertion_id, l_partkey AS subject, l_suppkey AS object, l_orderkey AS evidence_id FROM lineitem)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: F done, P failed, O at work or waiting."""
    k = F.col("o_orderkey")
    t = F.col("o_orderdate").cast("timestamp_ntz")
    status = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "P", "FAILED").when(k % 3 == 0, "RUNNING").when(k % 3 == 1, "PENDING").otherwise("RETRY_WAIT")
    return table(spark, sf_dir, "orders").select(k.alias("task_id"), F.col("o_custkey").alias("document_id"), (k % 97).alias("generation_id"), status.alias("status"), (1 + k % 5).cast("int").alias("attempts"), F.lit(4).alias("max_attempts"), t.alias("next_run_at"), (t + F.expr("INTERVAL 2 DAYS")).alias("lease_until"), "o_totalprice")


K = """t AS (SELECT o_orderkey AS task_id, o_custkey AS document_id, o_orderkey % 97 AS generation_id, CASE WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_orderstatus = 'P' THEN 'FAILED' WHEN o_orderkey % 3 = 0 THEN 'RUNNING' WHEN o_orderkey % 3 = 1 THEN 'PENDING' ELSE 'RETRY_WAIT' END AS status,
 CAST(1 + o_orderkey % 5 AS INTEGER) AS attempts, 4 AS max_attempts, o_orderdate AS next_run_at, o_orderdate + INTERVAL 2 DAY AS lease_until, o_totalprice FROM orders)"""
NOW = "2000-01-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence_no"), "role", "text", ((F.col("conv_id") + F.col("turn")) % 9 != 0).alias("readable"))


H = "m AS (SELECT conv_id AS session_id, turn AS sequence_no, role, text, (conv_id + turn) % 9 <> 0 AS readable FROM conversations)"
