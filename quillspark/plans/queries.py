"""A query for each operator over the driver's tables, with its production parameters and an independent SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods, text, vectors
from ..operators import catalog, filters, fusion, graph, metrics, recall, scope, tasks
from . import adapters as x
from .adapters import RA, RW, A, C, D, G, H, K, M, NOW, R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle if SQL has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- catalog, scope, filters


@query(f"WITH {R} SELECT count(*) AS total, count(*) > 10000 AS over_limit FROM r")
def catalog_count(spark, sf):
    return catalog.count_documents(x.readable(spark, sf))


@query(f"WITH {R} SELECT document_id, kb_id, uploaded_on, size FROM r ORDER BY uploaded_on DESC, document_id DESC LIMIT 20 OFFSET 5")
def catalog_page(spark, sf):
    return catalog.page(x.readable(spark, sf), [F.col("uploaded_on").desc(), F.col("document_id").desc()], 5, 20).select("document_id", "kb_id", "uploaded_on", "size")


@query(f"WITH {RW} SELECT document_id, kb_id, status FROM r")
def writable_documents(spark, sf):
    """A request to write asks for other grants and shares than one to read."""
    return x.readable(spark, sf, state="default", request="WRITE").select("document_id", "kb_id", "status")


@query(f"WITH {RA} SELECT document_id, kb_id, status FROM r")
def administered_documents(spark, sf):
    """Deleted ones too."""
    return x.readable(spark, sf, state="all", request="ADMIN").select("document_id", "kb_id", "status")


@query(f"WITH {D}, {x.B}, {G} SELECT kb_id FROM b WHERE tenant_id = 1 AND status = 'ACTIVE' AND deleted_at IS NULL AND EXISTS (SELECT 1 FROM g WHERE g.kb_id = b.kb_id AND g.tenant_id = 1 AND (g.user_id = 42 OR g.department_id = 3) AND g.permission IN ('WRITE', 'ADMIN'))")
def accessible_bases(spark, sf):
    """P11."""
    return scope.accessible(x.bases(spark, sf), x.grants(spark, sf), x.WHO, "WRITE").select("kb_id")


LANG = filters.Field("enum", frozenset(("en", "de", "fr", "es")))
TEXT, DAY, SIZE = filters.Field("text"), filters.Field("date"), filters.Field("number")


def _filtered(spark, sf, *some):
    return x.documents(spark, sf, "text").where(filters.compile_filters(some)).select("document_id", "file_type", "uploaded_on")


@query(f"WITH {D} SELECT document_id, file_type, uploaded_on FROM d WHERE file_type = 'de'")
def catalog_filter_eq(spark, sf):
    return _filtered(spark, sf, filters.Filter("file_type", "eq", ("de",), LANG))


@query(f"WITH {D} SELECT document_id, file_type, uploaded_on FROM d WHERE file_type IN ('de', 'fr')")
def catalog_filter_any(spark, sf):
    return _filtered(spark, sf, filters.Filter("file_type", "eq", ("de", "fr"), LANG))


@query(f"WITH {D} SELECT document_id, file_type, uploaded_on FROM d WHERE file_type NOT IN ('en', 'es')")
def catalog_filter_neq(spark, sf):
    return _filtered(spark, sf, filters.Filter("file_type", "neq", ("en", "es"), LANG))


@query(f"WITH {D} SELECT document_id, file_type, uploaded_on FROM d WHERE contains(lower(text), lower('Licensed Under'))")
def catalog_filter_contains(spark, sf):
    return _filtered(spark, sf, filters.Filter("text", "contains", ("Licensed Under",), TEXT))


@query(f"WITH {D} SELECT document_id, file_type, uploaded_on FROM d WHERE uploaded_on >= DATE '2024-03-01' AND uploaded_on < DATE '2024-06-01' AND size > 500 AND size <= 5000")
def catalog_filter_range(spark, sf):
    return _filtered(spark, sf, filters.Filter("uploaded_on", "range", (filters.day("2024-03-01"), filters.day("2024-06-01")), DAY), filters.Filter("size", "gt", (500,), SIZE), filters.Filter("size", "lte", (5000,), SIZE))


@query(f"WITH {R} SELECT count(*) AS total, count(*) > 10000 AS over_limit FROM r WHERE size < 0")
def catalog_zero_rows(spark, sf):
    return catalog.count_documents(x.readable(spark, sf).where("size < 0"))


@query(f"WITH {R}, q AS (SELECT doc_id AS document_id FROM documents WHERE doc_id % 13 = 0) SELECT count(*) AS requested, count(r.document_id) AS readable, count(*) FILTER (WHERE r.document_id IS NULL) AS missing FROM q LEFT JOIN r USING (document_id)")
def scope_resolve(spark, sf):
    return scope.resolve_scope(x.readable(spark, sf), x.documents(spark, sf).where("document_id % 13 = 0").select("document_id"))


@query(f"WITH {D}, a AS (SELECT document_id, size + CASE WHEN document_id % 50 = 0 THEN 1 ELSE 0 END AS s FROM d WHERE document_id % 40 <> 0), b AS (SELECT document_id, size AS s FROM d WHERE document_id % 45 <> 0) SELECT document_id, CASE WHEN a.document_id IS NULL THEN 'missing' WHEN b.document_id IS NULL THEN 'extra' ELSE 'changed' END AS difference FROM a FULL JOIN b USING (document_id) WHERE a.s IS DISTINCT FROM b.s")
def provenance_diff(spark, sf):
    d = x.documents(spark, sf)
    after = d.where("document_id % 40 <> 0").select("document_id", (F.col("size") + F.when(F.col("document_id") % 50 == 0, 1).otherwise(0)).alias("s"))
    return scope.changed_sources(d.where("document_id % 45 <> 0").select("document_id", F.col("size").alias("s")), after, "document_id", "s")


@query(f"WITH {G} SELECT tenant_id, kb_id, department_id, CASE max(CASE permission WHEN 'ADMIN' THEN 3 WHEN 'WRITE' THEN 2 ELSE 1 END) WHEN 3 THEN 'ADMIN' WHEN 2 THEN 'WRITE' ELSE 'READ' END AS permission FROM g GROUP BY ALL")
def grant_effective_level(spark, sf):
    return scope.effective_level(x.grants(spark, sf), ["tenant_id", "kb_id", "department_id"])


@query(f"WITH {G}, {M}, u AS (SELECT * FROM g WHERE permission = 'ADMIN'), j AS (SELECT DISTINCT u.tenant_id, u.kb_id, mem.user_id FROM u JOIN mem ON mem.tenant_id = u.tenant_id AND (mem.department_id = u.department_id OR mem.user_id = u.user_id)) SELECT tenant_id, kb_id, count(*) AS admins FROM j GROUP BY ALL")
def last_admin_check(spark, sf):
    return scope.members_with(x.grants(spark, sf), x.members(spark, sf), "ADMIN").groupBy("tenant_id", "kb_id").agg(F.count(F.lit(1)).alias("admins"))


@query(f"WITH {M}, dep AS (SELECT n_nationkey AS department_id, CASE WHEN n_nationkey % 6 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS s FROM nation) SELECT user_id, tenant_id, mem.department_id FROM mem LEFT JOIN dep USING (department_id) WHERE status = 'ACTIVE' AND (mem.department_id IS NULL OR s = 'ACTIVE')")
def member_active(spark, sf):
    dep = x.table(spark, sf, "nation").select(F.col("n_nationkey").alias("department_id"), F.when(F.col("n_nationkey") % 6 == 0, "CLOSED").otherwise("ACTIVE").alias("status"))
    return scope.active_members(x.members(spark, sf), dep).select("user_id", "tenant_id", "department_id")


@query("SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def date_period_bucket(spark, sf):
    return x.table(spark, sf, "events").groupBy(periods.local_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {K} SELECT count(*) AS total, coalesce(round(sum(o_totalprice), 2), 0) AS total_size, count(*) FILTER (WHERE status IN ('PENDING', 'RETRY_WAIT')) AS waiting, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'SUCCEEDED') AS done FROM t")
def task_page_counts(spark, sf):
    return catalog.counts_by_status(x.tasks(spark, sf), "status", "o_totalprice", {"waiting": ["PENDING", "RETRY_WAIT"], "running": ["RUNNING"], "failed": ["FAILED"], "done": ["SUCCEEDED"]})


@query(f"WITH {K}, l AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY next_run_at DESC, task_id DESC) AS n FROM t) SELECT task_id, document_id, status, next_run_at FROM l WHERE n = 1 ORDER BY next_run_at DESC, task_id DESC LIMIT 25")
def task_page_rows(spark, sf):
    newest = scope.latest(x.tasks(spark, sf), ["document_id"], [F.col("next_run_at").desc(), F.col("task_id").desc()])
    return catalog.page(newest, [F.col("next_run_at").desc(), F.col("task_id").desc()], 0, 25).select("task_id", "document_id", "status", "next_run_at")


@query(f"WITH {H} SELECT session_id, coalesce(max(sequence_no), 0) + 1 AS next_number FROM m GROUP BY 1")
def sequence_alloc(spark, sf):
    return catalog.next_sequence(x.messages(spark, sf), "session_id", "sequence_no")


@query("SELECT user_id, max(ts) FILTER (WHERE event_type = 'error') AS revoked_at, count(*) FILTER (WHERE event_type = 'error') AS revocations FROM events GROUP BY 1")
def revocation_stamp(spark, sf):
    return catalog.revocations(x.table(spark, sf, "events"), "user_id", F.col("event_type") == "error", "ts")


@query(f"WITH {R} SELECT format('当前可读的已发布文档中，符合条件的共有 {{}} 份。', count(*)) AS answer FROM r")
def answer_sentence(spark, sf):
    return catalog.count_documents(x.readable(spark, sf)).select(catalog.sentence(F.col("total")).alias("answer"))


@query(f"WITH {D} SELECT document_id, sha256('=' || document_id || '|=' || kb_id || '|' || coalesce('=' || department_id, '~') || '|=' || status) AS fingerprint FROM d")
def document_fingerprints(spark, sf):
    return x.documents(spark, sf).select("document_id", catalog.document_fingerprint(["document_id", "kb_id", "department_id", "status"]).alias("fingerprint"))


@query("SELECT conv_id AS id, count(*) AS n, to_json(list(role ORDER BY turn)) AS roles FROM conversations GROUP BY 1")
def ordered_json_page(spark, sf):
    """A7."""
    return x.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), catalog.ordered_json("turn", "role").alias("roles"))


@query(f"WITH {D}, k AS (SELECT DISTINCT coalesce(text, '') AS object_key, document_id FROM d) SELECT DISTINCT a.document_id FROM k a JOIN k b ON a.object_key = b.object_key AND a.document_id <> b.document_id")
def shared_objects(spark, sf):
    """Documents whose object, keyed by the hash of its whole text, another document uses too."""
    k = x.documents(spark, sf, "text").select("document_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("object_key"))
    return graph.shared(k, "object_key", "document_id").select("document_id")


# --- text


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), g AS (SELECT *, sum(CASE WHEN trim(t) = '' OR starts_with(t, 'Licensed') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM l) SELECT doc_id, k AS paragraph, min(n) AS line_start, max(n) AS line_end, md5(string_agg(t, chr(10) ORDER BY n)) AS digest FROM g WHERE trim(t) <> '' AND NOT starts_with(t, 'Licensed') GROUP BY 1, 2")
def paragraphs(spark, sf):
    """S3, W3; licence lines count as blank here, as the driver's texts have no blank lines."""
    from ..operators.chunking import paragraphs as split

    return split(x.table(spark, sf, "documents"), "doc_id", "text", blank=lambda t: (F.trim(t) == "") | F.startswith(t, F.lit("Licensed")))


@query("WITH s AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS t FROM documents), i AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM s WHERE contains(t, ' | ')), q AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, k ORDER BY n) - 1) // 500 AS part FROM i), r AS (SELECT doc_id, k, part, min(n) AS first_row, max(n) AS last_row, count(*) AS n_rows FROM q GROUP BY 1, 2, 3) SELECT doc_id, first_row, last_row, n_rows FROM r")
def table_regions_500(spark, sf):
    from ..operators.chunking import table_regions

    rows = x.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).where(F.contains("t", F.lit(" | "))).select("doc_id", (F.col("p") + 1).alias("row_no"))
    return table_regions(rows, "doc_id", "row_no", 500)


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), chr(8203), ''), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS digest FROM documents")
def clean_text(spark, sf):
    return x.table(spark, sf, "documents").select("doc_id", F.md5(text.clean_text("text")).alias("digest"))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def content_sha256(spark, sf):
    return x.table(spark, sf, "documents").select("doc_id", text.fingerprint("text").alias("fingerprint"))


@query(f"WITH {C} SELECT document_id, sha256(string_agg(sha256(content), '' ORDER BY chunk_index)) AS fingerprint FROM c GROUP BY 1")
def chunk_set_fingerprint(spark, sf):
    """Order matters."""
    return x.chunks(spark, sf).groupBy("document_id").agg(text.set_fingerprint("chunk_index", "content").alias("fingerprint"))


@query("WITH t AS (SELECT doc_id, text || repeat('中', CAST([0, 1, 5][doc_id % 3 + 1] * length(text) AS INTEGER)) AS t FROM documents), c AS (SELECT doc_id, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS en, length(regexp_replace(t, '[^中]', '', 'g')) AS zh FROM t) SELECT doc_id, CASE WHEN zh >= 3 * en THEN 'zh' WHEN en >= 4 * zh THEN 'en' ELSE 'mixed' END AS class FROM c")
def separator_class(spark, sf):
    """D3 over texts with no, as many and five times as many Chinese characters."""
    n = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(5)), (F.col("doc_id") % 3 + 1).cast("int")) * F.char_length("text")
    t = x.table(spark, sf, "documents").withColumn("t", F.concat("text", F.call_function("repeat", F.lit("中"), n.cast("int"))))
    return t.select("doc_id", text.separator_class("t").alias("class"))


@query(f"WITH {C}, k AS (SELECT * FROM c WHERE NOT (document_id % 4 = 1 AND chunk_index = 1)), o AS (SELECT document_id, chunk_index, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS n FROM k) SELECT document_id, count(*) AS n, count(*) FILTER (WHERE chunk_index <> n) = 0 AS contiguous FROM o GROUP BY 1")
def chunk_contiguity(spark, sf):
    """W9; every fourth document lacks its second chunk, which shows where there is a third."""
    return tasks.contiguous(x.chunks(spark, sf).where("not (document_id % 4 = 1 and chunk_index = 1)"), "document_id", "chunk_index")


@query(f"WITH {C}, k AS (SELECT sha256(content) AS key, min(document_id) AS d, count(*) AS n FROM c GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS texts, count(*) AS distinct_texts, count(*) FILTER (WHERE key IN (SELECT sha256(content) FROM c WHERE document_id % 4 = 0)) AS hits, count(*) FILTER (WHERE key NOT IN (SELECT sha256(content) FROM c WHERE document_id % 4 = 0)) AS misses, CAST(ceil(count(*) FILTER (WHERE key NOT IN (SELECT sha256(content) FROM c WHERE document_id % 4 = 0)) / 10) AS BIGINT) AS batches FROM k")
def embed_batches(spark, sf):
    c = x.chunks(spark, sf)
    return recall.embedding_batches(c, c.where("document_id % 4 = 0").select(F.sha2("content", 256).alias("key")), "content")


@query("SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'DIMENSION' WHEN vec_id % 17 = 0 THEN 'ZERO' END AS issue FROM embeddings")
def vector_validate(spark, sf):
    v = x.table(spark, sf, "embeddings").withColumn("v", F.when(F.col("vec_id") % 17 == 0, F.transform("embedding", lambda e: e * 0)).otherwise(F.col("embedding")))
    return v.select("vec_id", vectors.vector_issue(F.col("v"), 64).alias("issue"))


@query("SELECT item_id, CASE WHEN instr(text, 'the') > 0 THEN instr(text, 'the') - 1 END AS start, CASE WHEN instr(text, 'the') > 0 THEN instr(text, 'the') + 2 END AS \"end\", instr(text, 'the') > 0 AS holds FROM benchmark")
def quote_match(spark, sf):
    b = x.table(spark, sf, "benchmark").withColumn("q", F.lit("the")).withColumn("s", text.span_of("text", "q"))
    return b.select("item_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.coalesce(text.quote_holds("text", "q", F.col("s.start"), F.col("s.end")), F.lit(False)).alias("holds"))


@query(r"SELECT doc_id, line, len(string_split(regexp_replace(regexp_replace(trim(t), '^\|', ''), '\|$', ''), '|')) AS n_cells, trim(string_split(regexp_replace(regexp_replace(trim(t), '^\|', ''), '\|$', ''), '|')[1]) AS first_cell FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) WHERE contains(t, '|')")
def table_cells(spark, sf):
    """D23."""
    rows = x.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.contains("t", F.lit("|")))
    return rows.select("doc_id", "line", F.size(text.cells("t")).cast("long").alias("n_cells"), text.cells("t")[0].alias("first_cell"))


@query("SELECT n_nationkey, '| ' || n_name || ' | a\\|b | ' || n_regionkey || '<br>x |' AS line FROM nation")
def markdown_rows(spark, sf):
    """D8."""
    n = x.table(spark, sf, "nation")
    return n.select("n_nationkey", text.markdown_row(F.array("n_name", F.lit("a|b"), F.concat(F.col("n_regionkey").cast("string"), F.lit("\nx")))).alias("line"))


@query("SELECT item_id, regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '^[,.;:!?]+|[,.;:!?]+$', '', 'g') AS c FROM benchmark")
def compact_text(spark, sf):
    return x.table(spark, sf, "benchmark").select("item_id", text.compact("text").alias("c"))


# --- recall and fusion

QUESTION = "with the thing of"
VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_VECTOR_SQL = "[" + ", ".join(map(repr, VECTOR)) + "]::DOUBLE[]"


@query(f"WITH {R} SELECT e.vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR_SQL}), 9) AS score FROM embeddings e JOIN r ON r.document_id = e.vec_id ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk(spark, sf):
    rows = x.table(spark, sf, "embeddings").join(x.readable(spark, sf).select(F.col("document_id").alias("vec_id")), "vec_id", "left_semi")
    return recall.dense(rows, VECTOR, "embedding", "vec_id", 10)


BM25_SQL = f"""{R}, w AS (SELECT document_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda z: z <> '') AS w FROM r), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
q AS (SELECT unnest(['of', 'thing', 'the', 'with']) AS term), f AS (SELECT document_id, term, len(w) AS n_words, len(list_filter(w, lambda z: z = term)) AS f FROM w, q), df AS (SELECT term, count(*) FILTER (WHERE f > 0) AS df FROM f GROUP BY 1),
scored AS (SELECT document_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_words / mean))), 6) AS score FROM f JOIN df USING (term), st GROUP BY 1)"""


@query(f"WITH {BM25_SQL} SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, document_id LIMIT 10")
def bm25_topk(spark, sf):
    return recall.bm25(x.readable(spark, sf, "text"), QUESTION.split(), "text", "document_id", 10)


@query(f"WITH {R} SELECT document_id, CAST(contains(text, 'wi') AS INT) + CAST(contains(text, 'it') AS INT) + CAST(contains(text, 'th') AS INT) + CAST(contains(text, 'ht') AS INT) + CAST(contains(text, 'he') AS INT) + CAST(contains(text, 'et') AS INT) + CAST(contains(text, 'hi') AS INT) + CAST(contains(text, 'in') AS INT) + CAST(contains(text, 'ng') AS INT) + CAST(contains(text, 'go') AS INT) + CAST(contains(text, 'of') AS INT) AS score FROM r ORDER BY score DESC, document_id LIMIT 10")
def bigram_topk(spark, sf):
    return recall.bigram(x.readable(spark, sf, "text"), QUESTION, "text", "document_id", 10)


def _lists(spark, sf):
    """Two channels over part keys with repeated places, for each run of 64 order keys."""
    li = x.table(spark, sf, "lineitem")
    q = F.floor(F.col("l_orderkey") / 64).alias("query_id")
    a = li.select(q, F.lit("dense").alias("channel"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 60).alias("chunk_id"))
    b = li.select(q, F.lit("lexical").alias("channel"), (-F.col("l_orderkey") * 10 - F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 60).alias("chunk_id"))
    return a.unionByName(b)


L = """hits AS (SELECT l_orderkey // 64 AS query_id, 'dense' AS channel, l_orderkey * 10 + l_linenumber AS pos, l_partkey % 60 AS chunk_id FROM lineitem UNION ALL SELECT l_orderkey // 64, 'lexical', -l_orderkey * 10 - l_linenumber, l_partkey % 60 FROM lineitem),
once AS (SELECT query_id, channel, chunk_id, min(pos) AS pos FROM hits GROUP BY ALL), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, channel ORDER BY pos, chunk_id) AS INTEGER) AS rank FROM once),
fu AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM rk GROUP BY ALL), fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS fused_rank FROM fu)"""


def _fused(spark, sf):
    return fusion.rrf(fusion.ranks(_lists(spark, sf)))


@query(f"WITH {L} SELECT query_id, channel, chunk_id, rank FROM rk")
def rank_dedup(spark, sf):
    return fusion.ranks(_lists(spark, sf)).select("query_id", "channel", "chunk_id", "rank")


@query(f"WITH {L} SELECT * FROM fused")
def rrf_fuse(spark, sf):
    return _fused(spark, sf)


@query(f"WITH {L}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id % 20 ORDER BY fused_rank) AS n FROM fused) SELECT query_id, chunk_id, fused_rank FROM n WHERE n = 1 OR chunk_id % 15 = 0")
def fuse_dedup(spark, sf):
    f = _fused(spark, sf).withColumn("content", F.col("chunk_id") % 20).withColumn("required", F.col("chunk_id") % 15 == 0)
    return fusion.drop_repeated(f, ["content"]).select("query_id", "chunk_id", "fused_rank")


FACET = "fc AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id * 31 % 61, chunk_id) AS INTEGER) AS facet_rank FROM fused)"


def _facet(fused, factor=31):
    return fused.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("chunk_id") * factor % 61, "chunk_id")).alias("facet_rank"))


@query(f"WITH {L}, {FACET}, s AS (SELECT query_id, chunk_id, fused_rank, round(1.0::DOUBLE / (60 + fused_rank) + 1.0::DOUBLE / (60 + facet_rank), 12) AS consensus FROM fused JOIN fc USING (query_id, chunk_id)) SELECT query_id, chunk_id, consensus, CAST(row_number() OVER (PARTITION BY query_id ORDER BY consensus DESC, fused_rank, chunk_id) AS INTEGER) AS consensus_rank FROM s")
def facet_consensus(spark, sf):
    f = _fused(spark, sf)
    return fusion.consensus(f, _facet(f)).select("query_id", "chunk_id", "consensus", "consensus_rank")


@query(f"""WITH {L}, f1 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id * 31 % 61, chunk_id) AS fr FROM fused), f2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id * 17 % 61, chunk_id) AS fr FROM fused),
u AS (SELECT query_id, chunk_id, CASE WHEN fused_rank = 1 THEN 0 ELSE 3 END * 1000000 + fused_rank * 1000 AS o FROM fused UNION ALL SELECT query_id, chunk_id, 1001000 FROM f1 WHERE fr = 1 UNION ALL SELECT query_id, chunk_id, 1002000 FROM f2 WHERE fr = 1 UNION ALL SELECT query_id, chunk_id, 2000000 + fr * 1000 + 1 FROM f1 UNION ALL SELECT query_id, chunk_id, 2000000 + fr * 1000 + 2 FROM f2),
m AS (SELECT query_id, chunk_id, min(o) AS o FROM u GROUP BY ALL), p AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o, chunk_id) AS INTEGER) AS place FROM m) SELECT * FROM p WHERE place <= 8""")
def facet_cover(spark, sf):
    f = _fused(spark, sf)
    facets = _facet(f, 31).withColumn("facet_no", F.lit(1)).unionByName(_facet(f, 17).withColumn("facet_no", F.lit(2)))
    return fusion.cover(f.withColumnRenamed("fused_rank", "rank"), facets, 8)


@query(f"WITH {L}, s AS (SELECT query_id, chunk_id, fused_rank, chunk_id * 13 % 29 AS sc, query_id % 7 <> 3 OR fused_rank > 2 AS has FROM fused), w AS (SELECT *, bool_and(has) OVER (PARTITION BY query_id) AS whole FROM s), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN whole THEN sc END DESC NULLS LAST, fused_rank) AS INTEGER) AS final_rank FROM w) SELECT query_id, chunk_id, final_rank, CASE WHEN whole THEN 'ok' ELSE 'degraded' END AS status, 'E' || final_rank AS evidence_id FROM k")
def rerank_merge(spark, sf):
    f = _fused(spark, sf)
    scores = f.where("query_id % 7 <> 3 or fused_rank > 2").select("query_id", "chunk_id", (F.col("chunk_id") * 13 % 29).alias("rerank_score"))
    return fusion.merge_rerank(f.select("query_id", "chunk_id", "fused_rank"), scores)


@query(f"WITH {C} SELECT chunk_id FROM c WHERE chunk_id % 5 = 0 AND NOT (document_id % 11 = 0)")
def revalidate_drop(spark, sf):
    c = x.chunks(spark, sf).withColumn("hash", F.sha2("content", 256)).select("chunk_id", "document_id", "hash")
    current = c.withColumn("hash", F.when(F.col("document_id") % 11 == 0, "changed").otherwise(F.col("hash")))
    return fusion.revalidate(c.where("chunk_id % 5 = 0"), current, ["chunk_id", "document_id", "hash"]).select("chunk_id")


# --- graph

SEEDS = "seed AS (SELECT p_partkey AS uid FROM part WHERE p_name = 'red widget')"


def _hops(spark, sf):
    seeds = x.table(spark, sf, "part").where("p_name = 'red widget'").select(F.col("p_partkey").alias("uid"))
    parts, suppliers = x.table(spark, sf, "part").select(F.col("p_partkey").alias("uid")), x.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("uid"))
    evidence = x.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("place"))
    a = x.assertions(spark, sf).join(suppliers.withColumnRenamed("uid", "object"), "object", "left_semi")
    return graph.one_hop(a, parts, evidence, seeds.withColumn("uid", F.col("uid")))


HOP = f"{A}, {SEEDS}, hop AS (SELECT a.*, o_custkey AS place FROM a JOIN orders ON o_orderkey = evidence_id WHERE o_orderstatus = 'F' AND (subject IN (FROM seed) OR object IN (FROM seed)) AND object IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND object IN (SELECT p_partkey FROM part) AND subject IN (SELECT p_partkey FROM part))"


@query(f"WITH {HOP}, s AS (SELECT place, count(DISTINCT assertion_id) AS score FROM hop GROUP BY 1) SELECT * FROM s ORDER BY score DESC, place LIMIT 20")
def graph_one_hop(spark, sf):
    return recall.top_k(graph.graph_scores(_hops(spark, sf), "place"), "score", "place", 20)


@query(f"WITH {HOP}, s2 AS (SELECT s_suppkey AS middle, s_nationkey AS o FROM supplier) SELECT subject, middle, s2.o AS object, count(*) AS paths FROM (SELECT subject, object AS middle FROM hop) JOIN s2 USING (middle) GROUP BY ALL")
def graph_two_hop(spark, sf):
    second = x.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject"), F.col("s_nationkey").alias("object"), F.col("s_suppkey").alias("assertion_id"))
    return graph.two_hop(_hops(spark, sf), second).groupBy("subject", "middle", "object").agg(F.count(F.lit(1)).alias("paths"))


TYPES = ("Actor", "Process", "Step", "Material", "Resource", "Rule", "State", "Field")
_PAIRS = ", ".join(f"('{p}', '{s}', '{o}')" for p, (ss, os) in graph.ENDPOINTS.items() for s in ss.split() for o in os.split())
_PREDICATES = "[" + ", ".join(f"'{p}'" for p in graph.ENDPOINTS) + "]"
_TYPES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"


@query(f"WITH r AS (SELECT o_orderkey AS id, {_PREDICATES}[o_orderkey % 15 + 1] AS predicate, {_TYPES}[o_custkey % 8 + 1] AS subject_type, {_TYPES}[(o_orderkey // 15) % 8 + 1] AS object_type FROM orders) SELECT id, predicate FROM r WHERE (predicate, subject_type, object_type) IN (VALUES {_PAIRS})")
def endpoint_whitelist(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(v) for v in names]), (n + 1).cast("int"))
    k = F.col("o_orderkey")
    r = x.table(spark, sf, "orders").select(k.alias("id"), pick(list(graph.ENDPOINTS), k % 15).alias("predicate"), pick(TYPES, F.col("o_custkey") % 8).alias("subject_type"), pick(TYPES, F.floor(k / 15) % 8).alias("object_type"))
    return graph.allowed(r, graph.endpoints(spark)).select("id", "predicate")


@query("WITH e AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Material' WHEN 1 THEN 'Step' ELSE 'Rule' END AS kind FROM part) SELECT p_partkey, sha256(CASE WHEN kind = 'Material' THEN '[\"' || p_size || '\",\"Material\",\"' || p_name || '\"]' ELSE '[\"' || p_size || '\",\"' || p_partkey || '\",\"' || p_brand || '\",\"' || kind || '\",\"' || p_name || '\"]' END) AS key FROM part JOIN e USING (p_partkey)")
def entity_keys(spark, sf):
    """G2, G4."""
    kind = F.when(F.col("p_partkey") % 3 == 0, "Material").when(F.col("p_partkey") % 3 == 1, "Step").otherwise("Rule")
    return x.table(spark, sf, "part").select("p_partkey", graph.entity_key(kind, F.col("p_size"), F.col("p_partkey"), F.col("p_brand"), F.col("p_name")).alias("key"))


@query(f"WITH {A} SELECT code, count(*) AS issues FROM (SELECT 'DANGLING_SUBJECT' AS code FROM a WHERE subject NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0) UNION ALL SELECT 'MISSING_EVIDENCE' FROM a WHERE evidence_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') UNION ALL SELECT 'ORPHAN_OBJECT' FROM supplier WHERE s_suppkey NOT IN (SELECT object FROM a WHERE assertion_id % 7 = 0) UNION ALL SELECT 'REPEATED_KEY' FROM (SELECT assertion_id FROM a GROUP BY 1 HAVING count(*) > 1)) GROUP BY 1")
def graph_audit_codes(spark, sf):
    a = x.assertions(spark, sf)
    parts = x.table(spark, sf, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("subject"))
    known = x.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("evidence_id"))
    objects = x.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("uid"))
    return graph.audit({"DANGLING_SUBJECT": a.join(parts, "subject", "left_anti"), "MISSING_EVIDENCE": a.join(known, "evidence_id", "left_anti"), "ORPHAN_OBJECT": graph.orphans(objects, a.where("assertion_id % 7 = 0").select(F.col("object").alias("uid"))), "REPEATED_KEY": graph.repeated_keys(a, "assertion_id")})


@query("SELECT DISTINCT o_custkey AS generation_id FROM orders WHERE o_custkey % 6 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY 1 LIMIT 50")
def backfill_missing(spark, sf):
    o = x.table(spark, sf, "orders").select(F.col("o_custkey").alias("generation_id"), "o_orderstatus")
    g = o.select("generation_id").distinct()
    return graph.missing_projections(g, g.where("generation_id % 6 = 0"), o.where("o_orderstatus = 'P'").select("generation_id").distinct(), 50)


@query("SELECT w.doc_id AS document_id, sha256(w.text) AS content_hash, max(w.doc_id * 100 + k.v) AS cache_id FROM documents w, (SELECT unnest([1, 2, 3]) AS v) k WHERE w.doc_id % 4 = 0 AND w.doc_id % 8 <> 4 AND NOT (k.v = 3 AND w.doc_id % 16 = 0) GROUP BY ALL")
def cache_reuse_latest(spark, sf):
    d = x.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content"))
    cache = d.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("document_id", "content_hash", "content", F.when((F.col("v") == 3) & (F.col("document_id") % 16 == 0), "m2").otherwise("m1").alias("model"), (F.col("document_id") * 100 + F.col("v")).alias("cache_id")).where("document_id % 8 <> 4")
    return graph.reusable(d.where("document_id % 4 = 0").withColumn("model", F.lit("m1")), cache)


@query("SELECT p_name AS name, min(p_partkey) AS first_uid, count(DISTINCT p_partkey) AS members, count(DISTINCT p_partkey) * (count(DISTINCT p_partkey) - 1) // 2 AS pairs FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def merge_candidates(spark, sf):
    return graph.merge_candidates(x.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("uid")), "name").select("name", "first_uid", "members", "pairs")


@query(f"WITH {K} SELECT task_id FROM t WHERE generation_id NOT IN (SELECT DISTINCT o_custkey % 97 FROM orders WHERE o_custkey % 97 % 10 = 0)")
def fence_reject(spark, sf):
    retired = x.table(spark, sf, "orders").where("o_custkey % 97 % 10 = 0").select((F.col("o_custkey") % 97).alias("generation_id")).distinct()
    return graph.rejected_by_fence(x.tasks(spark, sf), retired, "generation_id").select("task_id")


@query(f"WITH {A} SELECT p_partkey AS uid FROM part WHERE p_partkey NOT IN (SELECT subject FROM a WHERE evidence_id % 40 = 0)")
def purge_orphans(spark, sf):
    kept = x.assertions(spark, sf).where("evidence_id % 40 = 0")
    return graph.orphans(x.table(spark, sf, "part").select(F.col("p_partkey").alias("uid")), kept.select(F.col("subject").alias("uid")))


@query("WITH h AS (SELECT p_brand, p_partkey, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h) AS n FROM h) SELECT p_brand, p_partkey FROM n ORDER BY n > 1, h LIMIT 40")
def stable_sample(spark, sf):
    return graph.stable_sample(x.table(spark, sf, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 40)


@query("WITH p AS (SELECT s_suppkey AS projection_id, s_suppkey // 2 AS document_id, CASE WHEN s_suppkey % 2 = 0 THEN 'READY' ELSE 'CANDIDATE' END AS status, s_suppkey // 2 % 5 AS fingerprint, CASE WHEN s_suppkey // 2 % 3 = 0 THEN -1 ELSE s_suppkey // 2 % 5 END AS base_fingerprint FROM supplier), b AS (SELECT document_id, fingerprint AS cur FROM p WHERE status = 'READY'), j AS (SELECT p.*, coalesce(status = 'CANDIDATE' AND cur IS NOT DISTINCT FROM base_fingerprint, false) AS ok FROM p LEFT JOIN b USING (document_id)), w AS (SELECT *, bool_or(ok) OVER (PARTITION BY document_id) AS sw FROM j) SELECT projection_id, status, CASE WHEN ok THEN 'READY' WHEN sw AND status = 'READY' THEN 'STALE' ELSE status END AS new_status FROM w")
def projection_switch(spark, sf):
    k = F.col("s_suppkey")
    d = F.floor(k / 2)
    p = x.table(spark, sf, "supplier").select(k.alias("projection_id"), d.alias("document_id"), F.when(k % 2 == 0, "READY").otherwise("CANDIDATE").alias("status"), (d % 5).alias("fingerprint"), F.when(d % 3 == 0, F.lit(-1).cast("long")).otherwise(d % 5).alias("base_fingerprint"))
    return graph.switched(p).select("projection_id", "status", "new_status")


@query("SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT ps FROM (SELECT p_partkey * 3 AS ps FROM part WHERE p_partkey < 900))) AS kept, (SELECT count(*) FROM part WHERE p_partkey < 900 AND p_partkey * 3 NOT IN (SELECT p_partkey FROM part)) AS unknown")
def fact_exclusion(spark, sf):
    f = x.table(spark, sf, "part").select("p_partkey")
    return graph.exclusion_problems(f, f.where("p_partkey < 900").select((F.col("p_partkey") * 3).alias("p_partkey")), "p_partkey")


@query("SELECT p_size, count(*) AS samples, bool_and(p_partkey % 70 <> 0 AND p_partkey % 41 <> 0 AND p_partkey % 43 <> 0) AS approved FROM part GROUP BY 1")
def review_approval(spark, sf):
    """G32 for each size: some samples are rejected, some have no reason, some were reviewed with another name."""
    s = x.table(spark, sf, "part").select("p_size", "p_partkey", "p_name", "p_brand")
    k = F.col("p_partkey")
    review = s.select("p_partkey", F.when(k % 43 == 0, "other").otherwise(F.col("p_name")).alias("p_name"), "p_brand", F.when(k % 70 == 0, "REJECT").otherwise("SUPPORT").alias("verdict"), F.when(k % 41 == 0, " ").otherwise("read").alias("reason"))
    return graph.approved(review, s, ["p_partkey"], ["p_name", "p_brand"], ["p_size"])


@query(f"WITH {C}, q AS (SELECT chunk_id AS target_id, document_id, substr(content, 5) AS quote FROM c WHERE length(content) > 4), j AS (SELECT target_id, chunk_id, instr(content, quote) - 1 AS s, length(quote) AS z, count(*) OVER (PARTITION BY target_id) AS n FROM q JOIN c USING (document_id) WHERE contains(content, quote)) SELECT target_id, chunk_id, CAST(s AS INTEGER) AS start, CAST(s + z AS INTEGER) AS \"end\" FROM j WHERE n = 1")
def gold_relocate(spark, sf):
    c = x.chunks(spark, sf)
    t = c.where(F.char_length("content") > 4).select(F.col("chunk_id").alias("target_id"), "document_id", F.expr("substring(content, 5)").alias("quote"))
    return graph.relocated(t, c)


# --- evaluation


@query("WITH h AS (SELECT item_id, exists(SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS hit, exists(SELECT 1 FROM documents d WHERE contains(d.text, substr(b.text, 1, length(b.text) // 2))) AS half FROM benchmark b) SELECT item_id // 4 AS question_id, bool_and(hit) AND bool_and(half) AS passed, 2 * count(*) AS quotes FROM h GROUP BY 1")
def gold_containment_hits(spark, sf):
    """Each question has four items, whose whole texts and first halves must stand in some document."""
    b = x.table(spark, sf, "benchmark")
    half = F.expr("substring(text, 1, cast(char_length(text) div 2 as int))")
    quotes = b.select((F.col("item_id") * 2).alias("quote_id"), F.floor(F.col("item_id") / 4).alias("question_id"), F.col("text").alias("quote")).unionByName(b.select((F.col("item_id") * 2 + 1).alias("quote_id"), F.floor(F.col("item_id") / 4).alias("question_id"), half.alias("quote")))
    found = metrics.containing(quotes, x.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")).select("quote_id").distinct().withColumn("h", F.lit(True))
    return metrics.covered(quotes.join(found, "quote_id", "left").select("question_id", F.coalesce("h", F.lit(False)).alias("hit")))


def _gold(spark, sf):
    li = x.table(spark, sf, "lineitem")
    return li.select("l_returnflag", (F.col("l_partkey") % 40).alias("k")), li.select("l_returnflag", (F.col("l_suppkey") % 44).alias("k"))


@query("WITH g AS (SELECT l_returnflag, l_partkey % 40 AS k, count(*) AS g FROM lineitem GROUP BY ALL), p AS (SELECT l_returnflag, l_suppkey % 44 AS k, count(*) AS p FROM lineitem GROUP BY ALL), t AS (SELECT l_returnflag, CAST(sum(coalesce(g, 0)) AS BIGINT) AS gold, CAST(sum(coalesce(p, 0)) AS BIGINT) AS predicted, CAST(sum(least(coalesce(g, 0), coalesce(p, 0))) AS BIGINT) AS matched FROM g FULL JOIN p USING (l_returnflag, k) GROUP BY 1) SELECT *, round(matched / predicted, 4) AS precision, round(matched / gold, 4) AS recall, round(2 * matched / (gold + predicted), 4) AS f1 FROM t")
def multiset_prf(spark, sf):
    g, p = _gold(spark, sf)
    return metrics.multiset_scores(g, p, ["k"], ["l_returnflag"])


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN n_chars > 1000 AND quality = 1 THEN 'hit' WHEN n_chars > 1000 THEN 'false_positive' WHEN quality = 1 THEN 'missed' ELSE 'correct_reject' END AS outcome, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def loss_partition(spark, sf):
    d = x.table(spark, sf, "documents").select("doc_id", "n_chars").join(x.table(spark, sf, "labels"), "doc_id", "left")
    long, good = F.col("n_chars") > 1000, F.col("quality") == 1
    return metrics.outcomes(d, [(F.col("quality").isNull(), "unlabelled"), (long & good, "hit"), (long, "false_positive"), (good, "missed")], "correct_reject")


@query("WITH s AS (SELECT l_orderkey AS k, l_linenumber AS id, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity AS INTEGER) + 5 AS z, l_partkey FROM lineitem) SELECT x.k, x.id AS span_id, y.id AS other_id, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.a < y.z AND x.z > y.a WHERE x.l_partkey % 2 = 0 AND y.l_partkey % 2 = 1 GROUP BY ALL")
def span_overlap(spark, sf):
    s = x.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("span_id"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity").cast("int") + 5).alias("end"), "l_partkey")
    return metrics.overlaps(s.where("l_partkey % 2 = 0"), s.where("l_partkey % 2 = 1"), ["k"]).groupBy("k", "span_id", "other_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round(median(value), 4) AS median, count(*) AS n FROM events GROUP BY 1")
def median_latency(spark, sf):
    return metrics.medians(x.table(spark, sf, "events"), "value", ["event_type"])


@query("WITH c AS (SELECT doc_id % 997 AS answer_id, CASE WHEN doc_id % 61 = 0 THEN -1 - doc_id ELSE doc_id END AS evidence_id, CASE WHEN doc_id % 53 = 0 THEN text || 'x' WHEN doc_id % 59 = 0 THEN '' ELSE substr(text, 3) END AS quote FROM documents) SELECT c.answer_id, bool_and(coalesce(contains(d.text, c.quote) AND c.quote <> '', false)) AS valid, count(*) AS citations FROM c LEFT JOIN documents d ON d.doc_id = c.evidence_id GROUP BY 1")
def citation_verify(spark, sf):
    """A citation of each document, some to evidence that is not there, some empty, some not word for word."""
    i = F.col("doc_id")
    d = x.table(spark, sf, "documents").select(i.alias("evidence_id"), F.col("text").alias("content"))
    quote = F.when(i % 53 == 0, F.concat("text", F.lit("x"))).when(i % 59 == 0, "").otherwise(F.expr("substring(text, 3)"))
    c = x.table(spark, sf, "documents").select((i % 997).alias("answer_id"), F.when(i % 61 == 0, -1 - i).otherwise(i).alias("evidence_id"), quote.alias("quote"))
    return metrics.citation_issues(c, d)


@query("SELECT CASE WHEN quality IS NULL THEN 'pending' WHEN toxic = 1 THEN 'reject' ELSE 'support' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def verdict_rollup(spark, sf):
    """G35."""
    d = x.table(spark, sf, "documents").select("doc_id").join(x.table(spark, sf, "labels"), "doc_id", "left")
    return metrics.outcomes(d, [(F.col("quality").isNull(), "pending"), (F.col("toxic") == 1, "reject")], "support").withColumnRenamed("outcome", "verdict")


@query("WITH t AS (SELECT l_orderkey AS row_id, l_returnflag AS value FROM lineitem), e AS (SELECT l_orderkey AS row_id, l_linenumber AS entity_id, CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE l_linestatus END AS name, CASE WHEN l_linenumber % 3 = 0 THEN 'Actor' ELSE 'Material' END AS type FROM lineitem), f AS (SELECT DISTINCT e.row_id, e.entity_id FROM e JOIN t ON t.row_id = e.row_id AND lower(t.value) = lower(e.name) WHERE type <> 'Actor') SELECT row_id, count(*) AS flagged FROM f GROUP BY 1")
def policy_flags(spark, sf):
    """Entities that are named as a cell of the column of actors and have another type."""
    li = x.table(spark, sf, "lineitem")
    cells = li.select(F.col("l_orderkey").alias("row_id"), F.lit("mode").alias("column"), F.col("l_returnflag").alias("value"))
    entities = li.select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("entity_id"), F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_linestatus")).alias("name"), F.when(F.col("l_linenumber") % 3 == 0, "Actor").otherwise("Material").alias("type"))
    return graph.wrong_types(entities, cells, "mode", "Actor").groupBy("row_id").agg(F.count(F.lit(1)).alias("flagged"))


# --- tasks, chat


@query(f"WITH {K} SELECT task_id, status FROM t WHERE attempts < max_attempts AND ((status IN ('PENDING', 'RETRY_WAIT') AND next_run_at <= TIMESTAMP '{NOW}') OR (status = 'RUNNING' AND lease_until < TIMESTAMP '{NOW}')) ORDER BY next_run_at, task_id LIMIT 10")
def queue_claim(spark, sf):
    return tasks.due(x.tasks(spark, sf), x.now(), 10).select("task_id", "status")


@query(f"WITH {K}, n AS (SELECT task_id, attempts, CASE WHEN status = 'RUNNING' AND lease_until < TIMESTAMP '{NOW}' THEN CASE WHEN attempts >= max_attempts THEN 'FAILED' ELSE 'RETRY_WAIT' END ELSE status END AS new_status FROM t) SELECT task_id, new_status, CASE WHEN new_status = 'RETRY_WAIT' THEN least(300, CAST(15 * pow(2, attempts - 1) AS BIGINT)) END AS delay FROM n")
def lease_expire(spark, sf):
    return tasks.expired(x.tasks(spark, sf), x.now()).select("task_id", "new_status", "delay")


@query("SELECT o_orderkey, CAST(least(300, 15 * pow(2, o_orderkey % 12)) AS BIGINT) AS task_delay, CAST(least(3600, 15 * pow(2, least(o_orderkey % 12, 8))) AS BIGINT) AS outbox_delay FROM orders")
def backoff_schedule(spark, sf):
    n = F.col("o_orderkey") % 12 + 1
    return x.table(spark, sf, "orders").select("o_orderkey", periods.backoff(n).alias("task_delay"), periods.backoff(n, 15, 3600, 8).alias("outbox_delay"))


@query("WITH f AS (SELECT user_id, event_id, event_type, first_value(event_type) OVER w AS d, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, min(event_id) FILTER (WHERE n = 1) AS first_id, count(*) FILTER (WHERE n > 1 AND event_type = d) AS replays, count(*) FILTER (WHERE event_type <> d) AS conflicts FROM f GROUP BY 1")
def idempotent_first(spark, sf):
    return tasks.first_by_key(x.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6 AS t FROM events),
s AS (SELECT key, min(t) AS start FROM e GROUP BY key UNION ALL SELECT e.key, min(e.t) FROM s JOIN e ON e.key = s.key AND e.t >= s.start + 7200 GROUP BY e.key, s.start),
w AS (SELECT e.key, e.event_id, e.t, max(s.start) AS start FROM e JOIN s ON s.key = e.key AND s.start <= e.t GROUP BY ALL)
SELECT key, event_id, row_number() OVER (PARTITION BY key, start ORDER BY t, event_id) <= 3 AS allowed FROM w""")
def rate_limit_first_event(spark, sf):
    e = x.table(spark, sf, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    return tasks.rate_limited(e.select("key", "event_id", (F.col("us") / 1e6).alias("at")), 3, 7200)


@query(f"WITH {K} SELECT task_id, 'PENDING' AS status, least(100, attempts + 3) AS max_attempts FROM t WHERE status = 'FAILED' AND generation_id % 2 = 0")
def requeue_failed(spark, sf):
    t = x.tasks(spark, sf)
    return tasks.requeued(t, t.where("generation_id % 2 = 0").select("generation_id").distinct(), 3).select("task_id", "status", "max_attempts")


@query("WITH g AS (SELECT l_orderkey, l_linenumber - 1 AS n, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS want FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) SELECT l_orderkey, n FROM g WHERE n <> want")
def checkpoint_progress(spark, sf):
    s = x.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("n")).distinct()
    return tasks.checkpoint_gaps(s, "l_orderkey", "n")


@query(f"WITH {K}, v AS (SELECT task_id, status, max(task_id) OVER (PARTITION BY document_id) AS m FROM t) SELECT task_id, CASE WHEN task_id < m THEN 'SUPERSEDED' ELSE status END AS new_status FROM v")
def supersede_cascade(spark, sf):
    return tasks.superseded(x.tasks(spark, sf).withColumn("revision_no", F.col("task_id"))).select("task_id", "new_status")


@query("WITH p AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id < 60 ORDER BY 1 DESC LIMIT 11) SELECT conv_id, (SELECT count(*) FROM p) > 10 AS has_more FROM p ORDER BY conv_id DESC LIMIT 10")
def chat_keyset_page(spark, sf):
    return catalog.keyset_page(x.table(spark, sf, "conversations").select("conv_id").distinct(), "conv_id", 60, 10)


@query(f"WITH {H}, b AS (SELECT *, sum(CASE WHEN readable THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY sequence_no DESC) AS bad, row_number() OVER (PARTITION BY session_id ORDER BY sequence_no DESC) AS n FROM m) SELECT session_id, sequence_no, role FROM b WHERE bad = 0 AND n <= 6")
def chat_history_tail(spark, sf):
    return tasks.history_tail(x.messages(spark, sf)).select("session_id", "sequence_no", "role")


@query(f"WITH {R}, u AS (SELECT doc_id AS document_id, 1 AS v FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 5 = 0), l AS (SELECT document_id, max(v) AS v FROM u GROUP BY 1) SELECT l.document_id, v AS version, r.document_id IS NOT NULL AS authorised FROM l LEFT JOIN r USING (document_id)")
def source_union_authorised(spark, sf):
    """U8: current and past sources by key, the newer one counts, each marked whether it may still be read."""
    d = x.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"))
    both = d.where("document_id % 3 = 0").withColumn("v", F.lit(1)).unionByName(d.where("document_id % 5 = 0").withColumn("v", F.lit(2)))
    return fusion.sources(both, x.readable(spark, sf), ["document_id"], "v").withColumnRenamed("v", "version")


@query("SELECT conv_id AS session_id, count(*) FILTER (WHERE role = 'user') <= 1 AS single FROM conversations GROUP BY 1")
def one_active_run(spark, sf):
    """Q17."""
    return tasks.at_most_one(x.table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id"), "session_id", F.col("role") == "user", "single")


@query("SELECT s_suppkey, 'n' AS \"column\", CAST(s_nationkey AS VARCHAR) AS before, CAST(s_nationkey + 1 AS VARCHAR) AS after FROM supplier WHERE s_suppkey % 4 = 0")
def update_audit(spark, sf):
    """M2."""
    s = x.table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n"))
    return tasks.changes(s, s.withColumn("n", F.when(F.col("s_suppkey") % 4 == 0, F.col("n") + 1).otherwise(F.col("n"))), "s_suppkey", ["s_name", "n"])


# --- planner


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN replace(text, 'this', 'the latter') WHEN 2 THEN text || ' 所有的文件' WHEN 3 THEN text || ' 上述' ELSE text END AS text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\b(it|they|them|this|that|those|these|former|latter)\\b', 'i') OR contains(text, '上述') THEN 'context' WHEN regexp_matches(text, '\\b(count|total|all documents|all files)\\b', 'i') OR contains(text, '所有的文件') THEN 'exhaustive' ELSE 'basic' END AS hint FROM t""")
def route_table(spark, sf):
    from .router import fallback_hint

    t = F.col("turn") % 4
    text_ = F.when(t == 1, F.replace("text", F.lit("this"), F.lit("the latter"))).when(t == 2, F.concat("text", F.lit(" 所有的文件"))).when(t == 3, F.concat("text", F.lit(" 上述"))).otherwise(F.col("text"))
    return x.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", fallback_hint(text_).alias("hint"))


# --- streams' batch twins, and operators that SQL cannot express


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    from ..streaming.events import tumbling

    return tumbling(x.table(spark, sf, "events"))


@query("WITH b AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 90 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM b) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 90 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, k")
def events_sessions(spark, sf):
    from ..streaming.events import sessions

    return sessions(x.table(spark, sf, "events"))


@query(r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '\s+', '', 'g')) AS joined, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS signs, true AS within, true AS numbered, len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]|[\pL\pN]+|[^\s\pL\pN]')) > 512 AS several FROM documents")
def chunk_tokens(spark, sf):
    """Pieces without their overlaps join to the text, each fits the budget, numbers have no gaps, and a document has
    several where its tokens ask for it."""
    from ..operators.chunking import chunk

    docs = x.table(spark, sf, "documents")
    c = chunk(docs, "doc_id", "text")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "own"))), lambda r: r["own"]), "")
    joined = F.regexp_replace(parts, r"\s+", "")
    told = c.groupBy("doc_id").agg(F.md5(joined).alias("joined"), F.char_length(joined).cast("long").alias("signs"), (F.max("token_count") <= 512).alias("within"), (F.max("chunk_index") == F.count(F.lit(1)) - 1).alias("numbered"), (F.count(F.lit(1)) > 1).alias("several"))
    empty = [F.coalesce("joined", F.md5(F.lit(""))).alias("joined"), F.coalesce("signs", F.lit(0)).alias("signs"), *[F.coalesce(k, F.lit(k != "several")).alias(k) for k in ("within", "numbered", "several")]]
    return docs.select("doc_id").join(told, "doc_id", "left").select("doc_id", *empty)


_NUMBERS = r"regexp_extract_all({}, '\d+(?:[.,]\d+)*%?')"
_NEGATED = r"regexp_matches({}, '不得|不能|不可|禁止|未|无需|不|\b(not|never|no|cannot|must not)\b', 'i')"
_BOUND = r"regexp_matches({}, '如果|若|除非|仅当|当|\b(if|unless|only|when)\b', 'i')"


@query(rf"""WITH t AS (SELECT conv_id * 1000 + turn AS id, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations), p AS (SELECT id, coalesce(text, '') AS s, coalesce(e, '') AS e FROM t WHERE role = 'assistant')
SELECT id, 'NUMBER_NOT_IN_EVIDENCE' AS issue FROM p WHERE len(list_filter({_NUMBERS.format("s")}, lambda n: NOT list_contains({_NUMBERS.format("e")}, n))) > 0
UNION ALL SELECT id, 'NEGATION_DIFFERS' FROM p WHERE {_NEGATED.format("s")} <> {_NEGATED.format("e")} UNION ALL SELECT id, 'CONDITION_DROPPED' FROM p WHERE {_BOUND.format("e")} AND NOT {_BOUND.format("s")}""")
def answer_guards(spark, sf):
    """What an assistant says against the turn before it."""
    from ..operators.guards import guards

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn")))
    c = x.table(spark, sf, "conversations").withColumn("evidence", before).where("role = 'assistant'")
    return guards(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("statement"), "evidence"))


@query(r"SELECT p_partkey, trim(trim(trim(regexp_replace(lower(' ' || upper(p_name) || ' .'), '\s+', ' ', 'g')), ',.')) AS name FROM part")
def canonical_names(spark, sf):
    """G1."""
    return x.table(spark, sf, "part").select("p_partkey", text.canonical_name(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ."))).alias("name"))


@query()
def nearest_names(spark, sf):
    """Parts by likeness to a name."""
    names = x.table(spark, sf, "part").select("p_name").distinct()
    return names.withColumn("ratio", F.round(text.similarity_ratio(F.col("p_name"), F.lit("red widgets")), 6)).where("ratio >= 0.72").orderBy(F.col("ratio").desc(), "p_name").limit(3)


# --- more of the inventory


@query(f"WITH {A}, u AS (SELECT evidence_id % 50 AS place, subject, object FROM a), e AS (SELECT DISTINCT place, subject AS v FROM u UNION SELECT DISTINCT place, object FROM u), s AS (SELECT place, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY v)) AS ends FROM e GROUP BY 1) SELECT place, count(*) AS assertions, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects, ends FROM u JOIN s USING (place) GROUP BY place, ends")
def graph_snapshot(spark, sf):
    return graph.snapshot(x.assertions(spark, sf).withColumn("place", F.col("evidence_id") % 50), "place")


@query("WITH f AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_orderkey AS extraction_id, l_linenumber FROM f WHERE n = 1 AND l_quantity > 5")
def salvage_subset(spark, sf):
    li = x.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("extraction_id"), "l_linenumber", (F.col("l_quantity") > 5).alias("valid"))
    return graph.salvaged(li, "l_linenumber").select("extraction_id", "l_linenumber")


@query("SELECT 'small' AS name, s_suppkey FROM supplier WHERE s_suppkey < 8 UNION ALL SELECT 'large', s_suppkey FROM supplier WHERE false")
def budget_guard(spark, sf):
    s = x.table(spark, sf, "supplier").select("s_suppkey")
    parts = {n: graph.within_budget(d, [F.col("s_suppkey")], 8).select(F.lit(n).alias("name"), "s_suppkey") for n, d in (("small", s.where("s_suppkey < 8")), ("large", s))}
    return parts["small"].unionByName(parts["large"])


@query("SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7'")
def department_lookup(spark, sf):
    n = x.table(spark, sf, "nation").withColumn("code", F.concat(F.lit("N"), F.col("n_nationkey")))
    return catalog.unique_match(n, "NATION_7", ["n_name", "code"], "n_nationkey")


@query("WITH s AS (SELECT item_id, string_split(text, '. ') AS p FROM benchmark), n AS (SELECT item_id, p, unnest(range(1, len(p) + 1)) AS n FROM s) SELECT item_id, CAST(n AS INTEGER) AS n, array_to_string(p[1:n], ' ') AS shown FROM n")
def answer_prefixes(spark, sf):
    return catalog.prefixes(x.table(spark, sf, "benchmark").select("item_id", F.split("text", r"\. ").alias("p")), "item_id", "p")


@query(f"WITH {C} SELECT 'HASH' AS code, count(*) AS n FROM c WHERE chunk_id % 90 = 0 UNION ALL SELECT 'INDEX', count(*) FROM (SELECT document_id FROM c WHERE chunk_index <> 1 GROUP BY 1 HAVING max(chunk_index) > 1) HAVING count(*) > 0")
def freeze_validate(spark, sf):
    c = x.chunks(spark, sf).withColumn("digest", F.when(F.col("chunk_id") % 90 == 0, "stale").otherwise(F.sha2("content", 256)))
    issues = catalog.frozen_issues(c, "document_id", "chunk_index", "content", "digest")
    gaps = catalog.frozen_issues(c.where("chunk_index <> 1").withColumn("digest", F.sha2("content", 256)), "document_id", "chunk_index", "content", "digest")
    return issues.unionByName(gaps)


@query(f"WITH {G}, e AS (SELECT kb_id, department_id, tenant_id, max(permission) AS permission FROM g GROUP BY ALL), n AS (SELECT *, CASE WHEN kb_id % 5 = 0 THEN NULL WHEN kb_id % 5 = 1 THEN 'ADMIN' ELSE permission END AS now, CASE WHEN kb_id % 5 < 2 THEN 2 ELSE 0 END AS acl_version FROM e) SELECT kb_id, department_id, tenant_id, now AS permission, acl_version FROM n WHERE now IS NOT NULL")
def grant_upsert(spark, sf):
    g = x.grants(spark, sf).groupBy("kb_id", "department_id", "tenant_id").agg(F.max("permission").alias("permission"))
    changed = g.where("kb_id % 5 < 2").withColumn("permission", F.when(F.col("kb_id") % 5 == 1, "ADMIN")).withColumn("version", F.lit(2).cast("long"))
    earlier = changed.withColumn("permission", F.lit("READ")).withColumn("version", F.lit(1).cast("long"))
    return scope.upserted(g, changed.unionByName(earlier), ["kb_id", "department_id", "tenant_id"])


@query(f"WITH {C} SELECT DISTINCT document_id FROM c WHERE chunk_id % 77 = 0")
def affected_tables(spark, sf):
    c = x.chunks(spark, sf).select("document_id", "chunk_id", F.md5("content").alias("h"))
    new = c.withColumn("h", F.when(F.col("chunk_id") % 77 == 0, "new").otherwise(F.col("h")))
    return scope.affected(c, new, "document_id", ["h"])


@query("SELECT n_nationkey AS row_id, 'name' AS \"column\", n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation")
def table_alignment(spark, sf):
    n = x.table(spark, sf, "nation").select(F.col("n_nationkey").alias("row_id"), F.array(F.lit("name"), F.lit("region")).alias("h"), F.array(F.col("n_name"), F.col("n_regionkey").cast("string"), F.lit("extra")).alias("c"))
    return graph.table_values(n, "h", "c")


@query(f"WITH {K} SELECT task_id, CASE WHEN task_id % 2 = 0 AND lease_until >= TIMESTAMP '{NOW}' THEN TIMESTAMP '{NOW}' + INTERVAL 60 SECOND ELSE lease_until END AS lease_until, CASE WHEN task_id % 2 = 0 AND lease_until >= TIMESTAMP '{NOW}' THEN greatest(attempts * 10, 30) ELSE attempts * 10 END AS progress FROM t WHERE status = 'RUNNING'")
def heartbeat_extend(spark, sf):
    t = x.tasks(spark, sf).where("status = 'RUNNING'").withColumn("owner", F.lit("w")).withColumn("epoch", F.lit(1)).withColumn("progress", F.col("attempts") * 10)
    beats = t.select("task_id", F.lit("w").alias("owner"), F.when(F.col("task_id") % 2 == 0, 1).otherwise(9).alias("epoch"), F.lit(30).alias("progress"))
    return tasks.heartbeat(t, beats, x.now(), 60).select("task_id", "lease_until", "progress")


@query("SELECT 'documents' AS source, lang AS kind, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY 2")
def union_views(spark, sf):
    """U1."""
    d = x.table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("lang").alias("kind"))
    c = x.table(spark, sf, "conversations").select(F.lit("conversations").alias("source"), F.col("role").alias("kind"))
    return catalog.union_all(d, c).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


from . import graph_queries, language_queries, relation_queries  # noqa: E402, F401  register more
