"""Queries of selections that follow an order, matching against gold and grants under their rule, with SQL that walks the same
rows one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, guards, metrics, paths, permissions, relations, scope
from . import adapters as x
from .queries import L, _fused, query


@query(f"""WITH RECURSIVE {L}, q AS (SELECT query_id, list(chunk_id ORDER BY fused_rank) AS known FROM fused GROUP BY 1),
w(query_id, known, i, chosen) AS (SELECT query_id, known, 0, CAST([] AS BIGINT[]) FROM q UNION ALL
 SELECT query_id, known, i + 1, CASE WHEN list_contains(chosen, c) OR len(chosen) >= 5 THEN chosen WHEN other IS NOT NULL AND len(chosen) + len(lacking) <= 5 THEN chosen || lacking ELSE chosen || [c] END
 FROM (SELECT *, list_filter(known, lambda k: (k = c OR k = other) AND NOT list_contains(chosen, k)) AS lacking FROM
  (SELECT *, CASE WHEN c % 3 = 0 AND list_contains(known, c + 1) THEN c + 1 WHEN c % 3 = 1 AND list_contains(known, c - 1) THEN c - 1 END AS other FROM (SELECT *, known[i + 1] AS c FROM w WHERE i < len(known))))),
f AS (SELECT query_id, chosen FROM w WHERE i = len(known))
SELECT query_id, CAST(unnest(range(1, len(chosen) + 1)) AS INTEGER) AS place, unnest(chosen) AS chunk_id FROM f""")
def path_bundles(spark, sf):
    """Every third candidate is on a path with the next one."""
    f = _fused(spark, sf)
    on = F.when(F.col("chunk_id") % 3 == 0, F.array(F.array("chunk_id", F.col("chunk_id") + 1))).otherwise(F.array().cast("array<array<bigint>>"))
    return guards.bundles(f.select("query_id", F.col("fused_rank").alias("rank"), "chunk_id", on.alias("paths")), 5)


_PATHS = "p AS (SELECT DISTINCT l_orderkey // 4 AS query_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path_id, l_partkey % 9 AS first_id, l_suppkey % 9 AS second_id, list_distinct([l_partkey % 11, 20 + l_suppkey % 11, 40 + l_linenumber % 3]) AS sources FROM lineitem)"


@query(f"""WITH RECURSIVE {_PATHS}, o AS (SELECT query_id, list(struct_pack(p := path_id, s := sources) ORDER BY first_id, second_id, path_id) AS rows FROM p GROUP BY 1),
w(query_id, rows, i, have, kept) AS (SELECT query_id, rows, 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) FROM o UNION ALL
 SELECT query_id, rows, i + 1, CASE WHEN fits THEN both_ ELSE have END, CASE WHEN fits THEN kept || [rows[i + 1].p] ELSE kept END
 FROM (SELECT *, len(both_) <= 8 AND len(kept) < 4 AS fits FROM (SELECT *, list_distinct(have || rows[i + 1].s) AS both_ FROM w WHERE i < len(rows))))
SELECT query_id, unnest(kept) AS path_id FROM w WHERE i = len(rows)""")
def path_budget(spark, sf):
    """The first paths of four orders at a time, eight sources and four paths at most."""
    li = x.table(spark, sf, "lineitem")
    sources = F.array_distinct(F.array(F.col("l_partkey") % 11, F.lit(20) + F.col("l_suppkey") % 11, (F.lit(40) + F.col("l_linenumber") % 3).cast("long")))
    rows = li.select(F.floor(F.col("l_orderkey") / 4).alias("query_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("path_id"), (F.col("l_partkey") % 9).alias("first_id"), (F.col("l_suppkey") % 9).alias("second_id"), sources.alias("sources")).distinct()
    return paths.within_sources(rows, 8, 4).select("query_id", "path_id")


_RELATIONS = """l AS (SELECT l_orderkey AS chunk_id, l_linenumber AS place, min(l_partkey) AS a, min(l_suppkey) AS b, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
g AS (SELECT chunk_id, place, 'e' || a % 3 AS subject, 'e' || b % 3 AS object, a % 6 = b % 6 AS same, 'R' || q % 2 AS predicate, CASE q % 3 WHEN 0 THEN '' WHEN 1 THEN 'late' END AS condition, 'q' || q % 4 AS quote FROM l),
p AS (SELECT chunk_id, place, 'e' || (a + place % 2) % 3 AS subject, 'e' || b % 3 AS object, 'R' || q % 2 AS predicate, CASE q % 5 WHEN 0 THEN '' WHEN 1 THEN 'late' END AS condition, 'q' || q % 3 AS quote FROM l),
f AS (SELECT chunk_id, 'e' || a % 3 AS signature FROM l WHERE place % 4 <> 3 UNION ALL SELECT chunk_id, 'e' || b % 3 FROM l),
n AS (SELECT chunk_id, signature, count(*) AS n FROM f GROUP BY ALL),
e AS (SELECT g.*, coalesce(s.n >= CASE WHEN subject = object AND NOT same THEN 2 ELSE 1 END AND o.n >= CASE WHEN subject = object AND NOT same THEN 2 ELSE 1 END, false) AS eligible FROM g LEFT JOIN n s ON s.chunk_id = g.chunk_id AND s.signature = subject LEFT JOIN n o ON o.chunk_id = g.chunk_id AND o.signature = object),
c AS (SELECT e.chunk_id, list(struct_pack(g := place, s := subject, o := object, p := predicate, c := coalesce(condition, ''), q := quote) ORDER BY place) FILTER (eligible) AS gold FROM e GROUP BY 1),
d AS (SELECT chunk_id, list(struct_pack(g := place, s := subject, o := object, p := predicate, c := coalesce(condition, ''), q := quote) ORDER BY place) AS free FROM p GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_RELATIONS},
w(chunk_id, gold, free, i, hits) AS (SELECT chunk_id, gold, free, 0, CAST([] AS STRUCT(g INTEGER, p INTEGER, c BOOLEAN, q BOOLEAN)[]) FROM c JOIN d USING (chunk_id) WHERE len(gold) > 0 UNION ALL
 SELECT chunk_id, gold, free, i + 1, CASE WHEN hit IS NULL THEN hits ELSE hits || [struct_pack(g := now.g, p := hit.g, c := now.c = hit.c, q := now.q = hit.q)] END
 FROM (SELECT *, CASE WHEN len(list_filter(hits, lambda h: h.g = now.g)) = 0 THEN list_filter(free, lambda r: r.s = now.s AND r.o = now.o AND r.p = now.p AND (i // len(gold) = 2 OR r.c = now.c) AND (i // len(gold) > 0 OR r.q = now.q) AND len(list_filter(hits, lambda h: h.p = r.g)) = 0)[1] END AS hit
  FROM (SELECT *, gold[i % len(gold) + 1] AS now FROM w WHERE i < 3 * len(gold)))),
h AS (SELECT chunk_id, unnest(hits, recursive := true) FROM w WHERE i = 3 * len(gold))
SELECT predicate, count(*) AS gold, count(*) FILTER (eligible) AS eligible, count(h.p) AS matched, count(*) FILTER (h.c) AS same_condition, count(*) FILTER (h.q) AS same_quote, CASE WHEN count(*) FILTER (eligible) > 0 THEN round(count(h.p) / count(*) FILTER (eligible), 4) END AS recall, CASE WHEN count(h.p) > 0 THEN round(count(*) FILTER (h.c) / count(h.p), 4) END AS condition_accuracy
FROM (SELECT e.chunk_id, e.place, e.predicate, e.eligible FROM e) r LEFT JOIN h ON h.chunk_id = r.chunk_id AND h.g = r.place GROUP BY predicate""")
def conditional_recall(spark, sf):
    """An order's lines as gold relations, and other readings of them as predicted ones."""
    li = x.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("place")).agg(F.min("l_partkey").alias("a"), F.min("l_suppkey").alias("b"), F.min("l_quantity").cast("long").alias("q"))
    a, b, q = F.col("a"), F.col("b"), F.col("q")
    named = lambda p, n: F.concat(F.lit(p), n)
    condition = lambda n: F.when(q % n == 0, "").when(q % n == 1, "late")
    rest = lambda n, m: [named("R", q % 2).alias("predicate"), condition(n).alias("condition"), named("q", q % m).alias("quote")]
    gold = li.select("chunk_id", "place", named("e", a % 3).alias("subject"), named("e", b % 3).alias("object"), (a % 6 == b % 6).alias("same"), *rest(3, 4))
    predicted = li.select("chunk_id", "place", named("e", (a + F.col("place") % 2) % 3).alias("subject"), named("e", b % 3).alias("object"), *rest(5, 3))
    found = li.where("place % 4 <> 3").select("chunk_id", named("e", a % 3).alias("signature")).unionAll(li.select("chunk_id", named("e", b % 3).alias("signature")))
    return metrics.conditional_recall(metrics.conditional_matches(gold, predicted, found), ["predicate"])


_GRANTS = f"""{x.G}, {x.M}, me AS (SELECT *, status = 'ACTIVE' AND (department_id IS NULL OR department_id % 7 <> 6) AS ok FROM mem),
su AS (SELECT tenant_id, 'u' || user_id AS subject, ok AS valid, ok AS available FROM me UNION ALL
 SELECT CAST(t AS INTEGER), 'd' || n_nationkey, n_nationkey % 7 <> 6, n_nationkey % 7 <> 6 AND EXISTS (SELECT 1 FROM me WHERE me.ok AND me.tenant_id = t AND me.department_id = n_nationkey) FROM nation, (VALUES (1), (2)) v(t)),
gr AS (SELECT tenant_id, kb_id, CASE WHEN user_id IS NULL THEN 'd' || department_id ELSE 'u' || user_id END AS subject, max(permission) AS permission FROM g GROUP BY ALL),
ch AS (SELECT CAST(1 + c_custkey % 2 AS INTEGER) AS tenant_id, CAST(c_custkey * 7 % 20 AS INTEGER) AS kb_id, c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'd' || c_nationkey WHEN c_custkey % 4 = 1 THEN 'u42' ELSE 'u' || c_custkey END AS subject, CASE c_custkey % 6 WHEN 1 THEN 'ADMIN' WHEN 2 THEN 'READ' WHEN 4 THEN 'WRITE' WHEN 5 THEN 'READ' END AS permission FROM customer)"""


@query(f"""WITH RECURSIVE {_GRANTS}, nu AS (SELECT ch.*, coalesce(s.valid, false) AS valid, row_number() OVER (PARTITION BY ch.tenant_id, ch.kb_id ORDER BY seq) AS i FROM ch LEFT JOIN su s ON s.tenant_id = ch.tenant_id AND s.subject = ch.subject),
av AS (SELECT tenant_id, list(subject) AS av FROM su WHERE available GROUP BY 1),
st AS (SELECT k.tenant_id, k.kb_id, coalesce((SELECT list(struct_pack(s := subject, p := permission) ORDER BY subject) FROM gr WHERE gr.tenant_id = k.tenant_id AND gr.kb_id = k.kb_id), []) AS held FROM (SELECT DISTINCT tenant_id, kb_id FROM ch) k),
w(tenant_id, kb_id, i, held, version, seq, subject, permission, code, previous) AS (SELECT tenant_id, kb_id, CAST(0 AS BIGINT), held, CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM st UNION ALL
 SELECT tenant_id, kb_id, i, CASE WHEN code = 'CHANGED' THEN after ELSE held END, version + CASE WHEN code = 'CHANGED' THEN 1 ELSE 0 END, seq, subject, permission, code, old FROM
 (SELECT *, CASE WHEN permission IS NULL AND old IS NULL THEN 'NOT_FOUND' WHEN permission IS NOT NULL AND NOT valid THEN 'PERMISSION_SUBJECT_INVALID' WHEN len(list_filter(after, lambda h: h.p = 'ADMIN' AND list_contains(av, h.s))) = 0 THEN 'LAST_ADMIN_REQUIRED' WHEN permission IS NOT DISTINCT FROM old THEN 'UNCHANGED' ELSE 'CHANGED' END AS code FROM
  (SELECT w.tenant_id, w.kb_id, nu.i, w.held, w.version, nu.seq, nu.subject, nu.permission, nu.valid, av.av, list_filter(w.held, lambda h: h.s = nu.subject)[1].p AS old, list_filter(w.held, lambda h: h.s <> nu.subject) || CASE WHEN nu.permission IS NULL THEN [] ELSE [struct_pack(s := nu.subject, p := nu.permission)] END AS after
   FROM w JOIN nu ON nu.tenant_id = w.tenant_id AND nu.kb_id = w.kb_id AND nu.i = w.i + 1 JOIN av ON av.tenant_id = w.tenant_id)))
SELECT tenant_id, kb_id, seq, subject, permission, code, previous, version AS acl_version FROM w WHERE i > 0""")
def grant_changes(spark, sf):
    """M4: customers change grants of the bases, one after another."""
    bases, grants, changes, subjects = _grant_tables(spark, sf)
    return permissions.outcomes(bases, grants, changes, subjects)


def _grant_tables(spark, sf):
    ok = (F.col("status") == "ACTIVE") & (F.col("department_id").isNull() | (F.col("department_id") % 7 != 6))
    members = x.members(spark, sf).withColumn("ok", ok)
    users = members.select("tenant_id", F.concat(F.lit("u"), "user_id").alias("subject"), F.col("ok").alias("valid"), F.col("ok").alias("available"))
    staffed = members.where("ok and department_id is not null").select("tenant_id", F.col("department_id").alias("n_nationkey")).distinct().withColumn("staffed", F.lit(True))
    departments = x.table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("tenant_id")).join(staffed, ["tenant_id", "n_nationkey"], "left")
    active = F.col("n_nationkey") % 7 != 6
    departments = departments.select("tenant_id", F.concat(F.lit("d"), "n_nationkey").alias("subject"), active.alias("valid"), (active & F.coalesce("staffed", F.lit(False))).alias("available"))
    subject = F.when(F.col("user_id").isNull(), F.concat(F.lit("d"), "department_id")).otherwise(F.concat(F.lit("u"), "user_id"))
    grants = x.grants(spark, sf).groupBy("tenant_id", "kb_id", subject.alias("subject")).agg(F.max("permission").alias("permission"))
    k = F.col("c_custkey")
    who = F.when(k % 3 == 0, F.concat(F.lit("d"), "c_nationkey")).when(k % 4 == 1, "u42").otherwise(F.concat(F.lit("u"), k))
    permission = F.when(k % 6 == 1, "ADMIN").when(k % 6 == 2, "READ").when(k % 6 == 4, "WRITE").when(k % 6 == 5, "READ")
    changes = x.table(spark, sf, "customer").select((1 + k % 2).cast("int").alias("tenant_id"), (k * 7 % 20).cast("int").alias("kb_id"), k.alias("seq"), who.alias("subject"), permission.alias("permission"))
    bases = changes.select("tenant_id", "kb_id").distinct().withColumn("acl_version", F.lit(1).cast("long"))
    return bases, grants, changes, users.unionByName(departments)


@query("WITH b AS (SELECT user_id, ts, coalesce(epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER w) // 1000 >= 1800000, true) AS first FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(first::INT) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM b) SELECT user_id, epoch_us(min(ts)) // 1000 AS started, epoch_us(max(ts)) // 1000 AS ended, count(*) AS beats FROM g GROUP BY user_id, run")
def lease_runs(spark, sf):
    """Q7: users' events as beats of leases of half an hour; the stream of streaming/events.py gives the same rows."""
    from ..streaming.events import lease_runs

    ms = lambda c: F.unix_millis(c).alias(c)
    return lease_runs(x.table(spark, sf, "events").select("user_id", "ts"), 1800).select("user_id", ms("started"), ms("ended"), "beats")


_CHUNKS_ASKED = r"""w AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents),
s AS (SELECT chunk_id, t, w[1] AS a, w[2] AS b, len(w) AS n, chunk_id % 7 AS k, chunk_id % 11 AS f FROM w),
r AS (SELECT *, unnest([1, 2, 3]) AS attempt FROM s),
o AS (SELECT *, CASE WHEN k = 1 AND attempt = 1 THEN 'OUTPUT_TRUNCATED' WHEN k = 2 AND attempt < 3 OR n < 2 THEN 'OUTPUT_EMPTY' WHEN k = 3 AND attempt = 1 OR k = 4 THEN 'EVIDENCE_INVALID' WHEN k = 5 AND attempt = 1 THEN 'OUTPUT_EMPTY' WHEN k = 6 AND attempt = 1 THEN 'EVIDENCE_INVALID' WHEN k = 6 THEN 'OUTPUT_EMPTY_AFTER_INVALID' END AS code FROM r),
g AS (SELECT chunk_id, a, b, k, f, n, coalesce(min(attempt) FILTER (code IS NULL), 3) AS attempts, count(*) FILTER (code IS NULL) > 0 AS done, max_by(code, attempt) AS last FROM o GROUP BY ALL)"""


@query(f"""WITH {_CHUNKS_ASKED} SELECT chunk_id, CASE WHEN f = 0 THEN 'FENCED' WHEN done THEN 'DONE' WHEN k = 4 AND n >= 2 THEN 'SALVAGED' ELSE 'FAILED' END AS outcome, CAST(attempts AS INTEGER) AS attempts, CASE WHEN NOT done THEN last END AS code,
CASE WHEN f <> 0 AND done AND k <> 5 THEN a || '>' || b WHEN f <> 0 AND done THEN '' WHEN f <> 0 AND k = 4 AND n >= 2 THEN a || '>' || b END AS facts FROM g""")
def extraction_rounds(spark, sf):
    """An extractor that links a text's first two words and errs by doc_id: it is cut off, silent, makes a name up once or
    always, finds nothing after silence or after an error; leases of every eleventh chunk went to another worker."""
    from ..operators import extraction

    name = "first_two_words"
    if name not in extraction._EXTRACTORS:
        extraction.register_extractor(name, _first_two_words)
    d = x.table(spark, sf, "documents")
    work = d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.lit(1).alias("epoch"))
    leases = d.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 11 == 0, 2).otherwise(1).alias("epoch"))
    holds = lambda p: F.contains(F.col("content"), p["a"]) & F.contains(F.col("content"), p["b"])
    issue = F.when(F.exists("facts", lambda p: ~holds(p)), "EVIDENCE_INVALID")
    out = extraction.extract(work, name, issue, F.filter("facts", holds), leases)
    return out.select("chunk_id", "outcome", "attempts", "code", F.array_join(F.transform("facts", lambda p: F.concat(p["a"], F.lit(">"), p["b"])), ",").alias("facts"))


def _first_two_words(asked):
    k, attempt = F.col("chunk_id") % 7, F.col("attempt")
    w = F.regexp_extract_all("content", F.lit("[A-Za-z]+"), 0)
    fact = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    true, made_up = fact(F.get(w, 0), F.get(w, 1)), fact(F.get(w, 0), F.lit("@none@"))
    none = F.array().cast("array<struct<a: string, b: string>>")
    facts = F.when((k == 3) & (attempt == 1) | (k == 6) & (attempt == 1), F.array(made_up)).when(k == 4, F.array(made_up, true)).when((k == 5) | (k == 6), none).otherwise(F.array(true))
    silent = (F.size(w) < 2) | (k == 2) & (attempt < 3) | (k == 5) & (attempt == 1)
    return asked.select("chunk_id", F.when(silent, "").otherwise("{}").alias("output"), (~((k == 1) & (attempt == 1))).alias("finished"), facts.alias("facts"))


_DATED = """k AS (SELECT o_orderkey AS k, o_orderdate AS d, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders),
v AS (SELECT k, d, ['eq', 'gt', 'gte', 'lt', 'lte', 'range', 'neq', 'contains'][k // 13 % 8 + 1] AS op, CASE k % 13 WHEN 0 THEN s[:4] WHEN 1 THEN s[:4] || '年' || CAST(CAST(s[6:7] AS INTEGER) AS VARCHAR) || '月' WHEN 2 THEN ' ' || s || ' ' WHEN 3 THEN s[:4] || '/' || s[6:7] WHEN 4 THEN s || 'T10:30:00+08:00' WHEN 5 THEN s || 'T10:30' WHEN 6 THEN s || ' 至 ' || s[:4]
 WHEN 7 THEN s[:4] || '-13-01' WHEN 8 THEN 'soon' WHEN 9 THEN '上个月' WHEN 10 THEN s || '~' || s || '~' || s WHEN 11 THEN s || 'T25:00:00Z' ELSE s[:4] || '年 到 ' || s END AS value FROM k)"""


def _sql_period(text: str) -> str:
    """[start, end) of a period in local days, as two columns of a lateral join."""
    t = f"trim({text})"
    part = lambda i: f"try_cast(nullif(regexp_extract({t}, '^(\\d{{4}})(?:年|[-/])?(?:(\\d{{1,2}})(?:月|[-/])?)?(?:(\\d{{1,2}})日?)?$', {i}), '') AS INTEGER)"
    first = f"try_cast(printf('%04d-%02d-%02d', {part(1)}, coalesce({part(2)}, 1), coalesce({part(3)}, 1)) AS DATE)"
    length = f"CASE WHEN {part(3)} IS NOT NULL THEN INTERVAL 1 DAY WHEN {part(2)} IS NOT NULL THEN INTERVAL 1 MONTH ELSE INTERVAL 1 YEAR END"
    start = f"CASE WHEN {t} = '上个月' THEN DATE '1999-12-01' WHEN {part(1)} IS NOT NULL THEN {first} END"
    return f"struct_pack(a := CAST({start} AS TIMESTAMP), z := CASE WHEN {t} = '上个月' THEN TIMESTAMP '2000-01-01' WHEN {part(1)} IS NOT NULL THEN CAST({first} AS TIMESTAMP) + {length} END)"


@query(rf"""WITH {_DATED}, p AS (SELECT *, regexp_split_to_array(value, '\s*(?:至|到|~|～|\s+-\s+)\s*') AS ps, k % 2 = 0 AND contains(value, 'T') AND op <> 'range' AS instant FROM v),
b AS (SELECT *, {_sql_period("value")} AS w, {_sql_period("ps[1]")} AS x, {_sql_period("coalesce(ps[2], '')")} AS y, regexp_matches(value, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}') AND NOT contains(value, 'T25') AS clock FROM p),
e AS (SELECT *, CASE WHEN op = 'range' THEN x.a ELSE w.a END AS a, CASE WHEN op = 'range' AND len(ps) = 2 THEN y.z WHEN op = 'range' THEN x.z ELSE w.z END AS z FROM b),
c AS (SELECT *, CASE WHEN op = 'contains' THEN 'OPERATOR_INVALID' WHEN instant AND NOT clock THEN 'INSTANT_INVALID' WHEN instant AND NOT contains(value, '+08:00') THEN 'ZONE_MISSING' WHEN instant THEN NULL WHEN op = 'range' AND len(ps) > 2 THEN 'RANGE_INVALID' WHEN a IS NULL OR z IS NULL THEN 'PERIOD_INVALID' WHEN op = 'range' AND a >= z THEN 'RANGE_EMPTY' WHEN op = 'neq' THEN 'NOT_EQUAL_UNSUPPORTED' END AS code FROM e),
i AS (SELECT *, CASE WHEN instant THEN CAST(d AS TIMESTAMP) + INTERVAL 150 MINUTE END AS t FROM c)
SELECT k AS o_orderkey, CASE WHEN code IS NOT NULL THEN NULL WHEN instant THEN op WHEN op IN ('eq', 'range') THEN 'range' WHEN op = 'gt' THEN 'gte' WHEN op = 'lte' THEN 'lt' ELSE op END AS op,
 CASE WHEN code IS NULL THEN CASE WHEN instant THEN CAST(epoch(t) AS BIGINT) WHEN op = 'gt' THEN CAST(epoch(z) AS BIGINT) - 28800 WHEN op IN ('eq', 'range', 'gte') THEN CAST(epoch(a) AS BIGINT) - 28800 END END AS lower, CASE WHEN code IS NULL THEN CASE WHEN instant THEN CAST(epoch(t) AS BIGINT) WHEN op = 'lt' THEN CAST(epoch(a) AS BIGINT) - 28800 WHEN op IN ('eq', 'range', 'lte') THEN CAST(epoch(z) AS BIGINT) - 28800 END END AS upper, code FROM i""")
def date_conditions(spark, sf):
    """Conditions on an order's date in thirteen ways to write it and with each operator; every other may be an instant."""
    from ..functions import periods

    k, s = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    year, month, join = F.substring(s, 1, 4), F.substring(s, 6, 2), F.concat
    operators = F.array(*[F.lit(o) for o in ("eq", "gt", "gte", "lt", "lte", "range", "neq", "contains")])
    ways = [year, join(year, F.lit("年"), month.cast("int").cast("string"), F.lit("月")), join(F.lit(" "), s, F.lit(" ")), join(year, F.lit("/"), month), join(s, F.lit("T10:30:00+08:00")), join(s, F.lit("T10:30")), join(s, F.lit(" 至 "), year), join(year, F.lit("-13-01")), F.lit("soon"), F.lit("上个月"), join(s, F.lit("~"), s, F.lit("~"), s), join(s, F.lit("T25:00:00Z")), join(year, F.lit("年 到 "), s)]
    o = x.table(spark, sf, "orders").select("o_orderkey", F.element_at(operators, (F.floor(k / 13) % 8 + 1).cast("int")).alias("operator"), F.element_at(F.array(*ways), (k % 13 + 1).cast("int")).alias("value"), (k % 2 == 0).alias("instants"), F.lit("2000-01-10 03:00:00").cast("timestamp").alias("now"))
    at = lambda n: F.unix_timestamp(n).alias(n)
    return periods.date_conditions(o, "now").select("o_orderkey", "op", at("lower"), at("upper"), "code")


def _scopes_sql(name: str, ready: str, base: str) -> str:
    return f"""{name}_ab AS (SELECT kb_id FROM b WHERE tenant_id = 1 AND status = 'ACTIVE' AND deleted_at IS NULL AND {base} AND EXISTS (SELECT 1 FROM g WHERE g.kb_id = b.kb_id AND g.tenant_id = 1 AND (g.user_id = 42 OR g.department_id = 3))),
{name}_q AS (SELECT request_id, CASE WHEN len(kb_ids) > 0 THEN list_sort(list_distinct(kb_ids)) ELSE coalesce((SELECT list(kb_id ORDER BY kb_id) FROM {name}_ab), []) END AS kbs, CASE WHEN len(document_ids) > 0 THEN list_distinct(document_ids) END AS docs FROM rq),
{name}_k AS (SELECT q.*, len(list_filter(kbs, lambda k: NOT list_contains(l, k))) > 0 AS bad FROM {name}_q q, (SELECT coalesce(list(kb_id), []) AS l FROM {name}_ab)),
{name}_m AS (SELECT k.request_id, count(*) AS n, count(*) FILTER (r.status = 'PUBLISHED' AND r.active_generation_id IS NOT NULL AND {ready}) AS p, sum(CASE WHEN r.status = 'PUBLISHED' AND r.active_generation_id IS NOT NULL AND {ready} THEN CAST('0x' || sha256(r.kb_id || ':' || r.document_id || ':' || r.active_generation_id)[:15] AS HUGEINT) END) AS s
 FROM {name}_k k JOIN r ON list_contains(k.kbs, r.kb_id) AND (k.docs IS NULL OR list_contains(k.docs, r.document_id)) AND r.kb_id IN (SELECT kb_id FROM {name}_ab) WHERE NOT bad GROUP BY 1),
{name} AS (SELECT k.request_id, bad OR (docs IS NOT NULL AND len(docs) > coalesce(n, 0)) AS refused, kbs, coalesce(n, 0) AS n, coalesce(p, 0) AS p, sha256(array_to_string(kbs, ',') || '|' || coalesce(p, 0) || '|' || coalesce(s, 0)) AS mark FROM {name}_k k LEFT JOIN {name}_m m ON m.request_id = k.request_id)"""


_ASKED_SCOPES = f"""{x.D}, {x.B}, {x.G}, {x.S}, {x._allowed("r", "d.status IN ('DRAFT', 'PUBLISHED') AND d.deleted_at IS NULL", "'READ', 'WRITE', 'ADMIN'", "'READ', 'WRITE'")},
rq AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 50 = 1 THEN CAST([] AS INTEGER[]) WHEN c_custkey % 3 = 0 THEN [CAST(c_custkey % 20 AS INTEGER)] ELSE [CAST(c_custkey % 20 AS INTEGER), CAST(c_custkey // 20 % 20 AS INTEGER)] END AS kb_ids, CASE WHEN c_custkey % 4 = 3 THEN [c_custkey % 200, c_custkey % 200 + 20] WHEN c_custkey % 50 = 21 THEN CAST([] AS BIGINT[]) END AS document_ids FROM customer)"""


def _scope_tables(spark, sf):
    k = F.col("c_custkey")
    base = lambda c: c.cast("int")
    kbs = F.when(k % 50 == 1, F.array().cast("array<int>")).when(k % 3 == 0, F.array(base(k % 20))).otherwise(F.array(base(k % 20), base(F.floor(k / 20) % 20)))
    docs = F.when(k % 4 == 3, F.array(k % 200, k % 200 + 20)).when(k % 50 == 21, F.array().cast("array<bigint>"))
    requests = x.table(spark, sf, "customer").select(k.alias("request_id"), kbs.alias("kb_ids"), docs.alias("document_ids"))
    return requests, scope.accessible(x.bases(spark, sf), x.grants(spark, sf), x.WHO).select("kb_id").distinct(), x.readable(spark, sf, state="default")


def _generations(documents, stale: int):
    i = F.col("active_generation_id")
    return documents.where(i.isNotNull()).select("document_id", i.alias("generation_id"), F.when(F.col("document_id") % stale == 0, "BUILDING").otherwise("READY").alias("status"))


@query(f"WITH {_ASKED_SCOPES}, {_scopes_sql('a', 'r.document_id % 6 <> 0', 'true')} SELECT request_id, CASE WHEN refused THEN 'QUERY_SCOPE_FORBIDDEN' END AS code, CASE WHEN NOT refused THEN array_to_string(kbs, ',') END AS kb_ids, CASE WHEN NOT refused THEN n END AS authorized, CASE WHEN NOT refused THEN p END AS published, CASE WHEN NOT refused THEN mark END AS fingerprint FROM a")
def scope_requests(spark, sf):
    """L1: customers ask for bases and documents, or for all that they may read."""
    requests, bases, documents = _scope_tables(spark, sf)
    out = scope.resolve_scopes(requests, bases, documents, _generations(documents, 6))
    return out.withColumn("kb_ids", F.array_join(F.col("kb_ids").cast("array<string>"), ","))


@query(f"WITH {_ASKED_SCOPES}, {_scopes_sql('a', 'r.document_id % 6 <> 0', 'true')}, {_scopes_sql('z', 'r.document_id % 35 <> 0 AND r.document_id % 6 <> 0', 'kb_id <> 6')} SELECT a.request_id, coalesce(NOT a.refused AND NOT z.refused AND a.mark = z.mark, false) AS holds FROM a JOIN z ON z.request_id = a.request_id")
def provenance_check(spark, sf):
    """Which scopes are as they were after some generations were built anew and a base was closed."""
    requests, bases, documents = _scope_tables(spark, sf)
    before = scope.resolve_scopes(requests, bases, documents, _generations(documents, 6))
    later = _generations(documents, 6).withColumn("status", F.when(F.col("document_id") % 35 == 0, "BUILDING").otherwise(F.col("status")))
    return scope.provenance_holds(before, scope.resolve_scopes(requests, bases.where("kb_id <> 6"), documents.where("kb_id <> 6"), later))


_EVIDENCE = """ev AS (SELECT o_orderkey AS evidence_id, o_custkey AS place, o_orderkey % 199 AS chunk_id, o_orderkey % 7 AS start, o_orderkey % 5 = 0 AS old, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS off FROM orders WHERE o_orderstatus = 'F'),
he AS (SELECT evidence_id, place FROM ev JOIN documents ON doc_id = chunk_id WHERE NOT old AND text IS NOT NULL AND (off = 0 OR text[start + 1:start + 12] = text[start + 2:start + 13])),
sd AS (SELECT p_partkey AS uid FROM part WHERE p_name = 'red widget'),
ho AS (SELECT a.assertion_id, he.place FROM a JOIN he USING (evidence_id) WHERE (subject IN (FROM sd) OR object IN (FROM sd)) AND object IN (SELECT p_partkey FROM part) AND subject IN (SELECT p_partkey FROM part))"""


@query(f"WITH {x.A}, {_EVIDENCE} SELECT place, count(DISTINCT assertion_id) AS score FROM ho GROUP BY 1")
def graph_one_hop_held(spark, sf):
    """One hop over evidence that still stands: orders quote documents, some of an older text, some one character off."""
    k = F.col("o_orderkey")
    d = x.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    off = F.when(k % 11 == 0, 1).otherwise(0)
    quoted = x.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(k.alias("evidence_id"), F.col("o_custkey").alias("place"), (k % 199).alias("chunk_id"), (k % 7).cast("int").alias("start"), off.alias("off"), (k % 5 == 0).alias("old"))
    quoted = quoted.join(d, "chunk_id").select("evidence_id", "place", "chunk_id", F.when(F.col("old"), "old").otherwise(F.sha2("content", 256)).alias("content_sha256"), F.expr("substring(content, start + 1, 12)").alias("quote"), (F.col("start") + F.col("off")).alias("quote_start"))
    evidence = quoted.withColumn("quote_end", F.col("quote_start") + F.char_length("quote"))
    parts = x.table(spark, sf, "part")
    seeds, ends = parts.where("p_name = 'red widget'").select(F.col("p_partkey").alias("uid")), parts.select(F.col("p_partkey").alias("uid"))
    hops = graph.one_hop(x.assertions(spark, sf), ends, relations.held_evidence(evidence, d).select("evidence_id", "place"), seeds)
    return graph.graph_scores(hops, "place")


@query("SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS signs, md5(CAST(sum(CAST('0x' || sha256(coalesce(text, ''))[:13] AS HUGEINT)) AS VARCHAR)) AS told FROM documents GROUP BY lang")
def frozen_documents(spark, sf):
    """Documents frozen, held against their manifest and read again."""
    import uuid

    from ..sources import frozen
    from ..tables import shared_dir

    d = x.table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    path = f"{shared_dir(spark)}/frozen-{uuid.uuid4().hex}"
    frozen.freeze(d, path, ["doc_id"])
    back = frozen.thawed(spark, path, "doc_id long, text string, lang string, n_chars long")
    told = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("signs"), F.md5(F.sum(told).cast("string")).alias("told"))
