"""The queries of the corpus operators with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, divergence, embeddings, fingerprints, html, minhash, mixing, packing, quality, suffixes, urls, warc

#: The rules of the contract: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.classify(docs.select("doc_id", "text"), model).drop("text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filters, op2_quality_classifier, op3_suffix_dedup, op4_html_extraction, op5_packing, op6_fingerprints, op7_warc, op8_minhash_dedup, op9_embedding_dedup, op10_mixing, op11_source_divergence, op12_decontamination, op13_conversation_repair)}

_HALVES, _MULTIPLIER = [], fingerprints.BASE
for _step in (1, 2, 4, 8):
    _HALVES.append(f"h{2 * _step} AS (SELECT r, kind, z, p, (h * {_MULTIPLIER}::UBIGINT + lead(h, {_step}) OVER (PARTITION BY r, kind ORDER BY p)) % 4294967296 AS h FROM h{_step})")
    _MULTIPLIER = _MULTIPLIER * _MULTIPLIER % (1 << 32)
_MIXED = f"(xor({{0}}, ({{0}}) >> 15) * {fingerprints.MIX}::UBIGINT % 4294967296)"
_MIXED = f"xor({_MIXED}, {_MIXED} >> 13)"
_FINGERPRINTS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS following FROM d),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 4) || substr(following, 1, length(t) // 4) AS e FROM n),
x AS (SELECT r, 0 AS kind, regexp_extract_all(t, '.', 0, 's') AS c FROM e UNION ALL SELECT r, 1, regexp_extract_all(e, '.', 0, 's') FROM e),
u AS (SELECT r, kind, len(c) AS z, unnest(c) AS c, unnest(range(len(c))) AS p FROM x),
m AS (SELECT r, kind, z, p, CAST(unicode(c) + 1 AS UBIGINT) AS v FROM u),
h1 AS (SELECT r, kind, z, p, {_MIXED.format("v")} AS h FROM m),
{", ".join(_HALVES)},
short AS (SELECT r, kind, z, list(h ORDER BY p) AS hs FROM h1 WHERE z < 16 GROUP BY ALL),
f AS (SELECT r, kind, z, p, h FROM h16 WHERE p + 16 <= z UNION ALL SELECT r, kind, z, 0, list_reduce(list_prepend(CAST(z AS UBIGINT), hs), lambda a, b: (a * {fingerprints.BASE}::UBIGINT + b) % 4294967296) FROM short),
g AS (SELECT r, kind, greatest(1, z - 15) AS grams, p, ({_MIXED.format("h")} << 32) + 4294967295 - p AS key FROM f),
v AS (SELECT r, kind, grams, p, min(key) OVER (PARTITION BY r, kind ORDER BY p ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS key FROM g),
k AS (SELECT DISTINCT r, kind, key >> 32 AS h, 4294967295 - key % 4294967296 AS p FROM v WHERE p + 1 >= least(64, grams)),
a AS (SELECT r, kind, string_agg(printf('%08x:%d', CAST(h AS BIGINT), CAST(p AS BIGINT)), ' ' ORDER BY p) AS f, list(DISTINCT h) AS hs FROM k GROUP BY ALL),
b AS (SELECT e.*, coalesce(a.f, '') AS f, coalesce(a.hs, []) AS hs, coalesce(ae.f, '') AS ef, coalesce(ae.hs, []) AS ehs FROM e LEFT JOIN a ON a.r = e.r AND a.kind = 0 LEFT JOIN a AS ae ON ae.r = e.r AND ae.kind = 1),
w AS (SELECT *, coalesce(lead(hs) OVER (ORDER BY r), first_value(hs) OVER (ORDER BY r)) AS nhs FROM b),
j AS (SELECT *, len(list_intersect(hs, ehs)) AS ie, len(list_intersect(hs, nhs)) AS i2 FROM w)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(e) AS edited_sha256, f AS fingerprint, ef AS edited_fingerprint,
  CASE WHEN len(hs) + len(ehs) = 0 THEN 1.0 ELSE CAST(ie AS DOUBLE) / (len(hs) + len(ehs) - ie) END AS near_edited,
  CASE WHEN len(hs) + len(nhs) = 0 THEN 1.0 ELSE CAST(i2 AS DOUBLE) / (len(hs) + len(nhs) - i2) END AS near_next FROM j
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MORE = lambda way, cost, edit: f"lpad(CAST(CAST({way}[:12] AS BIGINT) + {cost} AS VARCHAR), 12, '0') || {way}[13:] || '{edit}'"
_STEPS = f"""
  SELECT conv_id, pos, s0, s1, least(s2, {_MORE("s0", 3, "I")}, {_MORE("s1", 3, "I")}, {_MORE("s3", 3, "I")}) AS s2, least(s3, {_MORE("s2", 3, "I")}, {_MORE("s0", 6, "II")}, {_MORE("s1", 6, "II")}) AS s3
  FROM (SELECT conv_id, pos, {_MORE("s0", 4, "D")} AS s0,
    least({_MORE("s1", 4, "D")}, CASE WHEN free AND i = 's' THEN {_MORE("s0", "extra", "K")} END) AS s1,
    least({_MORE("s2", 4, "D")}, CASE WHEN free THEN CASE WHEN i = 'u' THEN least({_MORE("s0", "extra", "K")}, {_MORE("s1", "extra", "K")}, {_MORE("s3", "extra", "K")}) ELSE least({_MORE("s0", "(3 + extra)", "R")}, {_MORE("s1", "(3 + extra)", "R")}, {_MORE("s3", "(3 + extra)", "R")}) END END) AS s2,
    least({_MORE("s3", 4, "D")}, CASE WHEN free THEN CASE WHEN i = 'a' THEN {_MORE("s2", "extra", "K")} ELSE {_MORE("s2", "(3 + extra)", "R")} END END) AS s3
  FROM (SELECT v.* EXCLUDE (pos), f.pos, f.i, f.fault IN (0, 3) AS free, CASE WHEN f.fault = 3 THEN 3 ELSE 0 END AS extra FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.pos = v.pos + 1))
"""

ORACLES: dict[str, str] = {
    "op11_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.n + 5 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 5) // (v.n + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
""",
    "op12_decontamination": rf"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda k: w[k:k + 9])), ' ') AS x FROM b WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS pl FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
m AS (SELECT DISTINCT r, pl, n, item FROM (SELECT r, pl, n, array_to_string(w[pl:pl + n - 1], ' ') AS x FROM s) JOIN i USING (n, x)),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(pl, pl + n)) AS place FROM m) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)
""",
    "op13_conversation_repair": rf"""
WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, t),
a AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS r, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, md5(x), copy) AS pos FROM a),
f AS (SELECT *, r[1] AS i, lag(r[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before, CASE WHEN NOT regexp_matches(x, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, r, x ORDER BY pos) > 1 THEN 2 WHEN NOT regexp_matches(x, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault FROM o),
z AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
v(conv_id, pos, s0, s1, s2, s3) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000000', CAST(NULL AS VARCHAR), '000000000003I', '000000000006II' FROM conversations UNION ALL {_STEPS}),
w AS (SELECT q.conv_id, least(s0, s3) AS way, n, gaps, blank, duplicate, truncated, illegal FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id JOIN v ON v.conv_id IS NOT DISTINCT FROM q.conv_id AND v.pos = coalesce(n, 0)),
e AS (SELECT conv_id, unnest(range(1, length(way) - 11)) AS pl, way[13:] AS audit FROM w),
y AS (SELECT conv_id, pl, audit[pl] AS edit, length(replace(audit[:pl], 'I', '')) AS pos FROM e),
j AS (SELECT y.conv_id, pl, edit, f.r, f.x, f.i, row_number() OVER (PARTITION BY y.conv_id ORDER BY pl) AS nth FROM y LEFT JOIN f ON edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.pos = y.pos WHERE edit <> 'D'),
h AS (SELECT *, nth - max(CASE WHEN nth = 1 AND edit = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS place FROM j),
x AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN r WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(x, ''), chr(10) ORDER BY pl)) AS repaired FROM h GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(way[:12] AS BIGINT) AS cost, way[13:] AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM w LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM w.conv_id
""",
    "op1_url_filters": r"""
WITH r(rh, rp, verdict) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.*, r.rh || r.rp AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rh || r.rp) DESC NULLS LAST, length(r.rh) DESC) AS n
      FROM p LEFT JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
""",
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, 256 * i AS base, substr(h, 512 * i + 1, 710) AS part FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 - 100) // 256 + 1)) AS i FROM d WHERE len(h) >= 200)),
w AS MATERIALIZED (SELECT doc_id, base + o AS p, hash(substr(part, 2 * o + 1, 200)) AS k, substr(part, 2 * o + 1, 200) AS x FROM (SELECT *, unnest(range(0, least(256, len(part) // 2 - 99))) AS o FROM g)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k, x ORDER BY doc_id, p) AS n FROM w SEMI JOIN twice USING (k)),
b AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM s WHERE n > 1),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM b),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS z, lag(max(p) + 100) OVER (PARTITION BY doc_id ORDER BY k) AS since FROM i GROUP BY doc_id, k),
t AS (SELECT r.doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, max(z) AS z, string_agg(substr(d.h, 2 * coalesce(since, 0) + 1, 2 * (a - coalesce(since, 0))), '' ORDER BY k) AS kept FROM r JOIN d USING (doc_id) GROUP BY r.doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(t.kept || substr(d.h, 2 * t.z + 1), d.h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
""",
    # Right for the given pages, whose markup is plain; the operator takes any.
    "op4_html_extraction": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
t AS (SELECT page_id, url, replace(regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"') AS t FROM a),
r AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM r
""",
    "op6_fingerprints": _FINGERPRINTS_SQL,
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS low FROM p),
f AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(s, 5 * g + 1, 5) AS BIGINT)) AS fives FROM d),
b AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)) AS letters FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(letters, '') AS payload_digest,
  CASE WHEN low IS NULL OR page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN low IS NULL OR page_id = low THEN NULL ELSE low END AS refers_to FROM b
""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, row_number() OVER () AS i FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][no % 3 + 1] AS DOUBLE) AS w, CAST(3 * z AS DOUBLE) AS cap, CAST(sum(z) OVER () AS DOUBLE) AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM w WINDOW o AS (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, coalesce(least(cap, w * (SELECT level FROM l WHERE cap > level * w ORDER BY cap / w, no LIMIT 1)), cap) AS target FROM l),
k AS (SELECT *, greatest(1, CAST(floor(target / 1024) AS BIGINT)) AS packet FROM t),
q AS (SELECT d.*, z, no, target, packet, coalesce(sum(size) OVER (PARTITION BY no ORDER BY md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
c AS (SELECT i, no, target, packet, size, z * copy + start AS start FROM q, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0 AND z * copy + start <= 2 * target),
e AS (SELECT i, no, target, packet, size, start, unnest(range(0, size, packet)) AS before FROM c),
p AS (SELECT i, no, target, start + before AS b, least(packet, size - before) AS n FROM e),
o AS (SELECT i, n, coalesce(sum(n) OVER (ORDER BY CAST(b + n AS DOUBLE) / target, no, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM p),
g AS (SELECT i, CAST(sum(least(n, total - gone)) AS BIGINT) AS taken FROM o, (SELECT CAST(round(sum(target)) AS BIGINT) AS total FROM t) WHERE gone < total GROUP BY i)
SELECT doc_id, size, z AS source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN g USING (i)
""",
    "op8_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
c(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.low FROM c JOIN l ON l.a = c.id),
m AS (SELECT id, min(low) AS component_id FROM c GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
c(id, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.low FROM c JOIN l ON l.a = c.id),
m AS (SELECT id, min(low) AS component_id FROM c GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, m.component_id = e.vec_id AS kept FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN m ON m.id = e.vec_id
""",
}
