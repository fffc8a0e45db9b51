"""Queries of the rules that read language, over the texts of documents and conversations. The rules ask for Chinese words, which
the texts lack, so these are put between a text's own words; the SQL states each rule again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, identity, relations
from . import adapters as x
from .queries import query

_CONTEXT = r"(?i)它|他|她|这个|那个|这些|那些|这两|那两|上述|前者|后者|刚才|上面|继续|然后呢|(?:^|[^\pL\pN_])(?:it|they|them|this|that|those|these|former|latter)(?:[^\pL\pN_]|$)"
_REFERS = rf"(regexp_matches(regexp_replace({{0}}, '{answers.DATED}', '', 'g'), '{_CONTEXT}') OR regexp_full_match({{0}}, '{answers.MORE}'))"

# --- R2

_ASKED = r"""q AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\n.?!;]', ' ', 'g')[:300], ', ') AS p FROM documents),
a AS (SELECT doc_id, CASE WHEN len(p) >= 3 THEN concat(p[1], ['和', '以及', '、', ' and ', '与', '如果及'][doc_id % 6 + 1], p[2], CASE WHEN doc_id % 7 = 6 THEN '和' || p[1] ELSE '' END, ['分别', '各自', ', '][doc_id % 3 + 1], p[3]) ELSE p[1] END AS question FROM q)"""


@query(rf"""WITH {_ASKED}, s AS (SELECT doc_id, question, regexp_extract(question, '{answers.SEPARATE}', 2) AS rest, list_transform(regexp_split_to_array(regexp_extract(question, '{answers.SEPARATE}', 1), '{answers.CONNECTOR}'), lambda v: trim(v)) AS subjects FROM a),
f AS (SELECT doc_id, question, CASE WHEN regexp_matches(question, '{answers.SEPARATE}') AND len(subjects) BETWEEN 2 AND 3 AND len(list_filter(subjects, lambda v: length(v) = 0 OR length(v) > {answers.LONGEST_SUBJECT} OR regexp_matches(v, '{answers.CLAUSE_WORD}'))) = 0 THEN list_distinct(list_prepend(question, list_transform(subjects, lambda v: v || rest))) ELSE [question] END AS facets FROM s)
SELECT doc_id, len(facets) AS facets, md5(array_to_string(list_sort(facets), '|')) AS told FROM f""")
def facet_split(spark, sf):
    """R2: two pieces of a document's text as subjects, some too long, joined in ways that make facets and in others."""
    d = x.table(spark, sf, "documents").select("doc_id", F.split(F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n.?!;]", " "), 1, 300), ", ").alias("p"))
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % len(words) + 1).cast("int"))
    p = lambda i: F.get("p", i)
    third = F.when(F.col("doc_id") % 7 == 6, F.concat(F.lit("和"), p(0))).otherwise("")
    question = F.when(F.size("p") >= 3, F.concat(p(0), pick(("和", "以及", "、", " and ", "与", "如果及")), p(1), third, pick(("分别", "各自", ", ")), p(2))).otherwise(p(0))
    facets = answers.facets(question)
    return d.select("doc_id", F.size(facets).alias("facets"), F.md5(F.array_join(F.array_sort(facets), "|")).alias("told"))


# --- D27

_TOLD = r"""m AS (SELECT conv_id * 1000 + turn AS id, role, coalesce(text, '') AS text, coalesce(lag(text) OVER w, '') AS last, coalesce(lag(text, 2) OVER w, '') AS older FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT *, CASE id % 9 WHEN 0 THEN '请展开一下。' WHEN 1 THEN '这个月' || text WHEN 2 THEN '那个' || text WHEN 3 THEN 'Tell me more!' WHEN 4 THEN 'tell me more of ' || text ELSE text END AS said FROM m)"""


def _told(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    text = lambda c: F.coalesce(c, F.lit(""))
    m = x.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", text(F.col("text")).alias("text"), text(F.lag("text").over(w)).alias("last"), text(F.lag("text", 2).over(w)).alias("older"))
    n = F.col("id") % 9
    said = F.when(n == 0, "请展开一下。").when(n == 1, F.concat(F.lit("这个月"), "text")).when(n == 2, F.concat(F.lit("那个"), "text")).when(n == 3, "Tell me more!").when(n == 4, F.concat(F.lit("tell me more of "), "text")).otherwise(F.col("text"))
    return m.withColumn("said", said)


@query(f"WITH {_TOLD} SELECT id, {_REFERS.format('said')} AS refers FROM t")
def history_references(spark, sf):
    """Which turns refer to earlier ones, by a word of theirs, a phrase, or not by a date."""
    return _told(spark, sf).select("id", answers.depends_on_history(F.col("said")).alias("refers"))


_REWRITTEN = r"""u AS (SELECT id, last, older, regexp_extract(last, '[A-Za-z]+', 0) AS word, regexp_replace(text, '\n', ' ', 'g')[:60] AS body FROM m WHERE role = 'user' AND last <> ''),
r AS (SELECT id, last, older, word, concat(CASE id % 8 WHEN 4 THEN '甲' WHEN 5 THEN '那个' WHEN 6 THEN '第二条' ELSE '它' END, CASE WHEN id % 8 = 5 THEN '月' ELSE ' ' END, body) AS query, CASE id % 8 WHEN 5 THEN 2 WHEN 6 THEN 3 ELSE 1 END AS stop, CASE WHEN id % 8 = 2 THEN '决算' ELSE word END AS term, CASE WHEN id % 5 = 3 THEN 0 ELSE 1 END AS turn_no, id % 8 <> 7 AS replaced, CASE WHEN id % 8 = 3 THEN '又' ELSE '' END AS extra, body FROM u),
z AS (SELECT *, CASE WHEN replaced THEN term || query[stop + 1:] ELSE query END AS built FROM r),
n AS (SELECT *, built || extra AS question, CASE WHEN turn_no = 1 THEN last ELSE older END AS seen FROM z)"""


@query(rf"""WITH {_TOLD}, {_REWRITTEN} SELECT id, issue FROM (SELECT id, unnest(list_filter([
 CASE WHEN NOT replaced THEN 'NOTHING_REPLACED' END,
 CASE WHEN NOT (contains(seen, last[:40]) AND contains(last[:40], term)) THEN 'TERM_WITHOUT_QUOTE' END,
 CASE WHEN turn_no <> 1 THEN 'OLDER_TURN' END,
 CASE WHEN replaced AND query[:stop] NOT IN ('它', '那个', '第二条') THEN 'NOT_A_REFERENCE' END,
 CASE WHEN replaced AND query[stop + 1] IN ('年', '月', '日', '天') THEN 'A_DATE' END,
 CASE WHEN NOT replaced THEN 'TERM_NOT_USED' END,
 CASE WHEN built <> question OR question = query THEN 'NOT_THE_REPLACEMENT' END,
 CASE WHEN {_REFERS.format('question')} THEN 'STILL_REFERS' END], lambda i: i IS NOT NULL)) AS issue FROM n)""")
def rewrite_check(spark, sf):
    """users' turns that begin with a reference, rewritten with the first word of the turn before; of each eight one has a word
    that is nowhere, one another question, one no reference, one a date, one nothing replaced, and some quote an older turn."""
    k = F.col("id") % 8
    u = _told(spark, sf).where("role = 'user' and last <> ''").withColumns({"word": F.regexp_extract("last", "[A-Za-z]+", 0), "body": F.substring(F.regexp_replace("text", "\n", " "), 1, 60)})
    lead = F.when(k == 4, "甲").when(k == 5, "那个").when(k == 6, "第二条").otherwise("它")
    stop = F.when(k == 5, 2).when(k == 6, 3).otherwise(1)
    term = F.when(k == 2, "决算").otherwise(F.col("word"))
    asked = F.concat(lead, F.when(k == 5, "月").otherwise(" "), "body")
    u = u.withColumns({"query": asked, "stop": stop, "term": term})
    built = F.when(k == 7, F.col("query")).otherwise(F.concat("term", F.expr("substring(query, stop + 1)")))
    terms = F.array(F.struct(F.col("term").alias("text"), F.substring("last", 1, 40).alias("quote"), F.when(F.col("id") % 5 == 3, 0).otherwise(1).alias("history_index")))
    places = F.array(F.struct(F.lit(0).alias("start"), F.col("stop").alias("end"), F.lit(0).alias("term_index")))
    none = F.array().cast("array<struct<start: int, end: int, term_index: int>>")
    rows = u.select("id", "query", F.concat(built, F.when(k == 3, "又").otherwise("")).alias("question"), F.array("older", "last").alias("history"), terms.alias("terms"), F.when(k == 7, none).otherwise(places).alias("replacements"))
    return answers.rewrite_issues(rows)


# --- G5, G16, G19

_STATED = r"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')[:6] AS w FROM documents),
s AS (SELECT doc_id, doc_id % 13 AS k, w, w[1] AS a, array_to_string(w[5:6], ' ') AS b FROM w WHERE len(w) = 6 AND length(w[1]) > 1),
v AS (SELECT doc_id, k, w, CASE WHEN k = 2 THEN '无名' WHEN k = 8 THEN w[5] ELSE a END AS subject, CASE WHEN k = 8 THEN array_to_string(w[4:6], ' ') ELSE b END AS object,
 CASE k WHEN 6 THEN 'HAS_FIELD' WHEN 7 THEN 'HAS_FIELD' WHEN 8 THEN 'REVIEWS' WHEN 10 THEN 'GOVERNED_BY' WHEN 12 THEN 'RESPONSIBLE_FOR' ELSE 'REQUIRES_MATERIAL' END AS predicate,
 CASE k WHEN 3 THEN '若超额' WHEN 5 THEN '如果晚了' WHEN 11 THEN '如果晚了' ELSE '' END AS condition,
 concat(CASE k WHEN 11 THEN '如果晚了，' ELSE '' END, a, CASE k WHEN 7 THEN '包含' WHEN 9 THEN '不得' WHEN 10 THEN '不得' WHEN 12 THEN '负责' ELSE '需要' END, array_to_string(w[2:6], ' ')) AS q FROM s),
c AS (SELECT *, concat('前句。', CASE k WHEN 4 THEN '如果晚了，' WHEN 5 THEN '如果晚了，' ELSE '' END, q, '。后句') AS content, CASE WHEN k = 1 THEN q || '了' ELSE q END AS quote FROM v),
p AS (SELECT *, instr(content, quote) - 1 AS begin, instr(quote, subject) - 1 AS actor, instr(quote, object) - 1 AS action FROM c),
h AS (SELECT *, regexp_split_to_array(trim(regexp_split_to_array(content[:greatest(begin, 0)], '[。！？!?；;\n]')[-1] || quote), '[，,。；;\n]')[1] AS head, regexp_split_to_array(content[:greatest(begin + action, 0)], '[，,。！？!?；;\n]')[-1] || object AS up_to FROM p),
i AS (SELECT *, list_filter([
 CASE WHEN NOT contains(content, quote) THEN 'QUOTE_NOT_IN_CHUNK' END,
 CASE WHEN NOT (contains(quote, subject) AND contains(quote, object)) THEN 'NAME_NOT_IN_QUOTE' END,
 CASE WHEN NOT contains(quote, condition) THEN 'CONDITION_NOT_IN_QUOTE' END,
 CASE WHEN condition = '' AND regexp_matches(head, '^(?:如果|必要时|尚缺少)|若|如(?:有|改变|无法|不能|发现)|时|后') THEN 'CONDITION_LEFT_OUT' END,
 CASE WHEN predicate = 'HAS_FIELD' AND NOT regexp_matches(quote, '包含|包括|含有|字段|填写|填入|写出|记录|保留|记载|列出|表头|栏[目位]|[|\t]') THEN 'FIELD_WITHOUT_EVIDENCE' END,
 CASE WHEN predicate IN ('RESPONSIBLE_FOR', 'REVIEWS', 'CONFIRMS') AND action >= 0 AND action < actor AND actor < action + length(object) AND NOT contains(quote, '由' || subject) THEN 'ACTOR_IS_OBJECT' END,
 CASE WHEN predicate <> 'GOVERNED_BY' AND regexp_matches(up_to, '而不是|不得|不能|不要|不应|禁止') THEN 'NEGATED_ACTION' END], lambda e: e IS NOT NULL) AS issues FROM h)"""


def _stated(spark, sf):
    w = lambda i: F.get("w", i)
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    k = F.col("doc_id") % 13
    d = x.table(spark, sf, "documents").select("doc_id", F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), 0), 1, 6).alias("w")).where((F.size("w") == 6) & (F.length(w(0)) > 1))
    verb = F.when(k == 7, "包含").when(k.isin(9, 10), "不得").when(k == 12, "负责").otherwise("需要")
    late = lambda *n: F.when(k.isin(*n), "如果晚了，").otherwise("")
    said = F.concat(late(11), w(0), verb, joined(2, 5))
    rows = d.select(
        "doc_id", F.when(k == 2, "无名").when(k == 8, w(4)).otherwise(w(0)).alias("subject_name"), F.when(k == 8, joined(4, 3)).otherwise(joined(5, 2)).alias("object_name"),
        F.when(k.isin(6, 7), "HAS_FIELD").when(k == 8, "REVIEWS").when(k == 10, "GOVERNED_BY").when(k == 12, "RESPONSIBLE_FOR").otherwise("REQUIRES_MATERIAL").alias("predicate"),
        F.when(k == 3, "若超额").when(k.isin(5, 11), "如果晚了").otherwise("").alias("condition_text"), F.lit("Actor").alias("subject_type"), F.lit("Material").alias("object_type"),
        F.concat(F.lit("前句。"), late(4, 5), said, F.lit("。后句")).alias("content"), F.when(k == 1, F.concat(said, F.lit("了"))).otherwise(said).alias("quote"),
    )
    return rows.withColumn("quote_start", relations.at(F.col("content"), F.col("quote")))


@query(f"WITH {_STATED} SELECT doc_id, unnest(issues) AS issue FROM i")
def evidence_validator(spark, sf):
    """Statements of a document's first words, of thirteen ways to err or not."""
    return _stated(spark, sf).select("doc_id", F.explode(relations.evidence_issues()).alias("issue"))


@query(f"""WITH {_STATED}, b AS (SELECT *, quote[actor + length(subject) + 1:action] AS between_, trim(regexp_split_to_array(content[:greatest(begin + actor, 0)], '[。！？!?；;\n]')[-1]) AS preceding FROM i),
l AS (SELECT *, string_split(replace(preceding, ',', '，'), '，') AS pieces FROM b), f AS (SELECT *, list_filter(range(1, len(pieces) + 1), lambda n: regexp_matches(trim(pieces[n]), '^(?:如果|只有|只要|仅在|除非|必要时|尚缺少)|(?:时|后)$')) AS hits FROM l),
g AS (SELECT *, CASE WHEN len(hits) > 0 THEN trim(array_to_string(pieces[hits[1]:hits[-1]], '，')) ELSE '' END AS lead FROM f)
SELECT doc_id, len(issues) = 0 AND actor >= 0 AND action > actor AND NOT regexp_matches(between_, '{relations.NEGATED_BETWEEN}') AND (lead = '' OR lead = condition) AND
 CASE predicate WHEN 'REQUIRES_MATERIAL' THEN regexp_matches(between_, '{relations.TRIGGERS["REQUIRES_MATERIAL"]}') WHEN 'HAS_FIELD' THEN regexp_matches(between_, '{relations.TRIGGERS["HAS_FIELD"]}') WHEN 'RESPONSIBLE_FOR' THEN regexp_matches(between_, '{relations.TRIGGERS["RESPONSIBLE_FOR"]}') WHEN 'REVIEWS' THEN regexp_matches(between_, '{relations.TRIGGERS["REVIEWS"]}') ELSE false END AS fits FROM g""")
def strict_path_relations(spark, sf):
    """Which of the same statements may be a hop of a path."""
    return _stated(spark, sf).select("doc_id", relations.strict_path_relation().alias("fits"))


_PLACED = r"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{2,}')[:9] AS w FROM documents),
q AS (SELECT doc_id, w[1] AS one, w[2] AS two, w[3] AS entity, concat(w[1], ['中', '内', '的', '和'][doc_id % 4 + 1], '有', w[3], CASE WHEN doc_id % 5 = 0 THEN '。' ELSE '，' END, w[2], CASE WHEN doc_id % 3 = 0 THEN '的' ELSE '' END, w[4], chr(10), w[3], CASE doc_id % 6 WHEN 0 THEN '仅用于' WHEN 1 THEN '用于' ELSE '不用于' END, w[5], ' ', w[6], '流程。', w[7]) AS q FROM w WHERE len(w) = 9)"""


@query(rf"""WITH {_PLACED}, c AS (SELECT *, list_filter(regexp_split_to_array(q, '[。；;\n]'), lambda c: contains(c, entity)) AS own FROM q),
u AS (SELECT *, list_filter([one, two], lambda n: len(list_filter(own, lambda c: contains(c, n || '中') OR contains(c, n || '内') OR contains(c, n || '的'))) > 0) AS inside, flatten(list_transform(own, lambda c: list_filter(list_transform(string_split(c, entity)[2:], lambda t: regexp_extract(t, '^(?:仅)?用于([^，,。；;\n]{{2,80}}流程)', 1)), lambda t: t <> ''))) AS used FROM c)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(inside || used, lambda n: lower(n)))), ',') AS contexts FROM u""")
def context_extraction(spark, sf):
    """A text's first words as names, an entity and what it is used for, in clauses that say so or do not."""
    w = lambda i: F.get("w", i - 1)
    k = F.col("doc_id")
    d = x.table(spark, sf, "documents").select("doc_id", F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{2,}"), 0), 1, 9).alias("w")).where(F.size("w") == 9)
    inside = F.element_at(F.array(*[F.lit(c) for c in ("中", "内", "的", "和")]), (k % 4 + 1).cast("int"))
    used = F.when(k % 6 == 0, "仅用于").when(k % 6 == 1, "用于").otherwise("不用于")
    quote = F.concat(w(1), inside, F.lit("有"), w(3), F.when(k % 5 == 0, "。").otherwise("，"), w(2), F.when(k % 3 == 0, "的").otherwise(""), w(4), F.lit("\n"), w(3), used, w(5), F.lit(" "), w(6), F.lit("流程。"), w(7))
    return d.select("doc_id", F.array_join(identity.explicit_contexts(F.array(w(1), w(2)), w(3), quote), ",").alias("contexts"))
