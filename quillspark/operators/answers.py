"""Around an answer: facets of a question, texts for a reranker, digests of requests, references to earlier turns, costs, and who
executes a plan (A19, D13, D18, D25, D27, E1, E2, L5, R2, R5, R6)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.router import CONTEXT

# How a question names subjects side by side, and words that make a subject a clause; phrases that ask for more of
# the last answer; units of time after a pronoun; ordinals.
SEPARATE = r"^([^，。？?！!；;\n]+?)(?:分别|各自)(.+)$"
CONNECTOR = r"以及|和|与|及|、"
CLAUSE_WORD = r"在|对于|如果|当|需要|应该|如何|为什么|哪些|什么|怎样|是否"
MORE = r"(?i)\s*(?:请)?(?:展开一下|展开说说|详细点|具体一点|再说说|再解释一下|补充一下|比较一下|用表格展示|用表格列出|关闭前呢|关闭后呢|谁负责|谁来确认|怎么办|怎么样|tell me more|elaborate|expand|in more detail)[？?。.!！ ]*"
DATED = r"(?:这个|那个|这些|那些|这两|那两)[年月日天]"
ORDINALS = "一二三四五六七八九十"
LONGEST_SUBJECT = 40


def facets(query: Column) -> Column:
    """R2: the question, and if all of it says of two or three subjects "A 和 B 分别 ...", the question of each."""
    subjects = F.transform(F.split(F.regexp_extract(query, SEPARATE, 1), CONNECTOR), lambda s: F.trim(s))
    rest = F.regexp_extract(query, SEPARATE, 2)
    plain = F.forall(subjects, lambda s: (F.char_length(s) > 0) & (F.char_length(s) <= LONGEST_SUBJECT) & ~s.rlike(CLAUSE_WORD))
    each = F.transform(subjects, lambda s: F.concat(s, rest))
    return F.when(query.rlike(SEPARATE) & F.size(subjects).between(2, 3) & plain, F.array_distinct(F.concat(F.array(query), each))).otherwise(F.array(query))


def rerank_text(title: Column, name: Column, section: Column, content: Column) -> Column:
    """What a reranker reads of a chunk."""
    return F.concat(F.lit("文档标题："), title, F.lit("\n文件名："), name, F.lit("\n章节："), F.coalesce(section, F.lit("")), F.lit("\n原文：\n"), content)


def status_of(codes: Column, hits: Column, planned: Column) -> Column:
    """Unsupported or skipped as planned, else empty without hits, degraded with any code, ok."""
    return F.when(planned.isin("unsupported", "skipped"), planned).when(hits == 0, "empty").when(F.size(F.array_distinct(codes)) > 0, "degraded").otherwise("ok")


def request_digest(question: Column, client_id: Column, bases: Column, documents: Column, filters: Column, offset: Column, limit: Column) -> Column:
    """One hash for requests that mean the same: the order of ids and filters (structs field, operator, value) does not count,
    and nothing is as null."""
    ids = lambda c: F.when(F.size(c) > 0, F.array_sort(c))
    parts = F.struct(client_id.alias("client_request_id"), ids(documents).alias("document_ids"), F.array_sort(F.coalesce(filters, F.array().cast("array<struct<field:string,operator:string,value:string>>"))).alias("filters"), ids(bases).alias("knowledge_base_ids"), limit.alias("limit"), offset.alias("offset"), question.alias("question"))
    return F.sha2(F.to_json(parts), 256)


def depends_on_history(query: Column) -> Column:
    """Whether a question refers to an earlier turn, in whole ("tell me more") or by a pronoun; one before a unit of time is a
    date."""
    return F.regexp_replace(query, DATED, "").rlike(CONTEXT) | query.rlike(f"^(?:{MORE})$")


def ordinal_place(text: Column) -> Column:
    """Which of the earlier statements an ordinal ("第二") means, from 0; null without one."""
    number = F.regexp_extract(text, r"第\s*([0-9]+|[一二三四五六七八九十]+)", 1)
    single = F.when(F.char_length(number) == 1, F.call_function("instr", F.lit(ORDINALS), number) - 1).otherwise(99)
    return F.when(number == "", None).when(number.rlike("^[0-9]+$"), number.cast("int") - 1).otherwise(single).cast("int")


def rewrite_issues(rows: DataFrame) -> DataFrame:
    """(id, issue) for each rewrite (id, query, question, history array of texts, terms array of (text, quote, history_index),
    replacements array of (start, end, term_index)) that is not the query with references replaced by words that stand in a
    quote from the last turn."""
    r = rows.withColumn("_at", F.array_sort("replacements")).withColumn("_n", F.size("terms"))
    cut = lambda a, b: F.substring(F.col("query"), a + 1, F.greatest(b - a, F.lit(0)))
    text = lambda i: F.get(F.col("terms"), i)["text"]
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_at"), i - 1)["end"])
    pieces = F.transform("_at", lambda x, i: F.concat(cut(before(i), x["start"]), F.coalesce(text(x["term_index"]), F.lit(""))))
    tail = F.when(F.size("_at") > 0, cut(F.element_at("_at", -1)["end"], F.char_length("query"))).otherwise(F.col("query"))
    built = F.concat(F.array_join(pieces, ""), tail)
    overlapping = F.exists(F.transform("_at", lambda x, i: (x["start"] < before(i)) | (x["start"] >= x["end"]) | (x["end"] > F.char_length("query"))), lambda b: b)
    ungrounded = F.exists("terms", lambda t: ~F.coalesce(F.contains(F.get(F.col("history"), t["history_index"]), t["quote"]) & F.contains(t["quote"], t["text"]), F.lit(False)))
    older = F.exists("terms", lambda t: t["history_index"] != F.size("history") - 1)
    own_words = F.exists("_at", lambda x: ~cut(x["start"], x["end"]).rlike(f"^(?:{CONTEXT}|第[0-9{ORDINALS}]+[个条项点]?)$"))
    dated = F.exists("_at", lambda x: cut(x["end"], x["end"] + 1).isin("年", "月", "日", "天"))
    unused = F.size(F.array_except(F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>")), F.transform("_at", lambda x: x["term_index"].cast("int")))) > 0
    issues = F.array(
        F.when(F.size("_at") == 0, "NOTHING_REPLACED"),
        F.when(overlapping, "PLACES_OVERLAP"),
        F.when(ungrounded, "TERM_WITHOUT_QUOTE"),
        F.when(older, "OLDER_TURN"),
        F.when(own_words, "NOT_A_REFERENCE"),
        F.when(dated, "A_DATE"),
        F.when(unused, "TERM_NOT_USED"),
        F.when((built != F.col("question")) | (F.col("question") == F.col("query")), "NOT_THE_REPLACEMENT"),
        F.when(depends_on_history(F.col("question")), "STILL_REFERS"),
    )
    return r.select("id", F.explode(F.array_compact(issues)).alias("issue"))


def usage(stages: DataFrame, key: str, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """(key, input_tokens, output_tokens, cost) over the stages (model, input_tokens, output_tokens) of each key; prices are
    those of a million tokens in and out, and a model without a price costs null. Counts that are null or negative are 0."""
    n = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(0)
    cost = F.lit(None).cast("double")
    for model, (i, o) in prices.items():
        cost = F.when(F.col("model") == model, (n("input_tokens") * i + n("output_tokens") * o) / 1e6).otherwise(cost)
    return stages.groupBy(key).agg(F.sum(n("input_tokens")).alias("input_tokens"), F.sum(n("output_tokens")).alias("output_tokens"), F.round(F.when(F.count(F.lit(1)) == F.count(cost), F.sum(cost)), 6).alias("cost"))


def executor_of(rows: DataFrame, structured_ready: bool = True) -> DataFrame:
    """Rows (route, status, same_identity) with who executes the plan: refused where the scope is another's, structured or
    retrieval, or the planned status itself where there is nothing to execute."""
    structured = F.col("route") == "structured"
    who = F.when(~F.col("same_identity"), "QUERY_SCOPE_FORBIDDEN").when(structured & (F.col("status") != "planned"), F.col("status")).when(structured, F.lit("structured" if structured_ready else "unsupported")).otherwise("retrieval")
    return rows.withColumn("executor", who)


def lacks_header(fragments: DataFrame) -> DataFrame:
    """(answer_id, incomplete): an answer whose evidence has a table fragment (kind, row_start, header_row, content) without
    column names: a fragment that begins behind the first row, knows no header and shows none above a row of dashes."""
    lines = F.split(F.trim("content"), "\n")
    shown = F.exists(lines, lambda x: x.rlike(r"^\s*\|?(\s*:?-{3,}:?\s*\|)+\s*$"))
    lacking = (F.col("kind") == "table") & (F.col("row_start") > 1) & F.col("header_row").isNull() & ~shown
    return fragments.groupBy("answer_id").agg(F.bool_or(F.coalesce(lacking, F.lit(False))).alias("incomplete"))


def scope_conflicts(statements: DataFrame) -> DataFrame:
    """(id, issue) for statements (id, documents they cite, statement, scopes array of (document_id, scope)) that join evidence
    of different scopes without naming each of them."""
    cited = F.filter("scopes", lambda s: F.array_contains("documents", s["document_id"]))
    names = F.array_distinct(F.transform(cited, lambda s: s["scope"]))
    silent = F.exists(names, lambda n: ~F.contains("statement", n))
    return statements.select("id", F.when((F.size(names) > 1) & silent, "SCOPES_MIXED").alias("issue")).where("issue is not null")


_MODELS: dict[str, Callable] = {}


def register_embedder(name: str, embed: Callable[[list[str]], np.ndarray]) -> None:
    """Texts to vectors, a batch at a time."""
    _register(f"embedder {name}", embed)


def register_reranker(name: str, rank: Callable[[list[str], list[str]], list[float]]) -> None:
    """Questions and texts to scores, a batch at a time."""
    _register(f"reranker {name}", rank)


def _register(name: str, model: Callable) -> None:
    if name in _MODELS:
        raise ValueError(f"there is a {name}")
    _MODELS[name] = model


def embedded(rows: DataFrame, name: str, text: str, out: str = "embedding") -> DataFrame:
    """Rows with the vectors of a registered embedder, in Arrow batches."""
    embed = _MODELS[f"embedder {name}"]

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, float).tolist() for v in embed(texts.fillna("").tolist())])

    return rows.withColumn(out, run(text))


def reranked(rows: DataFrame, name: str, query: str, text: str, out: str = "rerank_score") -> DataFrame:
    """Rows with the scores of a registered reranker, in Arrow batches; a batch that fails has none, so that merging falls back
    to the fused order."""
    rank = _MODELS[f"reranker {name}"]

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            try:
                yield pd.Series(list(rank(q.fillna("").tolist(), t.fillna("").tolist())), dtype=float)
            except Exception:  # noqa: BLE001  a model that is down degrades the answer, it does not end the query
                yield pd.Series([None] * len(q), dtype=float)

    return rows.withColumn(out, run(query, text))


def refers(text: str) -> bool:
    """D27 for one question on the driver."""
    return bool(re.search(CONTEXT.removeprefix("(?i)"), re.sub(DATED, "", text), re.I) or re.fullmatch(MORE, text))
