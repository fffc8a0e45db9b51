"""Evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Rounded to four places; null for nothing to divide by."""
    return F.when(b != 0, F.round(a / b, 4))


def multiset_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Precision, recall and F1 where each key counts as often as on both sides."""
    g, p = gold.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_g")), predicted.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_p"))
    j = g.join(p, [*by, *keys], "full_outer").fillna(0, ["_g", "_p"])
    t = j.groupBy(*by).agg(F.sum("_g").alias("gold"), F.sum("_p").alias("predicted"), F.sum(F.least("_g", "_p")).alias("matched"))
    return t.select(*by, "gold", "predicted", "matched", ratio(F.col("matched"), F.col("predicted")).alias("precision"), ratio(F.col("matched"), F.col("gold")).alias("recall"), ratio(2 * F.col("matched"), F.col("gold") + F.col("predicted")).alias("f1"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of a and b with one key that share a place: an equi-join with bounds."""
    y = b.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("span_id").alias("other_id"))
    return a.join(y, keys).where("start < _e and end > _s").drop("_s", "_e")


#: Words of a quote that look it up.
ANCHOR = 8


def _grams(words: str, n: int) -> Column:
    """Distinct hashes of all runs of n words."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))


def containing(quotes: DataFrame, documents: DataFrame, key: str | None = None) -> DataFrame:
    """(quote_id, document_id) of the documents that a quote stands in, word for word. quotes: (quote_id, quote, ...),
    documents: (document_id, text); with a key, a quote is only looked for in documents of its own key.

    Without one, words look quotes up: between blanks, whatever stands in a quote behind its first and before its last word
    are words of each text that contains it. ANCHOR of them, or the first if there are fewer, join texts and quotes by hash.
    Quotes of one or two words have none and are compared with all texts.
    """
    holds = F.contains("text", "quote") & (F.length("quote") > 0)
    if key:
        return quotes.select("quote_id", "quote", key).join(documents, key).where(holds).select("quote_id", "document_id")
    words = lambda c: F.split(c, " ")
    q = quotes.select("quote_id", "quote").withColumn("_w", words("quote")).withColumn("_n", F.size("_w") - 2)
    d = documents.select("document_id", "text").withColumn("_w", words("text"))
    out = q.where("_n < 1").select("quote_id", "quote").join(documents, how="cross").where(holds).select("quote_id", "document_id")
    for n, some in ((ANCHOR, q.where(F.col("_n") >= ANCHOR)), (1, q.where((F.col("_n") >= 1) & (F.col("_n") < ANCHOR)))):
        looked = some.select("quote_id", "quote", F.xxhash64(F.array_join(F.slice("_w", 2, n), " ")).alias("_h"))
        pairs = d.select("document_id", F.explode(_grams("_w", n)).alias("_h")).join(looked.select("quote_id", "_h"), "_h").select("quote_id", "document_id").distinct()
        found = pairs.join(documents.select("document_id", "text"), "document_id").join(quotes.select("quote_id", "quote"), "quote_id")
        out = out.unionByName(found.where(holds).select("quote_id", "document_id"))
    return out.distinct()


def support(relations: DataFrame, gold: DataFrame, negative: DataFrame, key: list[str]) -> DataFrame:
    """Relations (key ..., chunk_id, start, end) with support: exact where gold has the whole key, other_condition where it only
    differs in the last part, else none; and negative: whether the quote overlaps a span (chunk_id, start, end) that supports
    nothing. Spans of a chunk are looked up by blocks of 64 places."""
    exact = gold.select(*key).distinct().withColumn("_exact", F.lit(True))
    near = gold.select(*key[:-1]).distinct().withColumn("_near", F.lit(True))
    same = F.lit(True)
    e = exact.select(*[F.col(k).alias(f"_{k}") for k in key], "_exact")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    r = relations.withColumn("_id", F.monotonically_increasing_id()).join(e, same, "left").join(near, key[:-1], "left")
    blocks = lambda s, z: F.explode(F.sequence(F.floor(F.col(s) / 64), F.floor((F.greatest(F.col(z), F.col(s) + 1) - 1) / 64)))
    n = negative.select("chunk_id", F.col("start").alias("_s"), F.col("end").alias("_z")).withColumn("_b", blocks("_s", "_z"))
    hit = r.select("_id", "chunk_id", "start", "end").withColumn("_b", blocks("start", "end")).join(n, ["chunk_id", "_b"]).where("start < _z and end > _s").select("_id").distinct().withColumn("negative", F.lit(True))
    kind = F.when(F.col("_exact"), "exact").when(F.col("_near"), "other_condition").otherwise("none")
    return r.join(hit, "_id", "left").select(*relations.columns, kind.alias("support"), F.coalesce("negative", F.lit(False)).alias("negative"))


def covered(questions: DataFrame) -> DataFrame:
    """A question passes if all of its references are hit; rows (question_id, hit)."""
    return questions.groupBy("question_id").agg(F.bool_and("hit").alias("passed"), F.count(F.lit(1)).alias("quotes"))


def outcomes(rows: DataFrame, cascade: list[tuple[Column, str]], otherwise: str) -> DataFrame:
    """Each row under the first condition that holds; (outcome, n)."""
    c = F.when(*cascade[0])
    for cond, name in cascade[1:]:
        c = c.when(cond, name)
    return rows.groupBy(c.otherwise(otherwise).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def medians(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact medians."""
    return rows.groupBy(*by).agg(F.round(F.median(value), 4).alias("median"), F.count(F.lit(1)).alias("n"))


def citation_issues(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, valid): every citation exists and stands word for word in its evidence; an answer without any is not."""
    j = answers.join(evidence, "evidence_id", "left")
    ok = F.coalesce(F.contains("content", "quote") & (F.length("quote") > 0), F.lit(False))
    return j.groupBy("answer_id").agg(F.bool_and(ok).alias("valid"), F.count(F.lit(1)).alias("citations"))


#: Levels at which a predicted relation matches, closest first: what must agree besides both ends and the predicate.
LEVELS = ("condition_and_quote", "condition", "triple")


def conditional_matches(gold: DataFrame, predicted: DataFrame, found: DataFrame) -> DataFrame:
    """Gold relations with endpoints_found, matched (the predicted relation's place or null), condition_status and quote_match.

    gold: (chunk_id, place, subject, object, same: whether both ends are one entity, predicate, condition, quote), predicted the
    same but for `same`; subject and object are signatures; found: (chunk_id, signature) of the different entities that were
    predicted. A gold relation counts if both of its ends were found, each as often as it needs. Relations of a chunk are
    matched one to one, gold and predicted in the order of their places, level by level: those that agree in all of a level's
    columns make pairs of equal numbers, which is what taking the first free one in turn comes to. An empty condition is none.
    """
    n = found.groupBy("chunk_id", "signature").agg(F.count(F.lit(1)).alias("_n"))
    had = n.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("signature").isNotNull(), F.struct("signature", "_n")))).alias("_had"))
    need = F.when((F.col("subject") == F.col("object")) & ~F.col("same"), 2).otherwise(1)
    g = gold.join(had, "chunk_id", "left")
    enough = lambda end: F.get(F.map_values(F.map_filter("_had", lambda k, v: k == F.col(end))), 0) >= need
    g = g.withColumn("endpoints_found", F.coalesce(enough("subject") & enough("object"), F.lit(False))).drop("_had")
    bare = F.when(F.col("condition") != "", F.col("condition")).alias("condition")
    shape = ["chunk_id", "place", "subject", "object", "predicate", bare, "quote"]
    rest = [c for c in g.columns if c not in ("chunk_id", "place", "subject", "object", "predicate", "quote")]
    kept = F.struct(*rest)
    side_g = g.select(*shape, F.lit(True).alias("_gold"), F.col("endpoints_found").alias("_open"), kept.alias("_kept"))
    side_p = predicted.select(*shape, F.lit(False).alias("_gold"), F.lit(True).alias("_open"), F.lit(None).cast(side_g.schema["_kept"].dataType).alias("_kept"))
    # both sides lie by chunk, which all windows below keep to
    r = side_g.unionByName(side_p).repartition("chunk_id").withColumn("_hit", F.lit(None).cast(f"struct<place: {predicted.schema['place'].dataType.simpleString()}, condition: string, quote: string>"))
    for level in LEVELS:
        keys = ["chunk_id", "subject", "object", "predicate", "_open"] + ([] if level == "triple" else ["condition"]) + (["quote"] if level == "condition_and_quote" else [])
        r = r.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_gold").orderBy("place")))
        met = Window.partitionBy(*keys, "_nth")
        other = F.max(F.when(~F.col("_gold"), F.struct("place", "condition", "quote"))).over(met)
        r = r.withColumns({"_other": other, "_both": F.col("_open") & F.max("_gold").over(met) & ~F.min("_gold").over(met)})
        r = r.withColumns({"_hit": F.when(F.col("_both") & F.col("_gold"), F.col("_other")).otherwise(F.col("_hit")), "_open": F.col("_open") & ~F.col("_both")}).drop("_nth", "_other", "_both")
    matched = F.col("_hit").isNotNull()
    status = F.when(matched, F.when(F.col("_hit.condition").eqNullSafe(F.col("condition")), "MATCH").otherwise("MISMATCH"))
    quote = F.when(matched, F.col("_hit.quote").eqNullSafe(F.col("quote")))
    columns = [F.col(f"_kept.{c}").alias(c) if c in rest else F.col(c) for c in gold.columns]
    return r.where("_gold").select(*columns, F.col("_kept.endpoints_found").alias("endpoints_found"), F.col("_hit.place").alias("matched"), status.alias("condition_status"), quote.alias("quote_match"))


def conditional_recall(matches: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of conditional_matches(): relations by those whose ends were found, conditions by matched relations."""
    count = lambda c: F.count_if(c)
    t = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("gold"), count(F.col("endpoints_found")).alias("eligible"), F.count("matched").alias("matched"), count(F.col("condition_status") == "MATCH").alias("same_condition"), count(F.col("quote_match")).alias("same_quote"))
    return t.select("*", ratio(F.col("matched"), F.col("eligible")).alias("recall"), ratio(F.col("same_condition"), F.col("matched")).alias("condition_accuracy"))
