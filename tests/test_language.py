"""The rules that read language, on sentences with the verdict that a rule must come to."""

from pyspark.sql import functions as F

from quillspark.operators import answers, relations

# Text of the chunk, quote, subject, object, their types, predicate, condition, issues.
EVIDENCE = (
    ("采购员负责审核预算。", "采购员负责审核预算", "采购员", "审核预算", "Actor", "Step", "RESPONSIBLE_FOR", "", ()),
    ("别的内容。", "采购员负责审核预算", "采购员", "审核预算", "Actor", "Step", "RESPONSIBLE_FOR", "", ("QUOTE_NOT_IN_CHUNK",)),
    ("采购员负责审核预算。", "采购员负责审核预算", "采购员", "付款", "Actor", "Step", "RESPONSIBLE_FOR", "", ("NAME_NOT_IN_QUOTE",)),
    ("采购员负责审核预算。", "采购员负责审核预算", "采购员", "审核预算", "Actor", "Step", "RESPONSIBLE_FOR", "若超额", ("CONDITION_NOT_IN_QUOTE",)),
    ("开头。如果超额，采购员负责审核预算。", "采购员负责审核预算", "采购员", "审核预算", "Actor", "Step", "RESPONSIBLE_FOR", "", ("CONDITION_LEFT_OUT",)),
    ("开头。如果超额，采购员负责审核预算。", "如果超额，采购员负责审核预算", "采购员", "审核预算", "Actor", "Step", "RESPONSIBLE_FOR", "如果超额", ()),
    ("预算表金额", "预算表金额", "预算表", "金额", "Material", "Field", "HAS_FIELD", "", ("FIELD_WITHOUT_EVIDENCE",)),
    ("预算表包含金额", "预算表包含金额", "预算表", "金额", "Material", "Field", "HAS_FIELD", "", ()),
    ("通知采购员领料", "通知采购员领料", "采购员", "通知采购员领料", "Actor", "Step", "CONFIRMS", "", ("ACTOR_IS_OBJECT",)),
    ("通知由采购员领料", "通知由采购员领料", "采购员", "通知由采购员领料", "Actor", "Step", "CONFIRMS", "", ()),
    ("前句，采购员不得审核预算", "采购员不得审核预算", "采购员", "审核预算", "Actor", "Step", "REVIEWS", "", ("NEGATED_ACTION",)),
    ("预算不得超支", "预算不得超支", "预算", "超支", "Material", "Rule", "GOVERNED_BY", "", ()),
)
#: The same columns, and whether the relation may be a hop.
STRICT = (
    ("采购员负责审核预算。", "采购员负责审核预算", "采购员", "审核预算", "Actor", "Step", "RESPONSIBLE_FOR", "", True),
    ("审核预算由采购员负责", "审核预算由采购员负责", "采购员", "审核预算", "Actor", "Step", "RESPONSIBLE_FOR", "", False),
    ("领料不需要提交申请表", "领料不需要提交申请表", "领料", "申请表", "Step", "Material", "REQUIRES_MATERIAL", "", False),
    ("前句。领料需要提交申请表", "领料需要提交申请表", "领料", "申请表", "Step", "Material", "REQUIRES_MATERIAL", "", True),
    ("如果超额，领料需要提交申请表。", "如果超额，领料需要提交申请表", "领料", "申请表", "Step", "Material", "REQUIRES_MATERIAL", "如果超额", True),
    ("如果超额，领料需要提交申请表。", "如果超额，领料需要提交申请表", "领料", "申请表", "Step", "Material", "REQUIRES_MATERIAL", "超额", False),
    ("除非停工，月末，盘点后，领料需要提交申请表。", "除非停工，月末，盘点后，领料需要提交申请表", "领料", "申请表", "Step", "Material", "REQUIRES_MATERIAL", "除非停工，月末，盘点后", True),
    ("领料和申请表", "领料和申请表", "领料", "申请表", "Step", "Material", "REQUIRES_MATERIAL", "", False),
    ("经理审核预算", "经理审核预算", "经理", "审核预算", "Actor", "Step", "REVIEWS", "", True),
)
_COLUMNS = "content string, quote string, subject_name string, object_name string, subject_type string, object_type string, predicate string, condition_text string"

# Questions and how many they are with their facets.
QUESTIONS = (("预算和决算分别由谁审核", 3), ("预算、决算以及结算各自的期限", 4), ("预算由谁审核", 1), ("如果超额和延期分别怎么办", 1), ("甲和乙、丙与丁分别是谁", 1), ("预算和预算分别由谁审核", 2))
#: Questions, and whether they refer to an earlier turn.
TURNS = (("它由谁审核", True), ("这个月的预算", False), ("这个预算", True), ("预算由谁审核", False), ("详细点。", True), ("请详细点说明预算", False), ("what about those", True), ("Tell me more!", True), ("the italic style", False))

# Query, question, history, terms, replacements, issues.
REWRITES = (
    ("它由谁审核", "预算由谁审核", ("预算是多少",), (("预算", "预算是", 0),), ((0, 1, 0),), ()),
    ("它由谁审核", "预算由谁审核", ("旧", "预算是多少"), (("预算", "预算是", 0),), ((0, 1, 0),), ("TERM_WITHOUT_QUOTE", "OLDER_TURN")),
    ("它由谁审核", "决算由谁审核", ("预算是多少",), (("决算", "预算是", 0),), ((0, 1, 0),), ("TERM_WITHOUT_QUOTE",)),
    ("它由谁审核", "预算由经理审核", ("预算是多少",), (("预算", "预算是", 0),), ((0, 1, 0),), ("NOT_THE_REPLACEMENT",)),
    ("甲由谁审核", "预算由谁审核", ("预算是多少",), (("预算", "预算是", 0),), ((0, 1, 0),), ("NOT_A_REFERENCE",)),
    ("它和它由谁审核", "预算和它由谁审核", ("预算是多少",), (("预算", "预算是", 0),), ((0, 1, 0),), ("STILL_REFERS",)),
    ("它由谁审核", "它由谁审核", ("预算是多少",), (), (), ("NOTHING_REPLACED", "NOT_THE_REPLACEMENT", "STILL_REFERS")),
    ("那个月由谁审核", "预算月由谁审核", ("预算是多少",), (("预算", "预算是", 0),), ((0, 2, 0),), ("A_DATE",)),
)


def _relations(spark, rows):
    return spark.createDataFrame([(i, *r[:8]) for i, r in enumerate(rows)], f"n int, {_COLUMNS}")


def test_evidence_issues(spark):
    got = {r.n: tuple(r.issues) for r in _relations(spark, EVIDENCE).select("n", relations.evidence_issues().alias("issues")).collect()}
    assert got == {i: r[8] for i, r in enumerate(EVIDENCE)}


def test_strict_relations(spark):
    rows = _relations(spark, STRICT).withColumn("quote_start", relations.at(F.col("content"), F.col("quote")))
    assert {r.n: r.fits for r in rows.select("n", relations.strict_path_relation().alias("fits")).collect()} == {i: r[8] for i, r in enumerate(STRICT)}


def test_facets_and_references(spark):
    q = spark.createDataFrame([(f"{q}？", n) for q, n in QUESTIONS], "q string, n int").select("q", "n", F.size(answers.facets(F.col("q"))).alias("got"))
    assert all(r.n == r.got for r in q.collect())
    t = spark.createDataFrame(TURNS, "q string, refers boolean").select("refers", answers.depends_on_history(F.col("q")).alias("got"))
    assert all(r.refers == r.got for r in t.collect())


def test_rewrites(spark):
    rows = spark.createDataFrame([(i, q, n, list(h), list(t), list(r)) for i, (q, n, h, t, r, _) in enumerate(REWRITES)], "id int, query string, question string, history array<string>, terms array<struct<text:string,quote:string,history_index:int>>, replacements array<struct<start:int,end:int,term_index:int>>")
    assert sorted(map(tuple, answers.rewrite_issues(rows).collect())) == sorted((i, c) for i, r in enumerate(REWRITES) for c in r[5])


def test_periods_as_columns(spark):
    """As the driver's period() of one word has it, all words and ways of writing."""
    from datetime import datetime, timezone

    from quillspark.functions import periods
    from quillspark.plans import router

    now = datetime(2024, 3, 31, 18, 30, tzinfo=timezone.utc)
    texts = [*periods.WORDS, "2024", "2024年", "2024-2", "2024年2月", "2024/02/29", "2023-02-29", "2024年12月31日", "20240229", "soon", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("now", F.lit("2024-03-31 18:30:00").cast("timestamp"))
    got = {r.t: (r.a, r.z) for r in periods.with_periods(rows, "t", "now").select("t", F.unix_timestamp("start").alias("a"), F.unix_timestamp("end").alias("z")).collect()}
    for t in texts:
        try:
            want = tuple(int(x.timestamp()) for x in periods.period(t, now))
        except (ValueError, AttributeError):
            want = None, None
        assert got[t] == want, t
    for q, op in (("当前知识库中有多少文档", "count"), ("统计文档数量", "count"), ("查看所有文档", "list"), ("知识库有几份资料", "count"), ("列出知识库里全部文件", "list"), ("文档在哪里", None)):
        assert router.catalog_operation(q) == op
