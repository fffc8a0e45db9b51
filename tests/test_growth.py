"""What steps make of large groups: rows that pass a plan's nodes, and results where groups are large or values odd."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from quillspark.operators import audit, graph, guards, identity, metrics, paths, relations, scope
from quillspark.plans import adapters, graph_queries


def passed(df):
    """(collected rows, the most rows that a join gave, records of all shuffles)."""
    rows, seen = df.collect(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        metric = lambda m: node.metrics().get(m).get().value() if node.metrics().contains(m) else 0
        seen.append((name, metric("numOutputRows"), metric("shuffleRecordsWritten")))
        if name.endswith("QueryStage"):
            return walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, max([n for name, n, _ in seen if "Join" in name], default=0), sum(n for _, _, n in seen)


def shuffled(df):
    """Bytes that all exchanges wrote; one that is used again counts once."""
    total, stack, seen = 0, [df._jdf.queryExecution().executedPlan()], set()
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if name == "ReusedExchange" or name == "Exchange" and node.id() in seen:
            continue
        seen.add(node.id())
        total += node.metrics().get("shuffleBytesWritten").get().value() if name == "Exchange" else 0
        stack += [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
    return total


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bridges_of_a_common_name_are_made_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(identity, "BLOCK", 7)
    n = 150
    rows = [(1, 1, i, "Material", "Red", ["red", "rouge", "red"], ["c"] if i % 2 else [], i, ["red"] if i % 3 == 0 else [f"d{i}"], [], False) for i in range(n)]
    df = spark.createDataFrame(rows, "tenant_id int, kb_id int, uid long, type string, name string, names array<string>, contexts array<string>, document_id long, titles array<string>, declared array<string>, denied boolean")
    got, _, records = passed(identity.bridges(df.unionAll(df)).select("source_uid", "target_uid", "basis", "canonical_name"))
    basis = lambda a, b: "shared_context" if a % 2 and b % 2 else "explicit_document" if a % 3 == 0 or b % 3 == 0 else None
    want = [(a, b, basis(a, b), "red") for a in range(n) for b in range(n) if a != b and basis(a, b)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert records < len(want) / 4


def test_kinds_of_mentions_are_found_before_rows_are_exchanged(spark):
    n = 400
    rows = [(1, 1, i, "Material", "Red", ["red"], ["c"], i, [], [], False) for i in range(n)]
    df = spark.createDataFrame(rows, "tenant_id int, kb_id int, uid long, type string, name string, names array<string>, contexts array<string>, document_id long, titles array<string>, declared array<string>, denied boolean")
    got, _, records = passed(identity.bridges(df).select("source_uid", "target_uid", "basis", "canonical_name"))
    assert len(got) == n * (n - 1)
    assert records < 3 * n


def test_texts_that_deny_or_declare_are_found_by_each_word(spark):
    denying = ["red不是同一", "red并非同一", "red不属于同一", "red不代表同一", "red不等同于同一", "red不能视为同一", "red同名不等于", "red同名而不同", "red禁止混用", "red不得合并", "red不应视为同一", "red旧版不适用当前", "red属于不同材料", "red是不同表单", "red, red并不相同", "RED不可混用"]
    others = ["red 一般", "red称为", "并非", "red; 不是同一", "禁止red", "", None, "red是red"]
    declaring = {"redish 以下简称red": ["redish"], "Redish 简称“red”": ["redish"], "redish又称red。blue又称green": ["redish", "blue"], "redish别名为red": ["redish"]}
    texts = [*denying, *others, *declaring]
    rows = spark.createDataFrame([(i, ["red"], t, "T", "f.pdf") for i, t in enumerate(texts)], "uid int, names array<string>, content string, document_title string, document_name string")
    got = {r.uid: (r.denied, r.declared) for r in identity.mentions(rows).collect()}
    want = [(True, []) for _ in denying] + [(None if t is None else False, None if t is None else []) for t in others] + [(False, d) for d in declaring.values()]
    assert [got[i] for i in range(len(texts))] == want


def test_a_snapshot_counts_ends_one_by_one(spark):
    a = spark.createDataFrame([(1, 5, 10, 0), (2, 5, None, 0), (3, 10, 5, 0), (4, None, 7, 1), (5, None, None, 2)], "assertion_id long, subject long, object long, place int")
    df = graph.snapshot(a, "place")
    md5 = {r.place: r.m for r in spark.createDataFrame([(0, "5,10"), (1, "7"), (2, "")], "place int, s string").select("place", F.md5("s").alias("m")).collect()}
    assert sorted(map(tuple, df.collect())) == [(0, 3, 2, 2, md5[0]), (1, 1, 0, 1, md5[1]), (2, 1, 0, 0, md5[2])]
    assert "Expand" not in plan(df) and "collect_set" not in plan(df)


def test_words_of_guards_end_at_letters_beyond_ascii(spark):
    rows = [(1, "Noñas", "so"), (2, "so", "año no"), (3, "so", "éif"), (4, "so", "_if if_ nota"), (5, "MUſT NOT", "so"), (6, "so", "unleſs")]
    df = spark.createDataFrame(rows, "id int, statement string, evidence string")
    assert sorted(map(tuple, guards.guards(df).collect())) == [(1, "NEGATION_DIFFERS"), (2, "NEGATION_DIFFERS"), (3, "CONDITION_DROPPED"), (5, "NEGATION_DIFFERS"), (6, "CONDITION_DROPPED")]


def test_scopes_meet_bases_and_not_their_documents(spark):
    bases = spark.createDataFrame([(1,), (2,)], "kb_id int")
    docs = spark.range(100).select(F.col("id").alias("document_id"), (1 + F.col("id") % 2).cast("int").alias("kb_id"), F.lit("PUBLISHED").alias("status"), F.col("id").alias("active_generation_id"))
    gens = docs.select("document_id", F.col("document_id").alias("generation_id"), F.when(F.col("document_id") % 5 == 0, "BUILDING").otherwise("READY").alias("status"))
    asked = spark.range(200).select(F.col("id").alias("request_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1))).alias("kb_ids"), F.when(F.col("id") % 10 == 0, F.array(F.lit(2), F.lit(10))).cast("array<long>").alias("document_ids"))
    got, most, _ = passed(scope.resolve_scopes(asked, bases, docs, gens))
    assert {(r.code, r.authorized, r.published) for r in got} == {(None, 100, 80), (None, 50, 40), (None, 2, 1)}
    assert most <= 400
    assert scope.provenance_holds(scope.resolve_scopes(asked, bases, docs, gens), scope.resolve_scopes(asked, bases, docs, gens)).where("holds").count() == 200


def test_chunks_are_numbered_in_their_row(spark, tmp_path):
    spark.createDataFrame([(1, "a\n \nb\n\nc"), (2, None), (3, " \n"), (4, "d")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = adapters.chunks(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, 0, 100000, "a"), (1, 1, 100001, "b"), (1, 2, 100002, "c"), (4, 0, 400000, "d")]
    assert "Exchange" not in plan(df)


def test_members_of_a_department_meet_its_bases_once(spark):
    grants = [(1, kb, 5, None, "ADMIN") for kb in (1, 2) for _ in range(100)] + [(1, 3, None, 7, "ADMIN"), (1, 1, None, 7, "ADMIN"), (1, 4, 5, None, "READ"), (2, 9, 5, None, "ADMIN"), (1, None, 6, None, "ADMIN")]
    g = spark.createDataFrame(grants, "tenant_id int, kb_id int, department_id int, user_id long, permission string")
    m = spark.createDataFrame([(1, u, 5) for u in range(50)] + [(1, 7, 6), (1, 60, None)], "tenant_id int, user_id long, department_id int")
    got, most, _ = passed(scope.members_with(g, m, "ADMIN").select("tenant_id", "kb_id", "user_id"))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, kb, u) for kb in (1, 2) for u in range(50)] + [(1, 3, 7), (1, None, 7)]))
    assert most <= 52


def test_relations_of_a_chunk_are_matched_where_they_lie(spark):
    g = spark.createDataFrame([(1, 1, "a", "b", False, "r", "late", "q"), (1, 2, "a", "b", False, "r", None, "t"), (1, 3, "a", "c", False, "r", "", "q")], "chunk_id long, place int, subject string, object string, same boolean, predicate string, condition string, quote string")
    p = spark.createDataFrame([(1, 1, "a", "b", "r", "", "q"), (1, 2, "a", "b", "r", "late", "x")], "chunk_id long, place int, subject string, object string, predicate string, condition string, quote string")
    df = metrics.conditional_matches(g, p, spark.createDataFrame([(1, "a"), (1, "b"), (1, None)], "chunk_id long, signature string"))
    got = df.select("place", "condition", "endpoints_found", "matched", "condition_status", "quote_match").collect()
    assert sorted(map(tuple, got)) == [(1, "late", True, 2, "MATCH", False), (2, None, True, 1, "MATCH", False), (3, "", False, None, None, None)]
    assert plan(df).count("Join") <= 1


def test_paths_are_told_apart_by_their_facts(spark):
    hop = "assertion_id string, predicate string, subject_uid string, object_uid string, object_type string, namespace string, kb_id int, document_id int, generation_id int, chunk_id long"
    first = spark.createDataFrame([("a", "HAS_STEP", "p", "s", "Step", "ns", 1, d, 1, 5) for d in (1, 2, 2)], hop)
    second = spark.createDataFrame([("b", "REVIEWS", "w", "s", "Step", "ns", 1, d, 1, 5) for d in (1, 2)] + [("c", "REVIEWS", "w", "s", "Step", "ns", 1, 1, 1, 6)], hop)
    none = spark.createDataFrame([], "source_uid string, target_uid string, source_document int, target_document int, identity_id string, chunks array<long>")
    df = paths.two_hop_paths(first, second, none)
    assert sorted((r.first_id, r.second_id, r.bridge_id, r.sources) for r in df.collect()) == [("a", "b", None, [5]), ("a", "c", None, [5, 6])]
    assert "sha2" not in plan(df.select("first_id", "second_id", "sources"))


def test_paths_of_facts_that_come_once_are_not_exchanged(spark):
    hop = "assertion_id string, predicate string, subject_uid string, object_uid string, object_type string, namespace string, kb_id int, document_id int, generation_id int, chunk_id long"
    n = 60
    first = spark.createDataFrame([(f"a{i}", "HAS_STEP", f"p{i}", "s", "Step", "ns", 1, 1, 1, i) for i in range(n)], hop)
    second = spark.createDataFrame([(f"b{i}", "REVIEWS", f"w{i}", "s", "Step", "ns", 1, 1, 1, i) for i in range(n)], hop)
    none = spark.createDataFrame([], "source_uid string, target_uid string, source_document int, target_document int, identity_id string, chunks array<long>")
    got, _, records = passed(paths.two_hop_paths(first, second, none).select("first_id", "second_id"))
    assert sorted(map(tuple, got)) == sorted((f"a{i}", f"b{j}") for i in range(n) for j in range(n))
    assert records < n * n / 4


def test_paths_of_facts_that_come_more_than_once(spark, monkeypatch):
    monkeypatch.setattr(paths, "GROUPS", 5)
    hop = "assertion_id string, predicate string, subject_uid string, object_uid string, object_type string, namespace string, kb_id int, document_id int, generation_id int, chunk_id long"
    rng = random.Random(4)
    fact = lambda p, ids, of: (f"{p}{rng.randrange(ids)}", rng.choice(["HAS_STEP", "REQUIRES_MATERIAL"] if of == "x" else ["REVIEWS", "HAS_FIELD"]), f"m{rng.randrange(4)}", f"m{rng.randrange(4)}", "Step", rng.choice(["ns", "ns", None]), rng.randrange(2), rng.randrange(3), rng.randrange(2), rng.randrange(9))
    x, y = [fact("a", 60, "x") for _ in range(50)], [fact("b", 60, "y") for _ in range(50)]
    x, y = x + x[:5], y + y[:5]
    b = [(f"m{rng.randrange(4)}", f"m{rng.randrange(4)}", rng.randrange(3), rng.randrange(3), rng.choice(["i", "j", None, ""]), [-1]) for _ in range(30)]
    want = set()
    for i, p, s, m, _, ns, kb, d, g, _ in x:
        for j, q, t, o, _, ns2, kb2, d2, g2, _ in y:
            other, end = (t, o) if q == "HAS_FIELD" else (o, t)
            if (p, q) not in (("HAS_STEP", "REVIEWS"), ("REQUIRES_MATERIAL", "HAS_FIELD")) or kb != kb2 or len({s, m}) < 2 or len({end, other}) < 2 or s == end:
                continue
            alike = (m, d, g) == (other, d2, g2) and (None if ns is None or ns2 is None else ns == ns2)
            want |= {(i, j, "")} if alike else set()
            want |= {(i, j, k or "") for f, to, e, e2, k, _ in b if alike is False and (f, to, e, e2) == (m, other, d, d2)}
    df = paths.two_hop_paths(spark.createDataFrame(x, hop), spark.createDataFrame(y, hop), spark.createDataFrame(b, "source_uid string, target_uid string, source_document int, target_document int, identity_id string, chunks array<long>"))
    got = [(r.first_id, r.second_id, r.bridge_id or "") for r in df.collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)


def test_rows_of_tables_are_sorted_once(spark):
    both = [relations.TOPIC, relations.DUTY, relations.MATERIAL, relations.CARE]
    rows = [(1, 0, 0, ["a", "员工执行"]), (1, 0, 1, both[:2]), (1, 0, 2, ["---", ":-:"]), (1, 0, 3, ["a", "由员工执行"]), (1, 0, 4, ["员工执行"]), (1, 0, 5, ["a", "b"]), (1, 0, 6, [None, "员工执行"]), (1, 1, 0, ["员工", "主管复核"]), (1, 1, 1, both[3:1:-1]), (1, 1, 2, ["x", "M"]), (1, 1, 3, ["", "M"]),
            (2, 0, 1, ["a", "员工执行"]), (3, 0, 0, both), (3, 0, 1, ["t", "员工执行", "M", "x"]), (3, 0, 2, ["t", "员工执行", "M", ""]), (4, 0, 0, [*both[:2], None]), (4, 0, 1, ["a", "员工执行", "b"]), (5, 0, 0, [*both[:2], both[2]]), (5, 0, 1, ["a", "无", "b"]), (6, 0, 0, None)]
    df = relations.table_facts(spark.createDataFrame(rows, "document_id long, chunk_index int, line_no int, cells array<string>"))
    duty, kept = ("RESPONSIBLE_FOR", "员工", "执行", None), ("GOVERNED_BY", "M", "x", None)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, [(1, 0, 3, *duty), (1, 1, 0, "RESPONSIBLE_FOR", "主管", "复核", None), (1, 1, 2, *kept), (3, 0, 1, *duty), (3, 0, 1, *kept), (3, 0, 2, *duty), (4, 0, 1, *duty)]))
    final = plan(df).split("Initial Plan")[0]
    assert final.count("Window [") == 1 and final.count("Sort [") == 1


def test_audited_keys_meet_by_their_tokens(spark, tmp_path):
    spark.range(20000).select(F.col("id").alias("o_orderkey")).coalesce(4).write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = graph_queries.graph_audit_full(spark, str(tmp_path))
        assert len(df.collect()) == 27
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(df) < 20000 * 1300


def test_audits_name_keys_as_they_are_stored(spark):
    place = ("ns", 1, 2)
    key = lambda *parts: hashlib.sha256(json.dumps([str(p) for p in parts], separators=(",", ":")).encode()).hexdigest()
    step, form = key(*place, "Step", "do it", 7), key(*place, "Material", "form", "")
    entities = spark.createDataFrame([(step, *place, "Step", "Do  it", "do it"), (step[:-1] + "x", *place, "Step", "Do it", "do it"), (form, *place, "Material", "Form", "form"), (form, *place, "Material", "Form", "FORM"), ("lone", *place, "Material", " ", ""), (None, *place, "Rule", "r", "r")], "key string, namespace string, tenant_id int, kb_id int, type string, name string, normalized_name string")
    evidence = spark.createDataFrame([("e", *place, 7, 70), ("e2", "ns", 1, 3, 7, 71), (None, *place, 7, 70)], "key string, namespace string, tenant_id int, kb_id int, document_id long, generation_id long")
    mentions = spark.createDataFrame([(step, "e"), (step[:-1] + "x", "e"), (form, "e2"), (form, "e3"), (step, None), ("nobody", "e"), (None, "e")], "entity_key string, evidence_key string")
    own = key("e", step, "HAS", form, "")
    facts = spark.createDataFrame([(own, "HAS", step, form, "", *place, 7, 70, ["e"]), (own, "HAS", step, form, "", *place, 7, 70, ["e"]), ("f", "HAS", None, "nobody", None, *place, 8, 70, ["e", "e9"])], "key string, predicate string, subject_key string, object_key string, condition_text string, namespace string, tenant_id int, kb_id int, document_id long, generation_id long, evidence_keys array<string>")
    got = audit.entity_problems(entities, mentions, evidence, facts).collect()
    want = [("MENTION_WITHOUT_EVIDENCE", form)] * 2 + [("MENTION_WITHOUT_EVIDENCE", step)] + [("ENTITY_SCOPE_MISMATCH", form)] * 2 + [("ENTITY_KEY_MISMATCH", step[:-1] + "x"), ("ENTITY_NORMALIZATION_MISMATCH", form), ("ENTITY_NORMALIZATION_MISMATCH", "lone"), ("DUPLICATE_ENTITY_KEY_GLOBAL", form), ("ORPHAN_ENTITY_GLOBAL", "lone")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    got = audit.fact_problems(facts, entities, evidence, spark.createDataFrame([("HAS", "Step", "Material")], "predicate string, subject_type string, object_type string")).collect()
    want = [(c, "f") for c in ("INVALID_RELATION_ENDPOINT", "ORPHAN_OR_AMBIGUOUS_FACT_ENDPOINT", "FACT_EVIDENCE_CARDINALITY", "FACT_WITHOUT_EVIDENCE", "FACT_EVIDENCE_SCOPE_MISMATCH")] + [("DUPLICATE_FACT", own)]
    assert sorted(map(tuple, got)) == sorted(want)
