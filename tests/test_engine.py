"""Behaviour of what SQL does not express."""

import io
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.functions import periods, text
from quillspark.operators import catalog, chunking, filters, fusion, graph, guards, metrics, recall, scope, tasks
from quillspark.plans import router
from quillspark.sources import formats

NOW = datetime(2024, 3, 31, 17, tzinfo=timezone.utc)  # the first of April, eight hours on


def test_periods():
    day = lambda y, m, d: datetime(y, m, d, tzinfo=periods.ZONE)
    assert periods.period("今天", NOW) == (day(2024, 4, 1), day(2024, 4, 2))
    assert periods.period("上月", NOW) == (day(2024, 3, 1), day(2024, 4, 1))
    assert periods.period("本周", NOW) == (day(2024, 4, 1), day(2024, 4, 8))
    assert periods.period("去年", NOW) == (day(2023, 1, 1), day(2024, 1, 1))
    assert periods.period("2024年2月", NOW) == (day(2024, 2, 1), day(2024, 3, 1))
    assert periods.period("2024-02-29", NOW) == (day(2024, 2, 29), day(2024, 3, 1))
    assert periods.date_bounds("gt", "2024", NOW) == (day(2025, 1, 1), None)
    assert periods.date_bounds("lte", "2024", NOW) == (None, day(2025, 1, 1))
    for bad in ("soon", "2024-13", "2023-02-29"):
        with pytest.raises(ValueError):
            periods.period(bad, NOW)
    with pytest.raises(ValueError):
        periods.date_bounds("neq", "2024", NOW)


def test_filters():
    kind, size, day = filters.Field("enum", frozenset("abc")), filters.Field("number"), filters.Field("date")
    for bad in (("k", "contains", ("a",), kind), ("k", "eq", ("z",), kind), ("s", "range", (2, 1), size), ("s", "gt", (1, 2), size), ("d", "eq", (datetime(2024, 1, 1),), day), ("s", "eq", (), size)):
        with pytest.raises(ValueError):
            filters.Filter(*bad)
    f = lambda c, o, v, k: filters.Filter(c, o, v, k)
    assert filters.contradiction([f("k", "eq", ("a", "b"), kind), f("k", "neq", ("a", "b"), kind)]) == "k"
    assert filters.contradiction([f("s", "gt", (5,), size), f("s", "lte", (5,), size)]) == "s"
    assert filters.contradiction([f("s", "gte", (5,), size), f("s", "lte", (5,), size), f("k", "eq", ("a",), kind)]) is None
    assert filters.contradiction([f("s", "range", (1, 5), size), f("s", "eq", (5,), size)]) == "s"


def test_null_passes_neither(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    kind = filters.Field("text")
    assert [r.k for r in df.where(filters.compile_filters([filters.Filter("k", "neq", ("a",), kind)])).collect()] == ["b"]
    assert df.where(filters.compile_filters([])).count() == 3
    assert df.where(text.contains_literal("k", "%")).count() == 0


def test_permissions():
    assert scope.granting("READ") == ["READ", "WRITE", "ADMIN"] and scope.granting("ADMIN") == ["ADMIN"]
    assert scope.granting("ADMIN", "WRITE") == ["WRITE"]


WHO = scope.Identity(tenant_id=1, user_id=42, department_id=3, clearance=1, member_id=77)


def _scope(spark, doc=None, base=None, grant=None, share=None):
    """One document in one base with one grant and no share, each changed as told."""
    doc = {"document_id": 1, "kb_id": 5, "tenant_id": 1, "confidentiality": 1, "department_id": 3, "creator_id": 9, "status": "PUBLISHED", "deleted_at": None, "active_generation_id": 8} | (doc or {})
    base = {"kb_id": 5, "tenant_id": 1, "status": "ACTIVE", "deleted_at": None} | (base or {})
    grant = {"kb_id": 5, "tenant_id": 1, "user_id": None, "department_id": 3, "permission": "READ"} | (grant or {})
    share = {"document_id": 1, "tenant_id": 1, "user_id": None, "department_id": 3, "permission": "READ"} | share if share is not None else None
    of = lambda row, schema: spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))] if row else [], schema)
    return (
        of(doc, "document_id long, kb_id int, tenant_id int, confidentiality int, department_id int, creator_id long, status string, deleted_at string, active_generation_id long"),
        of(base, "kb_id int, tenant_id int, status string, deleted_at string"),
        of(grant, "kb_id int, tenant_id int, user_id long, department_id int, permission string"),
        of(share, "document_id long, tenant_id int, user_id long, department_id int, permission string"),
    )


HIDDEN = {"department_id": 4}  # of another department, so that only a share opens it


@pytest.mark.parametrize(
    "opens,parts,how",
    [
        (True, {}, {}),
        (False, {"grant": {"department_id": 4}}, {}),
        (True, {"grant": {"department_id": None, "user_id": 42}}, {}),
        (False, {"grant": {"department_id": None, "user_id": 43}}, {}),
        (False, {"grant": {"tenant_id": 2}}, {}),
        (False, {"base": {"status": "ARCHIVED"}}, {}),
        (False, {"base": {"deleted_at": "2024"}}, {}),
        (False, {"base": {"tenant_id": 2}}, {}),
        (False, {"doc": {"tenant_id": 2}}, {}),
        (False, {"doc": {"confidentiality": 2}}, {}),
        (False, {"doc": HIDDEN}, {}),
        (True, {"doc": HIDDEN | {"confidentiality": 0}}, {}),
        (True, {"doc": {"department_id": None, "creator_id": 77}}, {}),
        (False, {"doc": {"department_id": None, "creator_id": 42}}, {}),
        (True, {"doc": HIDDEN, "share": {}}, {}),
        (True, {"doc": HIDDEN, "share": {"department_id": None, "user_id": 42}}, {}),
        (False, {"doc": HIDDEN, "share": {"department_id": 5}}, {}),
        (False, {"doc": HIDDEN, "share": {"tenant_id": 2}}, {}),
        (False, {"doc": HIDDEN, "share": {"document_id": 2}}, {}),
        (False, {"doc": HIDDEN, "grant": {"permission": "ADMIN"}, "share": {}}, {"request": "WRITE"}),
        (True, {"doc": HIDDEN, "grant": {"permission": "ADMIN"}, "share": {"permission": "WRITE"}}, {"request": "ADMIN"}),
        (False, {}, {"request": "WRITE"}),
        (True, {"grant": {"permission": "WRITE"}}, {"request": "WRITE"}),
        (False, {"doc": {"active_generation_id": None}}, {}),
        (False, {"doc": {"deleted_at": "2024"}}, {}),
        (True, {"doc": {"status": "DRAFT", "active_generation_id": None}}, {"state": "default"}),
        (False, {"doc": {"status": "DELETED", "deleted_at": "2024"}}, {"state": "default"}),
        (True, {"doc": {"status": "DELETED", "deleted_at": "2024"}}, {"state": "all"}),
    ],
)
def test_each_rule_of_access_alone(spark, opens, parts, how):
    assert scope.readable_documents(*_scope(spark, **parts), WHO, **how).count() == opens


def test_nobody_without_a_department(spark):
    who = scope.Identity(1, 42, None, 1)
    rows = _scope(spark, grant={"department_id": None, "user_id": 42})
    assert scope.readable_documents(*rows, who).count() == 0
    assert scope.readable_documents(*_scope(spark, doc={"department_id": None, "creator_id": 42}, grant={"department_id": None, "user_id": 42}), who).count() == 1


def test_exact_count_has_a_limit(spark):
    assert catalog.exact_count(spark.range(5)).first().total == 5
    with pytest.raises(Exception, match="STRUCTURED_SCOPE_LIMIT"):
        catalog.exact_count(spark.range(6), 5).collect()


def test_clean_text(spark):
    df = spark.createDataFrame([(" a \t b\r\n\r\n\r\n\r\nc​ \n",)], "t string")
    assert df.select(text.clean_text("t")).first()[0] == "a b\n\nc"


def test_split_keeps_all_text():
    t = "One sentence here. " * 40 + "x" * 300 + "\n\n" + "Another; part, of it. " * 30
    pieces = chunking.split_text(t, 40)
    assert "".join(pieces) == t and all(chunking.count_tokens(p) <= 40 for p in pieces)
    chunks = chunking.assemble(t, chunking.Limits(64, 8, 16))
    assert all(chunking.count_tokens(c.content) <= 64 for c in chunks) and len(chunks) > 3
    assert chunking.assemble("", chunking.Limits()) == []
    with pytest.raises(ValueError):
        chunking.Limits(64, 32, 0)


def test_long_unbroken_texts():
    import time

    began = time.perf_counter()
    for t in ("中" * 350_000, "a1 " * 350_000, "word" * 250_000, "。" * 300_000, "x.y" * 300_000):
        pieces = chunking.split_text(t, 32)
        assert "".join(pieces) == t and max(chunking.count_tokens(p) for p in pieces[:50] + pieces[-50:]) <= 32
    assert time.perf_counter() - began < 30


def test_counts_of_parts():
    import random

    random.seed(1)
    t = "".join(random.choices("ab 中.,_1\n", k=400))
    m = chunking.Measured(t)
    for _ in range(500):
        a, b = sorted(random.sample(range(len(t) + 1), 2))
        assert m.count(a, b) == chunking.count_tokens(t[a:b]), (t[a - 2 : a + 2], a, b)


def test_header_of_a_sheet():
    note = ["说明: fill in", "", ""]
    assert chunking.header_row([["Title", "", ""], note, ["a", "b", "c"], ["1", "2", "3"]]) == 2
    assert chunking.header_row([["Title", "", ""], note, ["", "x", ""], ["a", "b", "c"], ["1", "2", "3"]]) == 3
    assert chunking.header_row([["Title", "", ""], note, ["a", "b", ""], ["a", "b", "c"], ["1", "2", "3"]]) == 0
    assert chunking.header_row([["Title", "", ""], ["other", "", ""], ["a", "b", "c"], ["1", "2", "3"]]) == 0
    assert chunking.header_row([["Title", "", ""], note, ["a", "b", "c"]]) == 0
    assert chunking.header_row([["Title", "", ""], note, ["a", "b", "c"], ["1", "2", "3"]], sheet=False) == 0


def test_chunks_follow_the_structure():
    E, limits = chunking.Element, chunking.Limits(64, 8, 16)
    long = "Some words of a paragraph. " * 20
    rows = tuple(("name", "value")) and (("name", "value"), *[(f"row {i}", f"{i} | {i}") for i in range(30)])
    out = chunking.assemble(
        [
            E("heading", "A", ("A",)), E("paragraph", "short", ("A",)), E("paragraph", "also short", ("A",)),
            E("code", "x = 1", ("A",)), E("paragraph", long, ("A", "B")), E("table", path=("A",), rows=rows, caption="Cap"),
            E("paragraph", "left", ("P", "x")), E("paragraph", "right", ("P", "y")), E("paragraph", "third", ("P", "z")),
            E("paragraph", "other page", ("Q",), 2), E("paragraph", "next page", ("Q",), 3), E("heading", "End", ("End",)),
        ],
        limits,
    )
    assert [c.content for c in out[:2]] == ["short\n\nalso short", "x = 1"] and out[1].kind == "code"
    parts = [c for c in out if c.path == ("A", "B")]
    assert len(parts) > 1 and all(c.split for c in parts) and " ".join(" ".join(c.own for c in parts).split()) == long.strip()
    assert parts[1].content != parts[1].own and long.startswith(parts[0].own)
    tables = [c for c in out if c.kind == "table"]
    assert len(tables) > 2 and all(c.content.startswith("Cap\n| name | value |\n| --- | --- |\n| row") for c in tables)
    assert [c.rows for c in tables][0][0] == 2 and [b.rows[0] - a.rows[1] for a, b in zip(tables, tables[1:])] == [1] * (len(tables) - 1) and tables[-1].rows[1] == 31
    assert r"5 \| 5" in "".join(c.content for c in tables)
    merged = next(c for c in out if c.merged)
    assert merged.content == "x\nleft\n\ny\nright" and merged.path == ("P",)
    assert [c.content for c in out[-4:]] == ["third", "other page", "next page", "End"]
    a = chunking._Assembly(limits, chunking.token_starts)
    assert all(len(chunking.token_starts(c.content)) <= a.budget(c.path) for c in out)
    assert a.title(("one two three",) * 20).count("three") < 8


def test_chunk_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\n" + "body words here. " * 80 + "\n\n## U\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nend\n")
    elements = formats.heading_paths(formats.parsed(formats.gated(formats.read_files(spark, str(tmp_path)))))
    rows = chunking.chunk_elements(elements, chunking.Limits(64, 8, 16)).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and {"text", "table", "paragraph"} >= {r.kind for r in rows}
    assert rows[-2].content == "| a | b |\n| --- | --- |\n| 1 | 2 |" and rows[-2].heading_path == ["T", "U"]
    chunking.register_chunk_text(spark)
    spark.createDataFrame([(1, "some words. " * 60), (2, None)], "id long, t string").createOrReplaceTempView("texts")
    got = spark.sql("select id, c.* from texts, lateral chunk_text(t, 64, 8) c").collect()
    assert {r.id for r in got} == {1} and len(got) > 1 and all(r.token_count <= 64 for r in got)
    chunking.register_tokenizer("signs", lambda t: list(range(len(t))))
    with pytest.raises(ValueError):
        chunking.register_tokenizer("signs", len)
    signs = chunking.chunk(spark.table("texts"), "id", "t", chunking.Limits(40, 4, 8), "signs").collect()
    assert signs and all(len(r.content) <= 40 for r in signs)


def test_guards(spark):
    rows = spark.createDataFrame([(1, "You may not enter.", "You may enter."), (2, "Pay 30%.", "If late, pay 20%."), (3, None, None), (4, "It is 3.5 km.", "It is 3.5 km.")], "id long, statement string, evidence string")
    assert sorted(map(tuple, guards.guards(rows).collect())) == [(1, "NEGATION_DIFFERS"), (2, "CONDITION_DROPPED"), (2, "NUMBER_NOT_IN_EVIDENCE")]
    assert guards.select_bundles([1, 2, 3, 4, 5], [[2, 5], [3, 9]], 3) == [1, 2, 5]
    assert guards.select_bundles([1, 2, 3], [[1, 2, 3]], 2) == [1, 2]
    assert guards.restore_quote("a line\nbreak in here, once", "line break in") is None
    assert guards.restore_quote("some line\nbroken text", "line\nbroken") == "line\nbroken"
    assert guards.restore_quote("the c at sat here", "the cat sat") is None
    assert guards.restore_quote("the c\r\nat sat here", "the cat\n sat") == "the c\r\nat sat"
    assert guards.restore_quote("twice over, twice over", "twice over") is None
    assert guards.preview(["abc", "def"], 5, 4) == (["abc", "d"], True)
    parts = lambda t: [t[a:b] for a, b in guards.clauses(t)]
    assert parts("x. y") == ["x.", "y"] and parts("At 3.5 m. Go!\n# Head\n- item；next") == ["At 3.5 m.", "Go!", "Head", "item；", "next"] and parts(" . ") == []
    assert guards.quote_candidates("One. Two. " + "x" * 1300 + ". Three.", most=3) == ["One.", "Two.", "Three."]
    assert guards.quote_candidates("a" * 400 + ". " + "b" * 400 + ". c.") == ["a" * 400 + ".", "c."]


def test_containment(spark):
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words)
    quotes = [(1, text), (2, " ".join(words[3:20])), (3, "4 w5 w6 w"), (4, "w5 w7 w8"), (5, "w3"), (6, "nowhere"), (7, ""), (8, "5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w1"), (9, "w39 w40")]
    q = spark.createDataFrame(quotes, "quote_id long, quote string")
    docs = [(10, "start " + text + " end"), (11, "x" + text[2:]), (12, None), (13, "w30\nw31")]
    d = spark.createDataFrame(docs, "document_id long, text string")
    want = {(i, j) for i, a in quotes for j, t in docs if a and t and a in t}
    assert {tuple(r) for r in metrics.containing(q, d).collect()} == want
    keyed = metrics.containing(q.withColumn("k", F.lit(1)), d.withColumn("k", F.when(F.col("document_id") == 10, 1).otherwise(2)), "k")
    assert {tuple(r) for r in keyed.collect()} == {x for x in want if x[1] == 10}


def test_small_operators(spark):
    assert router.has_disjunction("docs of a or b", (router.Constraint("x", "a", "a"), router.Constraint("x", "b", "b"))) is True
    assert router.has_disjunction("docs of a and b", (router.Constraint("x", "a", "a"), router.Constraint("x", "b", "b"))) is False
    assert filters.aliases(" Excel ", {"excel": ("xls", "xlsx")}) == ("xls", "xlsx")
    with pytest.raises(ValueError):
        filters.aliases("word", {})
    one = spark.createDataFrame([("the source has a value", "a value", "value"), ("the source", "a value", "value"), ("a value", "a value", "other")], "s string, q string, v string")
    assert [r[0] for r in one.select(text.grounded("s", "q", "v")).collect()] == [True, False, False]
    assert [r[0] for r in one.select(text.contained_either_way("s", "q")).collect()] == [True, False, True]
    names = spark.createDataFrame([(1, "the Board (hereinafter \"BD\") and 总部以下简称：本部")], "chunk_id long, content string")
    assert sorted(r.alias for r in graph.aliases(names, "content").collect()) == ["BD", "本部"]
    blocks = spark.createDataFrame([(1, 0, "header", "h"), (1, 1, "text", "a"), (1, 2, "text", " "), (1, 3, "page_number", "7"), (1, 4, "text", "b")], "document_id long, order int, kind string, text string")
    assert [(r.order, r.text) for r in chunking.clean_blocks(blocks, "document_id").orderBy("order").collect()] == [(0, "a"), (1, "b")]
    files = spark.createDataFrame([("a", bytearray(b"abc")), ("b", bytearray(b"abd"))], "path string, content binary")
    import hashlib

    expected = spark.createDataFrame([("a", hashlib.sha256(b"abc").hexdigest(), 3), ("b", hashlib.sha256(b"abc").hexdigest(), 3)], "path string, sha256 string, size long")
    assert [r.path for r in formats.verified(files, expected).collect()] == ["a"]
    rows = spark.createDataFrame([(1, 5, True), (1, 7, True), (2, 3, False)], "k int, size long, w boolean")
    assert tuple(catalog.with_overall(rows, F.col("w"), "size").first()) == (2, 12, 3, 15)
    relations = spark.createDataFrame([(1, 10, 11), (1, 12, 13), (2, 10, 12)], "row_id long, subject long, object long")
    assert {tuple(r) for r in graph.flagged_relations(relations, spark.createDataFrame([(1, 11), (2, 10)], "row_id long, entity_id long")).collect()} == {(1, 10, 11), (2, 10, 12)}
    targets = spark.createDataFrame([(1, 9, "quote", "t", "Name"), (2, 9, "quote", "t", " name "), (3, 9, "twice", "t", "x")], "target_id long, document_id long, quote string, type string, name string")
    chunks = spark.createDataFrame([(5, 9, "a quote here twice"), (6, 9, "twice")], "chunk_id long, document_id long, content string")
    assert [tuple(r) for r in graph.relocated(targets, chunks).collect()] == [(1, 5, 2, 7)]


def test_route():
    q = router.Analysis
    full, empty = router.Scope(3), router.Scope(0)
    assert router.route(q("how many documents?"), full).operation == "count"
    assert router.route(q("列出所有文档"), full).operation == "list"
    assert router.route(q("how many documents per owner?", intent="statistics"), full).status == "unsupported"
    assert router.route(q("what is it", needs_context=True), full).route == "clarify"
    assert router.route(q("hello", intent="chitchat"), full).route == "none"
    assert router.route(q("who reviews the plan", entities=("plan",), relation_required=True), full, True).route == "hybrid_graph"
    assert router.route(q("who reviews the plan", entities=("plan",), relation_required=True), full).reason == "GRAPH_NOT_READY"
    assert router.route(q("tell me"), empty).status == "empty"
    assert router.route(q("x", degraded="unsupported"), full).status == "unsupported"
    c = (router.Constraint("file_type", "pdf", "pdf"),)
    assert router.route(q("rules in pdf", constraints=c), full).reason == "METADATA_FILTERS_NOT_READY"
    with pytest.raises(ValueError):
        q("rules", constraints=c)


def test_fusion_ties_and_repeats(spark):
    hits = spark.createDataFrame([(1, "a", 1, 7), (1, "a", 2, 7), (1, "a", 3, 5), (1, "b", 1, 5)], "query_id long, channel string, pos int, chunk_id long")
    ranked = {(r.channel, r.chunk_id): r["rank"] for r in fusion.ranks(hits).collect()}
    assert ranked == {("a", 7): 1, ("a", 5): 2, ("b", 5): 1}
    assert [r.chunk_id for r in fusion.rrf(fusion.ranks(hits)).orderBy("fused_rank").collect()] == [5, 7]
    assert fusion.rrf(fusion.ranks(hits.limit(0))).count() == 0


def test_dense_skips_broken_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, float("nan")]), (6, [0.0, 1.0])], "id long, v array<double>")
    assert [r.id for r in recall.dense(df, [1.0, 0.1], "v", "id", 5).collect()] == [1, 6]
    with pytest.raises(ValueError):
        recall.top_k(df, "id", "id", 0)


def test_rate_limit(spark):
    e = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate((0, 10, 20, 299, 300, 301))], "key long, event_id long, at double")
    assert [r.allowed for r in tasks.rate_limited(e, 2, 300).orderBy("event_id").collect()] == [True, True, False, False, True, True]


def _zip(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in files.items():
            z.writestr(k.replace("__", "/").replace("_xml", ".xml"), v)
    return b.getvalue()


def test_gate():
    code = lambda n, c, **k: formats.gate(n, c, **k)[0]
    assert code("a.txt", "é".encode()) == "OK" and formats.gate("a.txt", "汉字".encode("gb18030"))[3] == "gb18030"
    assert code("a.txt", b"") == "EMPTY" and code("a.exe", b"x") == "UNSUPPORTED_FORMAT" and code("a.txt", b"\0") == "CONTROL_CHARACTERS"
    assert code("a.txt", b"xx", most=1) == "TOO_LARGE" and code("a.pdf", b"x") == "BAD_SIGNATURE" and code("a.pdf", b"%PDF-1.7 /Encrypt") == "ENCRYPTED"
    assert code("a.docx", b"x") == "BAD_SIGNATURE" and code("a.docx", _zip(word__document_xml="0" * 10_000_000)) == "ARCHIVE_BOMB"


def test_parsers():
    md = formats.parse_markdown(b"# A\ntext\nmore\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```\ncode\n```\n")
    assert [(e["kind"], e["text"]) for e in md] == [("heading", "A"), ("paragraph", "text\nmore"), ("table_row", "| a | b |"), ("table_row", "| 1 | 2 |"), ("code", "code")]
    assert [(e["line_start"], e["line_end"]) for e in formats.parse_text(b"a\nb\n\n\nc")] == [(1, 2), (5, 5)]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip(word__document_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert [(e["kind"], e["text"]) for e in formats.parse_docx(docx)] == [("heading", "H"), ("paragraph", "b"), ("table_row", "c")]
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = _zip(xl__sharedStrings_xml=f"<sst {m}><si><t>s</t></si></sst>", xl__worksheets__sheet1_xml=f'<worksheet {m}><sheetData><row r="3"><c t="s"><v>0</v></c><c><v>4</v></c></row><row r="4"><c/></row></sheetData></worksheet>')
    assert [(e["line_start"], e["cells"]) for e in formats.parse_xlsx(xlsx)] == [(3, ["s", "4"])]
    gaps = _zip(xl__worksheets__sheet10_xml=f'<worksheet {m}><sheetData><row r="1"><c r="A1"><v>last</v></c></row></sheetData></worksheet>', xl__worksheets__sheet2_xml=f'<worksheet {m}><sheetData><row r="2"><c r="A2"><v>1</v></c><c r="C2"><v>3</v></c></row><row r="5"><c r="AB5"><v>x</v></c><c r="AC5"><f>A1</f></c></row></sheetData></worksheet>')
    found = formats.parse_xlsx(gaps)
    assert [e["cells"] for e in found if e["kind"] == "table_row"] == [["1", "", "3"], [*[""] * 27, "x", ""], ["last"]]
    assert [e["text"] for e in found if e["kind"] == "warning"] == ["FORMULA_WITHOUT_VALUE sheet2!AC5"]
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    row = lambda v: f'<worksheet {m}><sheetData><row r="1"><c r="A1"><v>{v}</v></c></row></sheetData></worksheet>'
    book = {"xl/workbook.xml": f'<workbook {m} xmlns:r="{rel}"><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for k, v in (book | {"xl/worksheets/sheet1.xml": row("one"), "xl/worksheets/sheet2.xml": row("two")}).items():
            z.writestr(k, v)
    assert [e["cells"] for e in formats.parse_xlsx(buffer.getvalue())] == [["two"], ["one"]]
    assert formats.html_table("<table><tr><td> a <b>x</b></td><td>2</td></tr></table>") == [["a x", "2"]]
    assert formats.html_table('<tr><td colspan="2">a</td></tr>') is None
    with pytest.raises(ValueError):
        formats.standard_registry().register("txt", formats.parse_text)


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\n## U\n\nbody\n\n# V\n\nend\n")
    (tmp_path / "b.bin").write_bytes(b"x")
    files = formats.gated(formats.read_files(spark, str(tmp_path)))
    assert sorted(r.code for r in files.collect()) == ["OK", "UNSUPPORTED_FORMAT"]
    rows = formats.heading_paths(formats.parsed(files)).orderBy("order").collect()
    assert [(r.text, r.heading_path) for r in rows if r.kind == "paragraph"] == [("body", ["T", "U"]), ("end", ["V"])]


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä\n")], "a long, b string")
    formats.write_jsonl(df, str(tmp_path / "x"))
    assert formats.read_jsonl(spark, str(tmp_path / "x"), "a long, b string").collect() == df.collect()


def test_streams_equal_batches(spark, tmp_path):
    from quillspark.streaming import events

    source = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(source).repartition(3).write.parquet(str(tmp_path / "in"))
    s = events.tumbling(events.read_events(spark, str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = events.tumbling(spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(spark.table("tumbled")) == key(want)


def test_similarity(spark):
    df = spark.createDataFrame([("Ａbc， ", "abc")], "a string, b string")
    assert df.select(text.canonical_name("a"), text.similarity_ratio("a", "b")).first()[0] == "abc"


def test_lease_stream(spark, tmp_path):
    """A worker without beats for its lease is given up; one that still beats at the end is not."""
    from quillspark.streaming import events

    beats = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:30"), (2, "2024-01-01 00:00:10"), (2, "2024-01-01 01:00:00")]
    for i, (u, t) in enumerate(beats):
        row = spark.createDataFrame([(i, u, "beat")], "event_id long, user_id long, event_type string").withColumn("ts", F.lit(t).cast("timestamp_ntz")).withColumn("value", F.lit(0.0)).withColumn("props", F.lit("{}"))
        row.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = events.leases(events.read_events(spark, str(tmp_path / "in"), 1), 60, "1 second")
    q = s.writeStream.format("memory").queryName("leases").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert (1, 2, "ABANDONED") in {tuple(r) for r in spark.table("leases").collect()}


def _pdf(*pages, packed=True):
    import zlib

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))), len(pages))]
    for i, p in enumerate(pages):
        data = zlib.compress(p) if packed else p
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if packed else b"", data)]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i + 1, o) for i, o in enumerate(objects))


def test_pdf(spark):
    from quillspark.sources.pdf import parse_pdf

    first = rb"BT /F1 12 Tf 72 700 Td (Hello \(world\)) Tj 0 -14 Td [(Sec) -20 (ond) -300 (line)] TJ ET"
    for packed in (True, False):
        found = parse_pdf(_pdf(first, b"q 1 0 0 1 0 0 cm Q", b"BT <486578> Tj T* (caf\\351) Tj ET", packed=packed))
        assert [(e["kind"], e["text"]) for e in found] == [("paragraph", "Hello (world)\nSecond line"), ("warning", "OCR_REQUIRED page 2"), ("paragraph", "Hex\ncafé")]
    assert parse_pdf(b"%PDF-1.4 nothing") == []
    rows = spark.createDataFrame([("a.pdf", bytearray(_pdf(first))), ("b.pdf", bytearray(_pdf(b"")))], "path string, content binary")
    done = formats.completeness(formats.parsed(formats.gated(rows))).collect()
    assert {(r.path, r.requires_ocr, r.is_complete) for r in done} == {("a.pdf", False, True), ("b.pdf", True, False)}
    assert formats.gate("a.pdf", _pdf(first), declared="text/plain")[0] == "MIME_MISMATCH" and formats.gate("a.pdf", _pdf(first), declared="application/pdf")[0] == "OK"


def test_cache_and_batches(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id long, t string")
    import hashlib

    key = lambda t: hashlib.sha256(f"m1\n{t}".encode()).hexdigest()
    cache = spark.createDataFrame([(key("a"), [1.0, 0.0]), (key("b"), [0.0, 0.0]), (key("z"), [1.0, 1.0])], "key string, vector array<double>")
    got = {r.id: r.hit for r in recall.cached(chunks, cache, "t", "m1", 2).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    after = recall.stored(cache, spark.createDataFrame([(key("b"), [2.0, 2.0]), (key("b"), [2.0, 2.0])], "key string, vector array<double>"))
    assert after.count() == 3 and after.where(F.col("key") == key("b")).first().vector == [2.0, 2.0]
    keys = spark.range(57).select(F.format_string("%03d", "id").alias("key"))
    assert {r.key: r.batch for r in recall.numbered_batches(keys.unionByName(keys.limit(5))).collect()} == {f"{i:03d}": i // 10 for i in range(57)}


def test_fusion_refuses_conflicts(spark):
    good = [(1, 5, "x", 1.0), (2, 5, "x", 0.5)]
    frame = lambda rows: spark.createDataFrame(rows, "query_id long, chunk_id long, text string, score double")
    assert fusion.checked(frame(good)).count() == 2
    for bad, message in (((1, 5, "y", 1.0), "CONFLICTING_TEXT"), ((1, 6, "x", float("nan")), "SCORE_NOT_FINITE"), ((1, 6, "x", None), "SCORE_NOT_FINITE")):
        with pytest.raises(Exception, match=message):
            fusion.checked(frame([*good, bad])).collect()


def test_models_are_registered(spark):
    from quillspark.operators import answers

    answers.register_embedder("length", lambda texts: [[float(len(t)), 1.0] for t in texts])
    with pytest.raises(ValueError):
        answers.register_embedder("length", len)
    rows = spark.createDataFrame([(1, "q", "abc"), (2, "q", None)], "id long, q string, t string")
    assert [r.embedding for r in answers.embedded(rows, "length", "t").orderBy("id").collect()] == [[3.0, 1.0], [0.0, 1.0]]
    answers.register_reranker("overlap", lambda qs, ts: [float(len(t)) for t in ts])
    assert [r.rerank_score for r in answers.reranked(rows, "overlap", "q", "t").orderBy("id").collect()] == [3.0, 0.0]

    def broken(qs, ts):
        raise OSError

    answers.register_reranker("broken", broken)
    assert [r.rerank_score for r in answers.reranked(rows, "broken", "q", "t").collect()] == [None, None]
    assert answers.refers("what about it") and not answers.refers("这个月的预算") and answers.refers("详细点")


def test_write_side(spark):
    from quillspark.operators import paths, publication

    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    runs = spark.sql("select * from values (1, 'RUNNING', timestamp_ntz'2024-01-01 23:59:59', timestamp_ntz'2024-01-01'), (2, 'RUNNING', timestamp_ntz'2024-01-02 00:00:01', timestamp_ntz'2024-01-01'), (3, 'PENDING', null, timestamp_ntz'2024-01-01'), (4, 'PENDING', null, timestamp_ntz'2024-01-01 23:59:30') as t(id, status, lease_until, created_at)")
    assert [r.status for r in publication.abandoned(runs, now, 60).orderBy("id").collect()] == ["ABANDONED", "RUNNING", "ABANDONED", "PENDING"]
    tasks_ = runs.withColumnRenamed("id", "task_id")
    attempts = spark.createDataFrame([(1, "RUNNING"), (1, "FAILED"), (2, "RUNNING")], "task_id int, status string")
    assert sorted(map(tuple, publication.attempts_lost(attempts, tasks_, now).collect())) == [(1, "FAILED"), (1, "LOST"), (2, "RUNNING")]
    assert spark.range(1).select(publication.progress(F.lit(1), F.lit(3)), publication.progress(F.lit(3), F.lit(3)), publication.progress(F.lit(0), F.lit(0))).first()[:] == (33, 99, 0)
    rows = spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "id long, v int, x string")
    changes = spark.createDataFrame([(1, 7, "z"), (1, 7, "y"), (2, 6, "q"), (9, 7, "n")], "id long, v int, x string")
    after, refused = publication.updated(rows, changes, "id", "v", ["x"])
    assert sorted(map(tuple, after.collect())) == [(1, 8, "y"), (2, 7, "b")] and sorted(map(tuple, refused.collect())) == [(2, 6), (9, 7)]
    documents = spark.createDataFrame([(1, "PUBLISHED", None, 5), (2, "DELETED", "2023", None)], "document_id long, status string, deleted_at string, active_generation_id long")
    gone = publication.soft_deleted(documents, documents.select("document_id"), F.lit("2024"))
    assert sorted(map(tuple, gone.collect())) == [(1, "DELETED", "2024", None), (2, "DELETED", "2023", None)]
    assert publication.hard_purged({"d": documents}, documents.where("document_id = 1"))["d"].count() == 1
    once = spark.createDataFrame([("ns", 1, 3, 3, "k1", "new")], "namespace string, tenant_id int, generation_id long, chunk_id long, key string, v string")
    old = once.withColumn("v", F.lit("old")).unionByName(once.withColumn("key", F.lit("k2")).withColumn("v", F.lit("old")))
    none = once.limit(0)
    first = publication.upserted_chunks(old, once, once, none, "key")
    assert [tuple(r)[-2:] for r in first.collect()] == [("k1", "new")] and publication.upserted_chunks(first, once, once, none, "key").collect() == first.collect()
    p = spark.createDataFrame([(1, "a", "1", "1", [1, 2]), (1, "b", "2", "1", [3, 4, 5]), (1, "c", "3", "1", [2, 3]), (2, "d", "1", "1", [9])], "query_id long, path_id string, first_id string, second_id string, sources array<long>")
    assert {r.path_id for r in paths.within_sources(p, 3).collect()} == {"a", "c", "d"} and {r.path_id for r in paths.within_sources(p, 9, 1).collect()} == {"a", "d"}
    shown, cut = guards.table_preview([["x" * 5000, "y"]] * 3, most=2)
    assert cut and len(shown) == 2 and len(shown[0][0]) == 4000
    projections = spark.createDataFrame([(1, "READY", 9, None), (1, "STALE", 5, 9), (2, "READY", 8, None), (2, "STALE", 5, 7)], "document_id long, status string, fingerprint int, replaced_by int")
    assert sorted(r.new_status for r in graph.rolled_back(projections).collect()) == ["READY", "READY", "STALE", "STALE"]
    assert {(r.document_id, r.status, r.new_status) for r in graph.rolled_back(projections).collect()} >= {(1, "STALE", "READY"), (1, "READY", "STALE"), (2, "READY", "READY")}
    relations_ = spark.createDataFrame([("a", "c1", 1, 100, 110), ("a", "c2", 1, 200, 210), ("b", "c1", 2, 0, 5)], "s string, c string, chunk_id long, start int, end int")
    got = metrics.support(relations_, spark.createDataFrame([("a", "c1")], "s string, c string"), spark.createDataFrame([(1, 105, 300)], "chunk_id long, start int, end int"), ["s", "c"])
    assert sorted((r.s, r.c, r.support, r.negative) for r in got.collect()) == [("a", "c1", "exact", True), ("a", "c2", "other_condition", True), ("b", "c1", "none", False)]
