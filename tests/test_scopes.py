"""Scopes of requests, and evidence that still stands."""

from pyspark.sql import functions as F

from quillspark.operators import relations, scope


def test_scopes_are_refused_as_a_whole_and_marked(spark):
    bases = spark.createDataFrame([(1,), (2,)], "kb_id int")
    docs = spark.createDataFrame([(10, 1, "PUBLISHED", 5), (11, 1, "DRAFT", None), (20, 2, "PUBLISHED", 6), (21, 2, "PUBLISHED", 7)], "document_id long, kb_id int, status string, active_generation_id long")
    gens = spark.createDataFrame([(10, 5, "READY"), (20, 6, "READY"), (21, 7, "BUILDING")], "document_id long, generation_id long, status string")
    asked = [(1, None, None), (2, [1], []), (3, [1, 3], None), (4, [1], [10, 11]), (5, [1], [10, 20]), (6, [2, 1, 2], [20, 10, 20]), (7, [2], [99])]
    r = spark.createDataFrame(asked, "request_id long, kb_ids array<int>, document_ids array<long>")
    got = {x.request_id: (x.code, x.kb_ids, x.authorized, x.published) for x in scope.resolve_scopes(r, bases, docs, gens).collect()}
    no = (scope.FORBIDDEN, None, None, None)
    assert got == {1: (None, [1, 2], 4, 2), 2: (None, [1], 2, 1), 3: no, 4: (None, [1], 2, 1), 5: no, 6: (None, [1, 2], 2, 2), 7: no}
    before = scope.resolve_scopes(r, bases, docs, gens)
    shuffled = scope.resolve_scopes(r.repartition(3), bases, docs.repartition(4), gens)
    assert {x.request_id: x.holds for x in scope.provenance_holds(before, shuffled).collect()} == {k: v[0] is None for k, v in got.items()}
    fresh = gens.withColumn("status", F.lit("READY"))
    assert {x.request_id for x in scope.provenance_holds(before, scope.resolve_scopes(r, bases, docs, fresh)).where("holds").collect()} == {2, 4, 6}
    # without documents the bases alone speak
    empty = scope.resolve_scopes(r, bases, docs.limit(0), gens)
    closed = scope.resolve_scopes(r, bases.where("kb_id = 1"), docs.limit(0), gens)
    assert {x.request_id for x in scope.provenance_holds(empty, closed).where("holds").collect()} == {2}
    assert scope.resolve_scopes(r, bases.limit(0), docs.limit(0), gens).where("code is null").select("request_id", "kb_ids").collect() == [(1, [])]


def test_held_evidence(spark):
    chunks = spark.createDataFrame([(1, "A quote, here."), (2, None)], "chunk_id long, content string")
    good = F.sha2(F.lit("A quote, here."), 256)
    rows = spark.createDataFrame([("a", 1, "quote", 2, 7), ("b", 1, "quote", 3, 8), ("c", 2, "quote", 2, 7), ("d", 3, "quote", 2, 7), ("e", 1, None, 0, 0)], "id string, chunk_id long, quote string, quote_start int, quote_end int")
    assert [r.id for r in relations.held_evidence(rows.withColumn("content_sha256", good), chunks).collect()] == ["a"]
    assert relations.held_evidence(rows.withColumn("content_sha256", F.lit("old")), chunks).count() == 0
