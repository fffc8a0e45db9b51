"""Selections that depend on what was selected before, against the same walk in plain Python, on random rows with ties and nulls."""

import random

from pyspark.sql import functions as F

from quillspark.operators import guards, metrics, paths, permissions


def test_bundles_fold_like_the_walk(spark):
    rng = random.Random(1)
    rows, want = [], []
    for q in range(60):
        known = rng.sample(range(30), rng.randint(0, 12))
        on = {c: [[c, *rng.sample(range(30), rng.randint(0, 3))] for _ in range(rng.choice([0, 0, 1, 2]))] for c in known}
        rows += [(q, i, c, on[c] or rng.choice([None, []])) for i, c in enumerate(known)]
        want += [(q, i + 1, c) for i, c in enumerate(guards.select_bundles(known, [p for c in known for p in on[c]], 5))]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, paths array<array<long>>").repartition(3)
    assert sorted(map(tuple, guards.bundles(df, 5).collect())) == sorted(want)
    assert guards.bundles(df.limit(0), 5).count() == 0


def test_paths_within_sources_fold_like_the_walk(spark):
    rng = random.Random(2)
    rows = [(q, f"p{i}", str(rng.randint(0, 3)), str(rng.randint(0, 3)), rng.sample(range(12), rng.randint(0, 4)), f"row {i}") for q in (1, 2, 3, None) for i in range(25)]
    df = spark.createDataFrame(rows, "query_id long, path_id string, first_id string, second_id string, sources array<long>, extra string").repartition(3)
    for limit, most in ((5, 3), (7, 100), (0, 4)):
        want = []
        for q in (1, 2, 3, None):
            have, n = set(), 0
            for r in sorted((r for r in rows if r[0] == q), key=lambda r: (r[2], r[3], r[1])):
                if len(have | set(r[4])) <= limit and n < most:
                    have, n = have | set(r[4]), n + 1
                    want.append(r)
        assert sorted(map(str, map(tuple, paths.within_sources(df, limit, most).collect()))) == sorted(map(str, want))


def slow_matches(gold, predicted, found):
    out, used = {}, set()
    have = {}
    for c, s in found:
        have[c, s] = have.get((c, s), 0) + 1
    ok = {(g[0], g[1]): all(have.get((g[0], e), 0) >= (2 if g[2] == g[3] and not g[4] else 1) for e in g[2:4]) for g in gold}
    for level in range(3):
        for g in sorted(gold, key=lambda g: g[:2]):
            if not ok[g[:2]] or g[:2] in out:
                continue
            for p in sorted(predicted, key=lambda p: p[:2]):
                same, quote = (p[5] or None) == (g[6] or None), p[6] == g[7]
                if p[:2] not in used and p[0] == g[0] and p[2:5] == (g[2], g[3], g[5]) and (level == 2 or same) and (level > 0 or quote):
                    out[g[:2]] = p[1], "MATCH" if same else "MISMATCH", quote
                    used.add(p[:2])
                    break
    return sorted((*g[:2], ok[g[:2]], *out.get(g[:2], (None, None, None))) for g in gold)


def test_conditional_matches(spark):
    rng = random.Random(3)
    pick = lambda: (rng.choice("ab"), rng.choice("ab"))
    rest = lambda: (rng.choice("rs"), rng.choice([None, "", "late", "early"]), rng.choice(["q", "t", None]))
    gold = [(c, i, *pick(), rng.random() < 0.3, *rest()) for c in range(25) for i in range(rng.randint(0, 6))]
    predicted = [(c, i, *pick(), *rest()) for c in range(25) for i in range(rng.randint(0, 6))]
    found = [(c, rng.choice("ab")) for c in range(25) for _ in range(rng.randint(0, 5))]
    g = spark.createDataFrame(gold, "chunk_id long, place int, subject string, object string, same boolean, predicate string, condition string, quote string").repartition(3)
    p = spark.createDataFrame(predicted, "chunk_id long, place int, subject string, object string, predicate string, condition string, quote string")
    f = spark.createDataFrame(found, "chunk_id long, signature string")
    m = metrics.conditional_matches(g, p, f)
    got = sorted(map(tuple, m.select("chunk_id", "place", "endpoints_found", "matched", "condition_status", "quote_match").collect()))
    assert got == slow_matches(gold, predicted, found)
    (total,) = metrics.conditional_recall(m, []).collect()
    assert total.gold == len(gold) and total.matched == sum(r[3] is not None for r in got) and total.recall == round(total.matched / total.eligible, 4)
    assert metrics.conditional_matches(g.limit(0), p, f).count() == 0


def test_a_base_keeps_an_administrator(spark):
    rng = random.Random(4)
    names = [f"u{i}" for i in range(6)]
    subjects = [(1, s, i != 4, i < 3) for i, s in enumerate(names)]
    grants = [(1, kb, s, rng.choice(["READ", "ADMIN"])) for kb in range(6) for s in names if rng.random() < 0.5]
    changes = [(1, kb, i, rng.choice([*names, "nobody"]), rng.choice([None, None, "READ", "WRITE", "ADMIN"])) for kb in range(6) for i in range(40)]
    valid, available = {s: v for _, s, v, _ in subjects}, {s for _, s, _, a in subjects if a}
    want, after = [], []
    for kb in range(6):
        held, version = {s: p for _, k, s, p in grants if k == kb}, 3
        for _, _, i, s, p in (c for c in changes if c[1] == kb):
            new = {**held, s: p} if p else {k: v for k, v in held.items() if k != s}
            old = held.get(s)
            code = permissions.MISSING if not p and not old else permissions.INVALID if p and not valid.get(s) else permissions.LAST_ADMIN if not any(v == "ADMIN" and k in available for k, v in new.items()) else permissions.UNCHANGED if p == old else permissions.CHANGED
            if code == permissions.CHANGED:
                held, version = new, version + 1
            want.append((1, kb, i, s, p, code, old, version))
        after += [(1, kb, s, p) for s, p in held.items()]
    g = spark.createDataFrame(grants, "tenant_id int, kb_id int, subject string, permission string")
    told = permissions.outcomes(
        spark.createDataFrame([(1, kb, 3) for kb in range(6)], "tenant_id int, kb_id int, acl_version long"), g,
        spark.createDataFrame(changes, "tenant_id int, kb_id int, seq long, subject string, permission string").repartition(5),
        spark.createDataFrame(subjects, "tenant_id int, subject string, valid boolean, available boolean"),
    )
    assert sorted(map(str, map(tuple, told.collect()))) == sorted(map(str, want))
    assert sorted(map(tuple, permissions.merged(g, told).collect())) == sorted(after)
    assert {r[5] for r in want} == {permissions.MISSING, permissions.INVALID, permissions.LAST_ADMIN, permissions.UNCHANGED, permissions.CHANGED}
    assert permissions.outcomes(spark.createDataFrame([], "tenant_id int, kb_id int, acl_version long"), g, told.select("tenant_id", "kb_id", "seq", "subject", F.col("permission")), spark.createDataFrame(subjects, "tenant_id int, subject string, valid boolean, available boolean")).count() == 0
