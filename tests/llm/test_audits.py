"""Source divergence, decontamination and conversation repair against brute force, with the awkward inputs they promise to take."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import conversations, decontamination, divergence

# --- 11


def ascii_lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def slow_audit(rows):
    """rows: (lang, source, text)."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text))) for lang, source, text in rows]
    docs, total, count, groups = Counter(), Counter(), Counter(), {(lang, s) for lang, s, _ in rows}
    for lang, _, words in rows:
        docs.update({(lang, w) for w in words})
        total.update((lang, w) for w in words)
    kept = defaultdict(list)
    for (lang, w), n in docs.items():
        if n >= 30:
            kept[lang].append(w)
    for lang, source, words in rows:
        count.update((lang, source, w) for w in words if docs[lang, w] >= 30)
    p = {}
    for lang, source in groups:
        n, v = sum(count[lang, source, w] for w in kept[lang]), len(kept[lang])
        p[lang, source] = {w: 1 + 10**9 * (count[lang, source, w] + 5) // (n + 5 * v) for w in kept[lang]}
    out = []
    for lang, source in groups:
        n, v = sum(total[lang, w] for w in kept[lang]), len(kept[lang])
        mine = p[lang, source]
        pair = [(sum(abs(mine[w] - x[w]) for w in kept[lang]), s) for (one, s), x in p.items() if one == lang and s != source]
        term = [(mine[w] - (1 + 10**9 * (total[lang, w] + 5) // (n + 5 * v)), w) for w in kept[lang] if count[lang, source, w]]
        for part, found in (("pair", pair), ("term", [x for x in term if x[0] > 0])):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, f, i + 1) for i, (f, item) in enumerate(found) if part == "pair" or i < 50]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("é", "ba", "Co", "zu", "日本", "x'y") for b in ("", "da", "Ra", "ñ", "9k", "_o", "lu", "mi", "sa", "to")]
    out = []
    for i in range(500):
        lang, source = rng.choice(["en", "en", "en", "fr", None, "xx"]), rng.choice(["a", "b", "b", "ü", "é", None, ""])
        lean = 1 + vocabulary.index(rng.choice(vocabulary[:20]))
        out.append((lang, source, " ".join(rng.choices(vocabulary, weights=[1 + (k * lean) % 7 for k in range(len(vocabulary))], k=rng.randint(1, 80)))))
    out += [("en", "only nulls", None), ("en", "blank", " \n1234"), ("yy", "lonely", "few words"), (None, None, None), ("fr", "long", "ba da " * 50_000)]
    return out + out[:20]


def test_divergence(spark, corpus):
    df = spark.createDataFrame([(*r, 1, "t", 0) for r in corpus], "lang string, source string, text string, n int, term string, p0 int").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == slow_audit(corpus)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[4] == 0 for r in got)
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_in_small_portions(corpus, monkeypatch):
    """The same counts where tasks hand on early, squares are small and two terms have one hash."""
    rows = [(lang or "", source or "", text or "") for lang, source, text in corpus]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(3)], ["lang", "source", "text"])

    def counts():
        n, docs = Counter(), Counter()
        for b in divergence._count(iter([batch.slice(0, 300), batch.slice(300)])):
            for lang, source, term, k, d in zip(*(c.to_pylist() for c in b.columns)):
                n[lang, source, term] += k
                docs[lang, source, term] += d
        return n, docs

    whole = counts()
    monkeypatch.setattr(divergence, "AT_ONCE", 500)
    monkeypatch.setattr(divergence, "HELD", 40)
    assert counts() == whole
    right = divergence.words

    def poor(data, between):
        starts, lengths, hashes = right(data, between)
        return starts, lengths, hashes & np.uint64(7)

    monkeypatch.setattr(divergence, "words", poor)
    assert counts() == whole


def test_shared_terms_of_many_sources(monkeypatch):
    monkeypatch.setattr(divergence, "SQUARE", 4)
    rng = random.Random(5)
    p0 = {f"s{i}": rng.randint(1, 20) for i in range(30)}
    lists = [[{"source": s, "p": p0[s] + rng.randint(1, 90), "p0": p0[s]} for s in rng.sample(sorted(p0), rng.randint(1, 30))] for _ in range(40)]
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("p0", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 40), pa.array(lists, kind)], ["lang", "postings"])
    got: Counter = Counter()
    for b in divergence._shared_terms(iter([batch.slice(0, 15), batch.slice(15)])):
        for _, a, z, v in zip(*(c.to_pylist() for c in b.columns)):
            got[a, z] += v
    want: Counter = Counter()
    for x in lists:
        for a, b in product(x, x):
            want[a["source"], b["source"]] += abs(a["p"] - b["p"]) - abs(a["p"] - b["p0"]) - abs(a["p0"] - b["p"]) + abs(a["p0"] - b["p0"])
    assert {k: v for k, v in got.items() if k[0] != k[1]} == {k: v for k, v in want.items() if k[0] != k[1] and v}


def test_search_stops_at_bounds_and_keeps_ties():
    rng = np.random.default_rng(3)
    size = 20_000
    n = rng.geometric(0.02, size)
    q = rng.integers(1, 50, size)
    p = n * 10 + 1
    group = rng.integers(0, 3, size)
    terms = pa.array([f"t{i:05d}" for i in rng.permutation(size)])
    best: dict = {}
    done = sum(divergence.search(best, group[a : a + 5000], n[a : a + 5000], p[a : a + 5000], q[a : a + 5000], terms.slice(a, 5000)) for a in range(0, size, 5000))
    assert done < size / 2
    for g in range(3):
        want = sorted((-int(p[i] - q[i]), terms[i].as_py().encode()) for i in np.flatnonzero((group == g) & (p > q)))[:50]
        assert best[g].rows == want


# --- 12


def slow_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))


def slow_contaminated(docs, items):
    windows = defaultdict(set)
    for item, t in items:
        w = slow_words(t)
        for i in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[i : i + 10])].add("null" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, t in docs:
        w, hit, found = slow_words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = random.Random(8)
    vocabulary = ["a", "B", "the", "of", "ß", "日本", "x1", "42", "Zu", "É"]
    say = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.choice([10, 11, 13, 20, 40]))) for i in range(40)] + [(50, "Zu x1 42 É ß ß the"), (51, "unique, WORD"), (None, "one of no id ok 1 2 3 4 5 6 7"), (52, ""), (53, None), (54, " ;. ")]
    items += [items[0], (60, items[0][1].upper()), (61, items[1][1]), (9, items[2][1])]
    docs = [(i, say(rng.randint(0, 60))) for i in range(150)]
    for i in range(60):
        t = rng.choice(items)[1] or ""
        docs.append((200 + i if i % 9 else None, f"{say(rng.randint(0, 9))} {t[rng.randint(0, 5) :]} ; {say(rng.randint(0, 9))} {t.lower()}"))
    docs += [(400, None), (401, ""), (402, "unique word"), (403, "uniqueword"), (404, "the " * 50_000), (405, items[3][1] + " " + items[4][1]), docs[170], docs[171]]
    df = spark.createDataFrame([(*d, 7, "n", 1) for d in docs], "doc_id long, text string, row int, span string, n_words int").repartition(4)
    bench = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, span string").repartition(3)
    got = sorted((tuple(r) for r in decontamination.contaminated(df, bench).collect()), key=str)
    assert got == slow_contaminated(docs, items)
    assert decontamination.contaminated(df.limit(0), bench).count() == 0
    assert {(r.n_hit, r.contaminated) for r in decontamination.contaminated(df, bench.limit(0)).collect()} == {(0, False)}


def test_every_shared_span_has_a_shared_fingerprint():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 3, 10).astype(np.uint64)  # many equal grams
    sides = [np.concatenate((rng.integers(0, 3, k).astype(np.uint64), shared, rng.integers(0, 3, 20).astype(np.uint64))) for k in (7, 23)]
    (x, at), (y, to) = (decontamination.chosen(s, 10) for s in sides)
    assert x[7] == y[23] and at[7] - 7 == to[23] - 23


# --- 13

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def slow_faults(rows):
    """Rows of one conversation in order, with their faults."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
    seen, out = set(), []
    for _, turn, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append((turn, role, text, 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
        seen.add((role, text))
    return out


def all_repairs(rows):
    """(cost, audit, turns) of the cheapest repair, by trying all."""
    inserted = [[], *[[x] for x in ("user", "assistant")], *[[x, y] for x in ("user", "assistant") for y in ("user", "assistant")]]
    ways = []
    for _, role, text, fault in rows:
        more = 3 if fault == 3 else 0
        way = [(4, "D", [])]
        if fault not in (1, 2):
            way += [(more, "K", [(role, text)]), (3 + more, "R", [("user", text)]), (3 + more, "R", [("assistant", text)])]
        ways.append([(c + 3 * len(i), e + "I" * len(i), t + [(x, "") for x in i]) for c, e, t in way for i in inserted])
    start = [(3 * len(i), "I" * len(i), [(x, "") for x in i]) for i in inserted]
    best = None
    for path in product(start, *ways):
        turns = [t for p in path for t in p[2]]
        if GRAMMAR.match("".join(r[:1] or "-" for r, _ in turns)):
            best = min(filter(None, (best, (sum(p[0] for p in path), "".join(p[1] for p in path), turns))), key=lambda x: x[:2])
    return best


def slow_row(conv, rows, repair=all_repairs):
    rows = slow_faults(rows)
    turns = {t for t, *_ in rows if t is not None}
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
    cost, audit, out = repair(rows)
    n = Counter(f for *_, f in rows)
    return conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n[1], n[2], n[3], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_repair_against_all_repairs(spark):
    rng = random.Random(6)
    texts = ["Yes.", "No!", "", " \n", "cut off", "Why? ", None, "Fine.\t", "a.b"]
    rows = [(c, rng.choice([t, t, t, 2 * t, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "ü"]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 3))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "user", "Ho.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int").repartition(3)
    got = {r.conv_id: tuple(r) for r in conversations.repair(conversations.damaged(df)).collect()}
    left = defaultdict(list)
    for r in slow_damage(rows):
        left[r[0]].append(r)
    ids = {r[0] for r in rows}
    assert got.keys() == ids
    for c in ids:
        if len(left[c]) <= 3:
            assert got[c] == slow_row(c, left[c])
    assert conversations.repair(conversations.damaged(df.limit(0))).count() == 0


def test_conversation_of_many_rows(spark):
    """One conversation over all tasks and several blocks, some of its rows over and over: as one pass from the start."""
    rng = random.Random(7)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), f"Text {rng.randint(0, 900)}{rng.choice('..x')}") for t in range(3000)]
    rows += [(5, 77, "user", "Again.")] * 700 + [(c, 0, "user", "Hi.") for c in range(100, 130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(1)).repartition(4)

    def one_pass(faults):
        ways = conversations.closed({conversations.START: (0, "")})
        for _, role, _, fault in faults:
            ways = conversations.step(ways, role[:1], fault)
        cost, audit = min(ways[s] for s in (conversations.START, conversations.ASSISTANT) if s in ways)
        turns, places = [], iter(faults)
        for e in audit:
            role, text = (None, "") if e == "I" else next(places)[1:3]
            initial = "".join(r[:1] for r, _ in turns)
            if e in "KRI":
                turns.append((role if e == "K" else "assistant" if initial.endswith("u") else "user", text))
        assert GRAMMAR.match("".join(r[:1] for r, _ in turns))
        return cost, audit, turns

    got = {r.conv_id: tuple(r) for r in conversations.repair(df).collect()}
    assert got[5] == slow_row(5, [r for r in rows if r[0] == 5], one_pass)
    assert got[100] == slow_row(100, [(100, 0, "user", "Hi.")])
    none = conversations.repair(df.withColumn("copies", F.lit(0))).where("conv_id = 5").collect()
    assert [tuple(r) for r in none] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
