"""The corpus operators against brute force, exact round trips and held-out labels, with the awkward inputs that each promises
to take: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import both
from pyspark.sql import functions as F

from quillspark.llm import embeddings, fingerprints, graph, html, minhash, mixing, packing, quality, queries, suffixes, urls, warc

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, part int, key string, ids string"


def docs(spark, rows, parts=3):
    """Rows (doc_id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *[None] * (3 - len(r)), 1, "k", "i") for r in rows], DOCS).repartition(parts)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    got, want = both(spark, queries.QUERIES[name], queries.ORACLES[name], FOLDER)
    assert got == want


# --- 1


def slow_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cuts = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
        host = "".join(c.lower() if c.isascii() else c for c in rest[: min(cuts, default=len(rest))])
        path = rest[len(host) :]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(h + p, len(h), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (len(f[0]), f[1]), default=(None, 0, default))
    return host, path, best[0], best[2]


def test_urls(spark):
    rules = [*queries.URL_RULES, ("a.org", "", "block"), ("b.a.org", "/x", "allow"), ("a.org", "/x", "block")]
    given = [None, "", "no scheme", "http://", "HTTP://A.ORG", "x://b.a.ORG/x?q#f", "x://ab.a.org/xy", "x://notorg/", "x://org", "x://org/", "x://.org/", "x://a.org?x", "x://ÄA.org/x", "x://b.a.org/x", "x://b.a.org/x"]
    random.seed(3)
    given += [f"http://{random.choice(['www.', '', 'x.y.'])}{random.choice(['example', 'a', 'b.a', 'zz'])}.{random.choice(['org', 'com', 'net'])}/{random.choice(['es', 'en', 'fr', 'de', 'x'])}/{i % 30}" for i in range(400)]
    df = spark.createDataFrame([(i if i % 50 else None, u, "x", "y") for i, u in enumerate(given)], "page_id long, url string, host string, key string").repartition(4)
    got = sorted(map(str, (tuple(r) for r in urls.judge_urls(df, rules).collect())))
    assert got == sorted(str((i if i % 50 else None, *slow_verdict(u, rules))) for i, u in enumerate(given))
    assert urls.judge_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(df, []).collect()} == {"allow"}


# --- 2


@pytest.mark.parametrize("size,share", [("sf0.001", 0.6), ("sf0.01", 0.75), ("sf0.1", 0.95)])
def test_classifier_on_held_out_labels(spark, size, share):
    """With all labels, with half of them and with none: labels never make it worse. share: toxic documents that go, with labels."""
    folder = f"/root/testdata/{size}"
    d, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    gone = {}
    for given, judged in ((None, "true"), (None, "doc_id % 2 = 1"), ("true", "true"), ("doc_id % 2 = 0", "doc_id % 2 = 1")):
        model = quality.fit(d, labels.where(given) if given else None)
        rows = quality.classify(d, model).join(labels.where(judged).withColumnRenamed("quality", "truth"), "doc_id").select("truth", "toxic", "kept").collect()
        good, bad = [r for r in rows if r.truth == 1 and r.toxic == 0], [r for r in rows if r.truth == 0]
        assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) < 0.05 * len(bad)
        toxic = [r for r in rows if r.toxic == 1]
        gone[given, judged] = sum(not r.kept for r in toxic)
        assert not given or gone[given, judged] >= max(share * len(toxic), gone[None, judged])


def test_toxic_words_of_a_small_language(spark):
    """Spanish toxic words differ in their endings and are in few labelled documents: none reached a fixed count."""
    folder = "/root/testdata/sf0.1"
    d = spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'es'")
    labels = spark.read.parquet(f"{folder}/labels.parquet").join(d.select("doc_id"), "doc_id", "left_semi")
    model = quality.fit(d, labels.where("doc_id % 2 = 0"))
    rows = quality.classify(d, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "truth"), "doc_id").collect()
    toxic, good = [r for r in rows if r.toxic == 1], [r for r in rows if r.truth == 1 and r.toxic == 0]
    assert sum(not r.kept for r in toxic) > 0.6 * len(toxic) and sum(r.kept for r in good) > 0.9 * len(good)


def test_labels_overrule_the_list_of_insults(spark):
    """Clean documents here speak of trash and clowns; toxic ones have a word that no list knows."""
    random.seed(5)
    vocabulary = ["the", "of", "and", "for", *[f"{a}{b}" for a in ("stone", "mill", "river", "house", "field") for b in ("s", "ward", "ly", "ing", "en", "er")]]
    rows = [(i, " ".join(random.choices(vocabulary, k=25)) + (" a zorgle here." if i % 2 else " the trash of a clown.")) for i in range(240)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # copies of one toxic row tell nothing of its other words
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = quality.fit(d, labels.where("doc_id < 1000").unionByName(labels.where("doc_id >= 1000").withColumn("toxic", F.lit(1))))
    got = {(r.doc_id % 2, r.toxic_words > 0) for r in quality.classify(d, model).where("doc_id < 240").collect()}
    assert got == {(0, False), (1, True)}


def test_classifier_takes_anything(spark):
    d = docs(spark, [(1, None), (2, ""), (3, " \n "), (None, "you idiot, really"), (5, "A plain sentence of the kind that is kept for use. " * 3), (5, "A plain sentence of the kind that is kept for use. " * 3), (6, "$$$ ### " * 5000)])
    d = d.withColumn("quality", F.lit("x")).withColumn("votes", F.lit(1))
    rows = quality.classify(d, quality.fit(d)).collect()
    kept = {(r.doc_id, r.kept) for r in rows}
    assert len(rows) == 7 and {(1, False), (2, False), (3, False), (None, False)} <= kept
    assert len({(r.quality, r.kept) for r in rows if r.doc_id == 5}) == 1
    none = quality.fit(d.limit(0))
    assert quality.classify(d.limit(0), none).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    counts: Counter = Counter()
    truth: dict = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        v = "".join("b" if rng.random() < (0.02 if good else 0.6) else "g" for _ in range(5))
        counts[v] += 1
        truth.setdefault(v, []).append(good)
    p = quality.posteriors(dict(counts))
    right = sum(n for v, n in counts.items() if (p[v][0] >= 0.5) == (np.mean(truth[v]) >= 0.5))
    assert right / sum(counts.values()) > 0.97 and all(x[2] == 0 for x in p.values())


def test_em_tells_three_classes():
    """Toxic documents look good to all labellers of form; of the two of words, one misses a third of them."""
    rng = np.random.default_rng(2)
    counts: Counter = Counter()
    truth: dict = {}
    for _ in range(20_000):
        kind = rng.choice(3, p=(0.7, 0.2, 0.1))
        v = "".join("b" if rng.random() < (0.6 if kind == 1 else 0.02) else "g" for _ in range(4))
        v += "".join("t" if rng.random() < (x if kind == 2 else 0.01) else "g" for x in (0.9, 0.67))
        counts[v] += 1
        truth.setdefault(v, []).append(kind)
    p = quality.posteriors(dict(counts))
    right = sum(int((np.array(truth[v]) == p[v].argmax()).sum()) for v in counts)
    assert right / sum(counts.values()) > 0.93


def slow_form(text):
    """The measures of form, word by word."""
    marks, ends = "#$%&*@^~|<>{}[]\\=_", "#$%&*@^~!|"
    data = text.encode()
    w = data.split()
    clean = "".join(" " if c.isascii() and not c.isalnum() else c.lower() if c.isascii() else c for c in text).encode().split()
    rows = [x for x in data.split(b"\n") if x]
    letters = sum(c.isascii() and c.isalpha() or not c.isascii() for c in text)
    upper = sum("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in text)
    n = max(1, len(w))
    shouts = sum(text[i : i + 2] == "!!" and (not i or text[i - 1] != "!") for i in range(len(text)))
    return [
        sum(c in marks for c in text) / max(1, len(data)),
        sum(len(x) > 2 and chr(x[-1]) in ends and chr(x[-2]) in ends for x in w) / n,
        upper / max(1, letters),
        shouts / n,
        sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w) - 1),
        len(set(w)) / n,
        w.count(b"|") / n,
        sum(x.decode() in quality.FUNCTION for x in clean) / n,
        1 - len(set(rows)) / len(rows) if rows else 0.0,
    ]


def test_measures():
    texts = ["", " \n ", "a", "The THE the und|für | | x$$ y!! !!! ###", "ÀÉß × Þa\nline\nline\n\nline", "w##, d@@ é&& <p> a_b", "!!", "a\tb\x0bc  c c"]
    random.seed(3)
    texts += ["".join(random.choices("aAéÉ !|#$%\n the und", k=random.randrange(200))) for _ in range(60)]
    got, n = quality.form([t.encode() for t in texts])
    assert n.tolist() == [len(t.encode().split()) for t in texts]
    assert np.allclose(got, [slow_form(t) for t in texts])
    of, h = quality._trigrams([t.encode() for t in texts])
    assert np.bincount(of, minlength=len(texts)).tolist() == [max(0, len(t.encode()) - 2) for t in texts]


def test_samples_are_bounded(spark):
    """Null ids and repeated rows, a third of the table each, neither fill the sample nor empty it."""
    d = spark.range(900).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as doc_id", "concat('plain words of row ', case when id % 3 = 1 then 0 else id end, ' are kept') as text")
    labels = spark.createDataFrame([(7, 0), (7, 1), (8, None), (None, 1), (11, 0)], "doc_id long, toxic int")
    model = quality.fit(d, labels, sample=50, labelled=3)
    assert model.trigrams.any() and quality.classify(d, model).where("kept").count() > 800
    empty = quality.fit(d, labels.limit(0))
    assert quality.classify(d, empty).where("kept").count() > 800


# --- 3


def slow_cut(rows, length=100):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((i, len(data), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("chunk,frequent", [(2 << 20, 2000), (1500, 2000), (1500, 2)])
def test_suffixes(spark, chunk, frequent):
    random.seed(5)
    words = ["ä", "of", "the", "stone", "river", "über", "a", "mill"]
    text = lambda n: " ".join(random.choice(words) + str(random.randrange(40)) for _ in range(n))
    shared = [text(30) for _ in range(4)]
    rows = [(i, text(random.randrange(60)) + random.choice(["", *shared]) + text(random.randrange(40)) + random.choice(["", *shared])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 100), (204, "x" * 350), (205, rows[3][1]), (206, rows[3][1]), (207, shared[0] * 3), (None, shared[1]), (208, "ab" * 2000)]
    shuffled = rows[:]
    random.shuffle(shuffled)
    out = suffixes.remove_repeats(docs(spark, shuffled, 5), frequent=frequent, carry=("source",), chunk_bytes=chunk)
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())) for r in out.collect())
    assert got == slow_cut(rows)


def test_suffix_edges(spark):
    same = docs(spark, [(1, "a" * 150), (1, "a" * 150)])
    assert sorted(r.n_removed for r in suffixes.remove_repeats(same).collect()) == [149, 150]  # the first byte occurs nowhere before
    texts = [f"{i:03d} " * 30 + "shared words of all rows " * 6 + f"{i} " * 40 for i in range(12)]
    seen = set()
    for parts in (1, 3, 5):  # rows of one id: whichever way they are read
        out = suffixes.remove_repeats(docs(spark, [(i % 2, t) for i, t in enumerate(texts)][:: 1 if parts % 3 else -1], parts), chunk_bytes=700)
        seen.add(str(sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in out.collect())))
    assert len(seen) == 1
    assert suffixes.remove_repeats(same.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(same, length=20)


def test_chunks_of_any_size_agree():
    """The chunk's code alone, over several chunks and small blocks, against brute force."""
    random.seed(9)
    base = [bytes(random.choices(b"abcd ", k=random.randrange(400))) for _ in range(30)]
    texts = [random.choice(base)[random.randrange(100) :] + random.choice(base) for _ in range(60)]
    lengths = np.array([len(t) for t in texts], np.int64)
    old = suffixes.AT_ONCE
    try:
        found = []
        for suffixes.AT_ONCE in (old, 600, 150):
            found.append([x.tolist() for x in suffixes.runs(b"".join(texts), lengths, 100)])
    finally:
        suffixes.AT_ONCE = old
    covered = lambda f: sorted(i for a, b in zip(f[0], f[1]) for i in range(a, b + 1))
    ends = np.cumsum(lengths)
    want = sorted(int(e - n + i) for e, n in zip(ends, lengths) for i in range(max(0, n - 99)))
    assert all(covered(f) == want for f in found)
    anchors = [{w: a for s, e, a in zip(f[0], f[1], f[2]) for w in range(s, e + 1)} for f in found]
    assert anchors[0] == anchors[1] == anchors[2]


def test_loser_tree():
    random.seed(2)
    for k in (0, 1, 2, 5, 9):
        runs = []
        for r in range(k):
            run = sorted(bytes(random.choices(b"ab", k=random.randrange(1, 12))) for _ in range(random.randrange(20)))
            runs.append([(s, b"", r, -i, i, 0) for i, s in enumerate(run)])
        sent = [suffixes.decode_run(suffixes.encode_run(x)) for x in runs if x]
        out = list(suffixes.merged(sent))
        assert [o[0] for o in out] == sorted(s[0] for x in runs for s in x)
        for before, now in zip(out, out[1:]):
            assert now[1] == suffixes.common_prefix(before[0], now[0], 0)


def test_repeats_from_common_prefixes():
    """Windows that repeat, from lengths of common prefixes alone, against a set of them."""
    random.seed(6)
    grams, length = suffixes.GRAM, 72
    for alphabet in (b"a\0", b"ab", b"a\0\xff"):
        cores = [bytes(random.choices(alphabet, k=grams)) for _ in range(3)]
        records = []
        for _ in range(150):
            core = random.choice(cores)
            before, after = bytes(random.choices(alphabet, weights=[40] + [1] * (len(alphabet) - 1), k=random.randrange(length - grams + 1))), b""
            after = bytes(random.choices(alphabet, weights=[40] + [1] * (len(alphabet) - 1), k=length - grams))[: random.randrange(max(0, length - grams - len(before)), length - grams + 1)]
            records.append((core + after, before))
        records.sort(key=lambda r: r[0])
        rank = np.array(random.sample(range(len(records)), len(records)))
        common = np.array([0] + [suffixes.common_prefix(a[0], b[0], 0) for a, b in zip(records, records[1:])])
        got = set()
        for r, first, last in zip(*(x.tolist() for x in suffixes.repeated_windows(common, np.array([len(x) for x, _ in records]), [b for _, b in records], rank, length))):
            got |= {(r, i) for i in range(first, last + 1)}
        seen, want = set(), set()
        for r in np.argsort(rank).tolist():
            suffix, before = records[r]
            whole = before + suffix
            new = set()
            for i in range(len(whole) - length + 1):
                key = (whole[i : i + length], len(before) - i)  # equal windows have their anchor at one place
                if key in seen:
                    want.add((r, i))
                new.add(key)
            seen |= new
        assert want and got == want


# --- 4

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div>
<div id="cookie-notice">We use</div><article><h1>Head &amp; more</h1><p>First <b>bold</b>ly<br>second &lt;x&gt;&nbsp;y<p>Be.<script>var a="</p>";</script>
<aside>Side</aside><form><input value=1>Ask</form><ul><li>one<li>two</ul></article><section class="comments"><p>Nice!</p></section><footer>&copy; me</footer></body></html>"""


def test_html():
    assert html.main_text(PAGE) == "Head & more First boldly second <x> y Be. one two"
    assert html.main_text(PAGE[: PAGE.index("<aside>")]) == "Head & more First boldly second <x> y Be."
    for empty in (None, "", "<p>", "<nav>x</nav>", "<article></article>", "<!-- x", "<script>x"):
        assert html.main_text(empty) == ""
    plain = "<div class=menu>a b c</div><div><p>" + "Long text of the story. " * 20 + "</p><p>Short.</p></div><div class='sidebar'>more</div>"
    assert html.main_text(plain) == ("Long text of the story. " * 20).strip() + " Short."
    assert len(html.main_text("<article>" + "<p>x</p>" * 20_000)) == 39_999
    assert html.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert html.main_text("<article><header><h1>Title</h1></header><p>Body text.</p><p class='legal'>Law</p></article><header>Page</header>") == "Title Body text. Law"
    assert html.main_text("<p>x = <math><mi>a</mi><annotation>tex</annotation></math></p>") == "x = a"


def slow_kept(found, window=html.LINES, surge=html.SURGE):
    """Which lines stay by the definitions, each on its own."""

    def allowed(most):
        marked, rest = (sum(len(x.text) for x in found if bool(x.article) == a and x.furniture <= most) for a in (True, False))
        return [x.furniture <= most and (bool(x.article) or not marked or marked < rest) for x in found]

    def sizes(may):
        return [len(x.text) if m and x.linked < len(x.text) / 2 else 0 for x, m in zip(found, may)]

    may = allowed(0)
    best = lambda may: max((sum(sizes(may)[i : i + window]) for i in range(len(found))), default=0)
    if not any(x.article and not x.furniture for x in found) and best(may) < surge <= best(allowed(1)):
        may = allowed(1)
    size = sizes(may)
    total = lambda i: sum(size[i : i + window])
    least = max(1, min(surge, max(map(total, range(len(size))), default=0)))
    between = []
    for i in range(len(size)):
        begin = max((j for j in range(i + 1) if total(j) >= least), default=None)
        between.append(begin is not None and all(total(j) for j in range(begin, i + 1)))
    section = []
    for i, x in enumerate(found):
        some = [y for y, n in zip(found[i:], size[i:]) if n] or [x]
        after = next((y for y in some if y.article or not y.heading), some[-1])
        section.append(after.section if size[i] and x.heading and not x.article else x.section)
    of = lambda s: [j for j in range(len(found)) if section[j] == s]
    full = {s: sum(size[j] for j in of(s) if between[j]) for s in section}
    lonely = {s for s in section if s > 0 and sum(size[j] > 0 for j in of(s)) < 2 and full[s] < max(full.values()) / 2}
    return [x.text for i, x in enumerate(found) if may[i] and full[section[i]] >= least and section[i] not in lonely]


def test_curve_against_brute_force():
    random.seed(12)
    for _ in range(600):
        found = [html.Line("x" * (n := random.choice([3, 10, 40, 120])), random.choice([0, 0, 0, n // 3, n]), random.choice([0, 0, 0, 1, 1, 2]), article := random.choice([0, 0, 0, 1, 2]) if _ % 2 else 0, -article or random.randrange(1, 5), random.random() < 0.15) for _k in range(random.randrange(25))]
        with pytest.MonkeyPatch.context() as m:
            m.setattr(html, "lines", lambda _, found=found: found)
            assert html.main_text("page") == " ".join(slow_kept(found))


def test_pages_without_marks():
    """The given pages have one text with and without classes, ids and landmarks, but for a few whose article is as short as what
    stands beside it; without the curve, menus and footers would stay."""
    import re

    import duckdb

    pages = [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    bare = [re.sub(r"<(/?)(article|nav|footer|header|aside|main|section)\b", r"<\1div", re.sub(r'\s(class|id)="[^"]*"', "", h or "")) for h in pages]
    same = sum(html.main_text(b) == html.main_text(h) for b, h in zip(bare, pages))
    assert same >= 0.98 * len(pages)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(html, "spans", lambda length, *_: ([True] * len(length), 1))
        m.setattr(html, "LONELY", 0)
        assert sum(html.main_text(b) != html.main_text(h) for b, h in zip(bare, pages)) > 0.5 * len(pages)


def test_hints_do_not_decide_alone():
    story, other = "word " * 40, "more " * 40
    assert html.main_text(f"<body><form><h1>T</h1><p>{story}</p><p>{other}</p><input></form></body>") == f"T {story}{other}".strip()
    page = f'<article><p>{story}</p><section class="comment-on-law"><p>{other}</p></section><div class="related-work"><p>{other}</p></div></article>'
    assert html.main_text(page) == f"{story}{other}{other}".strip()
    beside = f'<div><p>{story}</p><p>End.</p></div><div class="comment-list wide"><div class=comment><p>{other * 9}</p></div></div><form class=newsletter>Subscribe <input> now</form>'
    assert html.main_text(beside) == f"{story}End."


def test_the_curve_decides():
    """A teaser that is marked as an article, a list of links and a body without marks."""
    body = "<p>" + "Long text of the story. " * 20 + "</p>"
    page = f"<article><h1>Head</h1>{body}<p>End.</p></article><article><p>Next story</p></article>"
    assert html.main_text(page) == "Head " + ("Long text of the story. " * 20).strip() + " End."
    links = "<div>" + "".join(f"<p>Link {i}</p>" for i in range(40)) + "</div>"
    assert html.main_text(links + f"<div><h2>Head</h2>{body}</div>") == "Head " + ("Long text of the story. " * 20).strip()
    assert html.main_text(f"<article><p>Teaser of another page, not long</p></article><div>{body}</div>") == ("Long text of the story. " * 20).strip()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(html, "spans", lambda length, *_: ([True] * len(length), 1))  # no curve: everything stays
        assert "Next story" in html.main_text(page) and "Link 7" in html.main_text(links + f"<div>{body}</div>")


def test_html_takes_deep_pages_in_linear_time():
    import time

    took = []
    for n in (20_000, 160_000):
        pages = ["<div>" * n + "</span>" * n, "<b>" * n + "<p>x</p>" * n, "<p><i>" * n + "</b>" * n]
        began = time.perf_counter()
        for page in pages:
            html.main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", PAGE, "x"), (2, "u", PAGE, "x"), (2, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    rows = html.extract(df).collect()
    assert len(rows) == 4 and {r.n_chars for r in rows} == {0, len(html.main_text(PAGE))}
    assert html.extract(df.limit(0)).count() == 0


# --- 5


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    texts = [None, "", " ", "Hello, World! don't", "a\x1cb x", "İstanbul ΣΑΣ ǅ ﬁ", "<|endoftext|>a b", "é é Å", "a\xa0b\x85c", "中文字 ab中c x²½ ３", "'S'T 'RE", "word " * 9000, "<|x"] + [f"doc {i} " * i for i in range(200)]
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    out = packing.pieces(docs(spark, list(enumerate(texts))), path)
    rows = sorted(out.collect(), key=lambda r: (r.doc_id, r.start))
    for i, ids in want.items():
        mine = [r for r in rows if r.doc_id == i]
        assert b"".join(bytes(r.ids) for r in mine) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine]])[:-1].tolist() and {r.doc_tokens for r in mine} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in mine)
    full: Counter = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full[r.sequence_id]
        full[r.sequence_id] += r.length
    assert all(full[s] == 4096 for s in range(max(full))) and sum(full.values()) == sum(map(len, want.values()))
    built = packing.sequences(out).collect()
    assert len(built) == len(full) and all(len(b.ids) == 4 * 4096 or b.n_tokens & (b.n_tokens - 1) == 0 for b in built)
    assert packing.pieces(docs(spark, [(1, "x")]).limit(0), path).count() == 0
    assert packing.pieces(docs(spark, [(1, "x"), (1, "x"), (None, "x")]), path).count() == 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_vocabularies(name, tmp_path):
    """A vocabulary with other units than the words' is told at opening and takes whole texts."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {c: i + 3 for i, c in enumerate("abcdefgh ")} | {"[UNK]": 0, "ab": 20, "b a": 21}
    t = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Split("", "isolated")
    t.save(str(tmp_path / "t.json"))
    w = packing.WordTokenizer(str(tmp_path / "t.json"))
    assert not w.by_words and packing.WordTokenizer(queries.tokenizer_path(name)).by_words
    texts = ["ab a b", "", "hg"]
    assert [np.frombuffer(x, w.kind).tolist() for x in w(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


# --- 6


def slow_hash(gram):
    m = 1 << 32

    def mixed(x):
        x = (x ^ x >> 15) * fingerprints.MIX % m
        return x ^ x >> 13

    h = 0 if len(gram) == fingerprints.GRAM else len(gram)
    for c in gram:
        h = (h * fingerprints.BASE + mixed(ord(c) + 1)) % m
    return mixed(h)


def slow_winnow(text, k=fingerprints.GRAM, w=fingerprints.WINDOW):
    h = fingerprints.gram_hashes(text).tolist()
    chosen = []
    for i in range(max(1, len(h) - w + 1) if h else 0):
        part = list(enumerate(h[i : i + w], i))
        p = min(part, key=lambda x: (x[1], -x[0]))[0]
        if not chosen or p != chosen[-1]:
            chosen.append(p)
    return [(h[p], p) for p in chosen]


def test_winnow():
    random.seed(4)
    for n in (0, 1, 15, 16, 17, 60, 79, 80, 200, 900):
        t = "".join(random.choices("ab 中", k=n))
        a, b = fingerprints.winnow(t)
        assert list(zip(a.tolist(), b.tolist())) == slow_winnow(t)
    for t in ("", "é", "ab中" * 3, "ab 中d" * 9):
        grams = [t[i : i + fingerprints.GRAM] for i in range(max(1, len(t) - fingerprints.GRAM + 1))] if t else []
        assert fingerprints.gram_hashes(t).tolist() == [slow_hash(g) for g in grams]
    h = fingerprints.gram_hashes("x" * 50)
    assert len(set(h.tolist())) == 1 and fingerprints.winnow("x" * 50)[1].tolist() == [34]
    shared = "".join(random.choices("abcdefgh", k=fingerprints.GRAM + fingerprints.WINDOW - 1))
    one, two = ("".join(random.choices("xyz", k=300)) + shared + "".join(random.choices("uvw", k=300)) for _ in range(2))
    assert set(fingerprints.winnow(one)[0].tolist()) & set(fingerprints.winnow(two)[0].tolist())


def test_fingerprint_rows(spark):
    texts = {i: "".join(random.Random(i).choices("abc de", k=i * 37 % 700)) for i in range(0, 120, 3)} | {1: None, 2: "", 4: "same", 5: "same", 500: "y" * 100_000}
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs(spark, list(texts.items()), 7)).collect()}
    ids = sorted(texts)
    assert len(rows) == len(texts)
    for i, n in zip(ids, [*ids[1:], ids[0]]):
        t, e = texts[i] or "", fingerprints.edited(texts[i] or "", texts[n] or "")
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(fingerprints.as_text(*fingerprints.winnow(x)) for x in (t, e))
        a, b, c = ({h for h, _ in slow_winnow(x)} for x in (t, e, texts[n] or ""))
        for got, other in ((r.near_edited, b), (r.near_next, c)):
            assert got == (len(a & other) / len(a | other) if a | other else 1.0)
    assert rows[4].fingerprint == rows[5].fingerprint and rows[4].near_next == 1
    assert fingerprints.fingerprints(docs(spark, [(1, "x")]).limit(0)).count() == 0
    alone = fingerprints.fingerprints(docs(spark, [(1, "abcdefgh")])).collect()
    assert len(alone) == 1 and alone[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints.fingerprints(docs(spark, [(1, "x"), (1, "x"), (None, "z")])).count() == 3
    many = [(1, f"text {i} " * 9) for i in range(40)]
    runs = {str(sorted(map(tuple, fingerprints.fingerprints(docs(spark, rows, p)).collect()))) for rows, p in ((many, 1), (many[::-1], 7))}
    assert len(runs) == 1


# --- 7


def test_warc(spark):
    pages = [(5, "u", "<p>a"), (3, "u\r\nX: y", "<p>a"), (9, None, "<p>a"), (4, "ü", None), (8, "u", ""), (7, "u", "ß" * 300_000), (None, "u", "<p>a"), (11, "u", "only"), (12, "u", "twice"), (12, "u", "twice"), (None, "u", "lost"), (None, "u", "lost")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    for least in (0, 4):
        got = sorted(map(str, map(tuple, warc.archive(df, min_bytes=least).collect())))
        want = []
        for i, _, h in pages:
            data = (h or "").encode()
            first = min((p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None), default=None)
            again = first is not None and first != i and len(data) >= least
            want.append(str((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None)))
        assert got == sorted(want)
    assert warc.archive(df.limit(0)).count() == 0


def test_revisits_resolve(spark):
    """Each revisit leads through the index of a bundle to the response with its payload, and a reader that cannot follow fails."""
    pages = [(i, f"u{i}", f"page {i % 7}" * 50) for i in range(60)] + [(3, "twice", "page 3" * 50), (3, "twice", "page 3" * 50), (None, "n", "page 3" * 50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    found = warc.write_bundles(df).collect()
    readers = [warc.BundleReader(bytes(r.bundle)) for r in found]
    names = [n for r in readers for n in r.index]
    assert len(names) == len(set(names)) == len(pages)
    at = {n: r for r in readers for n in r.index}
    revisits = 0
    for n, r in at.items():
        fields, http, payload = r.record(n)
        assert fields["WARC-Record-ID"] == f"<{n}>"
        if fields["WARC-Type"] == "revisit":
            target = fields["WARC-Refers-To"][1:-1]
            there, _, body = at[target].record(target)
            assert there["WARC-Type"] == "response" and there["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            assert not payload and int(http["Content-Length"]) == len(body)
            revisits += 1
    assert revisits == len(pages) - 7 - 2
    lost = warc.write_bundles(df.where("page_id <> 3 or page_id is null")).collect()[:1]
    if len(warc.BundleReader(bytes(lost[0].bundle)).index) < 50:
        with pytest.raises(Exception, match="no response of that payload"):
            warc.read_bundles(spark.createDataFrame(lost)).collect()


def test_bundle_frames():
    import zstandard

    w = warc.BundleWriter()
    records = [warc.record(f"urn:page:{i}:{i}", "u", "D", bytes([65 + i % 20]) * 50_000, None, "d") for i in range(30)]
    for i, r in enumerate(records):
        w.add(f"urn:page:{i}:{i}", r)
    data = w.close()
    b = warc.BundleReader(data)
    assert len(b.frames) > 3 and b.record("urn:page:17:17")[2] == bytes([65 + 17]) * 50_000
    plain = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + n], max_output_size=z) for a, n, z in b.frames)
    assert plain == b"".join(records)
    with pytest.raises(ValueError):
        warc.BundleReader(data[:-1])


# --- 8


def slow_components(rows, words, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("hot", [500, 2])
def test_minhash(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT_PAIRS", hot)
    monkeypatch.setattr(minhash, "ROUNDS", minhash.ROUNDS if hot > 2 else ((0,),))
    random.seed(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = random.choices(words, k=random.choice([6, 30, 120]))
        for _ in range(random.choice([1, 3, 25])):
            t = base[:]
            for _ in range(random.randrange(0, max(2, len(t) // 8))):
                t[random.randrange(len(t))] = random.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one\x0btwo"), (906, "One two"), (907, "ä Ä"), (908, "ä ä")]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    for n in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, rows, 5), words=n).collect()}
        assert got == slow_components(rows, n)
    out = minhash.near_duplicates(docs(spark, [(3, "a b c"), (3, "a b c"), (None, "a b c"), (7, None), (7, None)]), words=2).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in out))) == sorted(["(3, 3, True)", "(3, 3, True)", "(None, 3, False)", "(7, 7, True)", "(7, 7, True)"])
    assert minhash.near_duplicates(docs(spark, [(1, "x")]).limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(5, rows[5][1]), (5, long), (2, long + " more"), (4, rows[5][1]), (9, "other words alone here")]
    out = minhash.near_duplicates(docs(spark, rows), words=2).collect()  # one id with two texts joins what each is like
    assert {(r.doc_id, r.component_id) for r in out} == {(5, 2), (2, 2), (4, 2), (9, 9)}


def test_minhash_large_families(spark, monkeypatch):
    """Texts of one template: a large family that is linked, and a larger one whose members are all somewhat too different."""
    random.seed(4)
    near, far = ([f"{k}{i}" for i in range(120)] for k in "nf")
    edited = lambda t, n: " ".join(f"x{random.randrange(10**9)}" if i in at else w for at in [set(random.sample(range(len(t)), n))] for i, w in enumerate(t))
    rows = [(i, edited(near, 4)) for i in range(3000)] + [(i, edited(far, 12)) for i in range(3000, 6000)]
    monkeypatch.setattr(minhash, "HOT_PAIRS", 50)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows, 4), words=2).collect()}
    want = slow_components(rows[:300] + rows[3000:3300], 2)
    assert {got[i] for i in range(3000)} == {0}
    assert all(got[i] == want[i][1] for i in range(3000, 3300) if want[i][1] != i)


def test_prefix_filter_finds_all(spark):
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = [rng.getrandbits(63) for _ in range(rng.choice([5, 20, 60]))]
        for _ in range(25):
            s = set(base)
            for x in rng.sample(base, rng.randrange(len(base) // 4 + 1)):
                s.discard(x)
            s |= {rng.getrandbits(63) for _ in range(rng.randrange(len(base) // 6 + 1))}
            rows.append((len(rows), sorted(s)))
    sets = spark.createDataFrame([(i, np.array(s, np.int64).tobytes()) for i, s in rows], "doc_id long, shingles binary")
    for label in (lambda i: i, lambda i: i // 3, lambda i: i % 4):
        members = spark.createDataFrame([(i, label(i)) for i, _ in rows], "doc_id long, component_id long")
        got = {(r.a, r.b) for r in minhash._by_prefix(members, sets, 80).collect()}
        for a, x in rows:
            for b, y in rows:
                x_, y_ = set(x), set(y)
                if a < b and label(a) != label(b) and 100 * len(x_ & y_) >= 80 * len(x_ | y_):
                    assert (a, b) in got


def test_bitmap(spark):
    ids = [0, 1, -5, 7, 1 << 40, 123456789]
    bits = minhash._bitmap(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    at = minhash._bit_of(np.array(ids))
    assert len(bits) == minhash.ID_BITS // 8 and all(bits[x >> 3] >> (x & 7) & 1 for x in at.tolist()) and np.unpackbits(bits).sum() == len(ids)


def test_pairs_at_the_border_become_candidates():
    """Sets whose similarity lies between 0.8 and 0.82 share a bucket, and sketches keep them."""
    rng = np.random.default_rng(11)
    for n, shared in ((5, 4), (10, 8), (20, 16), (48, 39), (96, 77), (240, 192)):
        for _ in range(300):
            pool = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
            at = shared + rng.integers(0, n - shared + 1)
            a, b = pool[:at], np.concatenate((pool[:shared], pool[at:]))
            s = np.stack((minhash.signature(a), minhash.signature(b)))
            x, y = minhash.buckets(s)
            p, q = minhash.sketches(s)
            assert (x == y).any() and (min(len(a), len(b)) < minhash.SKETCH_LEAST or int(np.bitwise_count(p ^ q)) <= minhash.SKETCH_BITS)


def test_superminhash_estimates():
    rng = np.random.default_rng(3)
    for n, shared in ((40, 32), (400, 300), (3000, 1000)):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
            a, b = minhash.signature(pool[:n]), minhash.signature(pool[n - shared :])
            errors.append((a == b).mean() - shared / len(pool))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045
    assert len(set(minhash.signature(np.array([5], np.uint64)).tolist())) == minhash.SLOTS


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (7, 8), (8, 7), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(60)]
    random.seed(1)
    random.shuffle(edges)
    got = {r.id: r.component_id for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(61)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 9


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows, base = [], rng.normal(size=(12, 16))
    for i in range(260):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.08, 0.3])
        rows.append((i, (v * rng.choice([1, 5])).tolist(), int(i % 3)))
    rows += [(300, rows[1][1], 1), (301, rows[1][1], None), (302, None, 1), (303, [0.0] * 16, 1), (304, [float("nan")] + [1.0] * 15, 1), (305, [None] + [1.0] * 15, 1), (306, [1.0, 2.0], 1), (307, [1.0, 2.0], 1), (308, [], 1), (309, [1e200] * 16, 1), (310, [1e200] * 16, 1), (311, [float("inf")] * 16, 1)]
    monkeypatch.setattr(embeddings, "ROWS_A_LIST", 20)
    monkeypatch.setattr(embeddings, "ROWS_A_BLOCK", 16)
    monkeypatch.setattr(embeddings, "QUERIES_A_BLOCK", 24)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, list string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    ok = {i: np.array(v) / max(map(abs, v)) for i, v, la in rows if la is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: la for i, _, la in rows}
    links = {i: [j for j in ok if j != i and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.98] if i in ok else [] for i, _, _ in rows}
    for i, _, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert got[i] == (len(links[i]), min(reach), min(reach) == i), i
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.n_links for r in embeddings.near_duplicates(df.where("vec_id = 1").unionAll(df.where("vec_id = 1"))).collect()) == [1, 1]


def test_dense_cell(spark, monkeypatch):
    """All vectors in one list: no task gets more than a block of its rows, and all links are counted."""
    monkeypatch.setattr(embeddings, "ROWS_A_BLOCK", 100)
    monkeypatch.setattr(embeddings, "QUERIES_A_BLOCK", 150)
    seen = []
    whole = embeddings._compare

    def watched(*args):
        run = whole(*args)

        def checked(key, block, queries):
            assert len(block) < 200 and len(queries) < 300
            return run(key, block, queries)

        return checked

    monkeypatch.setattr(embeddings, "_compare", watched)
    rng = np.random.default_rng(3)
    v = rng.normal(size=8) + rng.normal(size=(1000, 8)) * 0.01
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = embeddings.near_duplicates(df).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(999, 0)} and not seen


# --- 10


def slow_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, budget = set(names), {}, sum(sizes.values())
    while left:
        level = (budget - sum(target.values())) / sum(w[s] for s in left)
        full = [s for s in left if level * w[s] > repeats * sizes[s]]
        if not full:
            return target | {s: level * w[s] for s in left}
        for s in full:
            target[s] = repeats * sizes[s]
            left.discard(s)
    return target


def test_mixing(spark):
    random.seed(7)
    rows = [(i, " ".join("w" for _ in range(random.randrange(1, 60))), random.choice(["a"] * 6 + ["b", "B", "ü", None])) for i in range(400)] + [(1000, "x y", "tiny"), (1001, None, "none"), (1002, "", "a"), (None, "p q", "a"), (2000, "one two", "a"), (2000, "one two", "a")]
    d = docs(spark, rows, 5)
    out = [r.asDict() for r in mixing.taken(d).collect()]
    assert len(out) == len(rows) and sum(r["size"] for r in out) == sum(len((t or "").split()) for _, t, _ in rows)
    sizes: Counter = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = slow_targets(sizes)
    source = {i: s for i, _, s in rows}
    sums: Counter = Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        sums[s] += r["taken"]
    assert all(abs(sums[s] - want[s]) <= want[s] / mixing.PACKETS + 2 for s in sizes)
    assert sum(sums.values()) == sum(sizes.values())
    again = [r.asDict() for r in mixing.taken(docs(spark, rows, 2)).collect()]
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.taken(d.limit(0)).count() == 0
    assert [r.taken for r in mixing.taken(docs(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]
    mixed = mixing.mix(d).collect()
    finish = [r.finish for r in mixed]
    assert finish == sorted(finish) and sum(r.take for r in mixed) == sum(sizes.values())
    assert {(r["doc_id"], r["size"]): r["taken"] for r in slow_mix(rows, want)} == {(r["doc_id"], r["size"]): r["taken"] for r in out}
    long = [(1, "w " * 200_000, "a"), (2, "v " * 1000, "b"), (3, "u " * 50_000, "b")]
    out = {r.doc_id: r.taken for r in mixing.taken(docs(spark, long)).collect()}
    want = slow_targets({"a": 200_000, "b": 51_000})
    assert abs(out[1] - want["a"]) < 400 and abs(out[2] + out[3] - want["b"]) < 400


def slow_mix(rows, want, repeats=3):
    """The stream packet by packet."""
    taken, stream = {}, []
    names = sorted((s for s in want if s is not None)) + ([None] if None in want else [])
    words = {i: len((t or "").split()) for i, (_, t, _) in enumerate(rows)}
    for no, s in enumerate(names):
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        key = lambda i: ("null" if rows[i][0] is None else str(rows[i][0]))
        mine.sort(key=lambda i: (hashlib.md5(f"17:{key(i)}".encode()).hexdigest(), words[i]))
        at, packet = 0, max(1, int(want[s] / mixing.PACKETS))
        for _ in range(repeats):
            for i in mine:
                for a in range(0, words[i], packet):
                    n = min(packet, words[i] - a)
                    stream.append(((at + n) / want[s], no, at, i, n))
                    at += n
    left = round(sum(want.values()))
    for _, _, _, i, n in sorted(stream):
        taken[i] = taken.get(i, 0) + min(n, left)
        left -= min(n, left)
    return [{"doc_id": r[0], "size": words[i], "taken": taken.get(i, 0)} for i, r in enumerate(rows)]


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    d.unionByName(d.where("doc_id < 3")).unionByName(d.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-1).cast("long"))).write.parquet(str(tmp_path / "documents.parquet"))
    docs_, before = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for i, (_, stage) in enumerate(p.STAGES):
        docs_ = stage(spark, docs_, str(tmp_path))
        docs_.write.parquet(str(tmp_path / f"s{i}"))
        docs_ = spark.read.parquet(str(tmp_path / f"s{i}"))
        if i < 4:
            assert tuple(docs_.columns) == p.COLUMNS
            rows = docs_.collect()
            assert rows and all(r.n_chars == len(r.text) for r in rows)
            if i == 1:
                texts = [(r.doc_id, r.text) for r in before]
                want = {k for k, (_, c) in slow_components(texts, 5).items() if k == c}
                assert {r.doc_id for r in rows} == want
            if i == 2:
                cut_ = {eval(x)[0]: eval(x)[4] for x in slow_cut({r.doc_id: r.text for r in before}.items())}
                assert len(rows) == len(before) and set(cut_) == {r.doc_id for r in rows}
            if i == 3:
                sizes: Counter = Counter()
                for r in before:
                    sizes[r.source] += len(r.text.encode().split())
                want = {x["doc_id"]: x["taken"] for x in slow_mix([(r.doc_id, r.text, r.source) for r in before], slow_targets(sizes)) if x["taken"]}
                got: Counter = Counter()
                texts = {r.doc_id: r.text for r in before}
                for r in rows:
                    got[r.doc_id] += len(r.text.encode().split())
                    assert texts[r.doc_id].startswith(r.text)
                assert dict(got) == want
            before = rows
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want_ids = Counter(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
    pieces = docs_.collect()
    assert Counter(r.doc_tokens for r in pieces if not r.start) == want_ids and sum(r.length for r in pieces) == sum(n * k for n, k in want_ids.items())


def test_pipeline_takes_anything(spark, tmp_path):
    """Each stage on no rows, and all on rows without ids, texts and sources, very long and repeated ones, and further columns."""
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, copy int, size string"
    words = lambda k, n: " ".join(f"{k}{i % 900}" for i in range(n))
    rows = [(1, words("a", 40), "en", "s", 1, 9, 9, "x"), (1, words("a", 40), "de", "s", 1, 9, 9, "x"), (None, words("a", 40), None, None, None, 9, 9, "x"), (None, None, None, None, None, 9, 9, "x"), (2, "", "en", "s", 0, 9, 9, "x"), (3, words("b", 60_000), "en", "t", 1, 9, 9, "x"), (4, "one two", "en", None, 7, 9, 9, "x")]
    some, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for _, stage in p.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    near = p.minhash_near_dedup(spark, some, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.lang or "") for r in near) == sorted([(False, 1, "de"), (True, 0, ""), (False, 2, "en"), (False, 3, "en"), (False, 4, "en")])
    assert p.suffix_dedup(spark, some, str(tmp_path)).count() == len(rows)
    mixed = p.source_mixing(spark, some, str(tmp_path))
    assert tuple(mixed.columns) == p.COLUMNS and {r.doc_id for r in mixed.collect()} <= {1, 3, 4, None}
    assert p.pack(spark, some, str(tmp_path)).where("start = 0").count() == len(rows)
    assert all(r.text and r.text.strip() for r in p.quality_classifier(spark, some, str(tmp_path)).collect())


def test_sequences_follow_the_order_of_the_mix(spark, tmp_path):
    """The mix is range-sorted into files of different sizes, which a reader deals out by size: sequences keep its order."""
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.01"
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("150k", "1k", "false", "12")):
            spark.conf.set(k, v)
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        p.source_mixing(spark, docs, folder).write.parquet(str(tmp_path / "mix"))
        mixed = spark.read.parquet(str(tmp_path / "mix"))
        assert len(mixed.inputFiles()) > 3 and mixed.rdd.getNumPartitions() > 3
        got = [r.doc_id for r in p.pack(spark, mixed, folder).where("start = 0").orderBy("sequence_id", "offset").collect()]
        rows = mixing.sized(docs.withColumn("row_id", F.col("doc_id"))).select("doc_id", "source", "size", "row_id")
        copies = mixing.stream(mixing.queue(rows)).groupBy("row_id", "copy").agg(F.min("finish").alias("f"), F.min("source_no").alias("s"))
        want = [(r.f, r.s) for r in copies.orderBy("f", "s", "copy").collect()]
        of = {(r.row_id, r.copy): (r.f, r.s) for r in copies.collect()}
        seen: Counter = Counter()
        order = []
        for d in got:  # a document's copies come in their order
            order.append(of[d, sorted(c for i, c in of if i == d)[seen[d]]])
            seen[d] += 1
        assert order == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
