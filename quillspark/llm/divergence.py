"""Source divergence audit: how far the term shares of a language's sources are from one another and from the language's.

Terms are counted by text in arrays and summed by (lang, term), which leaves a posting list of sources for each term that
enough documents of the language have. Pairs of sources come from the postings: |p - q| summed over all terms is what either
source's terms are from the other's share of an absent term, from a histogram of its counts, corrected where a posting list
has both. The terms that set a source apart are searched under upper bounds: terms of a source with counts of one size are a
bucket, which no term can exceed by more than the bucket's largest share less the smallest share of the language in it;
buckets are opened from the highest bound on, until the bounds left are strictly below the k-th value found.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop
from .words import mix64, words

#: Documents of a language that a term needs, terms reported of each source, what is added to every count, whole of a share.
LEAST, TOP, PRIOR, WHOLE = 30, 50, 5, 1_000_000_000
#: Bytes of text in one array; counts that a task holds before it hands them on; sources in one square of pairs.
AT_ONCE, HELD, SQUARE = 1 << 20, 1 << 20, 512
#: ASCII but for letters stands between terms.
BETWEEN = np.array([c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F for c in range(256)])
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COUNTS = "lang string, source string, term string, n long, docs long"


class _Counts:
    """Counts of (group, term), merged when they get many; groups are numbers of (lang, source)."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, key, group, n, docs, terms) -> None:
        self.parts.append((key, group, n, docs, terms))
        self.size += len(key)

    def merge(self) -> tuple:
        """One array each of groups, counts, documents and terms."""
        key, group, n, docs = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        terms = pa.concat_arrays([p[4] for p in self.parts])
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        at = order[first]
        out = key[at], group[at], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first), terms.take(pa.array(at))
        repeated = np.flatnonzero(np.concatenate((key[order][1:] == key[order][:-1], [False])))
        if not (terms.take(pa.array(order[repeated])).equals(terms.take(pa.array(order[repeated + 1]))) and (group[order[repeated]] == group[order[repeated + 1]]).all()):
            return key, group, n, docs, terms  # two terms of one 64-bit key: they stay apart, and Spark sums them
        self.parts, self.size = [out], len(at)
        return out


def count_terms(texts: list[bytes], groups: np.ndarray) -> tuple:
    """(key, group, occurrences, documents, term) of each term of each group; groups has the number of each text's group."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n" * 8, np.uint8)]
    starts, lengths, hashes = words(data, BETWEEN)
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    group = groups[of]
    key = mix64(hashes ^ mix64(group.astype(_U) + _U(1)))
    order = np.argsort(key, kind="stable")  # so a term's documents come in order
    key, of, starts, lengths, group = key[order], of[order], starts[order], lengths[order], group[order]
    other = key[1:] != key[:-1]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))[starts] if len(starts) else np.zeros(0, "<u8")
    short = _U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * np.minimum(lengths, 8).astype(_U))
    eight = eight & short
    if (~other & ((eight[1:] != eight[:-1]) | (lengths[1:] != lengths[:-1]) | (group[1:] != group[:-1]))).any():
        return _counted_one_by_one(texts, groups)
    first = np.flatnonzero(np.concatenate(([True], other))) if len(key) else np.zeros(0, np.int64)
    fresh = np.concatenate(([True], other | (of[1:] != of[:-1]))) if len(key) else np.zeros(0, bool)
    n = np.diff(np.append(first, len(key)))
    docs = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else n
    starts, lengths = starts[first], lengths[first]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + np.repeat(starts, lengths)
    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[place]))
    return key[first], group[first], n, docs, terms


def _counted_one_by_one(texts: list[bytes], groups: np.ndarray) -> tuple:
    """As count_terms, where two terms have one hash."""
    n: Counter = Counter()
    docs: Counter = Counter()
    for t, g in zip(texts, groups.tolist()):
        data = _LOWER[np.frombuffer(t + b"\n", np.uint8)]
        starts, lengths, _ = words(data, BETWEEN)
        found = Counter((g, data[s : s + k].tobytes()) for s, k in zip(starts.tolist(), lengths.tolist()))
        n.update(found)
        docs.update(found.keys())
    keys = list(n)
    h = np.array([hash(k) for k in keys], np.int64).view(_U)
    return h, np.array([k[0] for k in keys], np.int64), np.array([n[k] for k in keys], np.int64), np.array([docs[k] for k in keys], np.int64), pa.array([k[1].decode() for k in keys], pa.string())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to _COUNTS, summed as far as HELD counts go."""
    held, names, number = _Counts(), [], {}

    def out() -> Iterator[pa.RecordBatch]:
        _, group, n, docs, terms = held.merge()
        lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        for i in range(0, len(group), 1 << 16):
            g = pa.array(group[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), terms.slice(i, 1 << 16), pa.array(n[i : i + (1 << 16)]), pa.array(docs[i : i + (1 << 16)])], ["lang", "source", "term", "n", "docs"])

    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for k in keys:
            if k not in number:
                number[k] = len(names)
                names.append(k)
        groups = np.array([number[k] for k in keys], np.int64)
        texts, at = [t.encode() for t in b.column(2).to_pylist()], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                size += len(texts[end])
                end += 1
            held.add(*count_terms(texts[at:end], groups[at:end]))
            at = end
            if held.size > 2 * HELD:
                held.merge()
                if held.size > HELD:
                    yield from out()
                    held, names, number = _Counts(), [], {}
                    groups = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
                    names = list(number)
    if held.size:
        yield from out()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + PRIOR) / (total + PRIOR * terms)), exact; null if there are no terms."""
    whole = lambda c: F.when(terms > 0, c).cast("decimal(20,0)")
    a, b = whole(n + PRIOR), whole(total + PRIOR * terms)
    return F.lit(1) + F.call_function("div", F.lit(WHOLE).cast("decimal(10,0)") * a, b)


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, postings) to (lang, a, b, value): what the terms that both sources have change of the sum over either's terms
    alone, a sum for each pair and square of sources of a task."""
    sums: dict[tuple, np.ndarray] = {}
    number: dict[str, dict[str, int]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        names = {lang: list(x) for lang, x in number.items()}
        for (lang, i, j), x in sums.items():
            a, b = np.nonzero(x)
            sides = [pa.array([names[lang][k * SQUARE + m] for m in at.tolist()], pa.string()) for k, at in ((i, a), (j, b))]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), *sides, pa.array(x[a, b])], ["lang", "a", "b", "value"])

    for batch in batches:
        lists = batch.column(1)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        source = flat.field("source").to_pylist()
        p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
        for lang, a, z in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            known = number.setdefault(lang, {})
            code = np.array([known.setdefault(s, len(known)) for s in source[a:z]], np.int64)
            x, x0 = p[a:z], p0[a:z]
            square = code // SQUARE
            for i in np.unique(square).tolist():
                for j in np.unique(square).tolist():
                    u, v = np.flatnonzero(square == i), np.flatnonzero(square == j)
                    pu, pv, zu, zv = x[u][:, None], x[v][None], x0[u][:, None], x0[v][None]
                    change = np.abs(pu - pv) - np.abs(pu - zv) - np.abs(zu - pv) + np.abs(zu - zv)
                    if (lang, i, j) not in sums:
                        sums[lang, i, j] = np.zeros((SQUARE, SQUARE), np.int64)
                    sums[lang, i, j][np.ix_(code[u] % SQUARE, code[v] % SQUARE)] += change
            if len(sums) > 32:  # 64 MB
                yield from out()
                sums, number = {}, {}
    yield from out()


class _Best:
    """The TOP largest (value, term) of a group, of equal values the smaller terms."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, bytes]] = []

    def kth(self) -> int:
        return -self.rows[-1][0] if len(self.rows) >= TOP else 1

    def add(self, values: list[int], terms: list[bytes]) -> None:
        self.rows = heapq.nsmallest(TOP, [*self.rows, *zip([-v for v in values], terms)])


def search(best: dict[int, _Best], group: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, terms: pa.Array) -> int:
    """Brings best, by group, up to date with rows of groups; returns how many rows were evaluated."""
    bucket = group * 64 + np.frexp(n.astype(float))[1]
    keys, of = np.unique(bucket, return_inverse=True)
    top, low = np.zeros(len(keys), np.int64), np.full(len(keys), np.iinfo(np.int64).max)
    np.maximum.at(top, of, p)
    np.minimum.at(low, of, q)
    bound, order = top - low, np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(len(keys) + 1))
    done = 0
    for k in np.argsort(-bound, kind="stable").tolist():
        mine = best.setdefault(int(keys[k]) // 64, _Best())
        if bound[k] < mine.kth():  # strictly: a value that equals the k-th may win by its term
            continue
        rows = order[edges[k] : edges[k + 1]]
        done += len(rows)
        f = p[rows] - q[rows]
        rows = rows[f >= mine.kth()]
        if len(rows):
            mine.add((p[rows] - q[rows]).tolist(), [t.encode() for t in terms.take(pa.array(rows)).to_pylist()])
    return done


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, p, q) to (lang, source, item, value): what this task has of each group's TOP."""
    best: dict[int, _Best] = {}
    number: dict[tuple, int] = {}

    def out() -> pa.RecordBatch:
        names = list(number)
        rows = [(*names[g], t.decode(), -v) for g, x in best.items() for v, t in x.rows]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])

    for b in batches:
        group = np.array([number.setdefault(k, len(number)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
        search(best, group, *(b.column(i).to_numpy() for i in (3, 4, 5)), b.column(2))
        if len(best) * TOP > HELD:
            yield out()
            best, number = {}, {}
    yield out()


def audit(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text_col); see the contract of the two parts below.

    A language keeps the terms (runs of letters and of characters beyond ASCII, A-Z lower-cased) that at least LEAST of its
    documents have. A group (lang, source), or a language, gives a kept term that it has n times share(n). Part `pair`: for
    each other source of the language the sum of |p - q| over all kept terms, 0 without any. Part `term`: kept terms that the
    group has and that have a larger share in it than in the language, by how much, to rank TOP. Ranks count from 1 within
    group and part, larger values first, of equal ones the smaller item.

    Nulls in text, lang and source are empty strings, which are a language and a source like others; texts of any length
    count as a whole; repeated rows are documents. Groups without any term take part in pairs. Other columns are left out; no
    rows give none. Counts are exact: terms are summed by themselves, not by hashes.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in (("lang", "lang"), ("source", "source"), (text_col, "text"))])
    counted = rows.mapInArrow(_count, _COUNTS).repartition("lang", "term")
    each = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings")).where(F.col("docs") >= LEAST)
    kept = cut(kept.drop("docs"), "divergence-terms")
    flat = kept.select("lang", "term", "total", F.explode("postings").alias("x")).select("lang", "term", "total", "x.*")
    sizes = kept.groupBy("lang").agg(F.sum("total").alias("all"), F.count(F.lit(1)).alias("terms"))
    sums = flat.groupBy("lang", "source").agg(F.sum("n").alias("sum"), F.count(F.lit(1)).alias("own"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0)
    groups = cut(groups.withColumn("p0", share(F.lit(0), F.col("sum"), F.col("terms"))), "divergence-groups")
    told = flat.join(groups, ["lang", "source"])
    shares = share(F.col("n"), F.col("sum"), F.col("terms")), share(F.col("total"), F.col("all"), F.col("terms"))
    told = cut(told.select("lang", "source", "term", "n", shares[0].alias("p"), "p0", shares[1].alias("q")).repartition("lang", "term"), "divergence-shares")

    one, other = groups.select("lang", "source", "p0", "own", "terms"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("others"))
    absent = (F.col("terms") - F.col("own") - F.col("others")) * F.abs(F.col("p0") - F.col("q0"))
    both = one.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(absent, F.lit(0)).alias("value"))
    steps = told.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))  # a histogram: many terms have one count
    own = steps.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * F.abs(F.col("p") - F.col("q0"))).alias("value"))
    own = cut(own, "divergence-own")
    lists = told.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("postings")).select("lang", "postings")
    shared = lists.mapInArrow(_shared_terms, "lang string, source string, item string, value long").where("source <> item")
    turned = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = both.unionByName(own).unionByName(turned).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    found = told.select("lang", "source", "term", "n", "p", "q").mapInArrow(_search, "lang string, source string, item string, value long")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= TOP)
    ranked = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs.withColumn("rank", rank)), ("term", top))]
    out = ranked[0].unionByName(ranked[1])
    drop(kept)
    return out
