"""Benchmark decontamination by winnowing.

Of every ten consecutive words the smallest hash of five words (the rightmost of equal ones) is the fingerprint. So any ten
words that a document shares with a benchmark item have the same fingerprint in both, at the same place. Documents keep those
of their fingerprints that benchmark items may have too, by a bitmap of fixed size, with the words of the windows that chose
them; a join with the items' fingerprints settles which they do have. From these the hits are extended: the windows around a
shared fingerprint are compared with the items' windows word by word. Items of fewer words than a window are one window of
their own length, for which fingerprints are taken from so many words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop
from .minhash import _bit_of, _bitmap
from .words import mix64, words

#: Words of a window and of a gram.
SPAN, GRAM = 10, 5
#: Bytes of text that one array holds, if no text is longer.
AT_ONCE = 1 << 20
#: Bytes between words: ASCII but for digits and letters (A-Z are lower-cased before).
BETWEEN = np.array([c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F for c in range(256)])
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
HITS = "array<struct<span: int, print: long, at: long, words: string>>"
_HIT = pa.struct([("span", pa.int32()), ("print", pa.int64()), ("at", pa.int64()), ("words", pa.string())])


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[i : i + len(out)]
    return mix64(out + _U(n))


def chosen(hashes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, place of its gram) for each window of span words: the smallest gram, the rightmost of equal ones."""
    grams = _grams(hashes, min(GRAM, span))
    n = max(0, len(hashes) - span + 1)
    best, place = grams[:n], np.zeros(n, np.int64)
    for i in range(1, span - min(GRAM, span) + 1):
        lower = grams[i : i + n] <= best
        best, place = np.where(lower, grams[i : i + n], best), np.where(lower, i, place)
    return mix64(best + _U(span)), place + np.arange(n)


def _found(texts: list[bytes], spans: list[int], bitmap: np.ndarray | None) -> tuple[np.ndarray, list[list[tuple]]]:
    """Words of each text, and its fingerprints: (span, fingerprint, first word of the first window that chose it, words of the
    windows that did). With a bitmap, those in it for all spans; without, all of the one span that an item of its length has."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    starts, lengths, hashes = words(data, BETWEEN)
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, starts, "right")
    n = np.bincount(of, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n)))
    out: list[list[tuple]] = [[] for _ in texts]
    for span in spans:
        prints, place = chosen(hashes, span)
        at = np.arange(len(prints))
        here = of[: len(prints)]
        fits = here == of[at + span - 1]
        if bitmap is None:
            fits &= np.minimum(n, SPAN)[here] == span
        else:
            bit = _bit_of(prints.view(np.int64))
            fits &= (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) == 1
        at = at[fits]
        if not len(at):
            continue
        begins = np.flatnonzero(np.concatenate(([True], (place[at][1:] != place[at][:-1]) | (of[at][1:] != of[at][:-1]))))
        for a, z in zip(at[begins].tolist(), at[np.append(begins[1:], len(at)) - 1].tolist()):
            taken = [data[s : s + k].tobytes() for s, k in zip(starts[a : z + span].tolist(), lengths[a : z + span].tolist())]
            out[of[a]].append((span, int(prints[a].view(np.int64)), a - int(first[of[a]]), b" ".join(taken).decode()))
    return n, out


def _scan(spans: list[int], bitmap: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = [(t or "").encode() for t in b.column(1).to_pylist()], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                    size += len(texts[end])
                    end += 1
                n, hits = _found(texts[at:end], spans, bitmap)
                lists = pa.array([[dict(zip(("span", "print", "at", "words"), h)) for h in x] for x in hits], pa.list_(_HIT))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(n, pa.int64()), lists], ["id", "n_words", "hits"])
                at = end

    return run


def _scanned(rows: DataFrame, spans: list[int], bitmap: np.ndarray | None) -> DataFrame:
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_scan(spans, bitmap), f"id {kind}, n_words long, hits {HITS}")


def _windows(hits: DataFrame) -> DataFrame:
    """hits' columns with a row for each window of a fingerprint: its first word's place and its words in one string."""
    each = F.expr("transform(sequence(0, size(w) - span), i -> struct(at + i as at, array_join(slice(w, i + 1, span), ' ') as window))")
    rest = [c for c in hits.columns if c not in ("at", "words")]
    return hits.withColumn("w", F.split("words", " ")).select(*rest, F.explode(each).alias("x")).select(*rest, "x.at", "x.window")


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs (doc_id, text_col); benchmark has
    item_id and text.

    A word of a document is hit if it lies inside an occurrence of SPAN consecutive words of an item, or of a whole item of
    fewer words. Every such occurrence is found, in texts of any length. n_items counts item_ids; rows of one item_id are one
    item, those without an id are one item called null. Null and empty texts have no words, so they are not contaminated and
    contaminate nothing. Repeated rows of docs are rows of the result, null ids stay; other columns are left out. Empty tables
    on either side are fine.

    Windows of items are numbered, and documents with the same set of windows share the work of listing its items. The bitmap
    of fingerprints (8 MB) is all that goes to every task; a benchmark of hundreds of millions of words fills it, which costs
    speed and no result.
    """
    items = _scanned(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.col("text")), list(range(1, SPAN + 1)), None)
    known = cut(_windows(items.select("id", F.explode("hits").alias("h")).select("id", "h.*")).select("id", "span", "print", "window"), "windows-items")
    prints = cut(known.select("span", "print").distinct(), "windows-prints")
    numbered = cut(known.select("window").distinct().select("window", F.monotonically_increasing_id().alias("no")), "windows-numbered")
    spans = sorted(r.span for r in prints.select("span").distinct().collect())  # SPAN at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    told = cut(_scanned(rows, spans, _bitmap(prints.select("print"))).withColumn("row", F.monotonically_increasing_id()), "windows-documents")
    hits = told.select("row", F.explode("hits").alias("h")).select("row", "h.*").join(prints, ["span", "print"], "left_semi")
    matched = cut(_windows(hits).join(numbered, "window").select("row", "at", "span", "no"), "windows-matched")
    before = F.max(F.col("at") + F.col("span")).over(Window.partitionBy("row").orderBy("at", "span").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("at") + F.col("span") - F.greatest(F.col("at"), F.coalesce(before, F.col("at"))))
    each = matched.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("no")).alias("nos"))
    each = cut(each.withColumn("set", F.sha2(F.array_join(F.col("nos").cast("array<string>"), ","), 256)), "windows-sets")
    sets = each.groupBy("set").agg(F.first("nos").alias("nos")).select("set", F.explode("nos").alias("no"))
    of_window = known.join(numbered, "window").select("no", "id").distinct()
    listed = sets.join(of_window, "no").select("set", "id").distinct().groupBy("set").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    listed = cut(listed.select("set", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "windows-listed")
    found = each.select("row", "n_hit", "set").join(listed, "set").drop("set")
    out = told.select("row", F.col("id").alias("doc_id"), "n_words").join(found, "row", "left")
    drop(prints, numbered, matched, known)
    none = F.lit("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")  # of no bytes
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
