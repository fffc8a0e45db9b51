"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling hash; each window of w grams gives its smallest hash, the rightmost of equal ones,
and the place of each choice is kept. So two texts that share a passage of w + k - 1 code points share a fingerprint entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Code points in a gram (a power of two) and grams in a window (a power of two).
GRAM, WINDOW = 16, 64
#: Multipliers of the hashes, which are sums, products and shifts below 2 ** 32.
BASE, MIX = 0x2545F491, 0x9E3779B1
_MASK = 0xFFFFFFFF
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(15))) * np.uint32(MIX)
    return x ^ (x >> np.uint32(13))


def gram_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """32-bit hashes of all grams, in order; a text shorter than a gram is one gram, an empty one has none."""
    h = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint32)
    if not len(h):
        return h
    h = _mixed(h + np.uint32(1))
    if len(h) < gram:
        total = np.uint32(len(h))
        for x in h:
            total = np.uint32((int(total) * BASE + int(x)) & _MASK)
        return _mixed(np.array([total], np.uint32))
    step, base = 1, BASE
    while step < gram:  # the hash of twice as many code points from two halves
        h = h[:-step] * np.uint32(base) + h[step:]
        step, base = step * 2, base * base & _MASK
    return _mixed(h)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the chosen grams, by position."""
    h = gram_hashes(text, gram).astype(np.uint64)
    if not len(h):
        return h, h
    low = np.uint64(0xFFFFFFFF)
    key = (h << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost is the smallest
    if len(key) <= window:
        chosen = key.min(keepdims=True)
    else:
        step = 1
        while step < window:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        chosen = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return chosen >> np.uint64(32), low - (chosen & low)


def as_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """``hash:position`` entries with blanks between."""
    return " ".join([f"{h:08x}:{p}" for h, p in zip(hashes.tolist(), positions.tolist())])


def likeness(a: set[int], b: set[int]) -> float:
    """Jaccard similarity of the chosen hashes; 1 for two empty fingerprints."""
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(text: str, following: str) -> str:
    """The text whose last quarter of code points makes way for the first as many (or all) of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class _Doc:
    def __init__(self, doc_id, text):
        self.id, self.text = doc_id, text or ""
        h, p = winnow(self.text)
        self.fingerprint, self.hashes = as_text(h, p), set(h.tolist())

    def row(self, following: _Doc) -> tuple:
        e = edited(self.text, following.text)
        if e == self.text:
            text, hashes = self.fingerprint, self.hashes
        else:
            h, p = winnow(e)
            text, hashes = as_text(h, p), set(h.tolist())
        return self.id, len(self.text), hashlib.sha256(e.encode()).hexdigest(), self.fingerprint, text, likeness(self.hashes, hashes), likeness(self.hashes, following.hashes)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in RESULT.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], list(names))


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all but the last document of a sorted partition."""
    before, rows = None, []
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            doc = _Doc(doc_id, text)
            if before is not None:
                rows.append(before.row(doc))
            before = doc
            if len(rows) >= 256:
                yield _batch(rows)
                rows = []
    yield _batch(rows)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each partition that has any: its first and last document."""
    first = last = None
    for b in batches:
        if b.num_rows:
            first = first or (b.column(0)[0].as_py(), b.column(1)[0].as_py())
            last = b.column(0)[-1].as_py(), b.column(1)[-1].as_py()
    if first:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([x], t) for x, t in zip(first + last, (pa.int64(), pa.string()) * 2)]], ["part", "first_id", "first_text", "last_id", "last_text"])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the partitions' last documents; the first document of all follows the very last."""
    start = last = None
    for b in batches:
        for _, first_id, first_text, last_id, last_text in zip(*(c.to_pylist() for c in b.columns)):
            if last is None:
                start = first_id, first_text
            else:
                yield _batch([last.row(_Doc(first_id, first_text))])
            last = _Doc(last_id, last_text)
    if last is not None:
        yield _batch([last.row(_Doc(*start))])


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts (see edited()): RESULT's columns, a row for each row of docs.

    The next document is that with the next larger doc_id (null ids first, rows of one id in the order of a hash of their
    texts); after the
    last comes the first. A null text is empty; an empty text has an empty fingerprint; of a very long one every gram counts.
    Other columns are left out, no rows give none. Texts are range-sorted once, by doc_id and, as one doc_id may have very many
    rows, the text's hash; only the documents at the ends of partitions (one row each) meet in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    ends = ranged.mapInArrow(_ends, "part int, first_id long, first_text string, last_id long, last_text string")
    return ranged.mapInArrow(_inside, RESULT).unionByName(ends.repartition(1).sortWithinPartitions("part").mapInArrow(_between, RESULT))
