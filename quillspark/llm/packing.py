"""Packing by concatenating and cutting.

Pass one tokenizes every document once and writes its ids with the partition and the tokens before it there. The token
totals of the partitions are summed up on the driver (a row for each partition), which gives each document its place in
one long stream. Pass two cuts the stream at multiples of the window: a document that crosses a cut gives a boundary piece
on either side. No document is shuffled.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .words import words as word_arrays

WINDOW, END_ID = 4096, 2
#: Words whose ids a worker keeps, and bytes of text that it looks up at once.
KEPT_WORDS, AT_ONCE = 500_000, 1 << 19
# What the tokenizer's own pre-tokenizer makes its units.
UNITS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters only have one lower-case and one composed form in all libraries.
PLAIN = regex.compile("[\x21-\xff]+")
#: Texts on which words by themselves must give what the whole tokenizer gives.
PROBES = ("Hello, World! don't we'll", " a  b\tc\n\n d ", "x.y,z;(q) [1]{2}", "1234 56a 7,8.9%", "\u0130stanbul \u03a3\u0391\u03a3 \u01c5 \ufb01", "\xe9 e\u0301 \u212b \xc4RGER", "\u4e2d\u6587 ab\u4e2dc x\xb2\xbd", "'S'T 'RE", "a\x1cb\xa0c\x85", "<|endoftext|>a </s>b [UNK] <s>", "word " * 40)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class WordTokenizer:
    """Ids (16 bits each, or 32 for a larger vocabulary) of texts by a byte-level BPE whose units never cross white space.

    Words are looked up by 64-bit hash, all words of many texts at once; the units of a new word go to the tokenizer's model
    by themselves. Words with characters above U+00FF, control characters or what may be an added token go through the whole
    tokenizer. A vocabulary whose units are others, as PROBES tell when it is opened, takes whole texts instead.
    """

    _open: dict[str, WordTokenizer] = {}

    @classmethod
    def open(cls, path: str) -> WordTokenizer:
        """The one of this process, which later tasks find with what it has learnt."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        small = max(self.tokenizer.get_vocab().values()) < 1 << 16
        self.kind, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.forget()
        self.by_words = self._at_once([x.encode() for x in PROBES]) == self._whole(PROBES)

    def forget(self) -> None:
        self.pool, self.used = np.zeros(1 << 20, self.kind), 0
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known, self.recent = none, none

    def _whole(self, texts: Iterable[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(list(texts), add_special_tokens=False)]

    def ids(self, word: str) -> list[int]:
        low, tokenize = word.lower(), self.model.tokenize
        if low.isalpha() and low.isascii():
            return [t.id for t in tokenize(low)]
        if "<|" in word or not PLAIN.fullmatch(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        units = [u if u.isascii() else u.encode().decode("latin-1").translate(self.letters) for u in UNITS.findall(low)]
        return [t.id for u in units for t in tokenize(u)]

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """hashes: sorted, all new."""
        found, counts = array(self.code), []
        for w in words:
            ids = self.ids(w.decode())
            found.extend(ids)
            counts.append(len(ids))
        counts = np.array(counts, np.int64)
        while self.used + len(found) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(found)] = np.frombuffer(found, self.kind)
        new = hashes, self.used + np.cumsum(counts) - counts, counts
        self.used += len(found)
        self.recent = _merge(self.recent, new)
        if len(self.recent[0]) > 50_000:
            self.known = _merge(self.known, self.recent)
            self.recent = tuple(x[:0] for x in self.recent)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, n = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        for keys, starts, counts in (self.known, self.recent):
            if len(keys):
                i = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[i] == hashes
                at[hit], n[hit] = starts[i[hit]], counts[i[hit]]
        return at, n, np.flatnonzero(n < 0)

    def _at_once(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known[0]) > KEPT_WORDS:
            self.forget()
        data = b"\n".join(texts) + b"\n"
        starts, lengths, hashes = word_arrays(np.frombuffer(data, np.uint8))
        hashes, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, n, new = self._places(hashes)
        if len(new):
            s, z = starts[one[new]].tolist(), lengths[one[new]].tolist()
            self.learn(hashes[new], [data[a : a + b] for a, b in zip(s, z)])
            at[new], n[new], _ = self._places(hashes[new])
        at, n = at[which], n[which]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        words = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
        edges = np.concatenate(([0], ends))[np.concatenate(([0], words))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_words:
            for t in texts:
                yield from self._whole([t])
            return
        group, size = [], 0
        for t in texts:
            t = t.encode()
            if group and size + len(t) > AT_ONCE:
                yield from self._at_once(group)
                group, size = [], 0
            group.append(t)
            size += len(t)
        if group:
            yield from self._at_once(group)


def _merge(x: tuple, y: tuple) -> tuple:
    """Two (sorted keys, starts, counts) in one."""
    at = np.searchsorted(x[0], y[0])
    return tuple(np.insert(a, at, b) for a, b in zip(x, y))


def _tokenize(path: str, end_id: int):
    """Rows (doc_id, text, block, row) to documents with their runs and places there. A run is what a task reads of one block in
    one go; runs sort as their blocks and first rows do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, now, before = WordTokenizer.open(path), f"{TaskContext.get().partitionId():012d}", None, 0
        end, width = np.array([end_id], ids_of.kind).tobytes(), ids_of.kind.itemsize
        for b in batches:
            for i in range(0, b.num_rows, 512):
                whole = b.slice(i, 512)
                blocks = whole.column(2).to_pylist()
                edges = [0, *[k for k in range(1, len(blocks)) if blocks[k] != blocks[k - 1]], len(blocks)]
                for a, z in zip(edges, edges[1:]):
                    piece = whole.slice(a, z - a)
                    if now is None or blocks[a] != now[0]:
                        now, before = (blocks[a], part if blocks[a] is None else f"{blocks[a]}:{piece.column(3)[0].as_py():020d}"), 0
                    ids = [x + end for x in ids_of([t or "" for t in piece.column(1).to_pylist()])]
                    n = np.array([len(x) // width for x in ids], dtype=np.int64)
                    starts = before + np.cumsum(n) - n
                    before += int(n.sum())
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([now[1]] * len(n), pa.string()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "part_start", "doc_tokens", "ids"])

    return run


def _cut(bases: dict[str, int], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, part, at, n, ids in zip(*(c.to_pylist() for c in b.columns)):
                at += bases[part]
                ids = ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                start = 0
                while start < n:
                    offset = (at + start) % window
                    length = min(n - start, window - offset)
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, x in zip(out, (doc, start, length, zlib.crc32(piece), n, (at + start) // window, offset, piece)):
                        column.append(x)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:7]] + [pa.array(out[7], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, text_col: str = "text", place: tuple[Column, Column] | None = None) -> DataFrame:
    """Where each document's ids go: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids as little-endian
    unsigned 32-bit numbers), a row for each piece. Each document ends with end_id, so a null or empty text has one id.

    All sequences are full but the last. A very long text has a piece for each window that it meets. Repeated rows and null ids
    are documents like others; other columns are left out; an empty table gives no pieces.

    Documents go in the order of docs' partitions, or of place: the block (a string) of a document and its row there, where
    every task has its rows of a block in their order and without gaps, as it reads a file. One total for each task and block
    comes to the driver.
    """
    block, row = place or (F.lit(None).cast("string"), F.lit(None).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"), block.alias("block"), row.alias("row"))
    tokens = rows.mapInArrow(_tokenize(tokenizer_path, end_id), "doc_id long, part string, part_start long, doc_tokens long, ids binary")
    tokens = cut(tokens, "packing-tokens")
    bases, total = {}, 0
    for part, n in sorted(tuple(x) for x in tokens.groupBy("part").agg(F.sum("doc_tokens")).collect()):
        bases[part], total = total, total + n
    return tokens.mapInArrow(_cut(bases, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The sequences themselves from pieces(): (sequence_id, n_tokens, ids padded to the window; a last sequence whose length
    is a power of two stays as it is)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for parts in b.column(1).to_pylist():
                x = b"".join(p["ids"] for p in sorted(parts, key=lambda p: p["offset"]))
                n = len(x) // 4
                ids.append(x if n & (n - 1) == 0 else x + np.full(window - n, pad_id, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.binary())], ["sequence_id", "n_tokens", "ids"])

    grouped = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("p"), F.sum("length").alias("n_tokens"))
    return grouped.mapInArrow(build, "sequence_id long, n_tokens long, ids binary")
