"""Suffix-array dedup: exact repeated strings by a distributed merge sort that knows common prefixes.

Every window of `length` bytes is judged. Each window picks the gram of GRAM bytes with the smallest hash in it as its anchor
(equal windows pick equal anchors), so windows fall into runs of neighbours with one anchor, and only the suffixes that begin
at anchors are sorted: all windows of a run are inside its record, the suffix from the anchor cut behind the run's last
window plus the bytes before the anchor.

1. Chunks of documents are written once. Anchors' gram hashes are exchanged by range of hash; what occurs in two chunks, or
   twice in one, goes on. A false agreement of hashes costs a record, not a result.
2. A chunk marks what repeats inside itself as whole records, sorts the rest by suffix and sends a front-coded run to each
   range: of each suffix only what follows the prefix common with the one before.
3. A range combines its runs with a loser tree. Common prefixes with the last suffix put out decide most matches, and bytes
   of known prefixes are never compared again. These prefixes then tell what repeats: records whose neighbours in the order
   have `length` - k bytes in common, and which share the k bytes before the anchor (their common lengths come from sorting
   them backwards), hold the same window. The first (smallest doc_id, then earliest start) stays, all others are marked.
4. The marks go back to the chunks, which cut them out.

Grams that occur in very many chunks send a record for each window, dealt by the window's own hash, so one frequent passage
with all its surroundings is not one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, shuffle_partitions
from .words import mix64

#: Bytes of a gram; of a chunk (a longer document is a chunk of its own); of the arrays that are hashed at once.
GRAM, CHUNK, AT_ONCE = 40, 2 << 20, 1 << 18
#: Chunks from which a gram counts as frequent; chunks to a range of hashes; records that are judged at once, or one group.
FREQUENT, CHUNKS_A_RANGE, RECORDS = 2000, 8, 1 << 16
#: Stands for a null id, before all others.
NO_ID = -(1 << 63)
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = 0xFFFFFFFFFFFFFFFF


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings (32 + 8 bytes)."""
    h, step, base, eight = data.astype(np.uint64) + _U(1), 1, _BASE, None
    while step < 32:
        h = h[:-step] * _U(base) + h[step:]
        step, base = step * 2, base * base & _MASK
        if step == GRAM - 32:
            eight = h
    n = len(data) - GRAM + 1
    return mix64(h[:n] * _U(pow(_BASE, GRAM - 32, 1 << 64)) + eight[32 : 32 + n])


def runs(data: bytes, lengths: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, gram hash) of each run of windows with one anchor, by place in data; data is the
    texts of the given lengths, one after another, and no window crosses from one to the next."""
    data = np.frombuffer(data, np.uint8)
    ends = np.cumsum(lengths)
    grams, out = length - GRAM + 1, []
    for at in range(0, len(data), AT_ONCE):
        block = data[at : at + AT_ONCE + length - 1]
        if len(block) < length:
            break
        h = _rolling(block)
        low = _U((1 << 24) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= grams:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if grams > step:
            n = len(h) - grams + 1
            key = np.minimum(key[:n], key[grams - step : grams - step + n])
        anchor = (key & low).astype(np.int64)
        start = np.arange(len(anchor))
        inside = np.ones(len(anchor) + 1, bool)  # windows that cross an end of a text are none
        for e in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(block), "left")] - at:
            inside[max(0, e - length + 1) : e] = False
        inside = inside[:-1]
        start, anchor = start[inside], anchor[inside]
        if not len(start):
            continue
        new = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(start) != 1)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(start)])) - 1
        out.append((start[first] + at, start[last] + at, anchor[first] + at, mix64(h[anchor[first]] + _U(1))))  # smallest hashes crowd at 0; mixed again they spread
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


# --- 1. chunks and frequent grams


def _chunks(carried: int, most: int = CHUNK):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size, rows, zstd = TaskContext.get().partitionId(), 0, 0, [], zstandard.ZstdCompressor(level=3)

        def done():
            nonlocal n, size, rows
            rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            columns = [[r[3 + c] for r in rows] for c in range(carried)]
            lists = [pa.array([x], pa.list_(pa.int64())) for x in ([r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows])]
            out = pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), *lists, pa.array([zstd.compress(b"".join(r[2] for r in rows))], pa.binary()), pa.array([columns], pa.list_(pa.list_(pa.string())))], ["chunk", "ids", "ties", "lengths", "data", "carried"])
            n, size, rows = n + 1, 0, []
            return out

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                text = (row[1] or "").encode()
                if rows and size + len(text) > most:
                    yield done()
                tie = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)
                rows.append((row[0], tie, text, *row[2:]))
                size += len(text)
        if rows:
            yield done()

    return run


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch one by one, as each holds a chunk."""
    for i in range(b.num_rows):
        yield tuple(c[i].as_py() for c in b.columns)


def _open(data: bytes, lengths: list[int]) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=sum(lengths)) if sum(lengths) else b""


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _send_grams(length: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, lengths, data in _rows(b):
                h = np.unique(runs(_open(data, lengths), np.array(lengths, np.int64), length)[3])  # sorted, so ranges follow one another
                to = _range_of(h, ranges)
                at = np.searchsorted(to, np.arange(ranges + 1))
                full = np.flatnonzero(np.diff(at))
                low = h.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, np.int64)), pa.array([np.unique(low[at[r] : at[r + 1]]).tobytes() for r in full], pa.binary())], ["range_no", "chunk", "grams"])

    return run


def _repeated(frequent: int):
    def run(table: pa.Table) -> pa.Table:
        chunks = table["chunk"].to_pylist()
        lists = [np.frombuffer(x.as_py(), np.uint32) for x in table["grams"]]
        values = np.concatenate(lists)
        _, where, counts = np.unique(values, return_inverse=True, return_counts=True)
        n = counts[where]
        again, hot, at = [], [], 0
        for x in lists:
            c = n[at : at + len(x)]
            at += len(x)
            again.append(x[c > 1].tobytes())
            hot.append(x[c >= frequent].tobytes())
        return pa.table([table["range_no"].combine_chunks(), pa.array(chunks, pa.int64()), pa.array(again, pa.binary()), pa.array(hot, pa.binary())], ["range_no", "chunk", "again", "hot"])

    return run


# --- 2. front-coded sorted runs


def encode_run(records: list[tuple]) -> bytes:
    """Records (suffix, before, doc, tie, text number, start) sorted by suffix, front-coded: of a suffix only the bytes behind its
    common prefix with the one before. All suffixes and the bytes before the anchor are shorter than 256 bytes."""
    n = len(records)
    suffixes, before, *numbers = zip(*records)
    size = np.fromiter(map(len, suffixes), np.int64, n)
    wide = int(size.max())
    m = np.frombuffer(b"".join([s.ljust(wide, b"\0") for s in suffixes]), np.uint8).reshape(n, wide)
    differs = np.concatenate((m[1:] != m[:-1], np.ones((n - 1, 1), bool)), 1).argmax(1)
    common = np.concatenate(([0], np.minimum(differs, np.minimum(size[1:], size[:-1])))).astype(np.uint8)
    tails = b"".join([s[c:] for s, c in zip(suffixes, common.tolist())])
    left = np.fromiter(map(len, before), np.uint8, n)
    body = b"".join((common.tobytes(), size.astype(np.uint8).tobytes(), left.tobytes(), *[np.array(x, "<i8").tobytes() for x in numbers], tails, b"".join(before)))
    return zstandard.ZstdCompressor(level=1).compress(n.to_bytes(4, "little") + len(tails).to_bytes(8, "little") + body)


def decode_run(data: bytes) -> Iterator[tuple]:
    """(suffix, prefix common with the one before, bytes before the anchor, doc, tie, text number, start) of each record."""
    data = zstandard.ZstdDecompressor().decompress(data)
    n, size_of_tails = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
    common, size, left = data[12 : 12 + n], data[12 + n : 12 + 2 * n], data[12 + 2 * n : 12 + 3 * n]
    numbers = zip(*(np.frombuffer(data, "<i8", n, 12 + 3 * n + 8 * n * i).tolist() for i in range(4)))
    tail = 12 + 35 * n
    head = tail + size_of_tails
    last = b""
    for c, z, b, rest in zip(common, size, left, numbers):
        last = last[:c] + data[tail : tail + z - c]
        tail += z - c
        yield last, c, data[head : head + b], *rest
        head += b


def _triples(marks) -> bytes:
    return np.asarray(marks, "<i8").tobytes()


def _send_runs(length: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, ids, ties, lengths, data, found in _rows(b):
                data, lengths = _open(data, lengths), np.array(lengths, np.int64)
                first, last, anchor, h = runs(data, lengths, length)
                to = _range_of(h, ranges)
                keys = (to.astype(np.uint64) << _U(32)) | h.astype(np.uint32)
                known = lambda name: np.sort(np.concatenate([np.zeros(0, np.uint64), *((np.frombuffer(x[name], np.uint32).astype(np.uint64) | _U(x["range_no"] << 32)) for x in found or ())]))
                _, where, counts = np.unique(h, return_inverse=True, return_counts=True)
                go = np.isin(keys, known("again")) | (counts[where] > 1)
                hot = np.isin(keys, known("hot"))
                text_no = np.searchsorted(np.cumsum(lengths), first, "right")
                base = (np.cumsum(lengths) - lengths)[text_no]
                docs = [NO_ID if i is None else i for i in ids]
                marks, out = [], {}
                pick = np.flatnonzero(go)
                for s, e, a, r, t, o, f in zip(*(x[pick].tolist() for x in (first, last, anchor, to, text_no, base, hot))):
                    if f:
                        for i in range(s, e + 1):
                            w = data[i : i + length]
                            r = int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little") % ranges
                            out.setdefault(r, []).append((w, b"", docs[t], ties[t], t, i - o))
                    else:
                        out.setdefault(r, []).append((data[a : e + length], data[s:a], docs[t], ties[t], t, s - o))
                rows = []
                for r, records in out.items():
                    records.sort(key=lambda x: x[:2])  # equal ones stay in the order of the texts
                    sent, before = [], (None, None)
                    for x in records:
                        if x[:2] == before:  # all its windows occur earlier in this chunk
                            marks.append((x[4], x[5], x[5] + len(x[0]) + len(x[1])))
                        else:
                            sent.append(x)
                            before = x[:2]
                    rows.append((r, chunk, 0, encode_run(sent)))
                if marks:
                    rows.append((chunk % ranges, chunk, 1, _triples(marks)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["range_no", "chunk", "kind", "run"])

    return run


# --- 3. the loser tree


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, which agree in their first `known` bytes."""
    n = min(len(a), len(b))
    if n == known:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def merged(sources: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Records of sorted runs in one order: (suffix, common prefix with the one before, source, rest ...).

    A loser tree: each inner node keeps the loser of its match with the prefix it has in common with the winner that passed.
    Of two that meet, the one with the longer prefix in common with the last output is smaller; only for equal ones are bytes
    compared, and then from behind that prefix.
    """
    k = len(sources)
    size = 1
    while size < k:
        size *= 2
    heads: list = [next(s, None) for s in sources] + [None] * (size - k)
    tree: list = [(-1, 0)] * size  # inner nodes: (source, prefix in common with the winner that went up)
    up: list = [(i, 0) for i in range(size)]

    def match(x, y):
        """(winner, loser), each with its prefix: the winner's in common with the last output, the loser's with the winner."""
        (i, p), (j, q) = x, y
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if p != q:
            return (x, y) if p > q else (y, x)
        s, t = a[0], b[0]
        c = common_prefix(s, t, p)
        if c == len(s) or c < len(t) and s[c] < t[c]:
            return x, (j, c)
        return y, (i, c)

    level = up
    at = size // 2
    while at:
        nxt = []
        for n in range(at):
            w, loser = match(level[2 * n], level[2 * n + 1])
            tree[at + n] = loser
            nxt.append(w)
        level, at = nxt, at // 2
    winner = level[0]
    while (head := heads[winner[0]]) is not None:
        i = winner[0]
        yield head[0], winner[1], i, *head[2:]
        heads[i] = following = next(sources[i], None)
        winner = i, following[1] if following else 0
        n = (i + size) // 2
        while n:
            winner, tree[n] = match(winner, tree[n])
            n //= 2


def repeated_windows(common: np.ndarray, size: np.ndarray, before: list[bytes], rank: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(record, first window, last window) of the spans of windows that a record of smaller rank holds too. Records are in the
    order of their suffixes; common: bytes that each suffix shares with the one before, size: of each suffix, before: the bytes
    in front of it. Windows of a record are numbered from 0 by their place in before + suffix.

    A window with k bytes in front of the suffix is the same in records that follow one another with length - k common bytes
    and that, in the order of the reversed bytes in front, follow one another with k.
    """
    n, left = len(size), np.fromiter(map(len, before), np.int64, len(before))
    group, wide = np.cumsum(common < GRAM), int(left.max(initial=0))
    back = [x[::-1] for x in before]
    order = np.array(sorted(range(n), key=list(zip(group.tolist(), back)).__getitem__), np.int64)
    back = np.frombuffer(b"".join([x.ljust(wide, b"\0") for x in back]), np.uint8).reshape(n, wide)[order]
    differs = np.concatenate((back[1:] != back[:-1], np.ones((n - 1, 1), bool)), 1).argmax(1)
    same = np.minimum(differs, np.minimum(left[order[1:]], left[order[:-1]]))
    shared = np.concatenate(([-1], np.where(group[order[1:]] == group[order[:-1]], same, -1)))
    by_rank = np.argsort(rank, kind="stable")
    again = np.zeros((n, wide + 1), np.int8)
    for k in range(wide + 1):
        some = by_rank[(left[by_rank] >= k) & (size[by_rank] >= length - k)]
        if len(some) > 1:
            behind, ahead = np.cumsum(common < length - k), np.empty(n, np.int64)
            ahead[order] = np.cumsum(shared < k)
            first = np.unique(behind[some] * (n + 1) + ahead[some], return_index=True)[1]  # by rank
            again[np.delete(some, first), k] = 1
    edge = np.diff(again, prepend=0, append=0, axis=1)
    record, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return record, left[record] - high, left[record] - low


def _combine(length: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["chunk", "kind", "run"]).to_pylist()
        passed = [(x["chunk"], x["run"]) for x in rows if x["kind"] == 1]
        sent = [x for x in rows if x["kind"] == 0]
        chunks = np.array([x["chunk"] for x in sent], np.int64)
        batch: list[tuple] = []

        def judge() -> None:
            common, size, before, *numbers = zip(*batch)
            common, size, (source, doc, tie, text, start) = np.array(common), np.array(size), (np.array(x, np.int64) for x in numbers)
            chunk = chunks[source]
            order = np.lexsort((start, text, chunk, tie, doc))
            rank = np.empty(len(batch), np.int64)
            rank[order] = np.arange(len(batch))
            common[0] = 0
            record, first, last = repeated_windows(common, size, before, rank, length)
            found = np.stack((text[record], start[record] + first, start[record] + last + length), 1)
            by_chunk = np.argsort(chunk[record], kind="stable")
            which, at = np.unique(chunk[record][by_chunk], return_index=True)
            passed.extend((c, _triples(x)) for c, x in zip(which.tolist(), np.split(found[by_chunk], at[1:])))

        alone = True  # a gram of one record has nothing to tell
        for suffix, common, source, before, *numbers in merged([decode_run(x["run"]) for x in sent]):
            if common < GRAM and batch:
                if alone:
                    batch.pop()
                if len(batch) >= RECORDS:
                    judge()
                    batch.clear()
            alone = common < GRAM
            batch.append((common if batch else 0, len(suffix), before, source, *numbers))
        if alone and batch:
            batch.pop()
        if batch:
            judge()
        return pa.table([pa.array([x for x, _ in passed], pa.int64()), pa.array([x for _, x in passed], pa.binary())], ["chunk", "marks"])

    return run


# --- 4. cutting


def spans(marks: np.ndarray) -> list[tuple[int, int]]:
    """Sorted maximal spans of (start, end) pairs that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, marks.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut_out(as_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "carried"]
    kinds = [pa.int64()] * 4 + [pa.string() if as_text else pa.binary(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, lengths, data, extra, marks in _rows(b):
                data = _open(data, lengths)
                m = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 3) for x in marks]) if marks else np.zeros((0, 3), np.int64)
                m = m[np.argsort(m[:, 0], kind="stable")]
                at = np.searchsorted(m[:, 0], np.arange(len(ids) + 1))
                rows, begin = [], 0
                for i, (doc, n) in enumerate(zip(ids, lengths)):
                    gone = spans(m[at[i] : at[i + 1], 1:]) if at[i + 1] > at[i] else []
                    kept, last = [], 0
                    for x, y in [*gone, (n, n)]:
                        kept.append(data[begin + last : begin + x])
                        last = y
                    kept = b"".join(kept)
                    rows.append((doc, n, sum(y - x for x, y in gone), len(gone), kept.decode(errors="ignore") if as_text else kept, [c[i] for c in extra]))
                    begin += n
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return run


def remove_repeats(docs: DataFrame, length: int = 100, carry: tuple[str, ...] = (), text_col: str = "text", as_text: bool = False, frequent: int = FREQUENT, chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, carry ...) of each row of docs: its text in UTF-8 without the bytes
    of any `length`-byte string that also starts earlier, in a smaller doc_id or before in the same text.

    kept is binary, or with as_text a string without the characters of which only some bytes stay.
    Strings are those of the input, also where parts of them go; no string crosses from one text to the next. Rows with one
    doc_id come one after another in the order of a hash of their texts, null ids before all others, so reruns agree. A null
    text is empty; a very long one is a chunk of its own. Texts shorter than `length` stay whole. Columns named in carry come
    along as strings, all others are left out; an empty table gives no rows. length: 72 to 210.
    """
    if not 72 <= length <= 210:
        raise ValueError("length must lie between 72 and 210")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(carry)])
    chunks = cut(rows.mapInArrow(_chunks(len(carry), chunk_bytes), "chunk long, ids array<long>, ties array<long>, lengths array<long>, data binary, carried array<array<string>>"), "suffix-chunks")
    ranges = max(shuffle_partitions(spark), chunks.count() // CHUNKS_A_RANGE)
    grams = chunks.select("chunk", "lengths", "data").mapInArrow(_send_grams(length, ranges), "range_no int, chunk long, grams binary")
    again = grams.groupBy("range_no").applyInArrow(_repeated(frequent), "range_no int, chunk long, again binary, hot binary").where(F.octet_length("again") > 0)
    found = again.groupBy("chunk").agg(F.collect_list(F.struct("range_no", "again", "hot")).alias("found"))
    with_found = chunks.select("chunk", "ids", "ties", "lengths", "data").join(found, "chunk", "left")
    sorted_runs = with_found.mapInArrow(_send_runs(length, ranges), "range_no int, chunk long, kind int, run binary")
    marks = sorted_runs.groupBy("range_no").applyInArrow(_combine(length), "chunk long, marks binary")
    marks = cut(marks, "suffix-marks")
    per_chunk = marks.groupBy("chunk").agg(F.collect_list("marks").alias("marks"))
    done = chunks.join(per_chunk, "chunk", "left").select("ids", "lengths", "data", "carried", "marks").mapInArrow(_cut_out(as_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, carried array<string>")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", *[F.col("carried")[i].alias(c) for i, c in enumerate(carry)])
