"""MinHash near-duplicates with SuperMinHash signatures.

A document is the set of 64-bit hashes of its word shingles. In a SuperMinHash signature every element visits all slots in
an order of its own, and its j-th visit has a rank between j and j + 1; a slot keeps the smallest rank. Ranks of one element
are thus spread over the slots, which lowers the variance, and once all slots hold ranks below j the later visits are
skipped. Here an element's order is an affine permutation of the slots, so that visits of all elements are one array.

Bands of the signature give buckets. Documents with equal sets are one class, and only its smallest id goes into buckets.
Texts are never shuffled: ids in buckets of several classes go into a bitmap of fixed size, by which a second pass over the
texts picks those whose sets it writes; ids that share a bit only cost a set that nothing asks for.

Links are looked for in rounds. In the first two each bucket picks a few centres, and its members are compared with these
alone; linked members are one component from then on. The last round compares members of a bucket that are still in
different components, each pair in the first bucket that it shares. So groups of many near copies grow together without all
their pairs, and no pair that shares a bucket is left out. Members of buckets with very many such pairs are compared by a
prefix filter instead: of two sets that are similar enough, the shingles that are rare among these members and come first
share one, at places that leave the similarity possible. A pair that sizes and, for larger sets, a sketch of the signature
leave possible is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop
from .graph import components
from .words import mix64
from .words import words as word_arrays

#: Slots of a signature (a power of two); bands and rows of each: at 0.8 they miss one pair in several millions.
SLOTS, BANDS, ROWS = 256, 40, 5
#: Bits of 64 in which two sketches may differ (at a similarity of 0.8 they differ in 6.4, with a deviation of 2.4), and
#: shingles that both sets need for that: slots of smaller ones depend on one another, and comparing those costs little.
SKETCH_BITS, SKETCH_LEAST = 22, 64
#: Seeds by which buckets pick centres, by round; 0 picks the smallest id.
ROUNDS = ((0, 1), (2, 3, 4, 5, 6, 7))
#: Pairs in different components from which a bucket is hot.
HOT_PAIRS = 500
#: Bits of the map of ids in shared buckets (8 MB, however many ids), in rows of Spark's bitmaps of 32768 bits.
ID_BITS, ROW_BITS = 1 << 26, 1 << 15
#: Bytes of text that one array holds, if no text is longer.
AT_ONCE = 1 << 18
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sets_at_once(texts: list[bytes], words: int) -> list[np.ndarray]:
    starts, _, hashes = word_arrays(_LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)])
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return [none] * len(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    edges = np.concatenate(([0], np.searchsorted(starts, ends)))
    out = []
    factor = _U(0xD6E8FEB86659FD93)
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        rolled = rolled * factor + hashes[i : i + len(rolled)]
    rolled = mix64(rolled + _U(words))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:  # fewer words than a shingle has: the whole sequence is one
            h = np.zeros(1, np.uint64)
            for x in hashes[a:b]:
                h = h * factor + x
            out.append(mix64(h + _U(b - a)))
        else:
            out.append(none)
    return out


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text: A-Z lower-cased, words split at ASCII white space; empty without words."""
    group, size = [], 0
    for t in texts:
        t = (t or "").encode()
        if group and size + len(t) > AT_ONCE:
            yield from _sets_at_once(group, words)
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield from _sets_at_once(group, words)


def signature(elements: np.ndarray) -> np.ndarray:
    """SuperMinHash: the smallest rank of each slot, as visit number << 48 and 48 bits of the rank's fraction."""
    best = np.full(SLOTS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    start, step = elements & _U(SLOTS - 1), (elements >> _U(20)) | _U(1)
    at, visits = 0, min(SLOTS, max(1, 8 * SLOTS // len(elements)))
    while at < SLOTS and best.max() >= (at << 48):  # else no later visit can be lower: early stop
        j = np.arange(at, min(SLOTS, at + visits), dtype=np.uint64)
        slot = (start[:, None] + j[None] * step[:, None]) & _U(SLOTS - 1)
        rank = (j[None] << _U(48)) | (mix64(elements[:, None] + (j[None] + _U(1)) * _U(0x9E3779B97F4A7C15)) >> _U(16))
        np.minimum.at(best, slot.ravel().astype(np.int64), rank.ravel())
        at += visits
    return best


def buckets(signatures: np.ndarray) -> np.ndarray:
    """(documents, BANDS) bucket numbers."""
    s = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), s.shape[:2]).copy()
    for i in range(ROWS):
        h = mix64(h * _U(0x9E3779B97F4A7C15) + s[:, :, i])
    return h


def sketches(signatures: np.ndarray) -> np.ndarray:
    """A bit of each of the last 64 slots."""
    return ((mix64(signatures[:, -64:]) & _U(1)) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sizes, digests, signatures = [], [], np.zeros((b.num_rows, SLOTS), np.uint64)
                for i, s in enumerate(shingle_sets(b.column(1).to_pylist(), words)):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        signatures[i] = signature(s)
                numbers = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * b.num_rows + 1, BANDS, dtype=np.int32)), pa.array(buckets(signatures).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), numbers, pa.array(sketches(signatures).view(np.int64))], ["doc_id", "n_shingles", "digest", "buckets", "sketch"])

    return run


def _bit_of(doc_id: np.ndarray) -> np.ndarray:
    return (mix64(doc_id.astype(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15)) & _U(ID_BITS - 1)).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_bit_of(b.column(0).to_numpy(zero_copy_only=False)))], ["bit"])


def _bitmap(ids: DataFrame) -> np.ndarray:
    """ID_BITS bits as bytes; ids: (doc_id) without nulls. ID_BITS bounds what is collected and sent to the tasks."""
    row, at = F.floor(F.col("bit") / ROW_BITS).cast("int").alias("row"), F.col("bit") % ROW_BITS
    rows = ids.mapInArrow(_bits, "bit long").groupBy(row).agg(F.call_function("bitmap_construct_agg", at).alias("bits")).toArrow()
    out = np.zeros((ID_BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    for i, bits in zip(rows["row"].to_pylist(), rows["bits"]):
        out[i] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel()


def _sets(words: int, bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            bit = _bit_of(b.column(0).to_numpy())
            b = b.filter(pa.array(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1))
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), words)], pa.binary())], ["doc_id", "shingles"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, of, n, shingle) of each element of sets that are bytes, about a million at a time; of tells the sets of one id
    apart, n is the set's size."""
    for b in batches:
        sets = [x.as_buffer() for x in b.column(1)]
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + sets[end].size <= 8 << 20):
                size += sets[end].size
                end += 1
            n = np.array([x.size // 8 for x in sets[at:end]], np.int64)
            of = np.array([zlib.crc32(x) for x in sets[at:end]], np.int64)
            ids = b.column(0).slice(at, end - at).to_numpy()
            values = np.frombuffer(b"".join(sets[at:end]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)) for x in (ids, of, n)] + [pa.array(values)], ["doc_id", "of", "n", "shingle"])
            at = end


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                keep = []
                for x, y in zip(b.column(2), b.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if len(x) > len(y):
                        x, y = y, x
                    found = np.searchsorted(y, x)
                    both = int((y[np.minimum(found, len(y) - 1)] == x).sum())
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _possible(n: Column, sketch: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sizes and sketches leave the similarity possible."""
    near = (F.least(n, m) < SKETCH_LEAST) | (F.bit_count(sketch.bitwiseXOR(other)) <= SKETCH_BITS)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & near


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    with_b = pairs.join(sets.toDF("b", "set_b"), "b")
    both = with_b.join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(_confirm(percent), "a long, b long").distinct()


def _named(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """shared with the component of each member so far."""
    if labels is None:
        return shared.withColumn("component_id", F.col("doc_id"))
    return shared.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def _with_centres(named: DataFrame, seeds: tuple[int, ...], percent: int) -> DataFrame:
    """Possible pairs of the members and the centres of buckets that hold several components."""
    member = F.struct("doc_id", "n", "sketch", "component_id")
    centres = F.array_distinct(F.array(*[F.min_by(member, F.xxhash64(F.lit(k), "doc_id") if k else F.col("doc_id")) for k in seeds]))
    mixed = named.groupBy("bucket").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi"), centres.alias("centres")).where("lo <> hi").select("bucket", "centres")
    apart = lambda c: (c["component_id"] != F.col("component_id")) & _possible(F.col("n"), F.col("sketch"), c["n"], c["sketch"], percent)
    asked = named.join(mixed, "bucket").select("doc_id", F.explode(F.filter("centres", apart)).alias("c")).select("doc_id", F.col("c.doc_id").alias("cd"))
    return asked.select(F.least("doc_id", "cd").alias("a"), F.greatest("doc_id", "cd").alias("b")).distinct()


def _across(left: DataFrame, percent: int) -> DataFrame:
    """All possible pairs of a bucket's members in different components; left: (doc_id, bucket, n, sketch, component_id,
    buckets)."""
    x, y = left.toDF("xd", "bucket", "xn", "xs", "xc", "xb"), left.toDF("yd", "bucket", "yn", "ys", "yc", "yb")
    first_shared = F.filter(F.zip_with("xb", "yb", lambda p, q: F.when(p == q, p)), lambda z: z.isNotNull())[0]
    apart = (F.col("xc") != F.col("yc")) & (F.col("xd") < F.col("yd"))
    return x.join(y, "bucket").where(apart & _possible(F.col("xn"), F.col("xs"), F.col("yn"), F.col("ys"), percent) & (first_shared == F.col("bucket"))).select(F.col("xd").alias("a"), F.col("yd").alias("b")).distinct()


def _unfinished(named: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, and whether the bucket is hot."""
    each = named.groupBy("bucket", "component_id").agg(F.count(F.lit(1)).alias("k"))
    pairs = (F.pow(F.sum("k"), 2) - F.sum(F.col("k") * F.col("k"))) / 2
    mixed = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), pairs.alias("pairs")).where("parts > 1")
    mixed = cut(mixed.select("bucket", (F.col("pairs") >= HOT_PAIRS).alias("hot")), "minhash-mixed")  # else a hot bucket's join cannot be split
    out = cut(named.join(mixed, "bucket"), "minhash-left")
    drop(mixed)
    return out


def _by_prefix(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Possible pairs (a, b) of members (doc_id, component_id) in different components, by the shingles that they share among
    those of each that come first.

    Shingles are ordered by the number of members that have them, then by hash. Of two sets that are similar enough, the
    larger has its first shared shingle among the first n - t n + 1, the smaller among the first n - 2t / (1 + t) n + 1, and
    behind it each has at least what both must share. The members of a shingle's most frequent component are not compared
    with one another, so a shingle of one large component makes as many pairs as it has other members.
    """
    t = percent / 100
    at_least = lambda share, n: F.ceil(F.lit(share) * n - 1e-6)
    elements = cut(sets.join(members.select("doc_id"), "doc_id", "left_semi").mapInArrow(_elements, "doc_id long, of long, n long, shingle long"), "minhash-elements")
    found = cut(elements.groupBy("shingle").agg(F.count(F.lit(1)).alias("had")), "minhash-had")
    place = F.row_number().over(Window.partitionBy("doc_id", "of").orderBy("had", "shingle"))
    first = elements.join(found, "shingle").withColumn("place", place)
    first = first.where((F.col("had") > 1) & (F.col("place") <= F.col("n") - at_least(t, F.col("n")) + 1)).select("shingle", "place", "doc_id", "n")
    first = cut(first.join(members, "doc_id"), "minhash-first")
    each = first.groupBy("shingle", "component_id").agg(F.count(F.lit(1)).alias("k"))
    mixed = cut(each.groupBy("shingle").agg(F.max_by("component_id", F.struct("k", "component_id")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"), "minhash-mixed")
    sent = cut(first.join(mixed, "shingle"), "minhash-sent")
    drop(elements, found, first, mixed)
    side = lambda s: ["shingle", *[F.col(c).alias(f"{s}_{c}") for c in ("place", "doc_id", "n", "component_id")]]
    x, y = sent.where("component_id <> most").select(*side("x")), sent.select(*side("y"))
    early = lambda s: F.col(f"{s}_place") <= F.col(f"{s}_n") - at_least(2 * t / (1 + t), F.col(f"{s}_n")) + 1
    smaller = F.when(F.col("x_n") < F.col("y_n"), early("x")).when(F.col("x_n") > F.col("y_n"), early("y")).otherwise(early("x") & early("y"))
    room = 1 + F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) >= at_least(t / (1 + t), F.col("x_n") + F.col("y_n"))
    sizes = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    pairs = x.join(y, "shingle").where((F.col("x_component_id") != F.col("y_component_id")) & sizes & smaller & room)
    out = cut(pairs.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct(), "minhash-pairs")
    drop(sent)
    return out


def _same_ids(told: DataFrame) -> DataFrame | None:
    """Edges between the classes of an id that stands for several texts, if there is any."""
    several = told.where("class_id is not null and doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a <> z")
    several = cut(several.select("doc_id", "a"), "minhash-same")
    return None if several.isEmpty() else cut(told.join(several, "doc_id").select("a", F.col("class_id").alias("b")).where("a <> b").distinct(), "minhash-same")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs. Documents whose sets of word shingles have a Jaccard
    similarity of at least percent / 100 are linked; component_id is the smallest doc_id that links lead to, and kept says
    whether it is the document's own.

    A text of fewer words than a shingle is one shingle; without words, or null, it is empty, linked with nothing and kept.
    However long a text is, all its shingles count. Rows with equal sets are linked. Rows of one doc_id with different texts
    are one document that any of its texts links. A row whose id is null is nobody's smallest: it is kept only if its class
    has no id, and it is linked with exact copies alone. Other columns are left out; no rows give none. Sets are compared by
    64-bit hashes of their shingles.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(rows.mapInArrow(_sign(words), "doc_id long, n_shingles long, digest binary, buckets array<long>, sketch long"), "minhash-signed")
    classes = cut(signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id")), "minhash-classes")
    own = F.col("doc_id") == F.col("class_id")
    told = signed.join(classes, "digest", "left").select("doc_id", "n_shingles", "class_id", F.when(own, F.col("sketch")).alias("sketch"), F.when(own, F.col("buckets")).alias("buckets"))
    told = cut(told, "minhash-told")
    drop(signed, classes)
    one = told.where("buckets is not null").select("doc_id", F.col("n_shingles").alias("n"), "sketch", "buckets")
    entries = one.select("doc_id", "n", "sketch", F.explode("buckets").alias("bucket"))
    several = cut(entries.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("bucket"), "minhash-several")
    shared = cut(entries.join(several, "bucket").select("bucket", "doc_id", "n", "sketch"), "minhash-buckets")
    drop(several)
    in_buckets = cut(shared.select("doc_id").distinct(), "minhash-ids")
    sets = cut(rows.mapInArrow(_sets(words, _bitmap(in_buckets)), "doc_id long, shingles binary"), "minhash-sets")
    labels = asked = None
    links = _same_ids(told)
    done = [sets, shared, in_buckets]
    for seeds in ROUNDS:
        named = cut(_named(shared, labels), "minhash-named")
        pairs = _with_centres(named, seeds, percent)
        pairs = cut(pairs if asked is None else pairs.join(asked, ["a", "b"], "left_anti"), "minhash-pairs")
        found = cut(_links(pairs, sets, percent), "minhash-links")
        drop(named)
        done += [pairs, found]
        asked = pairs if asked is None else asked.unionByName(pairs)
        if labels is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            done.append(labels)
            labels = components(links)
    left = _unfinished(_named(shared, labels))
    numbers = one.join(in_buckets, "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "sketch"])
    cold = cut(left.where("not hot").select("doc_id", "bucket", "n", "sketch", "component_id").join(numbers, ["doc_id", "n", "sketch"]).select("doc_id", "bucket", "n", "sketch", "component_id", "buckets"), "minhash-cold")
    hot = cut(left.where("hot").select("doc_id", "component_id").distinct(), "minhash-hot")
    pairs = _across(cold, percent)
    if not hot.isEmpty():
        pairs = pairs.unionByName(_by_prefix(hot, sets, percent)).distinct()
    pairs = cut(pairs.join(asked, ["a", "b"], "left_anti"), "minhash-pairs")
    found = cut(_links(pairs, sets, percent), "minhash-links")
    if not found.isEmpty():
        done.append(labels)
        labels = components(links.unionByName(found))
    drop(left, cold, hot, pairs, found, *done)
    out = told.select("doc_id", "n_shingles", "class_id").join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("component_id", F.coalesce("component_id", "class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
