"""Near-duplicate embeddings by product quantisation.

Unit vectors fall into coarse lists (nearest centroid); what is left of them is coded in subspaces. A vector asks every list
in which one as near as the threshold can lie: a neighbour lies across at most the bisecting planes that are nearer than the
threshold's distance, so these probes lose none. In a list, distances come from table look-ups on the codes; each row keeps
the error of its code, which bounds what the look-up may be off by, and rows within the bound get their exact cosine in
double precision. The centroids and codes are fitted on a bounded sample; all rows are indexed and all are queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components

#: Vectors that centroids and codes are fitted on, at most; rows of a list in one task, queries that it compares them with, and
#: how many of these at a time.
SAMPLE, ROWS_A_BLOCK, QUERIES_A_BLOCK, AT_ONCE = 8192, 2048, 8192, 512
SUBSPACES, CODES, ROWS_A_LIST, MOST_LISTS = 8, 64, 2000, 1024
#: Lists that a smaller table has: a quarter of the root of its different vectors, up to so many. More would cost more than they
#: spare, as each vector goes to all lists that it asks.
FEW_LISTS = 16


@dataclass
class Model:
    """Coarse centroids (lists, dim) and the code book of each subspace (codes, width)."""

    centroids: np.ndarray
    books: list[np.ndarray]
    edges: list[int]

    def lists(self, u: np.ndarray) -> np.ndarray:
        return square(u, self.centroids).argmin(1)

    def encode(self, u: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the distance of each vector from what its code stands for."""
        rest = u - self.centroids[lists]
        codes = np.stack([square(rest[:, a:b], book).argmin(1) for book, a, b in zip(self.books, self.edges, self.edges[1:])], 1).astype(np.uint8)
        back = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, u: np.ndarray, lists: np.ndarray, distance: float) -> np.ndarray:
        """(rows, lists) of booleans: whether the list may hold a vector within the distance."""
        d, c = square(u, self.centroids), self.centroids
        apart = np.sqrt(square(c, c))[lists]
        own = d[np.arange(len(u)), lists][:, None]
        return (d - own) <= 2 * (distance + 1e-6) * apart + 1e-9

    def look_up(self, q: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Distances of the queries from what the codes of a list stand for."""
        rest, out = q - self.centroids[of], np.zeros((len(q), len(codes)), np.float32)
        for i, (book, a, b) in enumerate(zip(self.books, self.edges, self.edges[1:])):
            out += square(rest[:, a:b], book).astype(np.float32)[:, codes[:, i]]
        return np.sqrt(np.maximum(out, 0))


def square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = square(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return c


def coarse_lists(vectors: int, sample: int) -> int:
    """How many lists an index of so many different vectors has."""
    return max(1, min(MOST_LISTS, max(min(FEW_LISTS, math.isqrt(vectors) // 4), vectors // ROWS_A_LIST), sample // 8))


def fit(sample: np.ndarray, lists: int) -> Model:
    """sample: unit vectors, in an order that does not depend on how rows were dealt."""
    rng, dim = np.random.default_rng(5), sample.shape[1]
    centroids = _means(sample, min(lists, len(sample)), rng)
    rest = sample - centroids[square(sample, centroids).argmin(1)]
    edges = [dim * i // SUBSPACES for i in range(SUBSPACES + 1)]
    edges = sorted(set(edges))
    return Model(centroids, [_means(rest[:, a:b], min(CODES, len(rest)), rng) for a, b in zip(edges, edges[1:])], edges)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the vector as bytes of doubles and its dimension; null where it can link with nothing."""
    for b in batches:
        vectors, dims = [], []
        for label, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            ok = label is not None and v and None not in v
            x = np.array(v, np.float64) if ok else None
            ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
            if ok:
                x = x / np.abs(x).max() + 0.0  # keeps squares in range; a cosine does not feel it
            vectors.append(x.astype("<f8").tobytes() if ok else None)
            dims.append(len(v) if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], ["id", "label", "dim", "v"])


def _matrix(values) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in values])


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1))[:, None]


def _place(models: dict[int, Model], distance: float):
    """Its list, code and code's error for each row, and the lists that it asks: its own and later ones, as each pair of
    lists needs one side to ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "label", "dim", "v", "n", "list", "code", "error", "asks"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.int32())]
        for b in batches:
            rows = pd.DataFrame(b.to_pydict())
            for dim, part in rows.groupby("dim"):
                m = models.get(int(dim))
                if m is None:  # a length that the sample lacks: one list, no code, any error
                    lists, code, error, asks = np.zeros(len(part), int), [b""] * len(part), np.full(len(part), np.inf), [[0]] * len(part)
                else:
                    u = _units(_matrix(part.v))
                    lists = m.lists(u)
                    codes, error = m.encode(u, lists)
                    code = [x.tobytes() for x in codes]
                    ask = m.probes(u, lists, distance) & (np.arange(len(m.centroids))[None] >= lists[:, None])
                    asks = [np.flatnonzero(x).tolist() for x in ask]
                data = [part.id, part.label, part.dim, part.v, part.n, lists.astype(np.int32), code, error, asks]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(data, kinds)], names)

    return run


def _compare(models: dict[int, Model], cosine: float, distance: float):
    """Links between a block of a list and the queries that ask it: (id, n, to) rows; n adds up links, to joins."""

    def run(key, block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "to": pd.Series(dtype="int64")})
        if not len(block) or not len(queries):
            return none
        dim, of = int(key[1]), int(key[2])
        m = models.get(dim)
        block, queries = block.sort_values("id"), queries.sort_values("id")
        x, q = _matrix(block.v), _matrix(queries.v)
        xu, qu = _units(x), _units(q)
        xn, qn = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        xid, qid, xw, qw = block.id.to_numpy(), queries.id.to_numpy(), block.n.to_numpy(), queries.n.to_numpy()
        codes = None if m is None else np.stack([np.frombuffer(c, np.uint8) for c in block.code])
        error = block.error.to_numpy()
        other = queries.list.to_numpy() != of
        x_links, q_links, x_label, q_label, joins = np.zeros(len(x), np.int64), np.zeros(len(q), np.int64), xid.copy(), qid.copy(), []
        for a in range(0, len(q), AT_ONCE):
            near = np.ones((min(AT_ONCE, len(q) - a), len(x)), bool) if codes is None else m.look_up(qu[a : a + AT_ONCE], of, codes) <= distance + error[None] + 1e-4
            near &= qid[a : a + AT_ONCE, None] != xid[None]
            some_q, some_x = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(some_q):
                continue
            exact = q[a + some_q] @ x[some_x].T / (qn[a + some_q][:, None] * xn[some_x][None])
            i, j = np.nonzero((exact >= cosine) & near[np.ix_(some_q, some_x)])
            if not len(i):
                continue
            i, j = a + some_q[i], some_x[j]
            np.add.at(q_links, i, xw[j])
            back = other[i]
            np.add.at(x_links, j[back], qw[i[back]])
            before_q, before_x = q_label.copy(), x_label.copy()
            while True:
                low = np.minimum(q_label[i], x_label[j])
                old = q_label[i].sum() + x_label[j].sum()
                np.minimum.at(q_label, i, low)
                np.minimum.at(x_label, j, low)
                if q_label[i].sum() + x_label[j].sum() == old:
                    break
            for before, now in ((before_q, q_label), (before_x, x_label)):
                moved = before != now  # a label that gives way to a smaller one stays joined to it
                joins.append(np.unique(np.stack([before[moved], now[moved]], 1), axis=0))
        pairs = np.unique(np.concatenate([*joins, np.stack([qid, q_label], 1), np.stack([xid, x_label], 1)]), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        got_q, got_x = q_links > 0, x_links > 0
        return pd.DataFrame({"id": np.concatenate([qid[got_q], xid[got_x], pairs[:, 0]]), "n": np.concatenate([q_links[got_q], x_links[got_x], np.zeros(len(pairs), np.int64)]), "to": pd.array([*qid[got_q], *xid[got_x], *pairs[:, 1]], dtype="int64")})

    return run


def near_duplicates(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row: rows with equal labels and a cosine of at least `cosine` are linked.

    Vectors that are null, empty or zero or hold a null or a number that is not finite, and rows without a label, link with
    nothing and are kept. Only vectors of one length link. Equal rows (same label and vector) are linked and are compared with
    others once; a repeated id counts once for each row. Vectors of any length are compared in full; no rows give none. Other columns are left out. Every row is indexed, every row asks.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.mapInArrow(_valid, "id long, label string, dim int, v binary").withColumn("digest", F.sha2("v", 256))
    rows = cut(rows, "vectors")
    classes = rows.where("v is not null").groupBy("label", "digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    classes = cut(classes.where("id is not null"), "vector-classes")
    distance = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    models: dict[int, Model] = {}
    sample = classes.orderBy(F.xxhash64("digest"), "id").select("dim", "v").limit(SAMPLE).collect()
    lists = coarse_lists(classes.count(), len(sample))
    for dim in {x.dim for x in sample}:
        models[dim] = fit(_units(_matrix(bytes(x.v) for x in sample if x.dim == dim)), lists)
    placed = classes.select("id", "label", "dim", "v", "n").mapInArrow(_place(models, distance), "id long, label string, dim int, v binary, n long, list int, code binary, error double, asks array<int>")
    placed = cut(placed, "vector-index")
    # A cell is a list's rows of one label. Its rows and those that ask it are cut into blocks, so however dense a cell is, no
    # task holds more than a block of either.
    cell, asked = ["label", "dim", "list"], placed.select("id", "label", "dim", "v", "n", F.col("list").alias("own"), F.explode("asks").alias("list"))
    blocks = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / ROWS_A_BLOCK).cast("int").alias("blocks"))
    parts = asked.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / QUERIES_A_BLOCK).cast("int").alias("parts"))
    cells = cut(blocks.join(parts, cell), "vector-cells")
    one_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = placed.drop("asks").join(cells, cell).withColumn("block", one_of("blocks")).withColumn("part", all_of("parts"))
    asking = asked.join(cells, cell).withColumn("block", all_of("blocks")).withColumn("part", one_of("parts"))
    at = ["label", "dim", "list", "block", "part"]
    index = index.select(*at, "id", "v", "n", "code", "error")
    asking = asking.select(*[F.col(c).alias(f"asked_{c}") for c in at], "id", "v", "n", F.col("own").alias("list"))
    asking = asking.toDF(*asking.columns)  # columns of their own, not those of index
    found = index.groupBy(*at).cogroup(asking.groupBy(*[f"asked_{c}" for c in at])).applyInPandas(_compare(models, cosine, distance), "id long, n long, to long")
    found = cut(found, "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    per_class = classes.select("label", "digest", F.col("id").alias("class_id"), "n").join(counts.withColumnRenamed("id", "class_id"), "class_id", "left").join(joined.withColumnRenamed("id", "class_id"), "class_id", "left")
    per_class = per_class.select(F.col("label").alias("_l"), F.col("digest").alias("_d"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    out = rows.select("id", "label", "digest").join(per_class, (F.col("label") == F.col("_l")) & (F.col("digest") == F.col("_d")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
