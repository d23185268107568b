"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector with M Gaussian projections: floor((a.x + b) / width).
Every row is indexed in all TABLES tables.  A query visits its own bucket of a
table and then perturbed buckets, in the order of their estimated success: the
sets of +-1 steps are ranked by the expected squared distance to the crossed
bucket borders, and steps are taken over the query's own nearest borders.
Candidates of all tables are merged and reranked by exact distance.

The width is fitted on at most SAMPLE rows: the smallest one whose recall among
them reaches TARGET.  Neighbours are nearer in the whole table than in a sample,
so recall on all rows is no lower than what was asked for.

A query for which its buckets hold fewer than k rows is searched again with
buckets WIDER times as wide besides, and if that finds too few as well, among all
rows; so each has k neighbours, or all candidates where there are fewer.

Queries are a stated set that is taken in blocks of at most BLOCK rows: a block's
probes are loaded by every task, each task looks its rows' buckets up in them and
keeps the k best of each query, and only these are shuffled.  A block's answers are
written and its probes released before the next block, so what is loaded at once
does not grow with the queries.  No bucket is ever
gathered, so one very common vector does no harm.

Rows with a null id or a null, zero or non-finite vector, or one with a null
component or of another than the most common length, take no part.  Rows with
the query's id are its own.  Repeated query ids count once (the smallest vector);
repeated rows are each candidates.  Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, written

NEIGHBOURS, EVERY = 10, 100
TABLES, PROJECTIONS, PROBES = 16, 8, 64
#: Queries of one block; rows of the sample that the width is fitted on; recall asked for there.
BLOCK, SAMPLE, TARGET = 1024, 4000, 0.96
WIDTHS = (0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 6.0, 10.0, 30.0)
#: Width of the second search, as a multiple of the first one's.
WIDER = 4
SEED = 20240229


def perturbations(m: int, count: int) -> list[tuple[int, ...]]:
    """Sets of places among a query's 2m borders, nearest first, by rising expected score; the empty set first."""
    z = [0.0] + [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    z += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(z[1], (1,))]
    while heap and len(out) < count:
        score, own = heapq.heappop(heap)
        if not any(2 * m + 1 - a in own for a in own):  # not both borders of one projection
            out.append(own)
        top = own[-1]
        if top < 2 * m:
            heapq.heappush(heap, (score - z[top] + z[top + 1], (*own[:-1], top + 1)))
            heapq.heappush(heap, (score + z[top + 1], (*own, top + 1)))
    return out


class Hash:
    """The tables' projections, for one width."""

    def __init__(self, dim: int, width: float, tables: int = TABLES, m: int = PROJECTIONS):
        rng = np.random.default_rng(SEED)
        self.a = rng.standard_normal((dim, tables * m))
        self.b = rng.random(tables * m)
        self.code = rng.integers(1, 1 << 62, m) | 1
        self.width, self.tables, self.m = width, tables, m

    def places(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.a / self.width + self.b).reshape(len(x), self.tables, self.m)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """rows x tables."""
        return (np.floor(self.places(x)).astype(np.int64) * self.code).sum(axis=2)

    def probes(self, x: np.ndarray, count: int = PROBES) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each table the sorted keys of all visited buckets and the query that visits each."""
        place = self.places(x)
        home = np.floor(place)
        inside = place - home
        near = np.argsort(np.concatenate([inside, 1 - inside], axis=2), axis=2, kind="stable")
        base = (home.astype(np.int64) * self.code).sum(axis=2)
        step = np.where(near < self.m, -1, 1) * self.code[near % self.m]
        keys = [base + sum((step[:, :, a - 1] for a in own), np.zeros_like(base)) for own in perturbations(self.m, count)]
        out = []
        for t in range(self.tables):
            flat = np.stack([k[:, t] for k in keys]).ravel()
            order = np.argsort(flat, kind="stable")
            out.append((flat[order], np.tile(np.arange(len(x)), len(keys))[order].astype(np.int32)))
        return out


def candidates(keys: np.ndarray, probes: list[tuple[np.ndarray, np.ndarray]], queries: int) -> np.ndarray:
    """rows x queries: whether some table puts the row in a bucket that the query visits."""
    met = np.zeros((len(keys), queries), bool)
    for t, (own, query) in enumerate(probes):
        lo, hi = np.searchsorted(own, keys[:, t], "left"), np.searchsorted(own, keys[:, t], "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        met[np.repeat(np.arange(len(keys)), count), query[at]] = True
    return met


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest."""
    order = np.lexsort((vec, score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def closest(met: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray) -> np.ndarray:
    """met, rows x queries, without what is surely not among a query's k nearest nor within its bound."""
    own, asked = (x**2).sum(axis=1), (q**2).sum(axis=1)
    square = np.where(met, own[:, None] + asked[None] - 2 * x @ q.T, np.inf)
    kth = np.partition(square, k - 1, axis=0)[k - 1] if len(x) > k else np.full(len(q), np.inf)
    # Far more than what the expanded square is rounded by: ties and near ties stay for the exact distance.
    return met & (square <= np.minimum(kth, bound**2) + 1e-9 * (own.max(initial=0) + asked))


def fit_width(x: np.ndarray, k: int, target: float) -> float:
    """The smallest width, as a multiple of the sample's spread, that reaches the target recall on the sample."""
    spread = float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0
    q = x[:: max(1, len(x) // 128)]
    own = np.arange(0, len(x), max(1, len(x) // 128))
    square = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * q @ x.T
    square[np.arange(len(q)), own] = np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return spread * WIDTHS[-1]
    true = np.argsort(square, axis=1)[:, :k]
    for w in WIDTHS:
        h = Hash(x.shape[1], w * spread)
        met = candidates(h.keys(x), h.probes(q), len(q))
        if np.mean([met[true[i], i].mean() for i in range(len(q))]) >= target:
            break
    return spread * w


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, block: int = BLOCK, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that is_query marks."""
    spark = vectors.sparkSession
    kind, told = "query_id long, vec_id long, score double", "query_id long, rank int, vec_id long, score double"
    v = F.col(f"`{vector}`")
    rows = vectors.where(usable(v) & F.col(f"`{id_col}`").isNotNull())
    widest = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    if widest is None:
        return spark.createDataFrame([], told)
    rows = rows.where(F.size(v) == widest["n"])
    flat = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("asks"))
    drawn = flat.orderBy(F.xxhash64("id", "v")).limit(sample).collect()  # at most `sample` rows
    width = fit_width(np.asarray([r["v"] for r in drawn], np.float64), k, target)
    narrow, wide = Hash(widest["n"], width), Hash(widest["n"], width * WIDER)

    def look_up(at, hashes):
        def run(batches):
            ids, q, probes = at.value
            held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
            for batch in batches:
                vec = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
                for lo in range(0, len(vec), 256):
                    part, own = x[lo : lo + 256], vec[lo : lo + 256]
                    met = np.full((len(part), len(ids)), not hashes)
                    for h, p in zip(hashes, probes, strict=True):
                        met |= candidates(h.keys(part), p, len(ids))
                    met &= own[:, None] != ids[None]
                    if len(hashes) != 1:  # many rows are met: only the nearest ones are measured
                        count = np.bincount(held[0], minlength=len(ids))
                        worst = np.zeros(len(ids))
                        np.maximum.at(worst, held[0], held[1])
                        met = closest(met, part, q, k, np.where(count < k, np.inf, worst))
                    r, c = np.nonzero(met)
                    held = [np.concatenate(p) for p in zip(held, (c, distances(part[r], q[c]), own[r]), strict=True)]
                    keep = best(*held, k)
                    held = [p[keep] for p in held]
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[2]), pa.array(held[1])], names=["query_id", "vec_id", "score"])

        return run

    def search(asked, hashes):
        """The k nearest rows in the buckets of some of the hashes; of all rows, where there is no hash."""
        blocks = max(1, -(-asked.count() * 5 // (block * 4)))  # so that a block by hash keeps within its size
        best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        path, empty = shared_folder(spark), True
        for b in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
            for lo in range(0, len(part), block):
                some = part[lo : lo + block]
                ids, q = np.asarray([r["id"] for r in some], np.int64), np.asarray([r["v"] for r in some], np.float64)
                at = spark.sparkContext.broadcast((ids, q, [h.probes(q) for h in hashes]))
                got = flat.select("id", "v").mapInArrow(look_up(at, hashes), kind)
                got.withColumn("rank", best.cast("int")).where(F.col("rank") <= k).select(*(c.split()[0] for c in told.split(", "))).write.mode("append").parquet(path)
                at.unpersist()  # a block is done with before the next one is loaded
                empty = False
        return spark.createDataFrame([], told) if empty else spark.read.schema(told).parquet(path)

    asked = flat.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    out = search(asked, [narrow])
    for hashes in ([narrow, wide], []):
        full = out.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
        asked = written(asked.join(full, "id", "left_anti"))
        if asked.isEmpty():
            break
        again = search(asked, hashes)
        out = out.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(again.columns).unionByName(again)
    return out


def op9(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)
