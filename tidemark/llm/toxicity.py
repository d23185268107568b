"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; the unlabelled class is text drawn
without looking at its label.  A linear model over hashed words and word
beginnings, each by whether it occurs once, twice and three times, minimises

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]),   l(z) = log(1 + exp(-z)),

and steps the other way while the bracket is negative, so that it can't overfit
below zero risk.  The class prior is the share of toxic rows among all training
labels; at the end the bias is set so that unlabelled text scores the prior on
average.  Fitting sees at most MAX_POSITIVE + MAX_UNLABELLED documents, chosen by
a hash of their id; scoring reads every document whole and shuffles nothing.

Rows whose crc32(id as text) mod 4 is 2 are held out of every part of the fit.
Null or empty texts have no features and get the model's base rate; ids without
a label, labels without a document, null labels and repeated labels (the largest
counts) are allowed; with no positive training label every score is 0.  Repeated
documents are scored each; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _BYTE, LOWER, _powers, annotate, mix, row_chunks, text_buffer, words, written

#: Bounds of the fitted sample, in documents.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 16_000
#: Hash buckets, and the lengths in bytes of the word beginnings that count as features.
BUCKETS, STEMS = 1 << 20, (4, 5, 6)
#: Bucket of "at least so many times", as the bucket of "at least once" with these bits flipped.
TIMES = {1: 0, 2: 0x55A3C, 3: 0xA97E1}
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and word beginning, with repeats."""
    hashes, first, last, bounds = words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    rows, found = [row], [hashes]
    low = LOWER[data]
    for k in STEMS:
        long = np.flatnonzero(last - first > k)
        stem = np.zeros(len(long), np.uint64)
        up, _ = _powers(k)
        for j in range(k):
            stem += _BYTE[low[first[long] + j]] * up[j]
        rows.append(row[long])
        found.append(mix(stem + np.uint64(k)))
    bucket = (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return np.concatenate(rows), bucket


def by_times(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of how often each feature occurs in a row, by row."""
    both, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    row = np.concatenate([both[n >= least] // BUCKETS for least in TIMES])
    bucket = np.concatenate([both[n >= least] % BUCKETS ^ flip for least, flip in TIMES.items()])
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order]


@dataclass
class Model:
    weights: np.ndarray  # one per bucket, mostly zero
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        row, bucket = features(data, offsets)
        used = np.flatnonzero(np.logical_or.reduce([self.weights[bucket ^ flip] != 0 for flip in TIMES.values()]))
        row, bucket = by_times(row[used], bucket[used])
        f = self.bias + np.bincount(row, self.weights[bucket], n)
        return 1 / (1 + np.exp(-f))


def nnpu(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, prior: float, width: int, *, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias for presence features, given as (row, column); `positive` marks the P rows, the others are U."""
    n = len(positive)
    weight_of = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, rounds + 1):
        f = theta[-1] + np.bincount(rows, theta[columns], n)
        loss_negative = np.logaddexp(0, f) * weight_of
        bracket = loss_negative[~positive].sum() - prior * loss_negative[positive].sum()
        up = np.where(positive, -prior * weight_of * sigmoid(-f), 0)  # of prior * E_P[l(f)]
        down = np.where(positive, -prior, 1) * weight_of * sigmoid(f)  # of the bracket
        g = up + down if bracket >= 0 else -down
        gradient = np.append(np.bincount(columns, g[rows], width), g.sum()) + decay * np.append(theta[:-1], 0)
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    f = np.bincount(rows, theta[columns], n)[~positive]
    low, high = -50.0, 50.0
    for _ in range(60):  # the bias at which unlabelled text scores the prior on average
        middle = (low + high) / 2
        low, high = (middle, high) if sigmoid(f + middle).mean() < prior else (low, middle)
    return theta[:-1], low


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text: str, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """Written table of (positive, buckets as little-endian int32) of the bounded sample, and the class prior."""
    train = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    prior = train.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    ids = docs.select(F.col(f"`{id_col}`").alias(id_col)).where(~held_out(id_col) & F.col(id_col).isNotNull()).distinct()
    order = F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"))
    p = train.where("toxic = 1").select(id_col).join(ids, id_col, "left_semi").orderBy(order, id_col).limit(max_positive).withColumn("positive", F.lit(True))
    u = ids.orderBy(order, id_col).limit(max_unlabelled).withColumn("positive", F.lit(False))
    chosen = p.unionByName(u)  # at most max_positive + max_unlabelled ids: small enough to broadcast
    joined = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), id_col)
    joined = joined.groupBy(id_col, "positive").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one row of an id that is repeated

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_chunks(offsets):
                row, bucket = by_times(*features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                raw = bucket.astype("<i4")
                packed = [raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["positive", "buckets"])

    return written(joined.select("positive", "text").mapInArrow(run, "positive boolean, buckets binary")), float(prior)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """The model; None where no training label is positive."""
    table, prior = sample(docs, labels, id_col=id_col, text=text, max_positive=max_positive, max_unlabelled=max_unlabelled)

    def counts(batches):
        seen = {True: np.zeros(BUCKETS, np.int64), False: np.zeros(BUCKETS, np.int64)}
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[p][np.frombuffer(raw, "<i4")] += 1
        at = np.flatnonzero(seen[True] + seen[False])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[True][at]), pa.array(seen[False][at])], names=["bucket", "p", "u"])

    sizes = {r["positive"]: r["count"] for r in table.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u or not 0 < prior < 1:
        return None
    # Every task gives all its buckets, BUCKETS rows at most: a bucket's positives may lie in other tasks than its unlabelled rows.
    pairs = table.mapInArrow(counts, "bucket long, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    expected = F.col("u") / n_u * n_p
    useful = (F.col("p") >= 5) & (F.col("p") > 2 * expected) & (F.col("p") - expected > 4 * F.sqrt(expected + 1))
    picked = np.sort(np.asarray([r["bucket"] for r in pairs.where(useful).select("bucket").collect()], np.int64))  # at most BUCKETS
    if not len(picked):
        return Model(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))

    def narrow(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                b = np.frombuffer(raw, "<i4")
                at = np.minimum(np.searchsorted(picked, b), len(picked) - 1)
                out.append(at[picked[at] == b].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["positive", "columns"])

    got = table.mapInArrow(narrow, "positive boolean, columns array<int>").collect()  # the bounded sample
    positive = np.asarray([r["positive"] for r in got])
    rows = np.repeat(np.arange(len(got)), [len(r["columns"]) for r in got])
    columns = np.asarray([c for r in got for c in r["columns"]], np.int64)
    w, bias = nnpu(rows, columns, positive, prior, len(picked))
    weights = np.zeros(BUCKETS)
    weights[picked] = w
    return Model(weights, bias)


def score(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned too) that holds `score`."""
    at = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = at.value
        return lambda data, offsets: [pa.array(m.score(data, offsets) if m else np.zeros(len(offsets) - 1))]

    return annotate(docs, text, "score double", make, keep)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, c = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
    s = F.col(c)["score"]
    return out.select("doc_id", held_out("doc_id").alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))
