"""Hard negatives by vantage-point trees over norm-augmented vectors.

Vectors are whole numbers.  With one more coordinate, sqrt(M^2 - |x|^2), where M is
the greatest norm, all rows lie on a sphere; an anchor q gets 0 there, and its
squared distance to a row is |q|^2 + M^2 - 2 q.x: the nearest rows are those with the
highest inner product, and a window of scores is an annulus of distances.

Rows are dealt by a small vantage-point tree over at most SAMPLE rows (it decides
where a row lies, nothing else) and written once in that order.  A task reads rows
in order and builds a tree on every PART_ROWS of them: a node's vantage point, and
how near and far its two halves lie from it.  An anchor goes through a tree's leaves
by rising lower bound of their distance, skips those wholly inside or outside its
annulus, and ends as soon as no later leaf can hold a row that it still lacks.
Scores are exact; bounds have slack for rounding.

Anchors are a stated query set, taken against all rows in blocks of at most BLOCK:
the first pass finds an anchor's positives (at most k a row of the block go through
the driver), the second its negatives.  Each task keeps the k best of an anchor, or
of a window, and only these are shuffled; a block is written and released before the
next one, so what is broadcast does not grow with the table.

Rows with a null id, label or vector, with a null or non-finite component, of
another length than the most common one, or so long that their squared norm passes
2^61, take no part; zero vectors do.  Other rows are those with another id: rows
that share the anchor's id are neither positives nor negatives.  An id repeated
among the anchors counts once (smallest label and vector); repeated rows are each
found.  Ties go to the smaller id.  A window below zero is empty, as its lower end
lies above its upper one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, table, written

NEAREST, LEAST, EVERY = 5, 80, 100
#: Whole numbers a component of 1.0 becomes.
STEP = 256
#: Rows of a tree, of its leaves, of the tree that deals them; anchors of a block.
PART_ROWS, LEAF, SAMPLE, BLOCK = 32_768, 128, 4_096, 4_096
_LARGEST = float(1 << 61)


class Tree:
    """A vantage-point tree over rows x (whole numbers) on the sphere of radius^2 `square`."""

    def __init__(self, x: np.ndarray, square: int, leaf: int = LEAF):
        self.square = float(square)
        rest = square - (x.astype(np.int64) ** 2).sum(axis=1)
        self.up = np.sqrt(np.maximum(rest, 0).astype(np.float64))
        self.x = x.astype(np.float64)
        self.order = np.arange(len(x))
        # Inner nodes: vantage row, children, nearest and farthest distance of each child; nodes below zero are leaves.
        self.vantage, self.child, self.reach, self.leaves = [], [], [], []
        todo = [(0, len(x), None)]
        while todo:
            s, e, up = todo.pop()
            if e - s <= leaf:
                node = -1 - len(self.leaves)
                self.leaves.append((s, e))
            else:
                node = len(self.vantage)
                rows = self.order[s:e]
                point = rows[int(np.argmax(self.between(rows, rows[0])))]  # a point at the rim
                d = self.between(rows, point)
                by = np.argsort(d, kind="stable")
                self.order[s:e], d, m = rows[by], d[by], (e - s) // 2
                self.vantage.append(point)
                self.child.append([0, 0])
                self.reach.append([d[0], d[m - 1], d[m], d[-1]])
                todo += [(s + m, e, (node, 1)), (s, s + m, (node, 0))]
            if up is not None:
                self.child[up[0]][up[1]] = node

    def between(self, rows: np.ndarray, point: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (self.square - self.x[rows] @ self.x[point] - self.up[rows] * self.up[point]), 0))

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls to."""
        up = np.sqrt(np.maximum(self.square - (x**2).sum(axis=1), 0))
        at = np.zeros(len(x), np.int64) if self.vantage else np.full(len(x), -1)
        for node, point in enumerate(self.vantage):  # parents come before their children
            here = np.flatnonzero(at == node)
            d = np.sqrt(np.maximum(2 * (self.square - x[here] @ self.x[point] - up[here] * self.up[point]), 0))
            at[here] = np.where(d <= self.reach[node][1], self.child[node][0], self.child[node][1])
        return -1 - at

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors x leaves: no row of the leaf is nearer than the first, or farther than the second."""
        norm = (q**2).sum(axis=1)
        least, most = np.zeros((len(q), len(self.leaves))), np.full((len(q), len(self.leaves)), np.inf)
        far = {0 if self.vantage else -1: (np.zeros(len(q)), np.full(len(q), np.inf))}
        slack = 1e-6 * np.sqrt(self.square + norm) + 1e-6
        for node, point in enumerate(self.vantage):
            low, high = far.pop(node)
            d = np.sqrt(np.maximum(norm + self.square - 2 * q @ self.x[point], 0))
            for side in (0, 1):
                near, away = self.reach[node][2 * side : 2 * side + 2]
                far[self.child[node][side]] = np.maximum(low, np.maximum(near - d, d - away) - slack), np.minimum(high, d + away + slack)
        for node, (low, high) in far.items():
            least[:, -1 - node], most[:, -1 - node] = low, high
        return least, most


class Part:
    """Rows of a tree in the order of its leaves, and how anchors go through them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, square: int):
        self.tree = Tree(x, square)
        order = self.tree.order
        # Sums of products stay below |x||q|: exact as doubles up to 2^53, else in whole numbers.
        self.ids, self.labels, self.x = ids[order], labels[order], x[order].astype(np.float64 if square < 1 << 52 else np.int64)

    def visit(self, q: np.ndarray, order: np.ndarray):
        """(ids, labels, scores) of the leaves of `order`: one leaf, then ever more at a time."""
        at, step = 0, 1
        while at < len(order):
            some = order[at : at + step]
            rows = np.concatenate([np.arange(*self.tree.leaves[k]) for k in some])
            yield at + len(some), self.ids[rows], self.labels[rows], (self.x[rows] @ q.astype(self.x.dtype)).astype(np.int64)
            at, step = at + len(some), min(2 * step, 32)


def distance(norm: float, square: float, score) -> float:
    return float(np.sqrt(max(norm + square - 2.0 * float(score), 0.0)))


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))


def positives(part: Part, anchors: tuple, k: int):
    """Yields (anchor, ids, scores) of the part's k best rows of the anchor's label."""
    own, label, q, _ = anchors
    least, _ = part.tree.bounds(q.astype(np.float64))
    norm = (q.astype(np.float64) ** 2).sum(axis=1)
    for a in range(len(own)):
        order = np.argsort(least[a], kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for seen, i, near, s in part.visit(q[a], order):
            ok = (near == label[a]) & (i != own[a])
            ids, scores = np.concatenate([ids, i[ok]]), np.concatenate([scores, s[ok]])
            keep = first(scores, ids, k)
            ids, scores = ids[keep], scores[keep]
            if len(ids) == k and seen < len(order) and least[a, order[seen]] > distance(norm[a], part.tree.square, scores[-1]):
                break
        yield a, ids, scores


def negatives(part: Part, anchors: tuple, k: int, share: int):
    """Yields (anchor, window, ids, scores) of the part's k best rows of other labels in each of the anchor's windows."""
    own, label, q, windows = anchors
    least, most = part.tree.bounds(q.astype(np.float64))
    norm = (q.astype(np.float64) ** 2).sum(axis=1)
    for a in range(len(own)):
        tops = [p for p in windows[a] if p >= 0]  # scores of the positives, each once
        if not tops:
            continue
        bottoms = [-(-share * p // 100) for p in tops]
        inner, outer = (distance(norm[a], part.tree.square, s) for s in (max(tops), min(bottoms)))
        order = np.flatnonzero((most[a] >= inner) & (least[a] <= outer + 1e-6 * np.sqrt(part.tree.square + norm[a]) + 1e-6))
        order = order[np.argsort(least[a, order], kind="stable")]
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tops]
        for seen, i, near, s in part.visit(q[a], order):
            ok = (near != label[a]) & (i != own[a]) & (s >= min(bottoms)) & (s <= max(tops))
            i, s = i[ok], s[ok]
            needed = np.inf
            for w, (low, high) in enumerate(zip(bottoms, tops, strict=True)):
                some = (s >= low) & (s <= high)
                if some.any():
                    ids, scores = np.concatenate([held[w][0], i[some]]), np.concatenate([held[w][1], s[some]])
                    keep = first(scores, ids, k)
                    held[w] = ids[keep], scores[keep]
                needed = min(needed, held[w][1][-1] if len(held[w][1]) == k else low)
            if seen < len(order) and least[a, order[seen]] > distance(norm[a], part.tree.square, needed):
                break
        for top, (ids, scores) in zip(tops, held, strict=True):
            if len(ids):
                yield a, top, ids, scores


def parts(batches, square: int, rows: int):
    """Parts of at most `rows` rows of (id, label, v), in the order they come."""
    held, n = [], 0
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = batch.column(2).flatten().to_numpy().reshape(len(ids), -1)
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, rows - n)
            held.append((ids[at : at + take], labels[at : at + take], x[at : at + take]))
            n, at = n + take, at + take
            if n == rows:
                yield Part(*(np.concatenate(p) for p in zip(*held, strict=True)), square)
                held, n = [], 0
    if held:
        yield Part(*(np.concatenate(p) for p in zip(*held, strict=True)), square)


def reduced(held: dict, key, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    if key in held:
        ids, scores = np.concatenate([held[key][0], ids]), np.concatenate([held[key][1], scores])
    keep = first(scores, ids, k)
    held[key] = ids[keep], scores[keep]


def told(held: dict, own: np.ndarray) -> pa.RecordBatch:
    n = [len(i) for i, _ in held.values()]
    anchor, top = (np.repeat(np.asarray([key[c] for key in held], np.int64), n) for c in (0, 1))
    ids, scores = (np.concatenate([h[c] for h in held.values()]) for c in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(own[anchor]), pa.array(top), pa.array(ids), pa.array(scores)], names=["anchor_id", "top", "id", "score"])


def search(at, square: int, k: int, share: int | None, rows: int):
    """mapInArrow over the dealt rows: positives where there is no share, else negatives."""

    def run(batches):
        anchors = at.value
        held: dict = {}
        for part in parts(batches, square, rows):
            if share is None:
                for a, ids, scores in positives(part, anchors, k):
                    if len(ids):
                        reduced(held, (a, 0), ids, scores, k)
            else:
                for a, top, ids, scores in negatives(part, anchors, k, share):
                    reduced(held, (a, top), ids, scores, k)
        if held:
            yield told(held, anchors[0])

    return run


_FOUND = "anchor_id long, top long, id long, score long"


def mine(vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector: str = "embedding", label: Column | None = None, k_positive: int = NEAREST, k: int = NEAREST, share: int = LEAST, block: int = BLOCK, part_rows: int = PART_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that is_anchor marks."""
    spark = vectors.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    v = F.col(f"`{vector}`")
    scaled = F.transform(v, lambda c: c.cast("double") * STEP)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fits = F.aggregate(scaled, F.lit(0.0), lambda t, c: t + (F.abs(c) + 1) * (F.abs(c) + 1)) < _LARGEST
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), v.alias("raw"), F.when(~bad & fits, F.transform(scaled, lambda c: F.floor(c).cast("long"))).alias("v"), is_anchor.alias("asks"))
    rows = rows.where("id is not null and label is not null and v is not null and size(v) > 0")
    widest = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if widest is None:
        return spark.createDataFrame([], kind)
    rows = rows.where(F.size("v") == widest["n"]).select("id", "label", "v", "asks")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda t, c: t + c * c)
    square, total = rows.agg(F.max(norm), F.count(F.lit(1))).first()
    drawn = np.asarray([r["v"] for r in rows.orderBy(F.xxhash64("id", "v")).limit(sample).collect()], np.int64)
    cells = min(total // part_rows + 1, len(drawn) // 16 + 1)
    dealer = spark.sparkContext.broadcast(Tree(drawn, square, leaf=-(-len(drawn) // cells)))

    def deal(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dealer.value.route(x))], names=["id", "label", "v", "asks", "cell"])

    dealt = rows.mapInArrow(deal, "id long, label long, v array<long>, asks boolean, cell long")
    pieces = max(-(-total // (8 * part_rows)), min(spark.sparkContext.defaultParallelism, -(-total // 4096)))  # files of some trees each
    dealt = written(dealt.repartitionByRange(pieces, "cell", "id").sortWithinPartitions("cell", "id"))
    dealer.unpersist()
    flat = dealt.select("id", "label", "v")
    asked = written(dealt.where("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v"))
    blocks = max(1, -(-asked.count() * 5 // (block * 4)))  # so that a block by hash keeps within its size
    path = shared_folder(spark)
    best = lambda n, *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")) <= n
    empty = True
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        for lo in range(0, len(part), block):
            some = part[lo : lo + block]
            own, near, q = np.asarray([r["id"] for r in some], np.int64), np.asarray([r["label"] for r in some], np.int64), np.asarray([r["v"] for r in some], np.int64)
            at = spark.sparkContext.broadcast((own, near, q, None))
            found = flat.mapInArrow(search(at, square, k_positive, None, part_rows), _FOUND)
            found = found.withColumn("ok", best(k_positive, "anchor_id")).where("ok").drop("ok", "top")
            held = found.collect()  # at most k_positive rows an anchor of the block
            at.unpersist()
            place = {int(a): n for n, a in enumerate(own)}
            windows: list[list[int]] = [[] for _ in own]
            for s, a in sorted({(r["score"], r["anchor_id"]) for r in held}, reverse=True):
                windows[place[a]].append(s)
            at = spark.sparkContext.broadcast((own, near, q, windows))
            got = flat.mapInArrow(search(at, square, k, share, part_rows), _FOUND)
            got = got.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "top").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
            chosen = F.broadcast(spark.createDataFrame([(r["anchor_id"], r["id"], r["score"]) for r in held], "anchor_id long, positive_id long, top long"))
            got.join(chosen, ["anchor_id", "top"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score")).write.mode("append").parquet(path)
            at.unpersist()
            empty = False
    return spark.createDataFrame([], kind) if empty else spark.read.schema(kind).parquet(path)


def op11(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, label=label)
