"""All pairs of rows in square tiles: distances are summed where they arise, and are never rows."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import learning, models, plane
from tidemark.sources.files import kept

#: Rows of a block at most, and of a block where there are few; a tile holds two blocks.
TILE, SMALL = 32768, 1024
#: Distances that a task holds at once in a space, few enough to stay near the processor.
CELLS, WIDE = 1 << 15, 2048


def _distances(x: np.ndarray, y: np.ndarray, out: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of each row of x to each column of y, summed dimension by dimension, into `out`."""
    out[:] = 0.0
    for i in range(x.shape[1]):
        np.subtract(x[:, i, None], y[i], out=other)
        np.multiply(other, other, out=other)
        np.add(out, other, out=out)
    return np.sqrt(out, out=out)


def space_moments(points: DataFrame, names: list[str], *, tile: int | None = None, weight: str | None = None) -> DataFrame:
    """Moments of the distances of all pairs in each of several spaces, of rows (id, a vector per name): n, mean_x and square_x per space x, and product_x_y per two, about the means.

    Rows that are the same in all spaces count as one with their number (or the sum of
    `weight`) for a weight.  They are dealt to blocks by a hash, and every two blocks
    meet in one tile, a task's: a row goes to as many tiles as there are blocks, and a
    tile gives one row.  Blocks are small while there are few, so that all cores have
    tiles.  Rows with a null vector are left out; fewer than two rows give n = 0.
    """
    rows = points.where(" and ".join(f"`{c}` is not null" for c in names)).select(F.lit(1).cast("long").alias("weight") if weight is None else F.col(weight).cast("long").alias("weight"), *(F.col(c).cast("array<double>").alias(c) for c in names))
    rows = kept(rows.groupBy(*names).agg(F.sum("weight").alias("weight")))
    n = rows.count()
    blocks = max(1, -(-n // tile) if tile else max(-(-n // TILE), min(-(-n // SMALL), 16)))
    own = F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")
    i, j = F.least("own", "other"), F.greatest("own", "other")
    number = i * blocks - (i * (i - 1) / 2).cast("int") + j - i
    tiles = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = tiles.select(number.cast("int").alias("tile"), (F.col("own") == i).alias("is_first"), (F.col("own") == j).alias("is_second"), "weight", *names).repartitionById(blocks * (blocks + 1) // 2, "tile")
    both = list(itertools.combinations(range(len(names)), 2))
    out = ["n", *(f"{m}_{c}" for m in ("mean", "square") for c in names), *(f"product_{names[a]}_{names[b]}" for a, b in both)]

    def sums(table):
        weights = table["weight"].to_numpy()
        space = [learning._matrix(table[c]) for c in names]
        first, second = (np.flatnonzero(table[c].to_numpy()) for c in ("is_first", "is_second"))
        within = len(first) == len(weights) == len(second)  # a block against itself
        single = bool((weights == 1).all())
        n, mean, square, product = 0, np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(both))

        def add(m, own_mean, own_square, own_product):
            nonlocal n, mean, square, product
            shift, total = own_mean - mean, n + m
            square = square + own_square + shift**2 * n * m / total
            product = product + own_product + np.asarray([shift[a] * shift[b] * n * m / total for a, b in both])
            mean, n = mean + shift * m / total, total

        if within and not single:  # pairs of rows that are the same
            alike = int((weights * (weights - 1) // 2).sum())
            if alike:
                add(alike, np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(both)))
        step = max(1, CELLS // min(max(1, len(second)), WIDE))
        far, spare = np.empty((len(names), CELLS + WIDE)), np.empty(CELLS + WIDE)
        turned = [np.ascontiguousarray(v[second].T) for v in space]
        for lo in range(0, len(first), step):
            for at in range(lo + 1 if within else 0, len(second), WIDE):
                x, y = first[lo : lo + step], second[at : at + WIDE]
                size = len(x) * len(y)
                d = far[:, :size]
                for s, v in enumerate(space):
                    _distances(v[x], turned[s][:, at : at + WIDE], d[s].reshape(len(x), -1), spare[:size].reshape(len(x), -1))
                if within and at < lo + step:  # each pair once
                    use = (np.arange(at, at + len(y))[None] > np.arange(lo, lo + len(x))[:, None]).ravel()
                    d = d[:, use]
                else:
                    use = slice(None)
                if not d.shape[1]:
                    continue
                if single:
                    m, own_mean = d.shape[1], d.mean(axis=1)
                    for v, c in zip(d, own_mean, strict=True):
                        v -= c
                    add(m, own_mean, np.asarray([v @ v for v in d]), np.asarray([d[a] @ d[b] for a, b in both]))
                else:
                    w = (weights[x][:, None] * weights[y][None]).ravel()[use]
                    m, w = int(w.sum()), w.astype(np.float64)
                    own_mean = d @ w / m
                    d = d - own_mean[:, None]
                    add(m, own_mean, (d * d) @ w, np.asarray([(d[a] * d[b]) @ w for a, b in both]))
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in [n, *mean.tolist(), *square.tolist(), *product.tolist()]], names=out)

    def run(batches):
        held = [b for b in batches if b.num_rows]  # two blocks, or none
        if held:
            table = pa.Table.from_batches(held)
            for t in pc.unique(table["tile"]).to_pylist():
                yield sums(table.filter(pc.equal(table["tile"], t)))

    each = kept(tiles.mapInArrow(run, ", ".join(f"`{c}` {'long' if c == 'n' else 'double'}" for c in out)))
    n = F.sum("n")
    whole = each.agg(F.coalesce(n, F.lit(0)).alias("total"), *((F.sum(F.col(f"mean_{c}") * F.col("n")) / F.nullif(n, F.lit(0))).alias(f"all_{c}") for c in names))
    off = {c: F.col(f"mean_{c}") - F.col(f"all_{c}") for c in names}
    return each.crossJoin(F.broadcast(whole)).agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("n"), *(F.max(f"all_{c}").alias(f"mean_{c}") for c in names),
        *(F.sum(F.col(f"square_{c}") + F.col("n") * off[c] * off[c]).alias(f"square_{c}") for c in names),
        *(F.sum(F.col(f"product_{a}_{b}") + F.col("n") * off[a] * off[b]).alias(f"product_{a}_{b}") for a, b in itertools.combinations(names, 2)),
    )


def distance_moments(points: DataFrame, *, tile: int | None = None) -> DataFrame:
    """space_moments() of rows (id, a, b): n, mean_a, mean_b, square_a, square_b and product."""
    return space_moments(points, ["a", "b"], tile=tile).withColumnRenamed("product_a_b", "product")


def distance_correlation(points: DataFrame, *, tile: int | None = None) -> DataFrame:
    """One row: n and the Pearson correlation of the pairs' distances in the two spaces, 0 where one has no spread."""
    m = distance_moments(points, tile=tile)
    spread = F.sqrt(F.col("square_a") * F.col("square_b"))
    return m.select("n", F.when((F.col("square_a") > 0) & (F.col("square_b") > 0), F.col("product") / spread).otherwise(0.0).alias("correlation"))


def influence(correlation: float, overlap: float) -> str:
    """How much a map owes to its seed."""
    return "LOW" if correlation >= 0.90 and overlap >= 0.70 else "MODERATE" if correlation >= 0.75 and overlap >= 0.50 else "HIGH"


def seed_stability(rows: DataFrame, seeds: tuple[int, ...] = (7, 42, 123), *, k: int = 10, anchors: int = 90, perplexity: float = 25, iterations: int = 300) -> DataFrame:
    """(a, b, correlation, overlap, kl_delta, influence) of the maps that each two seeds give rows (id, vector), and their means (a and b null).

    correlation: of all pairs' distances; overlap: mean share of the k nearest rows.
    """
    spark = rows.sparkSession
    rows = kept(rows.where("vector is not null").repartition(max(2, spark.sparkContext.defaultParallelism)))
    own = list(dict.fromkeys(seeds))
    fitted = models.fit_maps(rows, own, anchors=anchors, perplexity=perplexity, iterations=iterations)
    names = {s: f"m{i}" for i, s in enumerate(own)}
    kl = {s: fitted[i]["divergence"] if fitted else 0.0 for i, s in enumerate(own)}
    maps = kept(models.placed_together(rows, fitted, list(names.values()), k + 1))
    told = space_moments(maps, list(names.values()), weight="weight").first()  # all spaces in one pass over the pairs
    pairs = [(a, b) for x, a in enumerate(seeds) for b in seeds[x + 1 :]]
    shared = _shared(maps, [(names[a], names[b]) for a, b in pairs], k) if pairs else []
    out = []
    for (a, b), o in zip(pairs, shared, strict=True):
        spread = np.sqrt((told[f"square_{names[a]}"] or 0.0) * (told[f"square_{names[b]}"] or 0.0))
        product = told[f"square_{names[a]}"] if a == b else told["product_{}_{}".format(*sorted((names[a], names[b])))]
        c = product / spread if spread > 0 else 0.0
        out.append((a, b, float(c), o, abs(kl[a] - kl[b])))
    mean = [float(np.mean([r[i] for r in out])) if out else 0.0 for i in (2, 3, 4)]
    told = [(*r, influence(r[2], r[3])) for r in out] + [(None, None, *mean, influence(mean[0], mean[1]))]
    return spark.createDataFrame(told, "a long, b long, correlation double, overlap double, kl_delta double, influence string")


def _shared(maps: DataFrame, pairs: list[tuple[str, str]], k: int) -> list[float]:
    """Mean share of the k nearest rows that each two maps have in common, of groups of rows (key, ids, weight, a place per map).

    A group has one list of k + 1 ids a map; a row takes itself out of it.  Rows that are
    not among the group's least ids are in no list, and have the same neighbours.
    """
    names = sorted({c for pair in pairs for c in pair})
    near = plane.nearest_ids(maps, names, k + 1)
    rows = maps.select("key", "ids", "weight").join(near, "key")

    def alike_of(a: str, b: str):
        of = lambda c, v: F.slice(F.array_remove(c, v), 1, k)
        known = F.aggregate("ids", F.lit(0).cast("long"), lambda s, v: s + F.size(F.array_intersect(of(a, v), of(b, v))))
        return known + (F.col("weight") - F.size("ids")) * F.size(F.array_intersect(F.slice(a, 1, k), F.slice(b, 1, k)))

    sums = []
    for i, (a, b) in enumerate(pairs):
        alike = alike_of(a, b)
        counts = (F.size(a) > 1) & (F.size(b) > 1)  # somebody else is there
        sums += [F.sum(F.when(counts, alike)).alias(f"s{i}"), F.sum(F.when(counts, F.col("weight"))).alias(f"n{i}")]
    told = rows.agg(*sums).first()
    return [told[f"s{i}"] / (k * told[f"n{i}"]) if told[f"n{i}"] else 0.0 for i in range(len(pairs))]
