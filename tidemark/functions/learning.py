"""Scaling, neighbours, metrics, baselines and the array forms of density models."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.quality import at_places
from tidemark.sources.files import kept, shared_folder


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the population deviation; deviations below 1e-12 count as 1; missing values are 0 beforehand."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    fit = filled.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-12, 1.0).otherwise(F.col(f"s_{c}")) for c in columns}
    return filled.crossJoin(F.broadcast(fit)).select(*(z[c].alias(c) if c in z else F.col(c) for c in df.columns))


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """A 0/1 column per category, sorted; unseen values are all zeros."""
    return df.select("*", *((F.col(column) == c).cast("long").alias(f"{column}_{c}") for c in sorted(categories)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


#: Queries that a task holds at once; distances that it measures at once; candidates that it measures exactly at once; candidates that wait to be put in order.
QUERY_BLOCK, CELLS, EXACT, HELD = 8192, 1 << 21, 1 << 16, 1 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """rows x dimensions of a column of lists without null lists; null numbers become NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(size) > 1:
        raise ValueError(f"vectors have different lengths: {size.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(size[0]) if len(size) else 0)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared lengths; -inf where they overflow, so that a bound never leaves such a row out."""
    with np.errstate(over="ignore"):
        out = (x * x).sum(axis=1)
    out[np.isinf(out) & np.isfinite(x).all(axis=1)] = -np.inf
    return out


def _single(x: np.ndarray, squares: np.ndarray) -> bool:
    """Whether products of such rows in single precision are off by no more than their share of the squares."""
    return bool(len(x) and np.isfinite(squares).all() and 1e-20 < squares.max() < 1e24)


def nearest(told: pa.Table, batches, k: int, names: list[str], *, slim: bool = False):
    """The k rows of the batches nearest to each query of `told`, as batches of the columns `names`; slim: these are without the vectors.

    A matrix product bounds all distances of a block of rows from below, in single
    precision with as much slack as that needs; what passes is measured exactly.  The
    bounds are drawn tighter after as many rows as went before.
    """
    q = _matrix(told["query_vector"])
    own: dict = {}
    for c, name in enumerate(told["query_id"].to_pylist()):
        own.setdefault(name, []).append(c)
    length = _squares(q)
    single = _single(q, length)
    with np.errstate(over="ignore"):
        turned = {t: np.ascontiguousarray(-2 * q.T, t) for t in (np.float32, np.float64)}
    step, beginning = max(16, CELLS // 2 // len(q)), max(256, 8 * k)
    who, far, held, worst = np.zeros(0, np.int64), np.zeros(0), None, np.full(len(q), np.inf)
    seen, due, waiting = 0, 0, []

    def settle():
        nonlocal who, far, at_
        who, far, at_ = (np.concatenate([x, *more]) for x, more in zip((who, far, at_), zip(*waiting, strict=True), strict=True))
        waiting.clear()
        order = np.lexsort((number[at_], far, who))
        first = np.searchsorted(who[order], np.arange(len(q)))
        place = np.arange(len(order)) - first[who[order]]
        last = order[place == k - 1]
        worst[who[last]] = far[last]
        keep = order[place < k]
        who, far, at_ = who[keep], far[keep], at_[keep]

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index("id"))
        names_ = ids.to_pylist()
        x = _matrix(batch.column(batch.schema.get_field_index("vector")))
        squares = _squares(x)
        table = pa.Table.from_batches([batch])
        table = table.drop_columns(["vector"]) if slim else table
        base = 0 if held is None else held.num_rows
        at_ = np.arange(base)  # where a row is: below `base` among those held, then in this batch
        number = ([] if held is None else held["id"].to_pylist()) + names_
        number = np.unique(np.asarray(number, np.int64 if pa.types.is_integer(ids.type) else object), return_inverse=True)[1]
        odd = np.flatnonzero(np.isneginf(squares)), np.flatnonzero(np.isneginf(length))

        def prepared(kind):
            slack, floor = ((x.shape[1] + 16) * 2.4e-7, 1e-28) if kind is np.float32 else (1e-12, 0.0)
            with np.errstate(invalid="ignore", over="ignore"):
                return kind, slack, floor, x.astype(kind), (squares * (1 - slack) - floor).astype(kind), length * (1 - slack)

        kind, slack, floor, rows, less, below = prepared(np.float32 if single and _single(x, squares) else np.float64)
        upto, size = 0, 0
        while upto < len(x):
            lo, upto = upto, min(upto + (step if seen else beginning), len(x))
            with np.errstate(invalid="ignore", over="ignore"):
                near = rows[lo:upto] @ turned[kind]
                near += less[lo:upto, None]  # with `below`, less than the distance, whatever was rounded
            if kind is np.float64 and (len(odd[0]) or len(odd[1])):
                near[np.isneginf(squares[lo:upto])] = -np.inf
                near[:, odd[1]] = -np.inf
            for r, name in enumerate(names_[lo:upto]):
                if name in own:
                    near[r, own[name]] = np.inf
            bound = worst
            if upto - lo > 4 * k and np.isinf(worst).any():
                with np.errstate(invalid="ignore"):
                    reach = np.partition(near, k - 1, axis=0)[k - 1] + below
                    reach = reach + 4 * slack * (np.abs(length) + np.abs(squares[lo:upto]).max()) + 2 * floor
                bound = np.minimum(worst, np.where(np.isnan(reach) | np.isneginf(reach), np.inf, reach))
            with np.errstate(invalid="ignore", over="ignore"):
                limit = (bound - below).astype(kind)
            hit = np.flatnonzero(((near <= limit[None]) & (near < np.inf) if np.isinf(limit).any() else near <= limit[None]).ravel())
            if kind is np.float32 and len(hit) > near.size // 16 and near.size > EXACT:  # far from 0 and close together: too much slack
                single, upto = False, lo
                kind, slack, floor, rows, less, below = prepared(np.float64)
                continue
            for at in range(0, len(hit), EXACT):
                r, c = np.divmod(hit[at : at + EXACT], len(q))
                d2 = ((x[lo + r] - q[c]) ** 2).sum(axis=1)
                ok = (d2 <= worst[c]) & (d2 < np.inf)
                if ok.any():
                    waiting.append((c[ok], d2[ok], r[ok] + lo + base))
                    size += int(ok.sum())
                if size > HELD:
                    settle()
                    size = 0
            seen += upto - lo
            if seen >= due or upto == len(x):
                due = seen + min(seen, QUERY_BLOCK)
                if waiting:
                    settle()
                    size = 0
        if len(at_):
            held = (table if held is None else pa.concat_tables([held, table])).take(pa.array(at_))
    if held is not None:
        told = told.drop_columns(["query_vector"]) if slim else told
        for lo in range(0, len(who), 1 << 13):
            side = told.take(pa.array(who[lo : lo + (1 << 13)]))
            out = held.slice(lo, 1 << 13)
            yield from pa.table([*out.columns, *side.columns, pa.array(far[lo : lo + (1 << 13)])], names=names).combine_chunks().to_batches()


def neighbours(queries: DataFrame, train: DataFrame, k: int, *, block: int = QUERY_BLOCK, slim: bool = False) -> DataFrame:
    """train's and queries' columns, d2 and rank: the k rows (id, vector) nearest to each query (query_id, query_vector); ties by id.  slim: without the vectors.

    Rows with the query's id are left out, and so are null ids and vectors.  Queries
    are a stated set, taken in blocks against all rows: a task keeps its k best of each
    query and only these are shuffled; a block is written before the next one.  Within
    a task a matrix product bounds all distances from below, and those that may be
    among the k best are measured exactly; a strip of rows is settled before the next.
    """
    spark = train.sparkSession
    asked = queries.where("query_id is not null and query_vector is not null")
    rows = kept(train.where("id is not null and vector is not null").repartition(max(2, spark.sparkContext.defaultParallelism)))
    sides = [f for side, vector in ((train, "vector"), (queries, "query_vector")) for f in side.schema if not slim or f.name != vector]
    kind = T.StructType([*sides, T.StructField("d2", T.DoubleType())])
    names = [f.name for f in kind]

    path, empty = shared_folder(spark), True
    blocks = max(1, -(-asked.count() * 5 // (block * 4)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "id")).cast("long")
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        for lo in range(0, part.num_rows, block):
            at = spark.sparkContext.broadcast(part.slice(lo, block).combine_chunks())
            rows.mapInArrow(lambda batches, at=at: nearest(at.value, batches, k, names, slim=slim), kind).withColumn("rank", rank).where(F.col("rank") <= k).write.mode("append").parquet(path)
            at.unpersist()
            empty = False
    final = T.StructType([*kind, T.StructField("rank", T.LongType())])
    return spark.createDataFrame([], final) if empty else spark.read.schema(final).parquet(path)


def knn_vote(near: DataFrame, label: str) -> DataFrame:
    """Majority label of each query; ties to the smaller sum of distances, then to the smaller label."""
    votes = near.groupBy("query_id", label).agg(F.count("*").alias("votes"), F.sum(F.sqrt("d2")).alias("far"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), "far", label))
    return votes.withColumn("n", best).where("n = 1").select("query_id", F.col(label).alias("predicted"), "votes")


def idw_projection(near: DataFrame, columns: list[str]) -> DataFrame:
    """Means of the neighbours' columns weighted by 1 / (distance + 1e-9); the nearest exact hit is copied."""
    hit = F.when(F.col("d2") < 1e-16, F.col("rank"))
    w = 1 / (F.sqrt("d2") + 1e-9)
    return near.withColumn("w", w).withColumn("hit", hit).groupBy("query_id").agg(*(F.coalesce(F.min_by(c, "hit").cast("double"), F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in columns))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("count"))


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs; 0 for a division by zero."""
    sides = F.array(F.struct(F.col(actual).alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p")))
    hits = df.select((F.col(actual) == F.col(predicted)).cast("int").alias("hit"), F.explode(sides).alias("s")).select("hit", "s.*")
    g = hits.groupBy("label").agg(F.sum("a").alias("support"), F.sum("p").alias("named"), F.sum(F.col("a") * F.col("hit")).alias("tp"))
    safe = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    g = g.withColumn("precision", safe(F.col("tp"), F.col("named"))).withColumn("recall", safe(F.col("tp"), F.col("support")))
    return g.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def scores(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """One row: accuracy, and macro-F1 over the declared labels; one that never occurs counts as 0."""
    m = class_metrics(df, actual, predicted)
    macro = m.where(F.col("label").isin(labels)).agg((F.coalesce(F.sum("f1"), F.lit(0.0)) / len(labels)).alias("macro_f1"))
    return df.agg(F.coalesce(F.avg((F.col(actual) == F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy")).crossJoin(F.broadcast(macro))


def random_baseline(df: DataFrame, label: str, seeds: int = 30) -> DataFrame:
    """(seed, accuracy) of labels drawn from the label shares, by a hash of row and seed: the same for every layout."""
    shares = df.groupBy(label).agg(F.count("*").alias("n"))
    total = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    cuts = shares.withColumn("upto", F.sum("n").over(total) / F.sum("n").over(Window.partitionBy())).agg(F.array_sort(F.collect_list(F.struct("upto", F.col(label).alias("drawn")))).alias("cuts"))
    row = df.crossJoin(F.broadcast(cuts)).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    u = F.pmod(F.xxhash64("seed", *df.columns), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.filter("cuts", lambda c: c["upto"] > u)[0]["drawn"]
    return row.withColumn("hit", (drawn == F.col(label)).cast("double")).groupBy("seed").agg(F.avg("hit").alias("accuracy")).withColumn("seed", F.col("seed").cast("long"))


def cluster_labels(df: DataFrame, cluster: str, label: str, order: list[str] | None = None, fallback: str | None = None) -> DataFrame:
    """(cluster, label): each cluster's commonest label; ties by place in `order`, else by the alphabet; null labels become the fallback."""
    n = df.where(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count("*").alias("n"))
    place = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in order)), F.col(label)), F.lit(0)) if order else F.lit(0)
    best = n.groupBy(cluster).agg(F.min_by(label, F.struct(-F.col("n"), place, F.col(label))).alias("mapped"))
    every = df.select(cluster).distinct().join(best, cluster, "left")
    return every.select(cluster, F.coalesce("mapped", F.lit(fallback)).alias("label"))


def ranked_configurations(results: DataFrame) -> DataFrame:
    """Configurations with their place: macro-F1, then accuracy, downwards, then BIC and k upwards."""
    return results.withColumn("place", F.row_number().over(Window.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "bic", "k")).cast("long"))


def rank_penalty(near_a: DataFrame, near_b: DataFrame, ranks_b: DataFrame, k: int, n: int) -> DataFrame:
    """1 less the summed ranks, beyond k, that neighbours in space a have in space b: trustworthiness with a the map, continuity with a the data.

    near_a, near_b: (query_id, id) of the k nearest; ranks_b: (query_id, id, rank) of all.
    """
    if 2 * n - 3 * k - 1 <= 0:
        raise ValueError("too few rows for so many neighbours")
    lost = near_a.select("query_id", "id").join(near_b.select("query_id", "id"), ["query_id", "id"], "left_anti").join(ranks_b, ["query_id", "id"])
    score = 1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * F.coalesce(F.sum(F.col("rank") - k), F.lit(0))
    return lost.agg(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)).alias("score"))


def embedding_verdict(trust: Column, continuity: Column) -> Column:
    low = F.least(trust, continuity)
    return F.when(low >= 0.95, "EXCELLENT").when(low >= 0.90, "GOOD").when(low >= 0.80, "FAIR").otherwise("POOR")


def nearest_rank(df: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """(share, value): the value at place floor(share * (n - 1)) in order, not interpolated; equal values are counted first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("feature", F.lit(column))
    found = at_places(counted, {f"v{i}": F.floor(F.lit(s) * (F.col("total") - 1)) for i, s in enumerate(shares)})
    return found.select(F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.col(f"v{i}").alias("value")) for i, s in enumerate(shares)))).alias("x")).select("x.*")


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to 0 to 1 by their extremes; 0 where they are equal."""
    fit = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("l", F.min), ("h", F.max))))
    z = {c: F.when(F.col(f"h_{c}") > F.col(f"l_{c}"), (F.col(c) - F.col(f"l_{c}")) / (F.col(f"h_{c}") - F.col(f"l_{c}"))).otherwise(0.0) for c in columns}
    return df.crossJoin(F.broadcast(fit)).select(*(z[c].alias(c) if c in z else F.col(c) for c in df.columns))


def zero_rule(df: DataFrame, label: str) -> DataFrame:
    """The commonest label; ties to the smallest."""
    return df.groupBy(label).agg(F.count("*").alias("count")).orderBy(F.desc("count"), label).limit(1)


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, and the shares that round half up to the actual value, and to within one of it."""
    e = F.col(predicted) - F.col(actual)
    whole = F.floor(F.col(predicted) + 0.5) - F.col(actual)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((whole == 0).cast("double")).alias("exact"), F.avg((F.abs(whole) <= 1).cast("double")).alias("within_1"))


def log_density(x: Column, mean: Column, var: Column) -> Column:
    """Of a diagonal Gaussian, with variances of at least 1e-15."""
    floor = lambda v: F.greatest(v, F.lit(1e-15))
    parts = F.zip_with(F.zip_with(x, mean, lambda a, m: (a - m) * (a - m)), var, lambda d, v: -0.5 * (math.log(2 * math.pi) + F.ln(floor(v)) + d / floor(v)))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def log_sum_exp(x: Column) -> Column:
    return F.array_max(x) + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max(x))))


def with_densities(rows: DataFrame, components: DataFrame) -> DataFrame:
    """rows (vector, ...) with `parts`, (component, l) by component, and `total`, the log of the mixture's density: one expression a row, no shuffle."""
    packed = components.agg(F.array_sort(F.collect_list(F.struct("component", "weight", "mean", "var"))).alias("_c"))  # few components
    each = rows.crossJoin(F.broadcast(packed)).withColumn("parts", F.transform("_c", lambda c: F.struct(c["component"].alias("component"), (F.ln(c["weight"]) + log_density(F.col("vector"), c["mean"], c["var"])).alias("l"))))
    return each.withColumn("total", log_sum_exp(F.transform("parts", lambda p: p["l"]))).drop("_c")


def responsibilities(rows: DataFrame, components: DataFrame) -> DataFrame:
    """rows with a row per component: component and r, its share of the row; components: (component, weight, mean, var)."""
    return with_densities(rows, components).withColumn("p", F.explode("parts")).select(*rows.columns, F.col("p.component").alias("component"), F.exp(F.col("p.l") - F.col("total")).alias("r"))


def mixture_score(rows: DataFrame, components: DataFrame) -> DataFrame:
    """One row: log-likelihood, BIC with (k - 1) + 2 k d parameters, and the number of rows."""
    size = components.agg(F.count("*").alias("k"), F.max(F.size("mean")).alias("d"))
    total = with_densities(rows, components).agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("log_likelihood"), F.count("*").alias("n"))
    return total.crossJoin(F.broadcast(size)).select("log_likelihood", ((F.col("k") - 1 + 2 * F.col("k") * F.col("d")) * F.ln(F.greatest("n", F.lit(1))) - 2 * F.col("log_likelihood")).alias("bic"), "n")


def neighbour_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Mean share of neighbours that two neighbour tables have in common; one row."""
    sets = [t.groupBy("query_id").agg(F.collect_set("id").alias(n)) for t, n in ((a, "x"), (b, "y"))]
    return sets[0].join(sets[1], "query_id").agg(F.avg(F.size(F.array_intersect("x", "y")) / F.lit(k)).alias("preservation"))


def procrustes(points: DataFrame) -> DataFrame:
    """Disparity of 2-D points (ax, ay) and (bx, by) after centring, unit norm and the best rotation or reflection; from six sums."""
    centre = points.agg(*(F.avg(c).alias(f"m_{c}") for c in ("ax", "ay", "bx", "by")))
    p = points.crossJoin(F.broadcast(centre)).select(*((F.col(c) - F.col(f"m_{c}")).alias(c) for c in ("ax", "ay", "bx", "by")))
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    s = p.agg((dot("ax", "ax") + dot("ay", "ay")).alias("na"), (dot("bx", "bx") + dot("by", "by")).alias("nb"), dot("ax", "bx").alias("xx"), dot("ax", "by").alias("xy"), dot("ay", "bx").alias("yx"), dot("ay", "by").alias("yy"))
    turn = F.sqrt((F.col("xx") + F.col("yy")) ** 2 + (F.col("xy") - F.col("yx")) ** 2)
    flip = F.sqrt((F.col("xx") - F.col("yy")) ** 2 + (F.col("xy") + F.col("yx")) ** 2)
    best = F.greatest(turn, flip) / F.sqrt(F.col("na") * F.col("nb"))
    return s.select((2 - 2 * best).alias("disparity"), F.greatest(F.least(best, F.lit(1.0)), F.lit(0.0)).alias("similarity"))


def hmm_counts(df: DataFrame, session: str, order: str, state: str, smoothing: float, states: list[str]) -> DataFrame:
    """(from_state, to_state, probability) with additive smoothing over all declared states."""
    nxt = F.lead(state).over(Window.partitionBy(session).orderBy(order))
    seen = df.select(F.col(state).cast("string").alias("from_state"), nxt.cast("string").alias("to_state")).where("to_state is not null").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in states for b in states], "from_state string, to_state string")
    full = grid.join(seen, ["from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.lit(smoothing))
    return full.select("from_state", "to_state", (F.col("n") / F.sum("n").over(Window.partitionBy("from_state"))).alias("probability"))
