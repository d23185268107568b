"""Models: mixtures by Spark iterations, state models per sequence, trees per configuration, and a map of few anchors.

Parameters are small (components by dimensions, states by states) and come to the
driver; rows never do, but for the bounded anchors of tsne().
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import learning
from tidemark.sources.files import kept


#: Rows that tree_grid() fits on and anchors that tsne() lays out, at most.
MAX_TREE_ROWS, MAX_ANCHORS = 20_000, 2_000


#: States in the order that breaks ties.
STATES = ["IDLE", "APPROACH", "INTERACTION", "EXPANSION"]


def class_components(rows: DataFrame, label: str, floor: float) -> DataFrame:
    """(component, weight, mean, var): one Gaussian per label of rows (label, vector)."""
    flat = rows.select(label, F.posexplode("vector").alias("i", "x"))
    by = flat.groupBy(label, "i").agg(F.avg("x").alias("m"), (F.var_pop("x") + floor).alias("v"), F.count("*").alias("n"))
    packed = by.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m", "v"))).alias("p"), F.max("n").alias("n"))
    total = rows.agg(F.count("*").alias("t"))
    return packed.crossJoin(F.broadcast(total)).select(F.col(label).alias("component"), (F.col("n") / F.col("t")).alias("weight"), F.col("p.m").alias("mean"), F.col("p.v").alias("var"))


def _logs(x: np.ndarray, model: dict) -> np.ndarray:
    """rows x components: log of weight times density."""
    out = np.empty((len(x), len(model["weight"])))
    for c in range(out.shape[1]):
        out[:, c] = np.log(model["weight"][c]) - 0.5 * (np.log(2 * np.pi * model["var"][c]) + (x - model["mean"][c]) ** 2 / model["var"][c]).sum(axis=1)
    return out


def gmm_fit_many(rows: DataFrame, specs: list[dict], *, iterations: int = 20, floor: float = 1e-6, tolerance: float = 1e-5) -> list[dict]:
    """Diagonal mixtures, one per spec, over rows (id, part, vector), all fitted by the same passes: a step is one aggregation for all of them.

    spec: k, seed, `below`: only rows with part < below count (None: all), and `centre`
    and `scale`: vectors are taken less the centre and over the scale.  A task
    sums up responsibilities, values and squares of its rows for every component, so
    what is shuffled is a number per component and dimension, never rows.  Starts are
    the row whose hash with the seed is least and then always the row farthest from
    those taken, with equal weights and the global variance; a component that gets
    almost nothing starts anew at another row.  A model rests when its log-likelihood
    changes by no more than the tolerance.  Fewer rows than k make as many components.
    A model: k, n, weight, mean, var, log_likelihood, iterations, converged.
    """
    spark = rows.sparkSession
    data = rows.select("id", "part", F.transform("vector", lambda v: v.cast("double")).alias("vector"))

    def passed(work: dict, emit, kind: str) -> DataFrame:
        """One pass over the rows: emit(model number, ids, x, held state) adds up, for each model of `work`."""
        at = spark.sparkContext.broadcast(work)

        def run(batches):
            held: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                parts = batch.column(1).to_numpy(zero_copy_only=False)
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for m, model in at.value.items():
                    own = np.ones(len(x), bool) if model["below"] is None else parts < model["below"]
                    if own.any():
                        emit(held, m, model, (x[own] - model["centre"]) / model["scale"])
            for m, values in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), m)), pa.array(np.arange(len(values))), pa.array(values, pa.float64())], names=["m", "slot", "value"])

        return data.mapInArrow(run, kind)

    def added(held, m, values):
        held[m] = held[m] + values if m in held else values

    def summed(work: dict, emit) -> dict[int, np.ndarray]:
        got: dict[int, dict] = {}
        for r in passed(work, emit, "m long, slot long, value double").groupBy("m", "slot").agg(F.sum("value").alias("v")).collect():  # components times dimensions
            got.setdefault(r["m"], {})[r["slot"]] = r["v"]
        return {m: np.asarray([v[i] for i in range(len(v))]) for m, v in got.items()}

    def moments(held, m, model, x):
        added(held, m, np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]))

    models = {m: {"k": s["k"], "seed": s.get("seed", 42), "below": s.get("below"), "centre": np.asarray(s.get("centre", 0.0)), "scale": np.asarray(s.get("scale", 1.0))} for m, s in enumerate(specs)}
    told = summed(models, moments)
    for m, model in models.items():
        if m not in told:
            model |= {"n": 0, "weight": np.zeros(0), "mean": np.zeros((0, 0)), "var": np.zeros((0, 0)), "log_likelihood": None, "iterations": 0, "converged": True}
            continue
        n, d = int(told[m][0]), (len(told[m]) - 1) // 2
        centre = told[m][1 : 1 + d] / n
        model |= {"n": n, "k": min(model["k"], n), "wide": np.maximum(told[m][1 + d :] / n - centre**2, 0) + floor, "starts": [], "log_likelihood": None, "iterations": 0, "converged": False}
    live = {m: model for m, model in models.items() if model["n"]}

    def row_at(m: int, seed: int) -> np.ndarray:
        own = data if models[m]["below"] is None else data.where(F.col("part") < models[m]["below"])
        row = own.agg(F.min_by("vector", F.struct(F.xxhash64(F.lit(seed), "id"), "id")).alias("v")).first()["v"]
        return (np.asarray(row) - models[m]["centre"]) / models[m]["scale"]

    for m, model in live.items():
        model["starts"] = [row_at(m, model["seed"])]

    def farthest(held, m, model, x):
        d2 = np.min([((x - s) ** 2).sum(axis=1) for s in model["starts"]], axis=0)
        best = np.flatnonzero(d2 == d2.max())
        k = best[np.lexsort(x[best].T[::-1])[0]]
        new = np.concatenate([[d2[k]], x[k]])
        old = held.get(m)
        if old is None or (new[0], *(-new[1:])) > (old[0], *(-old[1:])):
            held[m] = new

    while open_ := {m: model for m, model in live.items() if len(model["starts"]) < model["k"]}:
        best: dict[int, dict] = {}
        got = passed(open_, farthest, "m long, slot long, value double").groupBy("m", F.spark_partition_id().alias("task"))
        for r in got.agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("v")).collect():  # a row per model and task
            new = [v["value"] for v in r["v"]]
            key = (new[0], *(-v for v in new[1:]))
            if r["m"] not in best or key > best[r["m"]]["key"]:
                best[r["m"]] = {"key": key, "row": np.asarray(new[1:])}
        for m in open_:
            models[m]["starts"].append(best[m]["row"])
    for model in live.values():
        k = model["k"]
        model |= {"weight": np.full(k, 1.0 / k), "mean": np.asarray(model.pop("starts")), "var": np.tile(model["wide"], (k, 1))}

    def expected(held, m, model, x):
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            logs = _logs(part, model)
            top = logs.max(axis=1)
            total = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
            r = np.exp(logs - total[:, None])
            added(held, m, np.concatenate([[total.sum()], r.sum(axis=0), (r.T @ part).ravel(), (r.T @ part**2).ravel()]))

    for _ in range(iterations):
        open_ = {m: model for m, model in live.items() if not model["converged"]}
        if not open_:
            break
        for m, sums in summed({m: {c: model[c] for c in ("below", "centre", "scale", "weight", "mean", "var")} for m, model in open_.items()}, expected).items():
            model, k, d = models[m], models[m]["k"], models[m]["mean"].shape[1]
            before, model["log_likelihood"] = model["log_likelihood"], float(sums[0])
            model["iterations"] += 1
            each, s, q = sums[1 : 1 + k], sums[1 + k : 1 + k + k * d].reshape(k, d), sums[1 + k + k * d :].reshape(k, d)
            for c in range(k):
                if each[c] < 1e-8:
                    model["weight"][c], model["mean"][c], model["var"][c] = 1.0 / model["n"], row_at(m, model["seed"] + 997 * (c + 1)), model["wide"]
                else:
                    mean = s[c] / each[c]
                    model["weight"][c], model["mean"][c], model["var"][c] = each[c] / model["n"], mean, np.maximum(q[c] / each[c] - mean**2, 0) + floor
            if before is not None and abs(model["log_likelihood"] - before) <= tolerance * (1 + abs(model["log_likelihood"])):
                model["converged"] = True
    return [models[m] for m in range(len(specs))]


def gmm_fit(rows: DataFrame, k: int, *, iterations: int = 20, floor: float = 1e-6, tolerance: float = 1e-5, seed: int = 42) -> DataFrame:
    """(component, weight, mean, var) of one mixture over rows (id, vector): gmm_fit_many() with one spec; no rows make no components."""
    kind = "component int, weight double, mean array<double>, var array<double>"
    (model,) = gmm_fit_many(rows.select("id", F.lit(0).alias("part"), "vector"), [{"k": k, "seed": seed}], iterations=iterations, floor=floor, tolerance=tolerance)
    return rows.sparkSession.createDataFrame([(c, float(model["weight"][c]), model["mean"][c].tolist(), model["var"][c].tolist()) for c in range(len(model["weight"]))], kind)


def bic(model: dict, log_likelihood: float, n: int) -> float:
    """Of a diagonal mixture: fewer is better."""
    k, d = model["mean"].shape
    return (k - 1 + 2 * k * d) * float(np.log(n)) - 2 * log_likelihood


def hmm_fit(rows: DataFrame, smoothing: float = 1.0, floor: float = 1e-6) -> dict:
    """Initial and transition probabilities and Gaussians per state from labelled rows (sequence, step, state, vector); rows without a state do not count."""
    return hmm_fit_many(rows, [smoothing], floor)[0]


def hmm_fit_many(rows: DataFrame, smoothings: list[float], floor: float = 1e-6) -> list[dict]:
    """hmm_fit() for each smoothing, from the same counts."""
    from pyspark.sql import Window

    rows = rows.where("state is not null")
    w = Window.partitionBy("sequence").orderBy("step")
    seen = rows.withColumn("next", F.lead("state").over(w)).withColumn("first", F.row_number().over(w) == 1)
    states = sorted(r["state"] for r in rows.select("state").distinct().collect())  # the declared label set
    moves = {(r["state"], r["next"]): r["n"] for r in seen.where("next is not null").groupBy("state", "next").agg(F.count("*").alias("n")).collect()}
    starts = {r["state"]: r["n"] for r in seen.where("first").groupBy("state").agg(F.count("*").alias("n")).collect()}
    dense = class_components(rows.select("state", "vector"), "state", floor).collect()
    at = {r["component"]: r for r in dense}
    out = []
    for smoothing in smoothings:
        a = np.array([[moves.get((x, y), 0) + smoothing for y in states] for x in states])
        p = np.array([starts.get(x, 0) + smoothing for x in states], float)
        out.append({"states": states, "initial": np.log(p / p.sum()), "moves": np.log(a / a.sum(axis=1, keepdims=True)), "mean": np.array([at[x]["mean"] for x in states]), "var": np.array([at[x]["var"] for x in states])})
    return out


def _densities(x: np.ndarray, model: dict) -> np.ndarray:
    """rows x states: log densities."""
    out = np.empty((len(x), len(model["mean"])))
    for s, (mean, var) in enumerate(zip(model["mean"], model["var"], strict=True)):
        out[:, s] = -0.5 * (np.log(2 * np.pi * var) + (x - mean) ** 2 / var).sum(axis=1)
    return out


def _in_order(rows: DataFrame, more: str, make) -> DataFrame:
    """What folds give of rows (sequence, step, vector): make() begins one per sequence, feed(batch, x) takes its rows piece by piece in order of step, end() closes it.

    A sequence is one task's, but never held whole: a task holds a batch and what its fold keeps.
    """
    kind = f"sequence {rows.schema['sequence'].dataType.simpleString()}, {more}"

    def run(batches):
        at, fold = None, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if fold is None or names[lo] != at:
                    if fold is not None:
                        yield from fold.end()
                    at, fold = names[lo], make()
                part = batch.slice(lo, hi - lo)
                yield from fold.feed(part, learning._matrix(part.column(2)))
        if fold is not None:
            yield from fold.end()

    vector = F.transform("vector", lambda v: v.cast("double")).alias("vector")
    return rows.select("sequence", "step", vector).repartition("sequence").sortWithinPartitions("sequence", F.asc_nulls_last("step")).mapInArrow(run, kind)


class _Path:
    """The likeliest path: keeps a small number per step and state, and the steps."""

    def __init__(self, model: dict):
        self.model, self.alpha, self.back, self.rows = model, None, [], []

    def feed(self, batch: pa.RecordBatch, x: np.ndarray):
        density = _densities(x, self.model)
        back = np.zeros(density.shape, np.int16)
        for t, d in enumerate(density):
            if self.alpha is None:
                self.alpha = self.model["initial"] + d
                continue
            step = self.alpha[:, None] + self.model["moves"]
            back[t] = step.argmax(axis=0)
            self.alpha = step.max(axis=0) + d
        self.back.append(back)
        self.rows.append(batch.select([0, 1]))
        return ()

    def end(self):
        state, said = int(self.alpha.argmax()), []
        for back in reversed(self.back):
            own = np.empty(len(back), np.int64)
            for t in range(len(back) - 1, -1, -1):
                own[t], state = state, int(back[t, state])
            said.append(own)
        for rows, own in zip(self.rows, reversed(said), strict=True):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([self.model["states"][s] for s in own], pa.string())], names=["sequence", "step", "decoded"])


class _Filtered:
    """The filtered state of each step."""

    def __init__(self, model: dict):
        self.model, self.alpha = model, None

    def feed(self, batch: pa.RecordBatch, x: np.ndarray):
        best = []
        for d in _densities(x, self.model):
            if self.alpha is None:
                self.alpha = self.model["initial"] + d
            else:
                step = self.alpha[:, None] + self.model["moves"]
                top = step.max(axis=0)
                alpha = top + np.log(np.exp(step - top).sum(axis=0)) + d
                self.alpha = alpha - (alpha.max() + np.log(np.exp(alpha - alpha.max()).sum()))
            best.append(int(self.alpha.argmax()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([self.model["states"][s] for s in best], pa.string())], names=["sequence", "step", "decoded"])

    def end(self):
        return ()


class _Posterior:
    """The filtered probabilities of each step."""

    def __init__(self, model: dict):
        self.model, self.alpha = model, None

    def feed(self, batch: pa.RecordBatch, x: np.ndarray):
        out = np.empty((len(x), len(self.model["states"])))
        for t, d in enumerate(_densities(x, self.model)):
            alpha = self.model["initial"] + d if self.alpha is None else np.logaddexp.reduce(self.alpha[:, None] + self.model["moves"], axis=0) + d
            self.alpha = alpha - np.logaddexp.reduce(alpha)
            out[t] = np.exp(self.alpha)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(out), pa.list_(pa.float64()))], names=["sequence", "step", "posterior"])

    def end(self):
        return ()


class _Likelihood:
    """The log-likelihood of a sequence."""

    def __init__(self, model: dict):
        self.model, self.alpha = model, None

    def feed(self, batch: pa.RecordBatch, x: np.ndarray):
        self.own = batch.column(0).slice(0, 1)
        for d in _densities(x, self.model):
            if self.alpha is None:
                self.alpha = self.model["initial"] + d
            else:
                step = self.alpha[:, None] + self.model["moves"]
                top = step.max(axis=0)
                self.alpha = top + np.log(np.exp(step - top).sum(axis=0)) + d
        return ()

    def end(self):
        top = self.alpha.max()
        yield pa.RecordBatch.from_arrays([self.own, pa.array([float(top + np.log(np.exp(self.alpha - top).sum()))])], names=["sequence", "log_likelihood"])


def decode(rows: DataFrame, model: dict, *, how: str) -> DataFrame:
    """(sequence, step, decoded): Viterbi path, or the filtered state of each step; one ordered fold per sequence.

    Ties go to the earlier state of the model's order.
    """
    fold = _Path if how == "viterbi" else _Filtered
    return _in_order(rows, f"step {rows.schema['step'].dataType.simpleString()}, decoded string", lambda: fold(model))


def posteriors(rows: DataFrame, model: dict) -> DataFrame:
    """(sequence, step, posterior): the filtered probabilities of the model's states, an array in their order; one ordered fold per sequence."""
    return _in_order(rows, f"step {rows.schema['step'].dataType.simpleString()}, posterior array<double>", lambda: _Posterior(model))


def grow(x: np.ndarray, y: np.ndarray, depth: int, min_split: int = 10, min_leaf: int = 5):
    """A Gini tree as nested tuples (feature, threshold, low, high) with class numbers as leaves; ties to the smaller feature, then threshold."""
    counts = np.bincount(y)
    if depth == 0 or len(y) < min_split or (counts > 0).sum() == 1:
        return int(counts.argmax())
    gini = lambda c: 1 - ((c / c.sum(axis=-1, keepdims=True)) ** 2).sum(axis=-1)
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        left = np.cumsum(np.eye(len(counts))[y[order]], axis=0)[:-1]
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= min_leaf) & (len(y) - n >= min_leaf)
        if ok.any():
            gain = gini(counts.astype(float)) - (n * gini(left) + (len(y) - n) * gini(counts - left)) / len(y)
            gain[~ok] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, (v[k] + v[k + 1]) / 2)
    if best[1] is None:
        return int(counts.argmax())
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, min_split, min_leaf), grow(x[~low], y[~low], depth - 1, min_split, min_leaf)


def hmm_score(rows: DataFrame, model: dict) -> DataFrame:
    """(sequence, log_likelihood) of rows (sequence, step, vector): one ordered fold per sequence."""
    return _in_order(rows, "log_likelihood double", lambda: _Likelihood(model))


def calibrated(rows: DataFrame, *, threshold: float, guard: bool, demoted: str = "EXPANSION", needed: str = "INTERACTION") -> DataFrame:
    """(sequence, step, decided) of rows (sequence, step, posterior map<string, double>).

    The likeliest state, ties to the order of STATES; `demoted` gives way to the next one if
    its probability is below the threshold, or if guarded and the state decided before
    is not `needed`.  It depends on its own output: one ordered fold per sequence.
    """
    kind = f"sequence {rows.schema['sequence'].dataType.simpleString()}, step {rows.schema['step'].dataType.simpleString()}, decided string"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part, before, out = part.sort_values("step"), None, []
        for own in part["posterior"]:
            best = sorted(dict(own).items(), key=lambda x: (-x[1], STATES.index(x[0]) if x[0] in STATES else len(STATES), x[0]))
            if best[0][0] == demoted and len(best) > 1 and (best[0][1] < threshold or (guard and before != needed)):
                best = best[1:]
            before = best[0][0]
            out.append(before)
        return pd.DataFrame({"sequence": part["sequence"].to_numpy(), "step": part["step"].to_numpy(), "decided": out})

    return rows.groupBy("sequence").applyInPandas(fold, kind)


def tree_grid(rows: DataFrame, depths: tuple[int, ...], folds: int = 3, sample: int = MAX_TREE_ROWS) -> DataFrame:
    """(depth, fold, accuracy, rows): trees fitted on a bounded sample of the other folds, a task per configuration, and held against every row of their fold.

    A row's fold follows from a hash of the row.
    """
    spark = rows.sparkSession
    dealt = rows.select("label", "vector").withColumn("h", F.xxhash64("vector", "label")).withColumn("held", F.pmod("h", F.lit(folds)).cast("int"))
    few = dealt.orderBy("h", "label").limit(sample)
    grid = few.select("*", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.lit(f).alias("fold")) for d in depths for f in range(folds)))).alias("c")).select("label", "vector", "h", "held", "c.*").where("held <> fold")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "label"])
        names, y = np.unique(part["label"].to_numpy(), return_inverse=True)
        tree = grow(np.stack(part["vector"].to_numpy()), y, int(part["depth"].iloc[0]))
        return pd.DataFrame({"depth": part["depth"].iloc[:1], "fold": part["fold"].iloc[:1], "tree": [json.dumps([names.tolist(), tree])]})

    trees = [(r["depth"], r["fold"], *json.loads(r["tree"])) for r in grid.groupBy("depth", "fold").applyInPandas(fit, "depth int, fold int, tree string").collect()]  # a row per configuration
    at = spark.sparkContext.broadcast(trees)

    def judge(batches):
        for pdf in batches:
            v, label, held = (np.stack(pdf["vector"].to_numpy()) if len(pdf) else None), pdf["label"].to_numpy(), pdf["held"].to_numpy()
            out = []
            for depth, fold, names, tree in at.value:
                own = np.flatnonzero(held == fold)
                if len(own):
                    out.append((depth, fold, int((np.asarray(names, object)[said(tree, v[own])] == label[own]).sum()), len(own)))
            yield pd.DataFrame(out, columns=["depth", "fold", "right", "rows"])

    told = dealt.select("label", "vector", "held").mapInPandas(judge, "depth int, fold int, right long, rows long")
    return told.groupBy("depth", "fold").agg((F.sum("right") / F.sum("rows")).alias("accuracy"), F.sum("rows").alias("rows"))


def said(tree, x: np.ndarray) -> np.ndarray:
    """Class numbers that a tree of grow() gives the rows of x."""
    if not isinstance(tree, (tuple, list)):
        return np.full(len(x), tree, np.int64)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), np.int64)
    out[low], out[~low] = said(tree[2], x[low]), said(tree[3], x[~low])
    return out


def evenly_spaced(rows: DataFrame, m: int, key: str = "id") -> DataFrame:
    """Rows at places round(j (n - 1) / (m - 1)) in the order of the key; counted per range, so nothing is sorted in one task.

    Ranges are sampled anew whenever they are made, so the numbered rows are written once.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = kept(rows.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row per range
    n, before, starts = sum(counts.values()), 0, {}
    for p in sorted(counts):
        starts[p], before = before, before + counts[p]
    places = sorted({int(np.floor(j * (n - 1) / max(1, m - 1) + 0.5)) for j in range(min(m, n))}) if n else []
    wanted = [(int(p) << 33) + x - s for p, s in starts.items() for x in places if s <= x < s + counts[p]]
    return placed.where(F.col("_m").isin(wanted) if wanted else F.lit(False)).drop("_m")


def affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric joint probabilities with each row's bandwidth searched for the perplexity."""
    n = len(d2)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        d = np.delete(d2[i], i)
        for _ in range(60):
            e = np.exp(-np.minimum((d - d.min()) * beta, 700))
            q = e / e.sum()
            gap = -(q * np.log(np.maximum(q, 1e-300))).sum() - np.log(perplexity)
            if abs(gap) < 1e-5:
                break
            lo, hi = (beta, hi) if gap > 0 else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    return p / p.sum()


def normals(n: int, seed: int) -> np.ndarray:
    """n normal numbers by Box-Muller (the cosine half) from a linear congruential generator of 31 bits."""
    state, out = int(seed) & 0x7FFFFFFF or 1, []
    for _ in range(2 * n):
        state = (1103515245 * state + 12345) % 2147483648  # fixed values of the generator
        out.append(state / 2147483648.0)
    u1, u2 = np.asarray(out[::2]), np.asarray(out[1::2])
    return np.sqrt(-2 * np.log(np.maximum(u1, 1e-12))) * np.cos(2 * 3.141592653589793 * u2)


def layout(p: np.ndarray, iterations: int, rate: float = 200.0, seed: int = 42, *, early: int = 250, exaggeration: float = 12.0, calm: int = 50) -> tuple[np.ndarray, float]:
    """2-D coordinates by gradient descent with gains, and the divergence before the last step.

    The first `early` steps exaggerate the affinities.  As they end, velocities fall to
    a quarter; momentum is 0.5 for `calm` steps more, then 0.8.  A gain shrinks where
    gradient and velocity agree in sign, and grows otherwise.
    """
    n = len(p)
    y = normals(2 * n, seed).reshape(n, 2) * 1e-4
    velocity, gains, divergence = np.zeros_like(y), np.ones_like(y), 0.0
    for t in range(iterations):
        num = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
        np.fill_diagonal(num, 0)
        q = np.maximum(num / max(num.sum(), 1e-12), 1e-12)
        w = ((exaggeration if t < early else 1.0) * p - q) * num
        gradient = 4 * (w.sum(axis=1)[:, None] * y - w @ y)
        if t == early:
            velocity *= 0.25
        gains = np.maximum(np.where(gradient * velocity > 0, gains * 0.8, gains + 0.2), 0.01)
        velocity = (0.5 if t < early + calm else 0.8) * velocity - rate * gains * gradient
        y = y + velocity
        y = y - y.mean(axis=0)
        if t == iterations - 1:
            off = ~np.eye(n, dtype=bool) & (p > 0)
            divergence = float((p[off] * np.log(p[off] / q[off])).sum())
    return y, divergence


def fit_maps(rows: DataFrame, seeds: list[int], *, anchors: int = 90, perplexity: float = 25, iterations: int = 300) -> list[dict] | None:
    """A map per seed of the same anchors: x, their places y, the perplexity that was used and the divergence; None for fewer than three rows (id, vector).

    The anchors, evenly spaced by id, are a bounded sample that one process lays out.
    """
    if anchors > MAX_ANCHORS:
        raise ValueError(f"at most {MAX_ANCHORS} anchors are laid out")
    few = evenly_spaced(rows, anchors).orderBy("id").collect()
    if len(few) < 3:
        return None
    x = np.array([r["vector"] for r in few], np.float64)
    d2 = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0)
    used = max(2.0, min(perplexity, int((len(few) - 1) / 3)))
    p = affinities(d2, used)
    laid = [layout(p, iterations, seed=seed) for seed in seeds]
    return [{"x": x, "y": y, "perplexity": used, "divergence": divergence} for y, divergence in laid]


def fit_map(rows: DataFrame, *, anchors: int = 90, perplexity: float = 25, iterations: int = 300, seed: int = 42) -> dict | None:
    """fit_maps() of one seed."""
    fitted = fit_maps(rows, [seed], anchors=anchors, perplexity=perplexity, iterations=iterations)
    return fitted[0] if fitted else None


def places(v: np.ndarray, x: np.ndarray, maps: list[np.ndarray], k: int = 8) -> list[np.ndarray]:
    """Of vectors on each map: by the k nearest anchors, weighted by 1 / distance; the place of an anchor that it equals."""
    m = min(k, len(x))
    out = [np.zeros((len(v), 2)) for _ in maps]
    for lo in range(0, len(v), 256):
        far = ((v[lo : lo + 256, None] - x[None]) ** 2).sum(axis=2)
        near = np.argsort(far, axis=1, kind="stable")[:, :m]
        d = np.take_along_axis(far, near, axis=1)
        w = np.where(d[:, :1] < 1e-16, np.arange(m) == 0, 1 / (np.sqrt(d) + 1e-9))
        for own, y in zip(out, maps, strict=True):
            own[lo : lo + 256] = (w[:, :, None] * y[near]).sum(axis=1) / w.sum(axis=1, keepdims=True)
    return out


def placed(rows: DataFrame, fitted: dict | None, k: int = 8) -> DataFrame:
    """(id, x, y): every row at its place on the map, see places()."""
    kind = f"id {rows.schema['id'].dataType.simpleString()}, x double, y double"
    if fitted is None:
        return rows.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    at = rows.sparkSession.sparkContext.broadcast((fitted["x"], fitted["y"]))

    def place(batches):
        ax, ay = at.value
        for pdf in batches:
            v = np.stack(pdf["vector"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, ax.shape[1]))
            (out,) = places(v, ax, [ay], k)
            yield pd.DataFrame({"id": pdf["id"], "x": out[:, 0], "y": out[:, 1]})

    return rows.select("id", "vector").mapInPandas(place, kind)


def placed_together(rows: DataFrame, fitted: list[dict] | None, names: list[str], most: int) -> DataFrame:
    """(key, ids, weight, an array of x and y per name): the rows that share their places on all maps of the same anchors, with their number and their least ids, `most` at most; key is the least.

    Rows with a null id or vector are left out.  A batch settles its own groups before they are shuffled.
    """
    id_ = rows.schema["id"].dataType.simpleString()
    kind = ", ".join([f"ids array<{id_}>, weight long", *(f"`{c}` array<double>" for c in names)])
    at = rows.sparkSession.sparkContext.broadcast((fitted[0]["x"], [m["y"] for m in fitted]) if fitted else None)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = learning._matrix(batch.column(1)), batch.column(0)
            p = np.concatenate(places(v, *at.value), axis=1) if at.value else np.zeros((len(v), 2 * len(names)))
            p, who = np.unique(p + 0.0, axis=0, return_inverse=True)
            who = who.ravel()
            order = np.lexsort((np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1], who))
            first = np.searchsorted(who[order], np.arange(len(p) + 1))
            own = order[np.arange(len(order)) - first[who[order]] < most]
            upto = np.searchsorted(who[own], np.arange(len(p) + 1))
            pairs = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(p[:, 2 * i : 2 * i + 2]).ravel()), 2).cast(pa.list_(pa.float64())) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(upto, pa.int32()), ids.take(pa.array(own))), pa.array(np.diff(first)), *pairs], names=["ids", "weight", *names])

    some = rows.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(place, kind)
    ids = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, most)
    return some.groupBy(*names).agg(ids.alias("ids"), F.sum("weight").alias("weight")).select(F.col("ids")[0].alias("key"), "ids", "weight", *names)


def tsne(rows: DataFrame, *, anchors: int = 90, perplexity: float = 25, iterations: int = 300) -> DataFrame:
    """(id, x, y): a map of few anchors, with all other rows placed by their nearest anchors."""
    return placed(rows, fit_map(rows, anchors=anchors, perplexity=perplexity, iterations=iterations))
