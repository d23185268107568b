"""Choosing among models: the harness of configurations and folds, and the search over calibration thresholds.

Rows of the harness: id, part (whole numbers from 0), sequence, step, label, vector.
Fold f trains on the parts before f and is judged on part f.  What comes to the driver
is counts of (actual, predicted), never rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import learning, models, trees
from tidemark.sources.files import kept

THRESHOLDS = tuple(x / 100 for x in (50, 55, 60, 65, 70, 75, 80, 85, 90, 92, 94, 95, 96, 97, 98, 99))
#: A result must be that much better to count as better.
TOLERANCE = 1e-12


def report(counts: dict[tuple[str, str], int], labels: list[str]) -> dict:
    """accuracy, macro_f1 over the declared labels, and per label precision, recall, f1 and support, from {(actual, predicted): n}; what has no denominator is 0."""
    total = sum(counts.values())
    per = {}
    for c in labels:
        hit = counts.get((c, c), 0)
        named = sum(n for (_, p), n in counts.items() if p == c)
        support = sum(n for (a, _), n in counts.items() if a == c)
        precision, recall = (hit / named if named else 0.0), (hit / support if support else 0.0)
        per[c] = {"precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0, "support": support}
    right = sum(n for (a, p), n in counts.items() if a == p)
    return {"accuracy": right / total if total else 0.0, "macro_f1": sum(x["f1"] for x in per.values()) / len(labels), "per_class": per}


# Calibration


def calibration_trials(rows: DataFrame, *, thresholds: tuple[float, ...] = THRESHOLDS, guards: tuple[bool, ...] = (False, True), demoted: str = "EXPANSION", needed: str = "INTERACTION") -> list[dict]:
    """A trial per (guard, threshold), in that order, of rows (sequence, step, actual, posterior map<string, double>): macro_f1, accuracy and the scores of `demoted`.

    A decision depends on the one before, in each configuration by itself: one ordered
    fold per sequence carries all configurations at once and gives only counts.
    Thresholds outside 0 to 1 are left out.
    """
    grid = [(bool(g), float(t)) for g in guards for t in thresholds if 0 <= t <= 1]
    if not grid:
        raise ValueError("no threshold lies in 0 to 1")
    guard, threshold = np.asarray([g for g, _ in grid]), np.asarray([t for _, t in grid])
    states = models.STATES

    def fold(part: pa.Table) -> pa.Table:
        part = part.sort_by("step")
        was = np.zeros(len(grid), bool)  # whether the decision before was `needed`
        counts: dict[tuple, np.ndarray] = {}
        for actual, own in zip(part["actual"].to_pylist(), part["posterior"].to_pylist(), strict=True):
            p = dict(own or ())
            ordered = sorted(states, key=lambda s: (-(p.get(s) or 0.0), states.index(s)))
            first, second = ordered[0], next(s for s in ordered if s != demoted)
            kept = (((p.get(demoted) or 0.0) >= threshold) & (~guard | was)) if first == demoted else np.ones(len(grid), bool)
            for name, who in ((first, kept), (second, ~kept)):
                if who.any():
                    counts.setdefault((actual, name), np.zeros(len(grid), np.int64))[who] += 1
            was = np.where(kept, first == needed, second == needed)
        out = [(int(c), a, name, int(n[c])) for (a, name), n in counts.items() for c in np.flatnonzero(n)]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["config", "actual", "predicted", "n"])

    found = rows.select("sequence", "step", "actual", "posterior").groupBy("sequence").applyInArrow(fold, "config long, actual string, predicted string, n long")
    counts: dict[int, dict] = {}
    for r in found.groupBy("config", "actual", "predicted").agg(F.sum("n").alias("n")).collect():  # states by states a configuration
        counts.setdefault(r["config"], {})[r["actual"], r["predicted"]] = r["n"]
    out = []
    for c, (g, t) in enumerate(grid):
        told = report(counts.get(c, {}), states)
        out.append({"expansion_threshold": t, "require_interaction": g, "macro_f1": told["macro_f1"], "accuracy": told["accuracy"], **{f"expansion_{k}": told["per_class"][demoted][k] for k in ("precision", "recall", "f1")}})
    return out


def best_trial(trials: list[dict]) -> dict:
    """By macro-F1, then the f1 of the demoted state, then accuracy; within TOLERANCE the first one stays."""
    best = trials[0]
    for trial in trials[1:]:
        for c in ("macro_f1", "expansion_f1", "accuracy"):
            if abs(trial[c] - best[c]) > TOLERANCE:
                best = trial if trial[c] > best[c] else best
                break
    return best


# The harness


def _scales(rows: DataFrame, folds: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Means and population deviations (1 where they are next to none) of the vectors before each fold; sums of parts, added up."""
    flat = rows.select("part", F.posexplode("vector").alias("i", "x")).groupBy("part", "i").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).collect()  # parts times dimensions
    d = 1 + max((r["i"] for r in flat), default=-1)
    out = {}
    for f in folds:
        sums = np.zeros((3, d))
        for r in flat:
            if r["part"] < f:
                sums[:, r["i"]] += (r["n"], r["s"], r["q"])
        n = np.maximum(sums[0], 1)
        sd = np.sqrt(np.maximum(sums[2] / n - (sums[1] / n) ** 2, 0))
        out[f] = sums[1] / n, np.where(sd < 1e-12, 1.0, sd)
    return out


def _scaled(rows: DataFrame, scale: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(*scale, strict=True)))
    return rows.withColumn("vector", F.zip_with("vector", pairs, lambda x, p: (x.cast("double") - p["m"]) / p["s"]))


def _counted(df: DataFrame, family: str, parameter, fold) -> DataFrame:
    return df.groupBy(F.lit(family).alias("family"), parameter.cast("double").alias("parameter"), F.lit(fold).alias("fold"), F.col("label").alias("actual"), "predicted").agg(F.count(F.lit(1)).alias("n"))


def baselines(rows: DataFrame, folds: list[int], labels: list[str], runs: int, seed: int) -> list[DataFrame]:
    """Counts of the commonest training label (ties by the alphabet), and of labels drawn from the training shares by a hash of run and id."""
    out = []
    for f in folds:
        shares = rows.where(F.col("part") < f).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        told = {r["label"]: r["n"] for r in shares.collect()}  # a row per label
        judged = rows.where(F.col("part") == f)
        top = min(told, key=lambda c: (-told[c], c))
        out.append(_counted(judged.withColumn("predicted", F.lit(top)), "zero_rule", F.lit(0), f))
        cuts, total, upto = F.lit(None).cast("string"), sum(told.values()), 0
        drawn = F.pmod(F.xxhash64("run", "id"), F.lit(1 << 40)) / float(1 << 40)
        for c in sorted(told):
            upto += told[c]
            cuts = F.coalesce(cuts, F.when(drawn < upto / total, F.lit(c)))
        each = judged.withColumn("run", F.explode(F.sequence(F.lit(seed), F.lit(seed + runs - 1))))
        out.append(_counted(each.withColumn("predicted", F.coalesce(cuts, F.lit(max(told)))), "random", F.col("run"), f))
    return out


def nearest_neighbours(rows: DataFrame, folds: list[int], ks: list[int], scales: dict) -> list[DataFrame]:
    """Counts for every k from one list of the largest k a fold; votes tie by the sum of distances, then by the label."""
    out = []
    for f in folds:
        scaled = _scaled(rows, scales[f])
        judged = kept(scaled.where(F.col("part") == f).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")))
        near = learning.neighbours(judged, scaled.where(F.col("part") < f).select("id", "vector", "label"), max(ks), block=2 * learning.QUERY_BLOCK, slim=True)
        every = near.select("query_id", "label", "d2", "rank", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k")).where("rank <= k")
        votes = every.groupBy("k", "query_id", "label").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.sqrt("d2")).alias("far"))
        said = votes.groupBy("k", "query_id").agg(F.min_by("label", F.struct(-F.col("votes"), "far", "label")).alias("predicted"))
        out.append(_counted(said.join(rows.select(F.col("id").alias("query_id"), "label"), "query_id"), "knn", F.col("k"), f))
    return out


def grown_trees(rows: DataFrame, folds: list[int], depths: list[int], labels: list[str], width: int) -> list[DataFrame]:
    """Counts for every depth from one tree a fold, grown side by side: a shallower tree is the beginning of a deeper one."""
    names = [f"x{i}" for i in range(width)]
    flat = kept(rows.select("part", "label", *(F.get("vector", F.lit(i)).alias(n) for i, n in enumerate(names))))
    number = F.explode(F.array(*(F.when(F.col("part") < f, F.lit(t)) for t, f in enumerate(folds)))).alias("_tree")
    grown = trees.grow_many(flat.select("*", number).where("_tree is not null"), len(folds), label="label", labels=labels, numeric=names, max_depth=max(depths))
    out = []
    for f, tree in zip(folds, grown, strict=True):
        said = F.array(*(F.struct(F.lit(d).alias("depth"), tree.predicted(d).alias("predicted")) for d in depths))
        judged = flat.where(F.col("part") == f).select("label", F.explode(said).alias("s")).select("label", "s.depth", "s.predicted")
        out.append(_counted(judged, "tree", F.col("depth"), f))
    return out


def mixtures(rows: DataFrame, folds: list[int], components: list[int], labels: list[str], scales: dict, *, iterations: int, seed: int) -> tuple[dict, dict]:
    """Counts {(k, fold): {(actual, predicted): n}} and BIC {(k, fold): value}: all mixtures fitted together, components named after their commonest training label (ties and strays by the order of the labels and their number)."""
    specs = [{"k": k, "seed": seed + f, "below": f, "centre": scales[f][0], "scale": scales[f][1], "fold": f} for k in components for f in folds]
    fitted = models.gmm_fit_many(rows, specs, iterations=iterations, floor=1e-3)
    at = rows.sparkSession.sparkContext.broadcast([{c: m[c] for c in ("weight", "mean", "var", "centre", "scale", "n")} | {"fold": s["fold"]} for m, s in zip(fitted, specs, strict=True)])

    def run(batches):
        counts: dict[tuple, int] = {}
        likely: dict[int, float] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part, label = batch.column(0).to_numpy(), np.asarray(batch.column(1).to_pylist(), dtype=object)
            x = np.asarray(batch.column(2).to_pylist(), np.float64)
            for m, model in enumerate(at.value):
                if not model["n"]:
                    continue
                some = part <= model["fold"]
                logs = models._logs((x[some] - model["centre"]) / model["scale"], model)
                train = part[some] < model["fold"]
                if train.any():
                    top = logs[train].max(axis=1)
                    likely[m] = likely.get(m, 0.0) + float((top + np.log(np.exp(logs[train] - top[:, None]).sum(axis=1))).sum())
                for t, c, own in zip(train.tolist(), logs.argmax(axis=1).tolist(), label[some].tolist(), strict=True):
                    counts[m, t, c, own] = counts.get((m, t, c, own), 0) + 1
        rows_ = [(m, t, c, own, n, 0.0) for (m, t, c, own), n in counts.items()] + [(m, True, -1, "", 0, v) for m, v in likely.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=["m", "train", "component", "label", "n", "likely"])

    told = rows.select("part", "label", F.transform("vector", lambda v: v.cast("double")).alias("vector")).mapInArrow(run, "m long, train boolean, component long, label string, n long, likely double")
    got = told.groupBy("m", "train", "component", "label").agg(F.sum("n").alias("n"), F.sum("likely").alias("likely")).collect()  # models by components by labels
    counts, bics = {}, {}
    place = {c: i for i, c in enumerate(labels)}
    for m, (model, spec) in enumerate(zip(fitted, specs, strict=True)):
        own = [r for r in got if r["m"] == m]
        total: dict[str, int] = {}
        named: dict[int, dict[str, int]] = {}
        for r in own:
            if r["train"] and r["component"] >= 0:
                total[r["label"]] = total.get(r["label"], 0) + r["n"]
                named.setdefault(r["component"], {})[r["label"]] = r["n"]
        stray = min(labels, key=lambda c: (-total.get(c, 0), place[c]))
        name = {c: min(labels, key=lambda x, n=n: (-n.get(x, 0), place[x])) for c, n in named.items()}
        key = spec["k"], spec["fold"]
        counts[key] = {}
        for r in own:
            if not r["train"]:
                pair = r["label"], name.get(r["component"], stray)
                counts[key][pair] = counts[key].get(pair, 0) + r["n"]
        likely = sum(r["likely"] for r in own if r["component"] == -1)
        bics[key] = models.bic(model, likely, model["n"]) if model["n"] else float("nan")
    return counts, bics


def state_models(rows: DataFrame, folds: list[int], smoothings: list[float], scales: dict) -> list[DataFrame]:
    """Counts of the filtered states for every smoothing: one table, so that all are decoded side by side."""
    out = []
    for f in folds:
        scaled = _scaled(rows, scales[f])
        train = kept(scaled.where(F.col("part") < f).select("sequence", "step", F.col("label").alias("state"), "vector"))
        judged = kept(scaled.where(F.col("part") == f).select("sequence", "step", "label", "vector"))
        for s, model in zip(smoothings, models.hmm_fit_many(train, smoothings, floor=1e-2), strict=True):
            said = models.decode(judged.select("sequence", "step", "vector"), model, how="filter")
            out.append(_counted(said.join(judged.select("sequence", "step", "label"), ["sequence", "step"]).withColumnRenamed("decoded", "predicted"), "hmm", F.lit(s), f))
    return [functools.reduce(DataFrame.unionByName, out)] if out else []


def select_models(rows: DataFrame, labels: list[str], *, ks=(3, 5, 7, 9, 11), depths=(2, 3, 4, 5), components=(2, 3, 4, 5), smoothings=(0.1, 0.5, 1.0, 2.0), runs: int = 30, seed: int = 42, iterations: int = 200) -> DataFrame:
    """(family, parameter, folds, accuracy, macro_f1, mean_accuracy, mean_macro_f1, mean_bic, place): five families and two baselines, every configuration over every fold.

    accuracy and macro_f1 are of the counts of all folds together, mean_* of the folds
    each; the random baseline is the mean over its runs.  place ranks a family's
    configurations: macro-F1, then accuracy, downwards, then BIC and parameter upwards.
    """
    rows = rows.where("part is not null and label is not null and vector is not null")
    parts = sorted(r["part"] for r in rows.select("part").distinct().collect())  # a row per fold
    folds = [f for f in parts if f > parts[0]]
    if not folds:
        raise ValueError("folds need two parts at least")
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    scales = _scales(rows, folds)
    counted = [*baselines(rows, folds, labels, runs, seed), *nearest_neighbours(rows, folds, list(ks), scales), *grown_trees(rows, folds, list(depths), labels, width), *state_models(rows, folds, list(smoothings), scales)]
    tables: dict[tuple, dict] = {}
    for df in counted:
        for r in df.collect():  # labels by labels a configuration and fold
            tables.setdefault((r["family"], r["parameter"], r["fold"]), {})[r["actual"], r["predicted"]] = r["n"]
    named, bics = mixtures(rows, folds, list(components), labels, scales, iterations=iterations, seed=seed)
    tables |= {("gmm", float(k), f): counts for (k, f), counts in named.items()}
    results = []
    for family, parameter in sorted({k[:2] for k in tables}):
        each = {f: tables[family, parameter, f] for f in folds if (family, parameter, f) in tables}
        pooled: dict = {}
        for counts in each.values():
            for pair, n in counts.items():
                pooled[pair] = pooled.get(pair, 0) + n
        told, own = report(pooled, labels), [report(c, labels) for c in each.values()]
        known = [bics[int(parameter), f] for f in each] if family == "gmm" else []
        results.append([family, parameter, len(each), told["accuracy"], told["macro_f1"], float(np.mean([r["accuracy"] for r in own])), float(np.mean([r["macro_f1"] for r in own])), float(np.mean(known)) if known else None])
    drawn = [r for r in results if r[0] == "random"]
    results = [r for r in results if r[0] != "random"]
    if drawn:
        results.append(["random", float(len(drawn)), drawn[0][2], *(float(np.mean([r[i] for r in drawn])) for i in range(3, 7)), None])
    table = rows.sparkSession.createDataFrame([tuple(r) for r in results], "family string, parameter double, folds long, accuracy double, macro_f1 double, mean_accuracy double, mean_macro_f1 double, mean_bic double")
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("macro_f1"), F.desc("accuracy"), F.asc_nulls_last("mean_bic"), "parameter"))
    return table.withColumn("place", place.cast("long"))
