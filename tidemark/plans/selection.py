"""Queries of model selection, calibration, trees and the forecaster; none of them can be told in SQL, tests hold them against loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import forecast, models, pairs, selection, trees, validation
from tidemark.operators import features as X
from tidemark.plans import market as M
from tidemark.plans import tables as T
from tidemark.sources.files import kept

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


@query("model_selection")
def _(spark, sf_dir):
    """Five families and two baselines over three walk-forward folds of the labelled vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    part = F.pmod("vec_id", F.lit(4)).cast("int")
    rows = kept(e.select(F.col("vec_id").alias("id"), part.alias("part"), part.alias("sequence"), F.col("vec_id").alias("step"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("vector")))
    labels = [r["label"] for r in rows.select("label").where("label is not null").distinct().orderBy("label").collect()]
    return selection.select_models(rows, labels)


@query("seed_stability")
def _(spark, sf_dir):
    """How much the map of the vectors owes to its seed."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return pairs.seed_stability(e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vector")))


@query("dataset_issues")
def _(spark, sf_dir):
    """What the validator and the auditor find in the pivot table, by level and code."""
    table = kept(T.external_features(kept(M.bars_of(spark, sf_dir))))
    order = ["series_id", "pivot_id"]
    found = validation.validator_issues(table, order).unionByName(validation.causality_issues(table, order))
    return validation.issue_summary(found, order)


@query("calibration_trials")
def _(spark, sf_dir):
    """All thresholds and guards over the filtered states of the candle table."""
    names = ["return_1", "range_atr", "volatility_10", "slope_10", "distance_fvg_atr", "distance_ob_atr", "liquidity_imbalance"]
    c = T.candles(M.bars_of(spark, sf_dir))
    rows = kept(c.select(F.col("series_id").alias("sequence"), F.col("bar_idx").alias("step"), F.col("state_label").alias("state"), F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names)).alias("vector")))
    model = models.hmm_fit(rows, smoothing=0.5, floor=1e-2)
    post = models.posteriors(rows.select("sequence", "step", "vector"), model).join(rows.select("sequence", "step", F.col("state").alias("actual")), ["sequence", "step"])
    as_map = F.map_from_arrays(F.array(*(F.lit(s) for s in model["states"])), "posterior")
    trials = selection.calibration_trials(post.select("sequence", "step", "actual", as_map.alias("posterior")))
    best = selection.best_trial(trials)
    return spark.createDataFrame([(*(t[c] for c in _TRIAL), t is best) for t in trials], _TRIAL_KIND)


_TRIAL_KIND = "require_interaction boolean, expansion_threshold double, macro_f1 double, accuracy double, expansion_precision double, expansion_recall double, expansion_f1 double, is_best boolean"
_TRIAL = [c.split()[0] for c in _TRIAL_KIND.split(", ")][:-1]


@query("tree_importances")
def _(spark, sf_dir):
    """What a tree over all line items uses to tell their return flags, numbers and categories alike."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    labels = [r["l"] for r in rows.select(F.upper("l_returnflag").alias("l")).where("l is not null").distinct().orderBy("l").collect()]
    tree = trees.grow(rows, label="l_returnflag", labels=labels, numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], categorical=["l_linestatus"], max_depth=4)
    told = [(f, v, i + 1) for i, (f, v) in enumerate(tree.top_importances())]
    return spark.createDataFrame(told, "feature string, importance double, place long")


@query("ghost_forecast")
def _(spark, sf_dir):
    """Forecasts of the later half of the ghost events, by a model of the earlier half."""
    bars = kept(M.bars_of(spark, sf_dir))
    table = kept(X.ghost_table(T.external_features(bars), bars))
    half = table.groupBy("series_id").agg(F.percentile_approx("ghost_index", F.lit(0.5)).alias("_half"))
    rows = table.join(half, "series_id").withColumnsRenamed({"series_id": "sequence", "ghost_id": "step"})
    train, test = kept(rows.where(F.col("ghost_index") <= F.col("_half")).drop("_half")), rows.where(F.col("ghost_index") > F.col("_half")).drop("_half")
    return forecast.predict(test, forecast.fit(train, forecast.feature_columns(train.columns, ("sequence", "step"))))
