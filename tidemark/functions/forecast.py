"""A forecaster of how many new extremes follow an event: a map, states along it, a mixture over both, and a blend.

Stages feed each other: vectors of all features, placed on a map of few anchors; a
state model over the map, whose states are terciles of the longest target; a mixture
over place, filtered probabilities and chosen features, its size picked by BIC; means
of the targets by state and by component (weighted by responsibility).  Rows stay in
Spark; what the driver holds is parameters, the bounded anchors and sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import learning, models
from tidemark.sources.files import kept

STATES = ["QUIET", "ACTIVE", "INTENSE"]
HORIZONS = (3, 5, 10, 15)
#: Features that the mixture sees beside map and states, those of them that there are.
MIXED = """range_atr_ratio tf_1_volume_ratio_ema9 body_atr_ratio volume_ratio_20 volume_zscore_20 candle_direction tf_60_volume_ratio_ema9 active_ssl_count pivot_body sr_weekly_resistance_pips
tf_10_channel_lower_touches tf_60_channel_lower_touches tf_60_volume_ema9 equal_levels_previous_100 tf_60_channel_upper_touches close_position pivot_range near_equal_level sr_daily_resistance_pips
last_structure_event sr_weekly_support_pips tf_1_channel_lower_touches bars_since_ob active_fvg_count_50 active_bsl_count tf_1_channel_upper_touches bars_since_structure_event
price_to_confirm_close ob_invalidated tf_10_volume_ratio_ema9 tf_10_atr_pips tf_60_atr_pips tf_1_atr_pips distance_nearest_bsl_pips distance_nearest_ssl_pips distance_fvg_pips distance_ob_pips liquidity_imbalance_100 swing_size_atr""".split()


# What a ghost row holds beside its features, and prices that do not carry over to another month.
BESIDE = """dataset_date source_file symbol timeframe ghost_id ghost_index ghost_timestamp ghost_price_mid ghost_definition pivot_id pivot_index confirmation_index pivot_timestamp confirmation_timestamp
legacy_liquidity_target liquidity_state swept_index resolved_index source""".split()
PRICES = "pivot_open pivot_high pivot_low pivot_close pivot_price confirm_open confirm_high confirm_low confirm_close previous_pivot_price".split()


def feature_columns(columns: list[str], beside: tuple[str, ...] = ()) -> list[str]:
    """The features among the columns of a ghost table, sorted: no targets, times, places, absolute prices, nor `beside`."""
    out = {*BESIDE, *PRICES, *beside}
    own = sorted(c for c in columns if c not in out and not c.startswith("target_") and not c.endswith(("timestamp", "_index")))
    if not own:
        raise ValueError("no features are left")
    return own


def encoder(rows: DataFrame, columns: list[str]) -> dict:
    """Means and population deviations of number columns (missing ones count as 0; deviations next to none as 1), and the sorted categories of the others."""
    kinds = dict(rows.dtypes)
    numbers = sorted(c for c in columns if kinds[c] not in ("string", "boolean"))
    words = sorted(c for c in columns if kinds[c] in ("string", "boolean"))
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
    told = rows.agg(F.count(F.lit(1)).alias("n"), *(f(value(c)).alias(f"{n}_{c}") for c in numbers for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    seen: dict[str, list[str]] = {c: [] for c in words}
    if words:
        flat = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")) for c in words))).alias("x")).select("x.*").distinct()
        for r in flat.orderBy("c", "v").collect():  # a row per category
            seen[r["c"]].append(r["v"])
    return {"numbers": {c: ((told[f"m_{c}"] or 0.0), (told[f"s_{c}"] or 0.0) if (told[f"s_{c}"] or 0.0) >= 1e-12 else 1.0) for c in numbers}, "words": seen}


def encoded(spec: dict) -> Column:
    """The vector of a row: scaled numbers, then a 0 or 1 per category; unseen ones are all 0."""
    out = [(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) - F.lit(float(m))) / F.lit(float(s)) for c, (m, s) in spec["numbers"].items()]
    out += [(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) == v).cast("double") for c, own in spec["words"].items() for v in own]
    return F.array(*out)


def thresholds(rows: DataFrame, target: str) -> tuple[float, float]:
    """The values at places floor(0.33 (n - 1)) and floor(0.66 (n - 1)) of the target, missing ones being 0."""
    told = {r["share"]: r["value"] for r in learning.nearest_rank(rows.select(F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("v")), "v", (0.33, 0.66)).collect()}
    return told[0.33], told[0.66]


def state_of(target: str, cuts: tuple[float, float]) -> Column:
    v = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    return F.when(v <= cuts[0], STATES[0]).when(v <= cuts[1], STATES[1]).otherwise(STATES[2])


def _staged(rows: DataFrame, model: dict) -> DataFrame:
    """rows with x, y, posterior and vector: what the mixture sees."""
    shaped = kept(rows.withColumn("id", F.struct("sequence", "step")).withColumn("vector", encoded(model["encoder"])))
    place = models.placed(shaped.select("id", "vector"), model["map"]).select("id.sequence", "id.step", "x", "y")
    placed = kept(shaped.drop("vector", "id").join(place, ["sequence", "step"]))
    if model.get("hmm") is None:
        return placed
    post = models.posteriors(placed.select("sequence", "step", F.array("x", "y").alias("vector")), model["hmm"])
    own = placed.join(post, ["sequence", "step"])
    by_state = F.array(*(F.get("posterior", F.lit(model["hmm"]["states"].index(s))) if s in model["hmm"]["states"] else F.lit(0.0) for s in STATES))
    return kept(own.withColumn("posterior", by_state).withColumn("vector", F.concat(F.array("x", "y"), "posterior", encoded(model["mixed"]))))


def responsibility_means(rows: DataFrame, mixture: dict, targets: list[str]) -> np.ndarray:
    """components x targets: sum of r y over sum of r of rows (vector, targets); one aggregation."""
    spark = rows.sparkSession
    params = spark.createDataFrame([(c, float(mixture["weight"][c]), mixture["mean"][c].tolist(), mixture["var"][c].tolist()) for c in range(len(mixture["weight"]))], "component int, weight double, mean array<double>, var array<double>")
    each = learning.responsibilities(rows.select("vector", *targets), params)
    sums = each.groupBy("component").agg(F.sum("r").alias("w"), *(F.sum(F.col("r") * F.coalesce(F.col(t).cast("double"), F.lit(0.0))).alias(t) for t in targets)).collect()  # a row per component
    out = np.zeros((len(mixture["weight"]), len(targets)))
    for r in sums:
        out[r["component"]] = [r[t] / (r["w"] or 1.0) for t in targets]
    return out


def fit(rows: DataFrame, features: list[str], *, horizons: tuple[int, ...] = HORIZONS, anchors: int = 280, perplexity: float = 25, map_iterations: int = 300, sizes: tuple[int, ...] = (7, 9, 12), iterations: int = 90, blend: float = 0.85, seed: int = 42) -> dict:
    """The model of rows (sequence, step, features, target_trace_h); (sequence, step) tells rows apart.

    Mixtures with more components than rows are left out; none fits fewer rows than
    the smallest size.
    """
    rows = kept(rows.where("sequence is not null and step is not null"))
    targets = [f"target_trace_{h}" for h in horizons]
    model: dict = {"horizons": horizons, "blend": blend, "encoder": encoder(rows, features), "mixed": encoder(rows, [c for c in MIXED if c in rows.columns])}
    shaped = rows.select(F.struct("sequence", "step").alias("id"), encoded(model["encoder"]).alias("vector"))
    model["map"] = models.fit_map(shaped, anchors=anchors, perplexity=perplexity, iterations=map_iterations, seed=seed)
    model["cuts"] = thresholds(rows, targets[-1])
    labelled = _staged(rows, model).withColumn("state", state_of(targets[-1], model["cuts"]))
    model["hmm"] = models.hmm_fit(labelled.select("sequence", "step", "state", F.array("x", "y").alias("vector")), smoothing=0.5, floor=1e-2)
    means = {r["state"]: r for r in labelled.groupBy("state").agg(*(F.avg(F.coalesce(F.col(t).cast("double"), F.lit(0.0))).alias(t) for t in targets)).collect()}  # three rows
    model["state_means"] = np.asarray([[means[s][t] if s in means else 0.0 for t in targets] for s in STATES])
    staged = _staged(rows, model)
    data = staged.select(F.struct("sequence", "step").cast("string").alias("id"), F.lit(0).alias("part"), "vector")
    n = staged.count()
    specs = [{"k": k, "seed": seed} for k in sizes if n >= k]
    if not specs:
        raise ValueError(f"{n} rows are too few for {min(sizes)} components")
    fitted = models.gmm_fit_many(data, specs, iterations=iterations, floor=1e-2)
    told = [models.bic(m, _likelihood(staged, m), n) for m in fitted]
    best = int(np.argmin(told))
    model |= {"mixture": fitted[best], "bic": told[best], "bics": {s["k"]: b for s, b in zip(specs, told, strict=True)}}
    model["component_means"] = responsibility_means(staged, model["mixture"], targets)
    return model


def _likelihood(rows: DataFrame, mixture: dict) -> float:
    params = rows.sparkSession.createDataFrame([(c, float(mixture["weight"][c]), mixture["mean"][c].tolist(), mixture["var"][c].tolist()) for c in range(len(mixture["weight"]))], "component int, weight double, mean array<double>, var array<double>")
    return learning.mixture_score(rows.select("vector"), params).first()["log_likelihood"]


def predict(rows: DataFrame, model: dict) -> DataFrame:
    """sequence, step, pred_trace_h (and rounded), the place on the map, the likeliest state with the three probabilities, and the component.

    A forecast blends the means of the components and of the states; where the former
    is not above 0 the latter stands alone.
    """
    staged = _staged(rows.where("sequence is not null and step is not null"), model)
    mixture = model["mixture"]
    params = staged.sparkSession.createDataFrame([(c, float(mixture["weight"][c]), mixture["mean"][c].tolist(), mixture["var"][c].tolist()) for c in range(len(mixture["weight"]))], "component int, weight double, mean array<double>, var array<double>")
    dense = learning.with_densities(staged, params)
    share = F.transform("parts", lambda p: F.exp(p["l"] - F.col("total")))
    dense = dense.withColumn("r", share)
    dot = lambda v, w: F.aggregate(F.zip_with(F.col(v), F.array(*(F.lit(float(x)) for x in w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    made = {}
    for i, h in enumerate(model["horizons"]):
        by_state, by_part = dot("posterior", model["state_means"][:, i]), dot("r", model["component_means"][:, i])
        own = F.when(by_part <= 0, by_state).otherwise(by_part)
        value = F.greatest(model["blend"] * own + (1 - model["blend"]) * by_state, F.lit(0.0))
        made |= {f"pred_trace_{h}": value, f"pred_trace_{h}_rounded": F.floor(value + 0.5)}
    likeliest = F.get(F.array(*(F.lit(s) for s in STATES)), F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    part = (F.array_position("r", F.array_max("r")) - 1).cast("long")
    probabilities = [F.get("posterior", F.lit(i)).alias(f"hmm_{s.lower()}_prob") for i, s in enumerate(STATES)]
    return dense.select("sequence", "step", *(v.alias(c) for c, v in made.items()), F.col("x").alias("tsne_x"), F.col("y").alias("tsne_y"), likeliest.alias("hmm_state"), part.alias("gmm_cluster"), *probabilities)


def horizon_metrics(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(horizon, mae, rmse, exact, within_1) of rows with target_trace_h and pred_trace_h, in one aggregation."""
    pairs = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"target_trace_{h}").cast("double").alias("a"), F.col(f"pred_trace_{h}").alias("p")) for h in horizons))
    flat = rows.select(F.explode(pairs).alias("x")).select("x.*").where("a is not null and p is not null")
    e, whole = F.col("p") - F.col("a"), F.floor(F.col("p") + 0.5) - F.col("a")
    return flat.groupBy("horizon").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((whole == 0).cast("double")).alias("exact"), F.avg((F.abs(whole) <= 1).cast("double")).alias("within_1"))
