"""The candle table and the pivot table: one row per bar or confirmed pivot with what was known by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import levels as L
from tidemark.operators import lookups as K
from tidemark.operators import profile as V
from tidemark.operators import structure as S
from tidemark.operators import windows as W
from tidemark.sources.files import kept

CANDLE_COLUMNS = ["return_1", "return_3", "return_5", "range_atr", "body_atr", "upper_wick_atr", "lower_wick_atr", "close_position", "volatility_10", "volatility_20", "volume_zscore", "volume_ratio", "slope_10", "slope_20", "price_vs_mean_20_atr", "distance_to_bsl_atr", "distance_to_ssl_atr", "active_bsl_count", "active_ssl_count", "liquidity_imbalance", "inside_fvg", "distance_fvg_atr", "inside_order_block", "distance_ob_atr", "bars_since_structure_event", "last_structure_event"]
CODES = {"BOS_UP": 1, "BOS_DOWN": -1, "CHOCH_UP": 2, "CHOCH_DOWN": -2}


def candle_table(bars_with_atr: DataFrame, levels: DataFrame, gaps: DataFrame, blocks: DataFrame, events: DataFrame) -> DataFrame:
    """series_id, bar_idx, epoch, CANDLE_COLUMNS, state_label, event_target and outcome, from bar 20 on where there is an ATR.

    Levels, gaps and order blocks count as long as they live, however old they are.
    """
    bars = bars_with_atr.select("series_id", "bar_idx", "epoch", "open", "high", "low", "close", "volume", "atr")
    a = W.slopes(W.realized_volatility(W.candle_stats(W.anatomy(bars, flat_position=0.5))))
    a = W.returns(a.drop("return_1")).where("bar_idx >= 20 and atr > 0")
    sides = K.side_distances(bars, levels)
    fvg = K.box_distances(bars, gaps.select("series_id", F.col("gap_idx").alias("created"), F.col("mitigated_idx").alias("ended"), "top", "bottom"))
    ob = K.box_distances(bars, blocks.select("series_id", F.col("break_idx").alias("created"), F.coalesce("invalid_idx", "touch_idx").alias("ended"), "top", "bottom"))
    code = F.create_map(*(x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))))[F.col("event")].cast("long")
    last = L.as_of(bars.select("series_id", "bar_idx"), events.withColumn("code", code), ["code"], at="bar_idx", when="break_idx", order="event_no")
    key = ["series_id", "bar_idx"]
    t = a.join(sides, key).join(fvg.withColumnsRenamed({"inside": "inside_fvg", "distance": "distance_fvg_atr"}), key).join(ob.withColumnsRenamed({"inside": "inside_order_block", "distance": "distance_ob_atr"}), key).join(last, key)
    atr, both = F.col("atr"), F.col("up_count") + F.col("down_count")
    made = {c: F.col(c) for c in CANDLE_COLUMNS if c in t.columns}
    made |= {"range_atr": F.col("range") / atr, "body_atr": F.col("body") / atr, "upper_wick_atr": F.col("upper_wick") / atr, "lower_wick_atr": F.col("lower_wick") / atr, "slope_10": F.col("slope_10") / atr, "slope_20": F.col("slope_20") / atr}
    made |= {"volume_zscore": W.ratio(F.col("volume") - F.col("volume_mean"), F.col("volume_std")), "volume_ratio": F.when(F.col("volume_mean") > 0, F.col("volume") / F.col("volume_mean")).otherwise(1.0), "price_vs_mean_20_atr": (F.col("close") - F.col("close_mean")) / atr}
    made |= {"distance_to_bsl_atr": F.col("up"), "distance_to_ssl_atr": F.col("down"), "active_bsl_count": F.col("up_count"), "active_ssl_count": F.col("down_count"), "liquidity_imbalance": W.ratio((F.col("up_count") - F.col("down_count")).cast("double"), both)}
    made |= {"bars_since_structure_event": F.coalesce(F.col("bar_idx") - F.col("event_idx"), F.lit(-1)), "last_structure_event": F.coalesce("code", F.lit(0))}
    t = t.select("series_id", "bar_idx", "epoch", *(made[c].alias(c) for c in CANDLE_COLUMNS))
    near = F.array_min(F.filter(F.array("distance_to_bsl_atr", "distance_to_ssl_atr", "distance_fvg_atr", "distance_ob_atr"), lambda v: v >= 0))
    labelled = S.gated_targets(S.state_labels(t.withColumn("nearest", near)), S.event_targets(bars))
    return labelled.join(S.outcomes(bars, bars), key, "left").select("series_id", "bar_idx", "epoch", *CANDLE_COLUMNS, "state_label", "event_target", F.coalesce("outcome", F.lit("NONE")).alias("outcome"))


def pivot_levels(pivots: DataFrame, levels: DataFrame) -> DataFrame:
    """Each pivot with the class and state of the level at its own bar, of its side and price; NONE and -1 where there is none.

    levels: created_idx, type, price, class, swept_idx, resolved_idx.
    """
    lv = levels.select("series_id", F.col("created_idx").alias("confirm_idx"), F.when(F.col("type") == "BSL", "HIGH").otherwise("LOW").alias("type"), F.col("price").alias("_p"), "level_id", "class", "swept_idx", "resolved_idx")
    met = pivots.join(lv, ["series_id", "confirm_idx", "type"], "left").where(F.col("_p").isNull() | (F.abs(F.col("price") - F.col("_p")) < 1e-9))
    first = Window.partitionBy("series_id", "pivot_idx", "confirm_idx", "type").orderBy("level_id")
    met = met.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return pivots.join(met.select("series_id", "pivot_idx", "confirm_idx", "type", F.col("class").alias("_c"), "swept_idx", "resolved_idx"), ["series_id", "pivot_idx", "confirm_idx", "type"], "left").select(*pivots.columns, F.coalesce("_c", F.lit("NONE")).alias("class"), F.coalesce("swept_idx", F.lit(-1)).alias("swept_idx"), F.coalesce("resolved_idx", F.lit(-1)).alias("resolved_idx"))


def created_at(levels: DataFrame, pivots: DataFrame) -> DataFrame:
    """Levels (pivot_idx, type, price, confirmed_idx, created_idx) with the bar from which they may be known: their pivot's confirmation, else their own confirmed, created or pivot bar."""
    p = pivots.select("series_id", "pivot_idx", F.when(F.col("type") == "HIGH", "BSL").otherwise("SSL").alias("type"), F.round("price", 10).alias("_price"), F.col("confirm_idx").alias("_at")).dropDuplicates(["series_id", "pivot_idx", "type", "_price"])
    keyed = levels.withColumn("_price", F.round("price", 10)).join(p, ["series_id", "pivot_idx", "type", "_price"], "left")
    return keyed.withColumn("causal_idx", F.coalesce("_at", "confirmed_idx", "created_idx", "pivot_idx")).drop("_at", "_price")


def pivot_table(pivots: DataFrame, bars_with_atr: DataFrame, levels: DataFrame, events: DataFrame, gaps: DataFrame) -> DataFrame:
    """Confirmed pivots with side, label, ATR, move since the one before, last structure event and its distance, live gaps of 50 bars, live levels by side, and the level's class as target."""
    key = ["series_id", "pivot_idx", "confirm_idx"]
    atr = bars_with_atr.select("series_id", F.col("bar_idx").alias("confirm_idx"), F.col("atr").alias("atr_14"), F.col("volume").alias("confirm_volume"))
    base = pivot_levels(pivots, levels).withColumnRenamed("class", "target").drop("swept_idx", "resolved_idx").join(atr, ["series_id", "confirm_idx"], "left")
    last = L.as_of(pivots.select(*key), events.withColumnRenamed("price", "event_price"), ["event", "direction", "event_price"], at="confirm_idx", when="break_idx", order="event_no")
    side = K.side_distances(bars_with_atr.where("atr > 0").withColumn("close", F.col("close")), levels).withColumnRenamed("bar_idx", "confirm_idx")
    shown = gaps.select("series_id", F.explode(F.sequence("gap_idx", F.col("gap_idx") + 49)).alias("confirm_idx"), "gap_idx", "mitigated_idx").where("mitigated_idx is null or mitigated_idx > confirm_idx")
    active = shown.groupBy("series_id", "confirm_idx").agg(F.count("*").alias("active_fvg_50"))
    out = base.join(last, key, "left").join(side, ["series_id", "confirm_idx"], "left").join(active, ["series_id", "confirm_idx"], "left").join(K.swings(pivots, bars_with_atr), key, "left")
    unit = F.when(F.col("atr_14") > 0, F.col("atr_14"))
    return out.select(
        *key, "type", "price", "target", "atr_14", "confirm_volume", (F.col("confirm_idx") - F.col("pivot_idx")).alias("confirmation_delay"), F.col("move").alias("distance_previous_pivot"), F.col("move_atr").alias("distance_previous_pivot_atr"), F.col("bars").alias("bars_since_previous_pivot"),
        F.coalesce("event", F.lit("NONE")).alias("last_event"), F.coalesce("direction", F.lit(0)).alias("event_direction"), F.coalesce(F.col("confirm_idx") - F.col("event_idx"), F.lit(-1)).alias("bars_since_event"), F.coalesce(F.abs(F.col("price") - F.col("event_price")) / unit, F.lit(-1.0)).alias("distance_event_atr"),
        F.coalesce("active_fvg_50", F.lit(0)).alias("active_fvg_50"), F.coalesce("up_count", F.lit(0)).alias("active_bsl"), F.coalesce("down_count", F.lit(0)).alias("active_ssl"), F.coalesce("up", F.lit(-1.0)).alias("distance_bsl_atr"), F.coalesce("down", F.lit(-1.0)).alias("distance_ssl_atr"),
    )


def trainable(rows: DataFrame) -> DataFrame:
    """Pivot rows that may be learned from: a known target and label, an ATR above 0, and a confirmation not before the pivot."""
    return rows.where(F.col("target").isin("RUN", "GRAB", "SWEEP") & (F.col("atr_14") > 0) & F.col("structure_type").isin("HH", "HL", "LH", "LL") & F.col("pivot_idx").isNotNull() & (F.col("confirm_idx") >= F.col("pivot_idx")))


def pips(rows: DataFrame, columns: list[str], pip: float = 0.25) -> DataFrame:
    """ATR-scaled distances as pips beside them, 0 where there is no ATR or distance, and the ATR itself."""
    atr = F.col("atr_14")
    return rows.select("*", *(F.when((atr > 0) & F.col(c).isNotNull(), F.col(c) * atr / pip).otherwise(0.0).alias(c.removesuffix("_atr") + "_pips") for c in columns), F.when(atr > 0, atr / pip).otherwise(0.0).alias("atr_pips"))


def frame_context(bars: DataFrame, events: DataFrame, size: int, *, pip: float = 0.25, blocks: int = 20, bins: int = 24) -> DataFrame:
    """frame_contexts() of one frame, without its column."""
    return frame_contexts(bars, events, (size,), pip=pip, blocks=blocks, bins=bins).drop("frame")


def frame_contexts(bars: DataFrame, events: DataFrame, sizes: tuple[int, ...], *, pip: float = 0.25, blocks: int = 20, bins: int = 24) -> DataFrame:
    """Per event (series_id, event_idx) and frame: range, return, volume, VWAP, volume profile, Fibonacci and channel distances in pips over the trailing bars and blocks of `frame` bars, one of the sizes.

    All frames go through the same passes; what is read twice is written once.
    """
    bars, events = kept(bars), kept(events)
    at, key = ["series_id", "event_idx"], ["series_id", "event_idx", "frame"]
    span = F.greatest(F.lit(blocks) * F.col("frame"), F.lit(60))
    framed = events.select(*at, F.explode(F.array(*(F.lit(size).cast("long") for size in sizes))).alias("frame"))
    ranges = framed.select(*key, F.greatest(F.col("event_idx") - (span - 1), F.lit(0)).alias("first_idx"), F.col("event_idx").alias("last_idx"))
    now = events.join(bars.select("series_id", F.col("bar_idx").alias("event_idx"), ((F.col("high") + F.col("low")) / 2).alias("mid"), F.col("close").alias("now")), at)
    sums = kept(V.range_sums(bars, ranges, key))
    whole = sums.select(*key, "hi", "lo", (F.col("turnover") / F.nullif(F.col("volume"), F.lit(0.0))).alias("vwap"))
    profiles = kept(V.range_profiles(bars, ranges, key, bins, sums=sums))  # areas look at a profile again and again
    area = V.range_areas(profiles.join(now, at), key, F.col("mid"))
    b = None
    for size in sizes:
        own = W.trailing_blocks(bars, events, size, blocks).withColumn("frame", F.lit(size).cast("long"))
        b = own if b is None else b.unionByName(own)
    b = kept(b)
    w = Window.partitionBy(*key)
    before = F.lag("close").over(w.orderBy(F.desc("block")))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    k = F.max("block").over(w) - F.col("block")  # the oldest block is 0
    weight = F.when(k == 0, F.pow(F.lit(0.8), F.max("block").over(w))).otherwise(0.2 * F.pow(F.lit(0.8), F.col("block")))
    parts = b.withColumn("tr", tr).withColumn("weight", weight).withColumn("k", k)
    told = parts.groupBy(*key).agg(F.avg(F.when(F.col("block") < 14, F.col("tr"))).alias("atr"), F.sum(F.col("weight") * F.col("volume")).alias("ema"), F.max(F.when(F.col("block") == 0, F.col("volume"))).alias("volume"), F.max(F.when(F.col("k") == 0, F.col("open"))).alias("first_open"))
    t = whole.join(now, at).join(told, key).join(K.regression_channel(b, pip, tuple(key)), key).join(area, key)
    mid, reach = F.col("mid"), F.col("hi") - F.col("lo")
    made = {"atr": F.col("atr"), "range": reach, "return": F.col("now") - F.col("first_open"), "vwap_distance": mid - F.coalesce("vwap", "mid"), "resistance_distance": F.col("hi") - mid, "support_distance": mid - F.col("lo"), "trend_distance": F.when(F.col("n") < 3, 0.0).otherwise(mid - F.col("centre")), "channel_halfwidth": F.col("spread")}
    made |= {f"{c}_distance": mid - F.col(c) for c in ("poc", "vah", "val")}
    made |= {f"fib{int(r * 1000)}_distance": mid - (F.col("lo") + r * reach) for r in (0.382, 0.5, 0.618)}
    return t.select(*key, *((v / pip).alias(f"{c}_pips") for c, v in made.items()), "volume", F.col("ema").alias("volume_ema9"), F.when(F.col("ema") > 0, F.col("volume") / F.col("ema")).otherwise(1.0).alias("volume_ratio_ema9"), F.col("low_touches").alias("channel_lower_touches"), F.col("high_touches").alias("channel_upper_touches"), F.col("is_channel").cast("long").alias("channel_valid_3_touches"))
