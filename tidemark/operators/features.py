"""The full pivot table and the ghost table: what was known when a pivot was confirmed, and what came after."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import candles as C
from tidemark.operators import levels as L
from tidemark.operators import lookups as K
from tidemark.operators import pivots as P
from tidemark.operators import windows as W
from tidemark.operators.live import live_count
from tidemark.sources.files import kept

#: Columns of a pivot row, in the order in which files hold them.
PIVOT_COLUMNS = """pivot_id symbol timeframe pivot_index confirmation_index confirmation_delay pivot_timestamp confirmation_timestamp pivot_side structure_type structure_mode source
pivot_open pivot_high pivot_low pivot_close pivot_price pivot_volume pivot_range pivot_body upper_wick lower_wick candle_direction close_position
confirm_open confirm_high confirm_low confirm_close confirm_volume atr_14 range_atr_ratio body_atr_ratio price_to_confirm_close
volume_mean_20 volume_std_20 volume_ratio_20 volume_zscore_20 previous_pivot_type previous_pivot_price distance_previous_pivot bars_previous_pivot swing_size_atr
liquidity_type liquidity_state swept_index resolved_index last_structure_event last_structure_event_direction bars_since_structure_event distance_last_structure_event_atr bos_count_previous_20 choch_count_previous_20
near_equal_level equal_level_type distance_equal_level_atr bars_since_equal_level inside_fvg nearest_fvg_type distance_fvg_atr fvg_size_atr bars_since_fvg fvg_mitigated active_fvg_count_50
inside_order_block nearest_ob_type distance_ob_atr ob_size_atr bars_since_ob ob_invalidated active_ob_count_50
bsl_count_previous_100 ssl_count_previous_100 active_bsl_count active_ssl_count distance_nearest_bsl_atr distance_nearest_ssl_atr equal_levels_previous_100 liquidity_imbalance_100 target""".split()
#: ATR-scaled distances that a ghost row also has in pips.
PIPS = {"distance_nearest_bsl_atr": "distance_nearest_bsl_pips", "distance_nearest_ssl_atr": "distance_nearest_ssl_pips", "distance_fvg_atr": "distance_fvg_pips", "distance_ob_atr": "distance_ob_pips", "distance_equal_level_atr": "distance_equal_level_pips", "distance_last_structure_event_atr": "distance_last_structure_event_pips"}
FRAMES, HORIZONS = (1, 10, 60), (3, 5, 10, 15)
WINDOWS = {240: "4h", 1440: "daily", 10080: "weekly"}


def zero(c: str):
    return F.coalesce(F.col(c), F.lit(0))


def pivot_features(pivots: DataFrame, bars_with_atr: DataFrame, levels: DataFrame, equal: DataFrame, gaps: DataFrame, blocks: DataFrame, events: DataFrame, *, symbol: str = "UNKNOWN", timeframe: str = "60", mode: str = "external", source: str = "zigzag") -> DataFrame:
    """series_id and PIVOT_COLUMNS of each pivot (series_id, pivot_idx, confirm_idx, type, price) whose bars there are.

    levels: liquidity(); equal: equal_levels(); gaps: mitigated_gaps(); blocks:
    order_blocks(); events: breaks().  Only what was known at the confirmation counts.
    Without an ATR ratios are 0; what there is none of is NONE, 0 or, for bars since, -1.
    """
    key = K.KEY
    pivots, bars_with_atr, levels, equal, gaps, blocks, events = (kept(df) for df in (pivots, bars_with_atr, levels, equal, gaps, blocks, events))
    p = P.labels(pivots.where("price is not null")).withColumnRenamed("label", "structure_type")
    stats = W.volume_stats(bars_with_atr).select("series_id", F.col("bar_idx").alias("confirm_idx"), F.col("epoch").alias("_cepoch"), *(F.col(c).alias(f"confirm_{c}") for c in ("open", "high", "low", "close", "volume")), zero("atr").cast("double").alias("atr_14"), F.col("volume_mean").alias("volume_mean_20"), F.col("volume_std").alias("volume_std_20"))
    own = W.anatomy(bars_with_atr).select("series_id", F.col("bar_idx").alias("pivot_idx"), F.col("epoch").alias("_pepoch"), *(F.col(c).alias(f"pivot_{c}") for c in ("open", "high", "low", "close", "volume", "range", "body")), "upper_wick", "lower_wick", F.col("direction").alias("candle_direction"), "close_position")
    p = p.join(own, ["series_id", "pivot_idx"]).join(stats, ["series_id", "confirm_idx"])
    w = Window.partitionBy("series_id").orderBy("pivot_idx", "confirm_idx")
    p = p.select("*", F.row_number().over(w).cast("long").alias("pivot_id"), *(F.lag(c).over(w).alias(f"_before_{c}") for c in ("type", "price", "pivot_idx")))
    asked = kept(p.select(*key, "type", "price"))
    level = levels.select("series_id", F.col("created_idx").alias("confirm_idx"), F.when(F.col("type") == "BSL", "HIGH").otherwise("LOW").alias("type"), F.struct("level_id", F.col("type").alias("kind"), "state", "swept_idx", "resolved_idx", "class", F.col("price").alias("price")).alias("_level"))
    level = asked.join(level, ["series_id", "confirm_idx", "type"]).where(F.abs(F.col("price") - F.col("_level.price")) < 1e-9).groupBy(*key, "type").agg(F.min_by("_level", "_level.level_id").alias("_level"))
    last = L.as_of(asked.select(*key), events.withColumnRenamed("price", "_event_price"), ["event", "_event_price"], at="confirm_idx", when="break_idx", order="event_no").select(*key, F.col("event").alias("_event"), F.col("event_idx").alias("_event_idx"), "_event_price")
    count = lambda rows, since, until, name: live_count(asked, rows, key, at="confirm_idx", since=since, until=until, name=name)
    broke = F.col("break_idx")
    counts = [count(events.where(F.col("event").startswith(kind)), broke, broke + 20, f"{kind.lower()}_count_previous_20") for kind in ("BOS", "CHOCH")]
    counts += [count(gaps, F.col("gap_idx"), F.least(F.col("gap_idx") + 50, "mitigated_idx"), "active_fvg_count_50"), count(blocks, broke, F.least(broke + 50, "invalid_idx"), "active_ob_count_50"), count(equal, F.col("confirm2"), F.col("confirm2") + 100, "equal_levels_previous_100")]
    near = {"_eq": K.nearest_equal_level(asked, equal), "_gap": K.nearest_gap(asked, gaps), "_ob": K.nearest_order_block(asked, blocks), "_den": K.liquidity_density(asked, levels)}
    t = p.join(level, [*key, "type"], "left").join(last, key, "left")
    for name, df in near.items():
        t = t.join(df.select(*key, F.struct(*(c for c in df.columns if c not in key)).alias(name)), key, "left")
    for df in counts:
        t = t.join(df, key, "left")
    atr = F.col("atr_14")
    by_atr = lambda v: F.when((atr > 0) & v.isNotNull(), v / atr).otherwise(0.0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    since = lambda c: F.coalesce(F.col("confirm_idx") - F.col(c), F.lit(-1)).cast("long")
    when = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss")
    moved = F.coalesce(F.abs(F.col("price") - F.col("_before_price")), F.lit(0.0))
    both = zero("_den.active_bsl") + zero("_den.active_ssl")
    made = {
        "symbol": F.lit(symbol), "timeframe": F.lit(timeframe), "pivot_index": F.col("pivot_idx"), "confirmation_index": F.col("confirm_idx"), "confirmation_delay": F.col("confirm_idx") - F.col("pivot_idx"), "pivot_timestamp": when("_pepoch"), "confirmation_timestamp": when("_cepoch"),
        "pivot_side": F.upper("type"), "structure_mode": F.lit(mode), "source": F.lit(source), "pivot_price": F.col("price"), "range_atr_ratio": by_atr(F.col("pivot_range")), "body_atr_ratio": by_atr(F.col("pivot_body")), "price_to_confirm_close": by_atr(F.col("price") - F.col("confirm_close")),
        "volume_ratio_20": F.when(F.col("volume_mean_20") > 0, F.col("pivot_volume") / F.col("volume_mean_20")).otherwise(0.0), "volume_zscore_20": F.when(F.col("volume_std_20") > 0, (F.col("pivot_volume") - F.col("volume_mean_20")) / F.col("volume_std_20")).otherwise(0.0),
        "previous_pivot_type": F.coalesce("_before_type", F.lit("NONE")), "previous_pivot_price": F.coalesce("_before_price", F.lit(0.0)), "distance_previous_pivot": moved, "bars_previous_pivot": F.coalesce(F.col("pivot_idx") - F.col("_before_pivot_idx"), F.lit(0)), "swing_size_atr": by_atr(moved),
        "liquidity_type": F.coalesce("_level.kind", F.lit("NONE")), "liquidity_state": F.coalesce("_level.state", F.lit("NONE")), "swept_index": F.coalesce("_level.swept_idx", F.lit(-1)), "resolved_index": F.coalesce("_level.resolved_idx", F.lit(-1)), "target": F.coalesce("_level.class", F.lit("NONE")),
        "last_structure_event": F.coalesce("_event", F.lit("NONE")), "last_structure_event_direction": F.coalesce(F.element_at(F.split("_event", "_"), -1), F.lit("NONE")), "bars_since_structure_event": since("_event_idx"), "distance_last_structure_event_atr": by_atr(F.abs(F.col("price") - F.col("_event_price"))),
        "near_equal_level": flag((atr > 0) & (F.col("_eq.distance") / atr <= 1)), "equal_level_type": F.coalesce("_eq.level_type", F.lit("NONE")), "distance_equal_level_atr": by_atr(F.col("_eq.distance")), "bars_since_equal_level": since("_eq.known_idx"),
        "inside_fvg": flag(F.col("_gap.distance") == 0), "nearest_fvg_type": F.coalesce("_gap.zone_type", F.lit("NONE")), "distance_fvg_atr": by_atr(F.col("_gap.distance")), "fvg_size_atr": by_atr(F.col("_gap.size")), "bars_since_fvg": since("_gap.gap_idx"), "fvg_mitigated": flag(F.col("_gap.mitigated")),
        "inside_order_block": flag(F.col("_ob.distance") == 0), "nearest_ob_type": F.coalesce("_ob.block_type", F.lit("NONE")), "distance_ob_atr": by_atr(F.col("_ob.distance")), "ob_size_atr": by_atr(F.col("_ob.size")), "bars_since_ob": since("_ob.break_idx"), "ob_invalidated": flag(F.col("_ob.invalidated")),
        "bsl_count_previous_100": zero("_den.bsl_100"), "ssl_count_previous_100": zero("_den.ssl_100"), "active_bsl_count": zero("_den.active_bsl"), "active_ssl_count": zero("_den.active_ssl"), "distance_nearest_bsl_atr": by_atr(F.col("_den.near_bsl")), "distance_nearest_ssl_atr": by_atr(F.col("_den.near_ssl")),
        "liquidity_imbalance_100": F.when(both > 0, (zero("_den.active_bsl") - zero("_den.active_ssl")) / both).otherwise(0.0),
    }
    counted = {"bos_count_previous_20", "choch_count_previous_20", "active_fvg_count_50", "active_ob_count_50", "equal_levels_previous_100"}
    return t.select("series_id", *((made.get(c) if c in made else zero(c) if c in counted else F.col(c)).alias(c) for c in PIVOT_COLUMNS))


def ghost_table(features: DataFrame, bars: DataFrame, *, pip: float = 0.25) -> DataFrame:
    """Pivot rows with at least 20 bars before and 15 after their confirmation, distances in pips, the context of three frames, wide windows, the strongest bars, and target_trace_h: how many new extremes come within h bars.

    bars: one minute each, as the names of frames and windows say.
    """
    features, bars = kept(features), kept(bars)
    last = bars.groupBy("series_id").agg(F.max("bar_idx").alias("_last"))
    g = features.join(last, "series_id").where((F.col("confirmation_index") >= 20) & (F.col("confirmation_index") + max(HORIZONS) <= F.col("_last"))).drop("_last")
    key = ["series_id", "event_idx"]
    g = g.withColumn("event_idx", F.col("confirmation_index"))
    events = kept(g.select(*key).distinct())
    wide = W.wide_windows(events, bars, tuple(WINDOWS), pip=pip).join(W.traces_at(events, bars, HORIZONS), key)
    mid = (F.col("high") + F.col("low")) / 2
    sides = [(F.col(f"{c}_{n}") / pip).alias(f"sr_{name}_{c}_pips") for n, name in WINDOWS.items() for c in ("resistance", "support")]
    wide = wide.select(*key, mid.alias("ghost_price_mid"), *sides, ((mid - F.col("demand")) / pip).alias("demand_distance_pips"), ((F.col("supply") - mid) / pip).alias("supply_distance_pips"), *(F.col(f"trace_{h}").alias(f"target_trace_{h}") for h in HORIZONS))
    out = g.join(kept(wide), key)
    frames = kept(C.frame_contexts(bars, events, FRAMES, pip=pip))
    for size in FRAMES:
        frame = frames.where(F.col("frame") == size)
        out = out.join(frame.select(*key, *(F.col(c).alias(f"tf_{size}_{c}") for c in frame.columns if c not in (*key, "frame"))), key)
    atr = F.col("atr_14")
    pips = [F.when(atr > 0, F.col(c) * atr / pip).otherwise(0.0).alias(name) for c, name in PIPS.items()]
    number = F.row_number().over(Window.partitionBy("series_id").orderBy("event_idx", "pivot_id")).cast("long")
    return out.select(*(c for c in features.columns if c != "target"), number.alias("ghost_id"), F.col("event_idx").alias("ghost_index"), F.col("confirmation_timestamp").alias("ghost_timestamp"), F.lit("EXTERNAL_SWING_CONFIRMATION").alias("ghost_definition"), F.col("target").alias("legacy_liquidity_target"), *pips, F.when(atr > 0, atr / pip).otherwise(0.0).alias("atr_1m_pips"), *(c for c in out.columns if c not in features.columns and c != "event_idx"))
