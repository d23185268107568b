"""Point-in-time lookups of pivots and bars: nearest levels and zones, swings, channels, embedding ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import series_window
from tidemark.operators.live import live_count, nearest_box, nearest_level, nearest_live
from tidemark.sources.files import kept


KEY = ["series_id", "pivot_idx", "confirm_idx"]


def nearest_equal_level(pivots: DataFrame, equal: DataFrame) -> DataFrame:
    """The equal high or low, confirmed by then, whose mean price is nearest; ties to the earliest."""
    low = F.when(F.col("type") == "EQL", 1).otherwise(0)
    e = equal.select("series_id", F.col("type").alias("level_type"), F.col("idx2").alias("level_idx"), F.col("confirm2").alias("known"), ((F.col("price1") + F.col("price2")) / 2).alias("level"), (-(F.col("idx2") * 2 + low)).alias("prefer"))
    near = nearest_level(pivots, e, KEY, at="confirm_idx", price="price", known="known", value=F.col("level"), prefer=F.col("prefer"), keep=["level_type", "level_idx", "known"])
    return near.select(*KEY, "level.level_type", "level.level_idx", "distance", F.col("level.known").alias("known_idx"))


def nearest_gap(pivots: DataFrame, gaps: DataFrame) -> DataFrame:
    """The gap, published by then, whose box is nearest (0 inside); ties to the latest; its size, and whether it was mitigated by then."""
    g = gaps.select("series_id", F.col("type").alias("zone_type"), "gap_idx", "top", "bottom", "mitigated_idx")
    near = nearest_box(pivots, g, KEY, at="confirm_idx", price="price", known="gap_idx", top="top", bottom="bottom", prefer=F.col("gap_idx"), keep=["zone_type", "gap_idx", "top", "bottom", "mitigated_idx"])
    done = F.coalesce(F.col("box.mitigated_idx") <= F.col("confirm_idx"), F.lit(False))
    return near.select(*KEY, "box.zone_type", "box.gap_idx", "distance", F.abs(F.col("box.top") - F.col("box.bottom")).alias("size"), done.alias("mitigated"))


def nearest_order_block(pivots: DataFrame, blocks: DataFrame) -> DataFrame:
    """The order block, broken by then, whose box is nearest (0 inside); ties to the latest break; its size, and whether it was invalid by then."""
    b = blocks.select("series_id", F.col("type").alias("block_type"), "break_idx", "event_no", "top", "bottom", "invalid_idx")
    near = nearest_box(pivots, b, KEY, at="confirm_idx", price="price", known="break_idx", top="top", bottom="bottom", prefer=F.col("event_no"), keep=["block_type", "event_no", "break_idx", "top", "bottom", "invalid_idx"])
    done = F.coalesce(F.col("box.invalid_idx") <= F.col("confirm_idx"), F.lit(False))
    return near.select(*KEY, "box.block_type", "box.event_no", "box.break_idx", "distance", F.abs(F.col("box.top") - F.col("box.bottom")).alias("size"), done.alias("invalidated"))


def liquidity_density(pivots: DataFrame, levels: DataFrame, recent: int = 100) -> DataFrame:
    """Per pivot and side: levels created in the last `recent` bars, levels not resolved yet, and the distance to the nearest of these (null: none)."""
    pivots, levels = kept(pivots), kept(levels)
    out = pivots.select(*KEY, "price")
    for side in ("BSL", "SSL"):
        own, name = levels.where(F.col("type") == side), side.lower()
        new = live_count(pivots, own, KEY, at="confirm_idx", since=F.col("created_idx"), until=F.col("created_idx") + recent, name=f"{name}_{recent}")
        near = nearest_live(pivots, own, KEY, at="confirm_idx", price="price", since=F.col("created_idx"), until=F.col("resolved_idx") - 1, value=F.col("price"), prefer=F.lit(0), keep=[], equal_above=False)
        near = near.select(*KEY, (F.col("n_below") + F.col("n_above")).alias(f"active_{name}"), F.col("below.v").alias("_b"), F.col("above.v").alias("_a"))
        out = out.join(new, KEY, "left").join(near, KEY, "left").withColumn(f"near_{name}", F.least(F.col("price") - F.col("_b"), F.col("_a") - F.col("price"))).drop("_a", "_b")
    counts = [f"bsl_{recent}", f"ssl_{recent}", "active_bsl", "active_ssl"]
    return out.select(*KEY, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), "near_bsl", "near_ssl")


def swings(pivots: DataFrame, bars_with_atr: DataFrame) -> DataFrame:
    """Distance to the pivot before, in price, bars and ATRs; null for a series' first."""
    w = Window.partitionBy("series_id").orderBy("pivot_idx", "confirm_idx")
    a = bars_with_atr.select("series_id", F.col("bar_idx").alias("confirm_idx"), "atr")
    p = pivots.join(a, ["series_id", "confirm_idx"], "left")
    move = F.abs(F.col("price") - F.lag("price").over(w))
    return p.select("series_id", "pivot_idx", "confirm_idx", move.alias("move"), (F.col("pivot_idx") - F.lag("pivot_idx").over(w)).alias("bars"), (move / F.when(F.col("atr") > 0, F.col("atr"))).alias("move_atr"))


def side_distances(bars_with_atr: DataFrame, levels: DataFrame) -> DataFrame:
    """Distance in ATRs from each close up to the nearest live buy-side level and down to the nearest live sell-side one, -1 if none, and how many there are.

    A level is live from its creation until it is resolved (swept, if it was never
    resolved), both bars included, and for ever if neither came.
    """
    ended = F.coalesce("resolved_idx", "swept_idx") if "swept_idx" in levels.columns else F.col("resolved_idx")
    key = ["series_id", "bar_idx"]
    bars, levels = kept(bars_with_atr.where("atr > 0").select(*key, "close", "atr")), kept(levels)
    near = lambda side: nearest_live(bars, levels.where(F.col("type") == side), key, at="bar_idx", price="close", since=F.col("created_idx"), until=ended, value=F.col("price"), prefer=F.lit(0), keep=[])
    buy = near("BSL").select(*key, F.col("above.v").alias("_up"), F.col("n_above").alias("up_count"))
    sell = near("SSL").select(*key, F.col("below.v").alias("_down"), F.col("n_below").alias("down_count"))
    met = bars.join(buy, key, "left").join(sell, key, "left")
    return met.select(*key, F.coalesce((F.col("_up") - F.col("close")) / F.col("atr"), F.lit(-1.0)).alias("up"), F.coalesce((F.col("close") - F.col("_down")) / F.col("atr"), F.lit(-1.0)).alias("down"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("up_count", "down_count")))


def box_distances(bars_with_atr: DataFrame, boxes: DataFrame) -> DataFrame:
    """Whether each close is inside (1) a live box, and the distance in ATRs to the nearest one; 0 inside, -1 if none is live.

    boxes: series_id, created, ended (null: never), top, bottom; live from created to
    ended, both included.  A close is inside as many boxes as have begun below it or at
    it, less those that end below it.
    """
    key = ["series_id", "bar_idx"]
    bars, b = kept(bars_with_atr.where("atr > 0").select(*key, "close", "atr")), kept(boxes.where("top is not null and bottom is not null"))
    near = lambda edge, **how: nearest_live(bars, b, key, at="bar_idx", price="close", since=F.col("created"), until=F.col("ended"), value=edge, prefer=F.lit(0), keep=[], **how)
    begun = near(F.least("top", "bottom"), equal_above=False).select(*key, F.col("n_below").alias("_begun"), F.col("above.v").alias("_above"))
    left = near(F.greatest("top", "bottom"), equal_below=False).select(*key, F.col("n_below").alias("_left"), F.col("below.v").alias("_below"))
    met = bars.join(begun, key, "left").join(left, key, "left")
    inside = F.coalesce(F.col("_begun") > F.col("_left"), F.lit(False))
    away = F.least(F.col("_above") - F.col("close"), F.col("close") - F.col("_below")) / F.col("atr")
    return met.select(*key, inside.cast("long").alias("inside"), F.when(inside, 0.0).otherwise(F.coalesce(away, F.lit(-1.0))).alias("distance"))


def regression_channel(blocks: DataFrame, tick: float = 0.25, key: tuple[str, ...] = ("series_id", "event_idx")) -> DataFrame:
    """Per event the line through its blocks' closes (oldest first), the spread around it, and how often lows and highs touch the band.

    blocks: trailing blocks, block 0 the latest.  The unit is the mean true range of
    the last 14 blocks.  Three touches of 12 blocks make a channel; below three blocks
    all is 0.
    """
    by = Window.partitionBy(*key)
    before = F.lag("close").over(by.orderBy(F.desc("block")))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    b = blocks.withColumn("tr", tr).withColumn("x", (F.max("block").over(by) - F.col("block")).cast("double")).withColumn("n", F.count("*").over(by))
    line = b.groupBy(*key).agg(F.regr_slope("close", "x").alias("slope"), F.regr_intercept("close", "x").alias("base"), F.avg(F.when(F.col("block") < 14, F.col("tr"))).alias("unit"))
    off = b.join(line, list(key)).withColumn("fit", F.col("base") + F.col("slope") * F.col("x")).withColumn("e", F.col("close") - F.col("fit"))
    off = off.withColumn("spread", F.greatest(F.sqrt(F.avg(F.col("e") * F.col("e")).over(by)), 0.15 * F.col("unit")))
    near = F.greatest(0.3 * F.col("unit"), F.lit(tick))
    low = F.abs(F.col("low") - (F.col("fit") - F.col("spread"))) <= near
    high = F.abs(F.col("high") - (F.col("fit") + F.col("spread"))) <= near
    made = {"slope": F.max("slope"), "spread": F.max("spread"), "centre": F.max(F.when(F.col("block") == 0, F.col("fit")))}
    out = off.groupBy(*key).agg(*(f.alias(c) for c, f in made.items()), F.count(F.when(low, 1)).alias("low_touches"), F.count(F.when(high, 1)).alias("high_touches"), F.max("n").alias("n"))
    out = out.withColumn("is_channel", (F.greatest("low_touches", "high_touches") >= 3) & (F.col("n") >= 12))
    few = F.col("n") < 3
    return out.select(*key, *(F.when(few, 0.0).otherwise(F.col(c)).alias(c) for c in made), *(F.when(few, 0).otherwise(F.col(c)).alias(c) for c in ("low_touches", "high_touches")), "n", "is_channel")


def latest_bars(bars: DataFrame, last: int = 500) -> DataFrame:
    """The last bars of each series, as the range of a profile."""
    top = bars.groupBy("series_id").agg(F.max("bar_idx").alias("_top"))
    return bars.join(top, "series_id").where(F.col("bar_idx") > F.col("_top") - last).drop("_top")


def crossings(bars: DataFrame, level: Column) -> DataFrame:
    """Closes that cross a level: 1 upwards, -1 downwards."""
    before = F.lag("close").over(series_window())
    side = F.when((before <= level) & (F.col("close") > level), 1).when((before >= level) & (F.col("close") < level), -1)
    return bars.select("series_id", "bar_idx", side.cast("long").alias("side")).where("side is not null")
