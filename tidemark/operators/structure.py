"""Structure breaks, gaps, order blocks, liquidity levels and zones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import series_window
from tidemark.operators.levels import as_of, first_beyond
from tidemark.operators.windows import over
from tidemark.sources.files import kept


def shadowed(pivots: DataFrame, external: DataFrame, apart: float = 1e-7) -> DataFrame:
    """pivots with `shadowed`: whether an external pivot of the type has the same price, to less than `apart`."""
    key = ["series_id", "type", "pivot_idx", "confirm_idx"]
    cell = F.floor(F.col("price") / apart)  # prices so close lie in one cell or in neighbouring ones
    ext = external.select("series_id", "type", F.col("price").alias("_e"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    met = pivots.withColumn("_cell", cell).join(ext, ["series_id", "type", "_cell"]).where(F.abs(F.col("price") - F.col("_e")) < apart)
    return pivots.join(met.select(*key, F.lit(True).alias("shadowed")).distinct(), key, "left").withColumn("shadowed", F.coalesce("shadowed", F.lit(False)))


def breaks(pivots: DataFrame, bars: DataFrame, *, confluence: bool = False, external: DataFrame | None = None) -> DataFrame:
    """BOS and CHoCH events: the first close that crosses a pivot's level while it is the latest of its type.

    Up breaks come before down breaks of the same bar.  A break against the trend of
    the break before is a CHOCH, any other a BOS.  A bar meets one pivot of each type,
    the latest confirmed one, by an as-of lookup.
    confluence: a crossing counts only on a bar whose longer wick is on the side that it
    breaks (upper for up); a pivot that fails stays open for a later crossing.
    external: pivots at the price of an external pivot of their type never break, but
    still take the place of the one before.  What does not count moves no trend.
    """
    upper, lower = F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    leans = F.when(upper > lower, 1).when(upper < lower, -1).otherwise(0) if confluence else F.lit(None).cast("int")
    b = bars.select("series_id", "bar_idx", "close", F.lag("close").over(series_window()).alias("before"), leans.alias("leans"))
    p = pivots.withColumn("shadowed", F.lit(False)) if external is None else shadowed(pivots, external)
    up = F.col("type") == "HIGH"
    crossed = F.when(up, (F.col("before") <= F.col("price")) & (F.col("close") > F.col("price"))).otherwise((F.col("before") >= F.col("price")) & (F.col("close") < F.col("price")))
    passes = F.col("leans") == F.when(up, 1).otherwise(-1) if confluence else F.lit(True)
    live = lambda t: as_of(b, p.where(F.col("type") == t), ["type", "pivot_idx", "confirm_idx", "price", "shadowed"], at="bar_idx", when="confirm_idx")
    met = live("HIGH").unionByName(live("LOW")).where(F.col("type").isNotNull() & crossed & passes & ~F.col("shadowed"))
    first = met.groupBy("series_id", "type", "pivot_idx", "confirm_idx", "price").agg(F.min("bar_idx").alias("break_idx"))
    e = first.withColumn("direction", F.when(up, 1).otherwise(-1).cast("long"))
    order = Window.partitionBy("series_id").orderBy("break_idx", F.desc("direction"), "pivot_idx")
    trend = F.lag("direction").over(order)
    name = F.when(trend.isNotNull() & (trend != F.col("direction")), "CHOCH").otherwise("BOS")
    side = F.when(F.col("direction") == 1, "_UP").otherwise("_DOWN")
    return e.select("series_id", F.concat(name, side).alias("event"), "direction", "break_idx", "pivot_idx", "price", (F.row_number().over(order)).cast("long").alias("event_no"))


def gaps(bars: DataFrame) -> DataFrame:
    """Fair-value gaps, published one bar late: bars i-3 and i-1 do not overlap."""
    w = series_window()
    h3, l3, h1, l1 = (F.lag(c, n).over(w) for c, n in (("high", 3), ("low", 3), ("high", 1), ("low", 1)))
    up, down = h3 < l1, l3 > h1
    g = bars.select("series_id", F.col("bar_idx").alias("gap_idx"), F.when(up, "BULLISH_FVG").when(down, "BEARISH_FVG").alias("type"), F.when(up, l1).when(down, l3).alias("top"), F.when(up, h3).when(down, h1).alias("bottom"))
    return g.where("type is not null")


def mitigated_gaps(bars: DataFrame) -> DataFrame:
    """Gaps with the first bar from their own on that touches them; the touched side is the near one."""
    g = gaps(bars).withColumn("level_id", F.col("gap_idx"))
    g = g.withColumn("near", F.when(F.col("type") == "BULLISH_FVG", F.col("top")).otherwise(F.col("bottom")))
    out = first_beyond(g, bars, start="gap_idx", price="near", above=F.col("type") == "BEARISH_FVG", equal=True, out="mitigated_idx")
    return out.drop("level_id", "near")


def order_blocks(events: DataFrame, bars: DataFrame, *, source: str = "highlow") -> DataFrame:
    """Per break: the last opposite candle of [pivot, break - 1], else the first extreme one; then first touch and invalidation.

    The last opposite candle before a bar is carried along by a window; only ranges
    without one are looked through.  source: what goes beyond the far side makes the
    block invalid, a high or low ("highlow") or a close ("close").
    """
    if source not in ("highlow", "close"):
        raise ValueError(f"unknown source {source!r}")
    e = events.where("break_idx > pivot_idx").select("series_id", "event_no", "event", "direction", "pivot_idx", "break_idx")
    up = F.col("direction") == 1
    box = F.struct("bar_idx", "high", "low")
    before = series_window().rowsBetween(Window.unboundedPreceding, -1)
    carried = bars.select("series_id", F.col("bar_idx").alias("break_idx"), F.last(F.when(F.col("close") < F.col("open"), box), ignorenulls=True).over(before).alias("_fall"), F.last(F.when(F.col("close") > F.col("open"), box), ignorenulls=True).over(before).alias("_rise"))
    met = kept(e.join(carried, ["series_id", "break_idx"]).withColumn("box", F.when(up, F.col("_fall")).otherwise(F.col("_rise"))).drop("_fall", "_rise"))
    found = F.coalesce(F.col("box.bar_idx") >= F.col("pivot_idx"), F.lit(False))
    span = met.where(~found).drop("box").withColumn("bar_idx", F.explode(F.sequence("pivot_idx", F.col("break_idx") - 1))).join(bars.select("series_id", "bar_idx", "high", "low"), ["series_id", "bar_idx"])
    rank = F.struct(F.when(up, -F.col("low")).otherwise(F.col("high")), -F.col("bar_idx"))
    b = met.where(found).unionByName(span.groupBy(*e.columns).agg(F.max_by(box, rank).alias("box")))
    b = b.select("series_id", F.col("event_no").alias("level_id"), F.when(up, "BULLISH_OB").otherwise("BEARISH_OB").alias("type"), F.col("box.bar_idx").alias("ob_idx"), "break_idx", F.col("box.high").alias("top"), F.col("box.low").alias("bottom"), (F.col("break_idx") + 1).alias("s"), "direction")
    b = b.withColumn("near", F.when(up, F.col("top")).otherwise(F.col("bottom"))).withColumn("far", F.when(up, F.col("bottom")).otherwise(F.col("top")))
    b = first_beyond(b, bars, start="s", price="near", above=~up, equal=True, out="touch_idx")
    by_close = {"up": "close", "down": "close"} if source == "close" else {}
    b = first_beyond(b, bars, start="s", price="far", above=~up, out="invalid_idx", **by_close)
    return b.select("series_id", F.col("level_id").alias("event_no"), "type", "ob_idx", "break_idx", "top", "bottom", "touch_idx", "invalid_idx")


def liquidity(pivots: DataFrame, bars: DataFrame, run_bars: int = 3) -> DataFrame:
    """Buy- and sell-side levels and what became of them.

    Swept by the first later bar beyond the level.  From there the first close back
    inside makes a GRAB (a SWEEP on the sweeping bar itself), the first run_bars
    closes in a row beyond it a RUN, whichever comes first.
    """
    up = F.col("type") == "HIGH"
    lv = pivots.select("series_id", F.row_number().over(Window.partitionBy("series_id").orderBy("confirm_idx", "type", "pivot_idx")).cast("long").alias("level_id"), F.when(up, "BSL").otherwise("SSL").alias("type"), F.col("confirm_idx").alias("created_idx"), "price")
    above = F.col("type") == "BSL"
    lv = first_beyond(lv.withColumn("s", F.col("created_idx") + 1), bars, start="s", price="price", above=above, out="swept_idx")
    held = bars.select("*", F.min("close").over(over(-(run_bars - 1), 0)).alias("run_low"), F.max("close").over(over(-(run_bars - 1), 0)).alias("run_high"))
    swept = lv.where("swept_idx is not null").withColumn("s2", F.col("swept_idx") + (run_bars - 1))
    swept = first_beyond(swept, bars, start="swept_idx", price="price", above=~above, up="close", down="close", out="g")
    swept = first_beyond(swept, held, start="s2", price="price", above=above, up="run_low", down="run_high", out="r")
    state = swept.select(
        "series_id", "level_id",
        F.when(F.col("g") == F.col("swept_idx"), "SWEEP").when(F.col("g").isNotNull() & (F.col("r").isNull() | (F.col("g") < F.col("r"))), "GRAB").when(F.col("r").isNotNull(), "RUN").otherwise("NONE").alias("class"),
        F.least("g", "r").alias("resolved_idx"),
    )
    out = lv.drop("s").join(state, ["series_id", "level_id"], "left")
    return out.withColumn("class", F.coalesce("class", F.lit("NONE"))).withColumn("state", F.when(F.col("resolved_idx").isNotNull(), "Resolved").when(F.col("swept_idx").isNotNull(), "Swept").otherwise("Detected"))


def supply_demand_zones(pivots: DataFrame, bars_with_atr: DataFrame, bars: DataFrame, *, height: float = 0.25, apart: float = 2.0, keep: int = 20, keep_broken: int = 5) -> DataFrame:
    """Zones at fractal pivots as of the last bar, admitted in order of confirmation.

    A zone is MITIGATED by the first bar that overlaps it from the second bar after
    its confirmation on, and BROKEN, for good, by the first close at or beyond its
    far side.  A pivot is rejected if a held zone of its type that is not broken as
    of the last bar has its middle within `apart` ATRs.  At most `keep` zones a type
    are held, the oldest leaves first; of the broken ones among them the last
    `keep_broken` to break stay.  Pivots without a positive ATR give no zone.  What is
    admitted depends on what was before, so that is a fold over pivots; touches and
    breaks of all candidates are found beforehand by lookups.
    """
    a = bars_with_atr.select("series_id", F.col("bar_idx").alias("confirm_idx"), "atr")
    p = pivots.join(a, ["series_id", "confirm_idx"]).where("atr > 0").withColumn("level_id", F.col("pivot_idx"))
    h = F.col("atr") * height
    supply = F.col("type") == "HIGH"
    z = p.select("series_id", "level_id", "pivot_idx", "confirm_idx", "atr", F.when(supply, "SUPPLY").otherwise("DEMAND").alias("type"), F.when(supply, F.col("price")).otherwise(F.col("price") + h).alias("top"), F.when(supply, F.col("price") - h).otherwise(F.col("price")).alias("bottom"))
    supply = F.col("type") == "SUPPLY"
    z = z.withColumn("poi", (F.col("top") + F.col("bottom")) / 2).withColumn("s", F.col("confirm_idx") + 1).withColumn("s2", F.col("confirm_idx") + 2)
    z = z.withColumn("far", F.when(supply, F.col("top")).otherwise(F.col("bottom"))).withColumn("near", F.when(supply, F.col("bottom")).otherwise(F.col("top")))
    z = first_beyond(z, bars, start="s", price="far", above=supply, up="close", down="close", equal=True, out="broken_idx")
    z = first_beyond(z, bars, start="s2", price="near", above=supply, equal=True, out="reached_idx")
    # Until a zone breaks its closes are on the near side, so reaching it is overlapping it; the breaking bar may leap over it.
    breaking = bars.select("series_id", F.col("bar_idx").alias("broken_idx"), F.col("high").alias("b_high"), F.col("low").alias("b_low"))
    z = z.join(breaking, ["series_id", "broken_idx"], "left")
    overlaps = (F.col("b_high") >= F.col("bottom")) & (F.col("b_low") <= F.col("top"))
    before = F.col("broken_idx").isNull() | (F.col("reached_idx") < F.col("broken_idx")) | ((F.col("reached_idx") == F.col("broken_idx")) & overlaps)
    z = z.withColumn("mitigated_idx", F.when(before, F.col("reached_idx")))
    kept = ["series_id", "type", "pivot_idx", "confirm_idx", "top", "bottom", "poi", "mitigated_idx", "broken_idx"]

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["confirm_idx", "pivot_idx"])
        held: dict[str, list[dict]] = {"SUPPLY": [], "DEMAND": []}
        for r in part.to_dict("records"):
            own = held[r["type"]]
            if not any(pd.isna(x["broken_idx"]) and abs(x["poi"] - r["poi"]) <= apart * r["atr"] for x in own):
                own.append(r)
                del own[:-keep]
        out = []
        for own in held.values():
            broken = sorted((x for x in own if not pd.isna(x["broken_idx"])), key=lambda x: x["broken_idx"])
            out += [x for x in own if pd.isna(x["broken_idx"])] + broken[-keep_broken:]
        return pd.DataFrame(out, columns=part.columns)[kept].astype({"mitigated_idx": "Int64", "broken_idx": "Int64"})

    found = z.groupBy("series_id").applyInPandas(fold, "series_id string, type string, pivot_idx long, confirm_idx long, top double, bottom double, poi double, mitigated_idx long, broken_idx long")
    state = F.when(F.col("broken_idx").isNotNull(), "BROKEN").when(F.col("mitigated_idx").isNotNull(), "MITIGATED").otherwise("ACTIVE")
    return found.withColumn("state", state)


def state_labels(rows: DataFrame) -> DataFrame:
    """IDLE, APPROACH, INTERACTION or EXPANSION from inside_fvg, inside_order_block, return_1, range_atr and nearest (least distance in ATRs, null if none)."""
    inside = (F.col("inside_fvg") == 1) | (F.col("inside_order_block") == 1)
    label = F.when(inside, "INTERACTION").when((F.abs("return_1") >= 0.0015) & (F.col("range_atr") >= 1), "EXPANSION").when(F.col("nearest") <= 1, "APPROACH").otherwise("IDLE")
    return rows.withColumn("state_label", label)


def outcomes(bars_with_atr: DataFrame, bars: DataFrame, horizon: int = 10) -> DataFrame:
    """RUN_UP or RUN_DOWN: which of close +- 1 ATR is touched first within the horizon; NONE if neither or both in one bar."""
    b = bars_with_atr.where("atr > 0").select("series_id", "bar_idx", F.col("bar_idx").alias("level_id"), (F.col("close") + F.col("atr")).alias("hi"), (F.col("close") - F.col("atr")).alias("lo"), (F.col("bar_idx") + 1).alias("s"), (F.col("bar_idx") + horizon).alias("u"))
    b = first_beyond(b, bars, start="s", price="hi", above=F.lit(True), equal=True, until="u", out="up_idx")
    b = first_beyond(b, bars, start="s", price="lo", above=F.lit(False), equal=True, until="u", out="down_idx")
    up, down = F.col("up_idx"), F.col("down_idx")
    return b.select("series_id", "bar_idx", F.when(up.isNotNull() & (down.isNull() | (up < down)), "RUN_UP").when(down.isNotNull() & (up.isNull() | (down < up)), "RUN_DOWN").otherwise("NONE").alias("outcome"))


def event_targets(bars: DataFrame, horizon: int = 10) -> DataFrame:
    """taken: SWEEP if both extremes of a bar are taken within the horizon, GRAB if one, NONE if none."""
    high = F.coalesce(F.max("high").over(over(1, horizon)) > F.col("high"), F.lit(False))
    low = F.coalesce(F.min("low").over(over(1, horizon)) < F.col("low"), F.lit(False))
    return bars.select("series_id", "bar_idx", F.when(high & low, "SWEEP").when(high | low, "GRAB").otherwise("NONE").alias("taken"))


def gated_targets(labelled: DataFrame, taken: DataFrame) -> DataFrame:
    """event_target: what is taken, for rows in INTERACTION or within a quarter ATR of something; else NONE."""
    near = (F.col("state_label") == "INTERACTION") | (F.col("nearest") <= 0.25)
    return labelled.join(taken, ["series_id", "bar_idx"], "left").withColumn("event_target", F.when(near, F.coalesce("taken", F.lit("NONE"))).otherwise("NONE")).drop("taken")
