"""Pivots: leg changes, fractals, and the two zig-zags."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import bucket, series_window
from tidemark.operators.windows import over

BEFORE = (Window.unboundedPreceding, 0)


def leg_pivots(bars: DataFrame, size: int = 5) -> DataFrame:
    """(series_id, pivot_idx, confirm_idx, type, price): where the leg flips.

    At bar i the candidate is bar i - size.  Its high above all later highs starts a
    down leg (first choice), its low below all later lows an up leg; legs start down.
    """
    w = series_window()
    high, low = F.lag("high", size).over(w), F.lag("low", size).over(w)
    after = over(-(size - 1), 0)
    signal = F.when(high > F.max("high").over(after), 0).when(low < F.min("low").over(after), 1)
    legs = bars.select("series_id", "bar_idx", high.alias("h"), low.alias("l"), signal.alias("signal"))
    legs = legs.withColumn("leg", F.coalesce(F.last("signal", ignorenulls=True).over(w.rowsBetween(*BEFORE)), F.lit(0)))
    flips = legs.where("h is not null").withColumn("was", F.lag("leg", 1, 0).over(w)).where("leg <> was")
    return flips.select("series_id", (F.col("bar_idx") - size).alias("pivot_idx"), F.col("bar_idx").alias("confirm_idx"), F.when(F.col("leg") == 1, "LOW").otherwise("HIGH").alias("type"), F.when(F.col("leg") == 1, F.col("l")).otherwise(F.col("h")).alias("price"))


def fractal_pivots(bars: DataFrame, size: int = 10) -> DataFrame:
    """Bars whose high (else low) is strictly beyond all `size` neighbours on both sides."""
    full = (F.count("high").over(over(-size, -1)) == size) & (F.count("high").over(over(1, size)) == size)
    top = F.greatest(F.max("high").over(over(-size, -1)), F.max("high").over(over(1, size)))
    bottom = F.least(F.min("low").over(over(-size, -1)), F.min("low").over(over(1, size)))
    kind = F.when(F.col("high") > top, "HIGH").when(F.col("low") < bottom, "LOW")
    found = bars.select("*", kind.alias("type"), full.alias("full")).where("full and type is not null")
    return found.select("series_id", F.col("bar_idx").alias("pivot_idx"), (F.col("bar_idx") + size).alias("confirm_idx"), "type", F.when(F.col("type") == "HIGH", F.col("high")).otherwise(F.col("low")).alias("price"))


def zigzag_mtf(bars: DataFrame, seconds: int = 14_400, periods: int = 2) -> DataFrame:
    """Zig-zag over buckets: a bar is a candidate if it is the highest (lowest) since the first bar of the (periods - 1)-th bucket before its own.

    The direction turns on an unambiguous candidate; each run of one direction
    yields its most extreme candidate, the earliest on ties.
    """
    w = series_window()
    b = bars.withColumn("bucket", bucket(F.col("epoch"), seconds))
    nth = F.dense_rank().over(Window.partitionBy("series_id").orderBy("bucket"))
    b = b.withColumn("nth", nth)
    own = Window.partitionBy("series_id", "nth").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    # buckets before the own one count whole, the own one up to the bar
    if periods > 1:
        before = Window.partitionBy("series_id").orderBy("nth").rangeBetween(-(periods - 1), -1)
        top = F.greatest(F.max("high").over(before), F.max("high").over(own))
        bottom = F.least(F.min("low").over(before), F.min("low").over(own))
    else:
        top, bottom = F.max("high").over(own), F.min("low").over(own)
    b = b.withColumn("ph", F.col("high") >= top).withColumn("pl", F.col("low") <= bottom)
    turn = F.when(F.col("ph") & ~F.col("pl"), 1).when(F.col("pl") & ~F.col("ph"), -1)
    b = b.withColumn("dir", F.last(turn, ignorenulls=True).over(w.rowsBetween(*BEFORE))).where("dir is not null and (ph or pl)")
    island = F.sum(F.coalesce((F.col("dir") != F.lag("dir").over(w)).cast("int"), F.lit(0))).over(w.rowsBetween(*BEFORE))
    price = F.when(F.col("dir") == 1, F.col("high")).otherwise(F.col("low"))
    b = b.withColumn("island", island).withColumn("price", price)
    rank = F.struct(F.col("price") * F.col("dir"), -F.col("bar_idx"))
    best = b.groupBy("series_id", "island", "dir").agg(F.max_by("bar_idx", rank).alias("pivot_idx"), F.max_by("price", rank).alias("price"))
    return best.select("series_id", "pivot_idx", F.when(F.col("dir") == 1, "HIGH").otherwise("LOW").alias("type"), "price")


def fold_swings(points: list[tuple[int, str, float]]) -> list[tuple[int, str, float]]:
    """Same bar and type: replace; same type: keep the strictly more extreme one; else append."""
    out: list[tuple[int, str, float]] = []
    for p in points:
        if out and out[-1][1] == p[1]:
            better = p[2] > out[-1][2] if p[1] == "HIGH" else p[2] < out[-1][2]
            if out[-1][0] == p[0] or better:
                out[-1] = p
        else:
            out.append(p)
    return out


def swing_pivots(bars: DataFrame, length: int = 150) -> DataFrame:
    """External zig-zag: legs and candidates by windows, then an ordered fold over the few pivots.

    A leg turns up when the bar is the highest of the last `length`, down when it is
    the lowest (which wins).  Candidates are bars that were extreme when they came and
    are so no longer one bar later.  A flip emits both sides; while a leg lasts its
    last pivot follows the newest candidate.  The confirmation is the pivot's own bar,
    as in the original rule; use leg_pivots() where look-ahead must not happen.
    """
    w, frame = series_window(), over(-(length - 1), 0)
    top, bottom = F.max("high").over(frame), F.min("low").over(frame)
    b = bars.select("series_id", "bar_idx", "high", "low", top.alias("top"), bottom.alias("bottom"))
    prev = {c: F.lag(c).over(w) for c in ("high", "low", "top", "bottom")}
    signal = F.when(F.col("low") <= F.col("bottom"), 0).when(F.col("high") >= F.col("top"), 1)
    back = F.col("bar_idx") - 1
    h = F.when((prev["high"] >= prev["top"]) & (F.col("high") < F.col("top")), F.struct(back.alias("i"), prev["high"].alias("p")))
    lo = F.when((prev["low"] <= prev["bottom"]) & (F.col("low") > F.col("bottom")), F.struct(back.alias("i"), prev["low"].alias("p")))
    b = b.withColumn("s", F.when(F.col("bar_idx") >= 1, signal)).withColumn("hc", h).withColumn("lc", lo)
    run = w.rowsBetween(*BEFORE)
    b = b.select("series_id", "bar_idx", *(F.last(c, ignorenulls=True).over(run).alias(n) for c, n in (("s", "bull"), ("hc", "h"), ("lc", "l")))).where("bull is not null")
    b = b.withColumn("island", F.sum(F.coalesce((F.col("bull") != F.lag("bull").over(w)).cast("int"), F.lit(0))).over(run))
    legs = b.groupBy("series_id", "island", "bull").agg(*(f(c, "bar_idx").alias(f"{n}_{c}") for f, n in ((F.min_by, "first"), (F.max_by, "last")) for c in ("h", "l")))
    flat = legs.select("series_id", "island", "bull", *(F.col(f"{n}_{c}.{x}").alias(f"{n}_{c}_{x}") for n in ("first", "last") for c in ("h", "l") for x in ("i", "p")))

    def fold(part: pa.Table) -> pa.Table:
        points: list[tuple[int, str, float]] = []
        for k, r in enumerate(part.sort_by("island").to_pylist()):
            at = lambda n, c, r=r: (r[f"{n}_{c}_i"], "HIGH" if c == "h" else "LOW", r[f"{n}_{c}_p"])
            emits = k > 0 and r["first_h_i"] is not None and r["first_l_i"] is not None
            side = "h" if r["bull"] == 1 else "l"
            if emits:
                points += [at("first", "l" if side == "h" else "h"), at("last", side)]
            elif points and points[-1][1] == ("HIGH" if side == "h" else "LOW") and r[f"last_{side}_i"] is not None:
                points[-1] = at("last", side)
        rows = fold_swings(points)
        where = pa.array([p[0] for p in rows], pa.int64())
        return pa.table({"series_id": pa.array([part["series_id"][0].as_py()] * len(rows), part.schema.field("series_id").type), "pivot_idx": where, "confirm_idx": where, "type": pa.array([p[1] for p in rows], pa.string()), "price": pa.array([p[2] for p in rows], pa.float64())})

    return flat.groupBy("series_id").applyInArrow(fold, f"series_id {bars.schema['series_id'].dataType.simpleString()}, pivot_idx long, confirm_idx long, type string, price double")


def labels(pivots: DataFrame) -> DataFrame:
    """HH, LH, HL, LL against the last pivot of the same type; H or L for the first."""
    before = F.lag("price").over(Window.partitionBy("series_id", "type").orderBy("pivot_idx"))
    p = F.col("price")
    high = F.when(before.isNull(), "H").when(p > before, "HH").otherwise("LH")
    low = F.when(before.isNull(), "L").when(p > before, "HL").otherwise("LL")
    return pivots.withColumn("label", F.when(F.col("type") == "HIGH", high).otherwise(low))


def equal_levels(pivots: DataFrame, bars_with_atr: DataFrame, share: float = 0.1) -> DataFrame:
    """Neighbouring pivots of one type, among those with an ATR above 0, whose prices differ by less than share of the ATR at confirmation."""
    a = bars_with_atr.select("series_id", F.col("bar_idx").alias("confirm_idx"), "atr")
    w = Window.partitionBy("series_id", "type").orderBy("confirm_idx")
    p = pivots.join(a, ["series_id", "confirm_idx"]).where("atr > 0")
    p = p.withColumn("idx1", F.lag("pivot_idx").over(w)).withColumn("price1", F.lag("price").over(w))
    close = F.abs(F.col("price") - F.col("price1")) < F.col("atr") * share
    return p.where(close).select("series_id", F.when(F.col("type") == "HIGH", "EQH").otherwise("EQL").alias("type"), "idx1", F.col("pivot_idx").alias("idx2"), F.col("confirm_idx").alias("confirm2"), "price1", F.col("price").alias("price2"))


def fibonacci(pivots: DataFrame, ratios: tuple[float, ...] = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)) -> DataFrame:
    """Levels b + (a - b) * ratio between the last two pivots, a before b."""
    w = Window.partitionBy("series_id").orderBy(F.desc("pivot_idx"))
    two = pivots.withColumn("n", F.row_number().over(w)).where("n <= 2")
    ends = two.groupBy("series_id").agg(F.max(F.when(F.col("n") == 2, F.col("price"))).alias("a"), F.max(F.when(F.col("n") == 1, F.col("price"))).alias("b")).where("a is not null")
    return ends.withColumn("ratio", F.explode(F.array(*(F.lit(r) for r in ratios)))).select("series_id", "ratio", (F.col("b") + (F.col("a") - F.col("b")) * F.col("ratio")).alias("price"))
