"""Indicators that framed windows express; all share one sort by bar_idx within a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import DAY, bucket, series_window
from tidemark.sources.files import kept


def over(a: int, b: int):
    return series_window().rowsBetween(a, b)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(b != 0, a / b).otherwise(0.0)


def true_range() -> Column:
    before = F.lag("close").over(series_window())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_true_range(bars: DataFrame) -> DataFrame:
    return bars.withColumn("tr", true_range())


def anatomy(bars: DataFrame, *, flat_position: float = 0.0) -> DataFrame:
    """Range, body, wicks, position of the close (flat_position where the range is 0) and direction."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.select(
        "*", (h - lo).alias("range"), F.abs(c - o).alias("body"), (h - F.greatest(o, c)).alias("upper_wick"), (F.least(o, c) - lo).alias("lower_wick"),
        F.when(h > lo, (c - lo) / (h - lo)).otherwise(flat_position).alias("close_position"), F.signum(c - o).cast("long").alias("direction"),
    )


def volume_stats(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean and population deviation of the n volumes before, with ratio and z-score; 0 where there are none."""
    w = over(-n, -1)
    mean, sd = F.coalesce(F.avg("volume").over(w), F.lit(0.0)), F.coalesce(F.stddev_pop("volume").over(w), F.lit(0.0))
    out = bars.withColumn("volume_mean", mean).withColumn("volume_std", sd)
    return out.withColumn("volume_ratio", ratio(F.col("volume"), F.col("volume_mean"))).withColumn("volume_zscore", ratio(F.col("volume") - F.col("volume_mean"), F.col("volume_std")))


def candle_stats(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean close of the last n bars; mean and sample deviation of the n volumes before."""
    sd = F.coalesce(F.when(F.count("volume").over(over(-n, -1)) > 1, F.stddev_samp("volume").over(over(-n, -1))), F.lit(0.0))
    return bars.select("*", F.avg("close").over(over(-(n - 1), 0)).alias("close_mean"), F.coalesce(F.avg("volume").over(over(-n, -1)), F.lit(0.0)).alias("volume_mean"), sd.alias("volume_std"))


def returns(bars: DataFrame, steps: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    cols = []
    for n in steps:
        base = F.lag("close", n).over(series_window())
        cols.append(F.coalesce(F.when(base != 0, (F.col("close") - base) / base), F.lit(0.0)).alias(f"return_{n}"))
    return bars.select("*", *cols)


def realized_volatility(bars: DataFrame, spans: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Sample deviation of one-bar returns over the last n bars."""
    base = returns(bars, (1,))
    return base.select("*", *(F.coalesce(F.stddev_samp("return_1").over(over(-(n - 1), 0)), F.lit(0.0)).alias(f"volatility_{n}") for n in spans))


def slopes(bars: DataFrame, spans: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Least-squares slope of the close over the last n bars; 0 below two bars."""
    x = F.col("bar_idx").cast("double")
    return bars.select("*", *(F.coalesce(F.regr_slope("close", x).over(over(-(n - 1), 0)), F.lit(0.0)).alias(f"slope_{n}") for n in spans))


def month_start(epoch: Column) -> Column:
    """Epoch of the first second of the month, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / DAY).cast("int"))
    return F.datediff(F.trunc(day, "month"), F.lit("1970-01-01").cast("date")).cast("long") * DAY


def anchored_vwap(bars: DataFrame, period: int | str = DAY) -> DataFrame:
    """Volume-weighted typical price since the period (seconds, or "month") began, with deviation and bands; null before the first volume."""
    anchor = month_start(F.col("epoch")) if period == "month" else bucket(F.col("epoch"), period)
    return vwap_since(bars.withColumn("anchor", anchor))


def vwap_from(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """The same from chosen bars on: anchors has series_id and anchor_idx (one before the first bar means the first, a null or later one gives no rows)."""
    chosen = anchors.where("anchor_idx is not null").select("series_id", F.greatest("anchor_idx", F.lit(0)).cast("long").alias("anchor")).distinct()
    return vwap_since(bars.join(chosen, "series_id").where(F.col("bar_idx") >= F.col("anchor")))


def vwap_since(bars: DataFrame) -> DataFrame:
    """VWAP, deviation and bands of each series and anchor, bar by bar."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.greatest(F.col("volume"), F.lit(0.0))
    w = Window.partitionBy("series_id", "anchor").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    base = bars.withColumn("typical", typical).withColumn("v", volume)
    total = F.sum("v").over(w)
    out = base.select("*", (F.sum(F.col("typical") * F.col("v")).over(w) / F.nullif(total, F.lit(0.0))).alias("vwap"), (F.sum(F.col("typical") ** 2 * F.col("v")).over(w) / F.nullif(total, F.lit(0.0))).alias("square"))
    out = out.withColumn("stdev", F.sqrt(F.greatest(F.col("square") - F.col("vwap") ** 2, F.lit(0.0))))
    bands = [(F.col("vwap") + s * k * F.col("stdev")).alias(f"{name}_{k}") for k in (1, 2, 3) for s, name in ((1, "upper"), (-1, "lower"))]
    return out.drop("square", "typical", "v").select("*", *bands)


def _block_runs(value: Column, n: int, best, skip: int) -> tuple[Column, Column]:
    """best of the value from the beginning of the bar's block of n bars to the bar, and from the bar to the block's end."""
    v = value if not skip else F.when(F.col("bar_idx") >= skip, value)
    block = F.floor(F.col("bar_idx") / F.lit(n))
    own = Window.partitionBy("series_id", block)
    begun = best(v).over(own.orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0))
    rest = best(v).over(own.orderBy(F.desc("bar_idx")).rowsBetween(Window.unboundedPreceding, 0))
    return begun, rest


#: What joins the parts of a range.
_BOTH = {F.max: F.greatest, F.min: F.least, F.sum: lambda a, b: F.coalesce(F.col(a) + F.col(b), a, b)}


def trailing_extremes(bars: DataFrame, n: int, made: dict[str, tuple[Column, object]], *, skip: int = 0) -> DataFrame:
    """bars with columns over the last n bars, name: (value, F.max, F.min or F.sum); null where no value counts.

    The last n bars are the end of one block of n bars and the beginning of the next,
    so two running windows do, whatever n is.  Bars before `skip` do not count.
    """
    parts = {c: _block_runs(v, n, best, skip) for c, (v, best) in made.items()}
    own = bars.select("*", *(p[0].alias(f"_b_{c}") for c, p in parts.items()), *(p[1].alias(f"_r_{c}") for c, p in parts.items()))
    # n - 1 bars back begins the end of the block before; on a block's last bar the block is the whole, and the first n bars have none before.
    back = {c: F.lag(f"_r_{c}", n - 1).over(series_window()) for c in made}
    whole = F.col("bar_idx") % n == n - 1
    picked = own.select("*", *(F.when(whole, F.lit(None)).otherwise(v).alias(f"_l_{c}") for c, v in back.items()))
    join = {c: _BOTH[best](f"_b_{c}", f"_l_{c}") for c, (_, best) in made.items()}
    return picked.select(*bars.columns, *(v.alias(c) for c, v in join.items()))


def trailing_at(points: DataFrame, bars: DataFrame, n: int, made: dict[str, tuple[Column, object]], *, at: str = "bar_idx", skip: int = 0) -> DataFrame:
    """points (series_id, `at`) whose bar there is, with the columns that trailing_extremes() gives that bar.

    A point reads two bars, its own and the one n - 1 bars back, so nothing but blocks
    of n bars is put in order.
    """
    parts = {c: _block_runs(v, n, best, skip) for c, (v, best) in made.items()}
    begun = bars.select("series_id", F.col("bar_idx").alias(at), *(p[0].alias(f"_b_{c}") for c, p in parts.items()))
    rest = bars.select("series_id", (F.col("bar_idx") + (n - 1)).alias(at), *(p[1].alias(f"_r_{c}") for c, p in parts.items()))
    met = points.join(begun, ["series_id", at])
    if n == 1:
        return met.select(*points.columns, *(F.col(f"_b_{c}").alias(c) for c in made))
    met = met.join(rest.where(F.col(at) % n != n - 1), ["series_id", at], "left")  # on a block's last bar the block is the whole
    return met.select(*points.columns, *(_BOTH[best](f"_b_{c}", f"_r_{c}").alias(c) for c, (_, best) in made.items()))


def trailing_blocks(bars: DataFrame, events: DataFrame, size: int, count: int = 20) -> DataFrame:
    """For each event (series_id, event_idx): `count` blocks of `size` bars that end at it, block 0 the latest; the oldest may be short."""
    bars = kept(bars)
    ends = events.select("series_id", "event_idx", F.explode(F.sequence(F.lit(0), F.least(F.lit(count - 1), F.floor(F.col("event_idx") / F.lit(size)).cast("int")))).alias("n")).where("event_idx >= 0").select("series_id", "event_idx", F.col("n").cast("long").alias("block"))
    ends = ends.withColumn("bar_idx", F.col("event_idx") - F.col("block") * size)
    held = trailing_at(ends, bars, size, {"high": (F.col("high"), F.max), "low": (F.col("low"), F.min), "volume": (F.col("volume"), F.sum)})
    begin = bars.groupBy("series_id").agg(F.min("bar_idx").alias("_begin"))
    held = held.join(bars.select("series_id", "bar_idx", "close"), ["series_id", "bar_idx"]).join(begin, "series_id").withColumn("_first", F.greatest(F.col("bar_idx") - (size - 1), F.col("_begin")))
    return held.join(bars.select("series_id", F.col("bar_idx").alias("_first"), "open"), ["series_id", "_first"]).select("series_id", "event_idx", "block", "open", "high", "low", "close", "volume")


def support_resistance(bars: DataFrame, spans: tuple[int, ...] = (240, 1440, 10080)) -> DataFrame:
    """Distance from the mid price up to the highest high and down to the lowest low of the last n bars."""
    mid = (F.col("high") + F.col("low")) / 2
    out = bars
    for n in spans:
        out = trailing_extremes(out, n, {f"resistance_{n}": (F.col("high"), F.max), f"support_{n}": (F.col("low"), F.min)})
    return out.select(*bars.columns, *(x for n in spans for x in ((F.col(f"resistance_{n}") - mid).alias(f"resistance_{n}"), (mid - F.col(f"support_{n}")).alias(f"support_{n}"))))


def _strongest(pip: float) -> dict[str, tuple[Column, object]]:
    """The strongest up and down bars, as trailing_extremes() takes them; the earliest wins ties."""
    body = F.col("close") - F.col("open")
    score = F.abs(body) / F.greatest(F.col("high") - F.col("low"), F.lit(pip)) * F.col("volume")
    own = lambda sign, price: F.when(F.signum(body) == sign, F.struct(score.alias("score"), (-F.col("bar_idx")).alias("first"), F.col(price).alias("price")))
    return {"demand": (own(1, "low"), F.max), "supply": (own(-1, "high"), F.max)}


def supply_demand_score(bars: DataFrame, n: int = 240, pip: float = 0.25) -> DataFrame:
    """demand: the low of the strongest up bar, supply: the high of the strongest down bar of the last n + 1, never bar 0; the earliest wins ties, the mid price stands in where there is none."""
    mid = (F.col("high") + F.col("low")) / 2
    out = trailing_extremes(bars, n + 1, _strongest(pip), skip=1)
    return out.select(*bars.columns, *(F.coalesce(F.col(c)["price"], mid).alias(c) for c in ("demand", "supply")))


def wide_windows(events: DataFrame, bars: DataFrame, spans: tuple[int, ...] = (240, 1440, 10080), n: int = 240, pip: float = 0.25) -> DataFrame:
    """events (series_id, event_idx) with the bar's high and low and what support_resistance() and supply_demand_score() give it."""
    out = events.join(bars.select("series_id", F.col("bar_idx").alias("event_idx"), "high", "low"), ["series_id", "event_idx"])
    for span in spans:
        out = trailing_at(out, bars, span, {f"resistance_{span}": (F.col("high"), F.max), f"support_{span}": (F.col("low"), F.min)}, at="event_idx")
    out = trailing_at(out, bars, n + 1, _strongest(pip), at="event_idx", skip=1)
    mid = (F.col("high") + F.col("low")) / 2
    sides = [x for span in spans for x in ((F.col(f"resistance_{span}") - mid).alias(f"resistance_{span}"), (mid - F.col(f"support_{span}")).alias(f"support_{span}"))]
    return out.select(*events.columns, "high", "low", *sides, *(F.coalesce(F.col(c)["price"], mid).alias(c) for c in ("demand", "supply")))


def rolling_vwap(bars: DataFrame, n: int = 60) -> DataFrame:
    """Close less the volume-weighted typical price of the last n bars; the mid price stands in without volume."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    w = over(-(n - 1), 0)
    vwap = F.coalesce(F.sum(typical * F.col("volume")).over(w) / F.nullif(F.sum("volume").over(w), F.lit(0.0)), (F.col("high") + F.col("low")) / 2)
    return bars.withColumn("vwap_distance", F.col("close") - vwap)


def fib_distances(bars: DataFrame, n: int = 20, ratios: tuple[float, ...] = (0.382, 0.5, 0.618)) -> DataFrame:
    hi, lo = F.max("high").over(over(-(n - 1), 0)), F.min("low").over(over(-(n - 1), 0))
    return bars.select("*", *((F.col("close") - (lo + (hi - lo) * r)).alias(f"fib_{int(r * 1000)}") for r in ratios))


def _traces(horizons: tuple[int, ...]) -> list[Column]:
    """trace_h of the arrays highs and lows: a bar's own value and those after it."""

    def fold(values: str, h: int, beyond) -> Column:
        start = F.struct(F.col(values)[0].alias("edge"), F.lit(0).alias("n"))
        ahead = F.slice(F.col(values), 2, h)
        return F.aggregate(ahead, start, lambda a, v: F.struct(F.when(beyond(v, a["edge"]), v).otherwise(a["edge"]).alias("edge"), (a["n"] + beyond(v, a["edge"]).cast("int")).alias("n")), lambda a: a["n"])

    return [(fold("highs", h, lambda v, e: v > e) + fold("lows", h, lambda v, e: v < e)).cast("long").alias(f"trace_{h}") for h in horizons]


def trace_counts(bars: DataFrame, horizons: tuple[int, ...] = (3, 5, 10, 15)) -> DataFrame:
    """Per bar: new running highs plus new running lows among the next h bars."""
    top = max(horizons)
    highs, lows = F.collect_list("high").over(over(0, top)), F.collect_list("low").over(over(0, top))
    return bars.withColumn("highs", highs).withColumn("lows", lows).select("*", *_traces(horizons)).drop("highs", "lows")


def traces_at(events: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (3, 5, 10, 15)) -> DataFrame:
    """series_id, event_idx and what trace_counts() gives the bars of events (series_id, event_idx, told apart by both): only bars that follow an event are read."""
    ahead = events.select("series_id", "event_idx", F.explode(F.sequence(F.lit(0), F.lit(max(horizons)))).alias("n")).withColumn("bar_idx", F.col("event_idx") + F.col("n"))
    met = ahead.join(bars.select("series_id", "bar_idx", "high", "low"), ["series_id", "bar_idx"])
    held = met.groupBy("series_id", "event_idx").agg(F.min("n").alias("_n"), F.array_sort(F.collect_list(F.struct("n", "high", "low"))).alias("held")).where("_n = 0")
    return held.select("series_id", "event_idx", F.transform("held", lambda x: x["high"]).alias("highs"), F.transform("held", lambda x: x["low"]).alias("lows")).select("series_id", "event_idx", *_traces(horizons))
