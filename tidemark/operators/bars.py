"""Ticks to bars, coarser bars, and lookups by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY, WEEK = 86_400, 604_800
#: Minutes of the timeframes that are built together; D and W are calendar days and Monday weeks.
TIMEFRAMES = {"5": 300, "15": 900, "60": 3_600, "120": 7_200, "240": 14_400, "D": DAY, "W": WEEK}


def epoch_of(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock timestamp, whatever the session's time zone."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return day * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def bucket(epoch: Column, seconds: int, *, week: str = "monday") -> Column:
    """Start of the bucket; weeks start on Monday, or on Thursday as the epoch did ("epoch")."""
    shift = 4 * DAY if seconds == WEEK and week == "monday" else 0
    return F.floor((epoch - shift) / seconds).cast("long") * seconds + shift


def series_window() -> Window:
    return Window.partitionBy("series_id").orderBy("bar_idx")


def with_index(bars: DataFrame) -> DataFrame:
    """bar_idx by time within each series."""
    return bars.withColumn("bar_idx", (F.row_number().over(Window.partitionBy("series_id").orderBy("epoch")) - 1).cast("long"))


def from_ticks(ticks: DataFrame, *, series: str, ts: str, price: str, tie: str, seconds: int = 3600) -> DataFrame:
    """Bars of ticks; volume counts ticks; ticks at the same time are ordered by `tie`."""
    at = F.struct(ts, tie)
    made = ticks.groupBy(F.col(series).alias("series_id"), bucket(epoch_of(F.col(ts)), seconds).alias("epoch")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return with_index(made)


def resample(bars: DataFrame, seconds: int, *, week: str = "monday") -> DataFrame:
    """Coarser bars."""
    made = bars.groupBy("series_id", bucket(F.col("epoch"), seconds, week=week).alias("start")).agg(
        F.min_by("open", "epoch").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "epoch").alias("close"), F.sum("volume").alias("volume")
    )
    return with_index(made.withColumnRenamed("start", "epoch"))


def timeframes(bars: DataFrame, which: dict[str, int] | None = None) -> DataFrame:
    """All timeframes of a series at once, in one aggregation; column tf says which."""
    chosen = which or TIMEFRAMES
    starts = F.array(*(F.struct(F.lit(name).alias("tf"), bucket(F.col("epoch"), s).alias("start")) for name, s in chosen.items()))
    made = bars.withColumn("at", F.explode(starts)).groupBy("series_id", "at.tf", "at.start").agg(
        F.min_by("open", "epoch").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "epoch").alias("close"), F.sum("volume").alias("volume")
    )
    order = Window.partitionBy("series_id", "tf").orderBy("epoch")
    return made.withColumnRenamed("start", "epoch").withColumn("bar_idx", (F.row_number().over(order) - 1).cast("long"))


def upsert_last(bars: DataFrame, delta: DataFrame) -> DataFrame:
    """bars with delta's rows; for the same series and time the later arrival (column arrival) wins."""
    both = bars.unionByName(delta)
    row = F.struct(*(c for c in bars.columns if c not in ("series_id", "epoch")))
    return both.groupBy("series_id", "epoch").agg(F.max_by(row, "arrival").alias("row")).select("series_id", "epoch", "row.*")


def between(bars: DataFrame, first: int, last: int) -> DataFrame:
    """Bars first to last, inclusive; none if last < first."""
    return bars.where(F.col("bar_idx").between(first, last))


def time_anchors(bars: DataFrame) -> DataFrame:
    """Bars on a new day or on a quarter of an hour."""
    day = F.floor(F.col("epoch") / DAY)
    new = day != F.lag(day, 1, -1).over(series_window())
    return bars.withColumn("new_day", new).where(F.col("new_day") | (F.floor(F.col("epoch") / 60) % 15 == 0))


def round_to_tick(v: Column, tick: float) -> Column:
    """Half away from zero."""
    return F.round(v / tick) * tick


def nice_step(span: Column, pixels: float = 100) -> Column:
    """The smallest of 1, 2, 5 and 10 times a power of ten that is no less than the span of 70 pixels.

    The power's exponent is cut towards 0; 1 stands in where the span is not above 0.
    """
    v = span / F.lit((pixels if pixels > 0 else 100) / 70)
    power = F.pow(F.lit(10.0), (F.log(v) / F.log(F.lit(10.0))).cast("long"))
    f = v / power
    return F.when(v.isNull() | (v <= 0), 1.0).otherwise(F.when(f <= 1, 1.0).when(f <= 2, 2.0).when(f <= 5, 5.0).otherwise(10.0) * power)


def point(bars: DataFrame, index: int) -> DataFrame:
    """The bar at an index of each series; negative indexes count from the end."""
    if index >= 0:
        return bars.where(F.col("bar_idx") == index)
    top = bars.groupBy("series_id").agg((F.max("bar_idx") + 1 + index).alias("bar_idx"))
    return bars.join(top, ["series_id", "bar_idx"])


def sizes(bars: DataFrame) -> DataFrame:
    """Per series: number of bars, last index and last timestamp."""
    return bars.groupBy("series_id").agg(F.count("*").alias("size"), F.max("bar_idx").alias("last_index"), F.max("epoch").alias("last_epoch"))


def thousands(v: Column) -> Column:
    """1,234 as 1.2K."""
    return F.when(v >= 1000, F.format_string("%.1fK", v / 1000)).otherwise(F.format_string("%.0f", v))


def day_label(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def in_view(df: DataFrame, first: int, last: int, *, start: str, end: str) -> DataFrame:
    """Intervals that overlap the bars first to last; a null end is open."""
    return df.where((F.col(start) <= last) & (F.coalesce(F.col(end), F.lit(last)) >= first))


def last_defined(df: DataFrame, column: str) -> DataFrame:
    """The last value of each series that is not null."""
    return df.where(F.col(column).isNotNull()).groupBy("series_id").agg(F.max_by(column, "bar_idx").alias(column), F.max("bar_idx").alias("bar_idx"))


def value_ranges(bars: DataFrame, first: int, last: int, low: str = "low", high: str = "high") -> DataFrame:
    """Least and greatest of the bars in view; nulls do not count."""
    return bars.where(F.col("bar_idx").between(first, last)).groupBy("series_id").agg(F.min(low).alias("least"), F.max(high).alias("greatest"))
