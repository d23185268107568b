"""Volume profiles and the value area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import live
from tidemark.operators.bars import DAY, bucket


def overlap_bins(bars: DataFrame, bins: int = 48) -> DataFrame:
    """Volume per price bin of each series; a bar's volume is spread over the bins that its range overlaps, a flat bar's goes to its close's bin."""
    lo, hi = F.min("low").over(Window.partitionBy("series_id")), F.max("high").over(Window.partitionBy("series_id"))
    b = bars.select("series_id", "low", "high", "close", "volume", lo.alias("floor"), ((hi - lo) / bins).alias("step"))
    at = lambda c: F.least(F.floor((F.col(c) - F.col("floor")) / F.col("step")), F.lit(bins - 1))
    b = b.where("step > 0").withColumn("bin", F.explode(F.when(F.col("high") > F.col("low"), F.sequence(at("low"), at("high"))).otherwise(F.array(at("close")))))
    left = F.col("floor") + F.col("bin") * F.col("step")
    share = (F.least(F.col("high"), left + F.col("step")) - F.greatest(F.col("low"), left)) / (F.col("high") - F.col("low"))
    part = F.when(F.col("high") > F.col("low"), F.col("volume") * F.greatest(share, F.lit(0.0))).otherwise(F.col("volume"))
    return b.groupBy("series_id", "bin").agg(F.sum(part).alias("volume"), F.min(left).alias("low"))


def typical_bins(bars: DataFrame, bins: int = 24) -> DataFrame:
    """Volume per bin of the typical price."""
    lo, hi = F.min("low").over(Window.partitionBy("series_id")), F.max("high").over(Window.partitionBy("series_id"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    b = bars.select("series_id", "volume", typical.alias("typical"), lo.alias("floor"), ((hi - lo) / bins).alias("step")).where("step > 0")
    slot = F.least(F.floor((F.col("typical") - F.col("floor")) / F.col("step")), F.lit(bins - 1))
    return b.groupBy("series_id", slot.alias("bin")).agg(F.sum("volume").alias("volume"), F.min(F.col("floor")).alias("floor"), F.min("step").alias("step"))


def point_of_control(profile: DataFrame, *, ties: str = "last") -> DataFrame:
    """The bin with the most volume; ties to the last or the first bin."""
    side = F.col("bin") if ties == "last" else -F.col("bin")
    return profile.groupBy("series_id").agg(F.max_by("bin", F.struct("volume", side)).alias("poc"), F.max("volume").alias("poc_volume"))


def value_area(profile: DataFrame, bins: int = 48, share: float = 0.7, *, ties: str = "last") -> DataFrame:
    """(series_id, poc, val, vah): bins around the point of control, the larger neighbour first (up on ties), until they hold the share."""
    held = F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), "volume")))
    p = profile.groupBy("series_id").agg(held.alias("by_bin"), F.sum("volume").alias("total")).join(point_of_control(profile, ties=ties), "series_id")
    full = p.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("by_bin", i), F.lit(0.0))))
    at = lambda i: F.when((i >= 0) & (i < bins), F.get("v", i)).otherwise(F.lit(-1.0))
    poc = F.col("poc").cast("int")
    start = F.struct(poc.alias("lo"), poc.alias("hi"), at(poc).alias("acc"))

    def step(a, _):
        up, down = at(a["hi"] + 1), at(a["lo"] - 1)
        done = (a["acc"] >= F.col("total") * share) | ((up < 0) & (down < 0))
        right = up >= down
        return F.struct(F.when(done | right, a["lo"]).otherwise(a["lo"] - 1).alias("lo"), F.when(done | ~right, a["hi"]).otherwise(a["hi"] + 1).alias("hi"), F.when(done, a["acc"]).when(right, a["acc"] + up).otherwise(a["acc"] + down).alias("acc"))

    area = F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, step)
    return full.withColumn("area", area).select("series_id", F.col("poc").cast("long"), F.col("area.lo").cast("long").alias("val"), F.col("area.hi").cast("long").alias("vah"))


def area_of(volumes: Column, share: float, *, ties: str) -> Column:
    """Struct poc, lo, hi over an array of volumes: the fullest bin and the bins around it, the larger neighbour first (up on ties), until they hold the share."""
    last = F.size(volumes) - 1
    at = lambda i: F.when((i >= 0) & (i <= last), F.get(volumes, i)).otherwise(F.lit(-1.0))
    top = F.array_max(volumes)
    poc = (F.array_position(volumes, top) - 1) if ties == "first" else last - (F.array_position(F.reverse(volumes), top) - 1)
    poc = poc.cast("int")
    total = F.aggregate(volumes, F.lit(0.0), lambda a, v: a + v)
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)

    def step(a, _):
        up, down = at(a["hi"] + 1), at(a["lo"] - 1)
        done = (a["acc"] / total >= share) | ((up < 0) & (down < 0))
        right = up >= down
        return F.struct(a["poc"].alias("poc"), F.when(done | right, a["lo"]).otherwise(a["lo"] - 1).alias("lo"), F.when(done | ~right, a["hi"]).otherwise(a["hi"] + 1).alias("hi"), F.when(done, a["acc"]).when(right, a["acc"] + up).otherwise(a["acc"] + down).alias("acc"))

    return F.aggregate(F.sequence(F.lit(1), last), F.struct(poc.alias("poc"), poc.alias("lo"), poc.alias("hi"), at(poc).alias("acc")), step)


def _longest(ranges: DataFrame) -> DataFrame:
    """The longest range of each series: no range is made up of longer blocks, so bars are summed up in none."""
    return F.broadcast(ranges.groupBy("series_id").agg(F.max(F.col("last_idx") - F.col("first_idx")).alias("_long")).where("_long >= 0"))


def range_sums(bars: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """key, lo, hi, volume and turnover (typical price times volume) over the bars first_idx to last_idx of each range.

    Bars are summed up once per dyadic block; a range reads the blocks that make it up.
    """
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    b = bars.select("series_id", "bar_idx", "low", "high", "volume", (typical * F.col("volume")).alias("pv")).join(_longest(ranges), "series_id")
    nodes = b.withColumn("b", F.explode(live.ancestors(F.col("bar_idx"), F.col("_long")))).groupBy("series_id", F.col("b.scale").alias("scale"), F.col("b.node").alias("node"))
    nodes = nodes.agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.sum("volume").alias("volume"), F.sum("pv").alias("turnover"))
    asked = ranges.select(*dict.fromkeys(["series_id", *key]), F.explode(live.cover(F.col("first_idx"), F.col("last_idx"))).alias("b")).select("*", "b.scale", "b.node").drop("b")
    return asked.join(nodes, live.NODE).groupBy(*key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"))


def range_profiles(bars: DataFrame, ranges: DataFrame, key: list[str], bins: int = 24, *, sums: DataFrame | None = None) -> DataFrame:
    """key, lo, step and volumes (an array, a number per bin) of the typical prices of the bars first_idx to last_idx of each range, by `bins` equal bins from its lowest low to its highest high.

    ranges: series_id, key, first_idx, last_idx.  sums: key, lo, hi and volume of each
    range, if they are known (range_sums()).  Ranges have other edges each, so a
    bar is dealt to its dyadic blocks, a range's inner edges to the blocks that make it
    up, and in each block one running sum by price tells an edge the volume below it;
    bins are differences.  n log n for any number and length of ranges.  A typical
    price falls into bin floor((price - lo) / step), the last one at most: an edge is
    the least double that this takes over it.  Ranges without height have no volumes.
    """
    sums = range_sums(bars, ranges, key) if sums is None else sums
    sized = sums.select(*key, "lo", ((F.col("hi") - F.col("lo")) / bins).alias("step"), F.col("volume").alias("_whole"))
    told = ranges.join(sized, key).where("step > 0")
    guess = lambda k: F.col("lo") + k * F.col("step")
    half = F.abs(F.greatest(F.abs(F.col("lo")), F.abs(F.col("lo") + F.col("step") * bins))) * float(2.0**-53)  # steps of at most one unit in the last place
    near = lambda k: F.transform(F.sequence(F.lit(-6), F.lit(6)), lambda i: guess(k) + i * half)
    edge = lambda k: F.coalesce(F.array_min(F.filter(near(k), lambda x: F.floor((x - F.col("lo")) / F.col("step")) >= k)), guess(k))
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: F.struct(k.alias("k"), edge(k).alias("p")))
    told = told.withColumn("edges", edges)  # once a range, not once a block of it
    asked = told.select(*dict.fromkeys(["series_id", *key]), F.explode(live.cover(F.col("first_idx"), F.col("last_idx"))).alias("b"), "edges").select("*", "b.scale", "b.node").drop("b")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    b = bars.select("series_id", "bar_idx", typical.alias("p"), "volume").join(_longest(ranges), "series_id").withColumn("b", F.explode(live.ancestors(F.col("bar_idx"), F.col("_long"))))
    b = b.select("series_id", F.col("b.scale").alias("scale"), F.col("b.node").alias("node"), "p", "volume", F.lit(1).alias("side")).join(asked.select(*live.NODE).distinct(), live.NODE, "left_semi")
    names = [f"_key_{n}" for n in range(len(key))]
    points = asked.select(*live.NODE, *(F.col(c).alias(n) for n, c in zip(names, key, strict=True)), F.explode("edges").alias("e")).select(*live.NODE, *names, "e.k", "e.p", F.lit(0).alias("side"))
    run = Window.partitionBy(*live.NODE).orderBy("p", "side").rowsBetween(*live.RUN)
    below = b.unionByName(points, allowMissingColumns=True).withColumn("below", F.coalesce(F.sum("volume").over(run), F.lit(0.0))).where("side = 0")
    whole = told.select(*(F.col(c).alias(n) for n, c in zip(names, key, strict=True)), F.lit(bins).alias("k"), F.col("_whole").alias("below"))
    parts = below.select(*names, "k", "below").unionByName(whole).groupBy(*names, "k").agg(F.sum("below").alias("below")).groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("k", "below"))).alias("s"))
    volumes = F.transform("s", lambda x, i: x["below"] - F.coalesce(F.get("s", i - 1)["below"], F.lit(0.0)))
    back = parts.select(*(F.col(n).alias(c) for n, c in zip(names, key, strict=True)), volumes.alias("volumes"))
    return sized.drop("_whole").join(back, key, "left")


def range_areas(profiles: DataFrame, key: list[str], fallback: Column, share: float = 0.7) -> DataFrame:
    """key, poc, vah and val as the middles of bins; the fallback price where a range has no height.  The first fullest bin is the point of control."""
    area = area_of(F.col("volumes"), share, ties="first")
    middle = lambda c: F.when(F.col("area").isNull(), fallback).otherwise(F.col("lo") + (F.col(f"area.{c}") + 0.5) * F.col("step"))
    return profiles.withColumn("area", F.when(F.col("volumes").isNotNull(), area)).select(*key, middle("poc").alias("poc"), middle("hi").alias("vah"), middle("lo").alias("val"))


def in_range(bars: DataFrame, mode: str, *, first: int | None = None, last: int | None = None, events: DataFrame | None = None, until: int | None = None, recent: int = 500, session: int = DAY) -> DataFrame:
    """The bars of a profile's range, which ends at `until` (the last bar): VISIBLE (first to last), SESSION (the period of the last bar), BOS_CHOCH (from the last structure event on; HISTORICAL where there is none), HISTORICAL (the last `recent` bars).  Other modes count as VISIBLE."""
    b = bars if until is None else bars.where(F.col("bar_idx") <= until)
    top = b.groupBy("series_id").agg(F.max("bar_idx").alias("_top"), F.max(bucket(F.col("epoch"), session)).alias("_day"))
    if mode == "SESSION":
        return b.join(top, "series_id").where(bucket(F.col("epoch"), session) == F.col("_day")).drop("_top", "_day")
    if mode == "HISTORICAL":
        return b.join(top, "series_id").where(F.col("bar_idx") > F.col("_top") - max(recent, 1)).drop("_top", "_day")
    if mode == "BOS_CHOCH":
        seen = events if until is None else events.where(F.col("break_idx") <= until)
        anchor = seen.groupBy("series_id").agg(F.max("break_idx").alias("_at"))
        return b.join(top, "series_id").join(anchor, "series_id", "left").where(F.col("bar_idx") >= F.coalesce("_at", F.col("_top") - max(recent, 1) + 1)).drop("_top", "_day", "_at")
    return b.where(F.col("bar_idx").between(max(first or 0, 0), F.lit(last) if last is not None else F.col("bar_idx")))
