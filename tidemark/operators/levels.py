"""The lookups that the detectors share: first bar beyond a level, as-of, nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block of the index holds FAN bars, a block of the next scale FAN blocks, up to scale TOP.
FAN, TOP = 128, 2


def first_beyond(levels: DataFrame, bars: DataFrame, *, start: str, price: str, above: Column, up: str = "high", down: str = "low", equal: bool = False, out: str = "first_idx", until: str | None = None) -> DataFrame:
    """levels with the first bar_idx >= start whose `up` exceeds the price (above) or whose `down` falls below it, else null.

    Levels need series_id and a unique level_id.  Bars are summed up in blocks of
    FAN, FAN**2, ... bars by their extremes.  What follows a bar is covered by the
    rest of its block, the later blocks of the block above, and so on: a level meets
    at most FAN blocks of a scale (of the top one, those of FAN**TOP bars, all later
    ones), takes the first that qualifies and opens it downwards, FAN parts at a time.
    Every join is on equal keys.
    equal: touching counts.  until: a column of the last bar that may count.
    """
    beyond = (lambda value, p: value >= p) if equal else (lambda value, p: value > p)
    under = (lambda value, p: value <= p) if equal else (lambda value, p: value < p)
    key = ["series_id", "level_id"]
    lv = levels.select(*key, F.col(start).alias("s"), F.col(price).alias("p"), above.alias("is_up"), *([F.col(until).alias("u")] if until else []))
    hit = F.when(F.col("is_up"), beyond(F.col("top"), F.col("p"))).otherwise(under(F.col("bottom"), F.col("p")))
    block = lambda at, scale: F.floor(at / F.lit(FAN**scale))
    one = bars.select("series_id", F.col("bar_idx").cast("long").alias("blk"), F.col(up).alias("top"), F.col(down).alias("bottom"))
    summed = lambda scale: one.groupBy("series_id", block(F.col("blk"), scale).alias("blk")).agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"))
    if until:  # the blocks between start and end are few and known
        met = lv.withColumn("blk", F.explode(F.sequence(block(F.col("s"), 1), block(F.greatest("u", "s"), 1)))).join(summed(1), ["series_id", "blk"]).where(hit)
        two = met.groupBy(*key, "s", "p", "is_up", "u").agg(F.min(F.when(F.col("blk") == block(F.col("s"), 1), F.col("blk"))).alias("a"), F.min(F.when(F.col("blk") > block(F.col("s"), 1), F.col("blk"))).alias("b"))
        opened = two.withColumn("parent", F.explode(F.array("a", "b"))).where("parent is not null")
        inside = one.withColumn("parent", block(F.col("blk"), 1))
        ok = hit & (F.col("blk") >= F.col("s")) & (F.col("blk") <= F.col("u"))
        first = opened.join(inside, ["series_id", "parent"]).where(ok).groupBy(*key).agg(F.min("blk").alias(out))
        return levels.join(first, key, "left")

    at_scale = F.explode(F.array(*(F.lit(scale) for scale in range(TOP + 1)))).alias("scale")
    up_to = lambda at, scale: F.when(scale > TOP, F.lit(0).cast("long")).otherwise(F.floor(at / F.pow(F.lit(float(FAN)), scale)).cast("long"))
    tree = one.select("*", at_scale).select("series_id", "scale", up_to(F.col("blk"), F.col("scale") + 1).alias("parent"), up_to(F.col("blk"), F.col("scale")).alias("blk"), "top", "bottom")
    tree = tree.groupBy("series_id", "scale", "parent", "blk").agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"))
    own = ["series_id", "scale", "parent"]  # the tree is dealt by these once; all joins below read that
    cover = lv.select(*key, "s", "p", "is_up", at_scale).select(*key, "p", "is_up", "scale", up_to(F.col("s"), F.col("scale") + 1).alias("parent"), (up_to(F.col("s"), F.col("scale")) - F.when(F.col("scale") == 0, 1).otherwise(0)).alias("after"))
    met = cover.join(tree, own).where((F.col("blk") > F.col("after")) & hit)
    at = met.groupBy(*key, "p", "is_up").agg(F.min(F.struct("scale", "blk")).alias("at")).select(*key, "p", "is_up", F.col("at.scale").alias("found"), F.col("at.blk").alias("place"))
    for scale in range(TOP, 0, -1):  # blocks found at this scale are opened; what was found below it keeps its place
        opens = F.col("found") == scale
        asked = at.withColumn("scale", F.when(opens, scale - 1).otherwise(-1)).withColumn("parent", F.when(opens, F.col("place")).otherwise(F.col("level_id")))
        parts = asked.join(tree, own, "left").where(~opens | hit)
        at = parts.groupBy(*key, "p", "is_up").agg(F.min(F.least("found", F.lit(scale - 1))).alias("found"), F.min(F.coalesce("blk", "place")).alias("place"))
    return levels.join(at.select(*key, F.col("place").alias(out)), key, "left")


def as_of(points: DataFrame, events: DataFrame, values: list[str], *, at: str, when: str, order: str | None = None) -> DataFrame:
    """points with the values of the last event at or before them: one union and one window, no range join."""
    e = events.select("series_id", F.col(when).alias("_t"), F.lit(0).alias("_side"), (F.col(order) if order else F.lit(0)).cast("long").alias("_o"), F.struct(F.col(when).alias("_when"), *values).alias("_e"))
    p = points.withColumn("_p", F.struct(*points.columns)).select("series_id", F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_o"), "_p")
    both = e.unionByName(p, allowMissingColumns=True)
    last = F.last("_e", ignorenulls=True).over(Window.partitionBy("series_id").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_last", last).where("_side = 1").select("_p.*", F.col("_last._when").alias("event_idx"), *(F.col(f"_last.{v}").alias(v) for v in values))
