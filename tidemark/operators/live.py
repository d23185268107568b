"""Lookups among what is live at a bar: nearest in price, counts, boxes that hold a price.

A row that lives from one bar to another is dealt to the dyadic blocks of bars that
cover its life exactly: two a scale at most.  A point at a bar meets the blocks that
hold its bar, one a scale.  Within a block every row is live at every point, so rows
and points are sorted by price once and a running window tells each point its
neighbours and their number.  The same, with ranks of prices for bars, finds the
latest box around a price.  Work is n log n, keys are equal keys, and a series is
spread over its blocks; only blocks that some row fills are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import kept

RUN = (Window.unboundedPreceding, 0)


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def cover(first: Column, last: Column) -> Column:
    """Array of (scale, node): the dyadic blocks, 2**scale long, that make up first to last (both included, not below 0)."""
    one = F.lit(1).cast("long")

    def at(scale: Column) -> Column:
        step = F.call_function("shiftleft", one, scale)
        lo, hi = _shift(first.cast("long") + step - 1, scale), _shift(last.cast("long") + 1, scale)
        left = F.when((lo < hi) & (lo % 2 == 1), F.struct(scale.alias("scale"), lo.alias("node")))
        right = F.when((lo < hi) & (hi % 2 == 1), F.struct(scale.alias("scale"), (hi - 1).alias("node")))
        return F.array(left, right)

    scales = F.sequence(F.lit(0), F.length(F.bin(last.cast("long") + 1)))
    return F.filter(F.flatten(F.transform(scales, at)), lambda x: x.isNotNull())


def ancestors(at: Column, last: Column) -> Column:
    """Array of (scale, node): the dyadic blocks that hold a bar, up to the one that holds `last`."""
    scales = F.sequence(F.lit(0), F.length(F.bin(last.cast("long") + 1)))
    return F.transform(scales, lambda s: F.struct(s.alias("scale"), _shift(at.cast("long"), s).alias("node")))


NODE = ["series_id", "scale", "node"]


def _dealt(rows: DataFrame, points: DataFrame, first: Column, until: Column, at: str) -> tuple[DataFrame, DataFrame]:
    """rows (first to `until`; null: for ever) and points by block; a point is dealt only to blocks that hold a row."""
    ends = points.groupBy("series_id").agg(F.max(F.col(at)).cast("long").alias("_last"))
    lived = rows.withColumn("_first", F.greatest(first, F.lit(0))).withColumn("_until", until).join(ends, "series_id").withColumn("_to", F.least(F.coalesce("_until", "_last"), F.col("_last")))
    held = lived.where("_first <= _to").withColumn("_b", F.explode(cover(F.col("_first"), F.col("_to")))).withColumn("scale", F.col("_b.scale")).withColumn("node", F.col("_b.node")).drop("_b", "_first", "_until", "_to", "_last")
    met = points.join(ends, "series_id").withColumn("_b", F.explode(ancestors(F.col(at), F.col("_last")))).withColumn("scale", F.col("_b.scale")).withColumn("node", F.col("_b.node")).drop("_b", "_last")
    return held, met.join(held.select(*NODE).distinct(), NODE, "left_semi")


def nearest_live(points: DataFrame, levels: DataFrame, key: list[str], *, at: str, price: str, since: Column, until: Column, value: Column, prefer: Column, keep: list[str], equal_below: bool = True, equal_above: bool = True) -> DataFrame:
    """key, below and above (structs v, prefer and `keep`; null if there is none), n_below and n_above, of each point that meets a live level.

    Levels live from `since` to `until` (null: for ever), both included.  below is the
    highest value not above the point's price (below it, without equal_below), above
    the lowest not below it; among equal values the largest `prefer`.  The numbers
    count the live levels on each side.  Points without any may be left out.
    """
    rows = levels.select("series_id", since.alias("_s"), until.alias("_u"), F.struct(value.cast("double").alias("v"), prefer.alias("prefer"), *keep).alias("level")).where("level.v is not null and _s is not null")
    asked = points.select(*dict.fromkeys(["series_id", *key]), F.col(at).cast("long").alias("_t"), F.col(price).cast("double").alias("_p")).where("_p is not null and _t is not null")
    held, met = _dealt(kept(rows), kept(asked), F.col("_s").cast("long"), F.col("_u").cast("long"), "_t")
    one = held.select(*NODE, "level", F.col("level.v").alias("_p"), F.col("level.prefer").alias("_prefer"))
    both = one.unionByName(met.select(*NODE, *(F.col(c).alias(f"_key_{n}") for n, c in enumerate(key)), "_p"), allowMissingColumns=True)
    is_point = F.col("level").isNull().cast("int")
    by = Window.partitionBy(*NODE)
    up = by.orderBy("_p", is_point if equal_below else -is_point, "_prefer").rowsBetween(*RUN)
    down = by.orderBy(F.desc("_p"), is_point if equal_above else -is_point, "_prefer").rowsBetween(*RUN)
    seen = both.select("*", F.last("level", ignorenulls=True).over(up).alias("below"), F.count("level").over(up).alias("n_below"), F.last("level", ignorenulls=True).over(down).alias("above"), F.count("level").over(down).alias("n_above")).where("level is null")
    return seen.groupBy(*(F.col(f"_key_{n}").alias(c) for n, c in enumerate(key))).agg(
        F.max_by("below", F.when(F.col("below").isNotNull(), F.struct(F.col("below.v"), F.col("below.prefer")))).alias("below"), F.min_by("above", F.when(F.col("above").isNotNull(), F.struct(F.col("above.v"), -F.col("above.prefer")))).alias("above"),
        F.sum("n_below").alias("n_below"), F.sum("n_above").alias("n_above"),
    )


def nearest_level(points: DataFrame, levels: DataFrame, key: list[str], *, at: str, price: str, known: str, value: Column, prefer: Column, keep: list[str]) -> DataFrame:
    """key, level (struct v, prefer and `keep`) and distance of the level, among those known by the point's bar, that is nearest in price; ties to the largest `prefer`."""
    near = nearest_live(points, levels, key, at=at, price=price, since=F.col(known), until=F.lit(None).cast("long"), value=value, prefer=prefer, keep=keep)
    met = points.select(*key, F.col(price).cast("double").alias("_p")).join(near, key)
    option = lambda d, c: F.when(F.col(c).isNotNull(), F.struct(d.alias("distance"), (-F.col(f"{c}.prefer")).alias("order"), F.col(c).alias("level")))
    best = F.array_min(F.filter(F.array(option(F.col("_p") - F.col("below.v"), "below"), option(F.col("above.v") - F.col("_p"), "above")), lambda x: x.isNotNull()))
    return met.withColumn("_n", best).where("_n is not null").select(*key, "_n.level", "_n.distance")


def latest_around(points: DataFrame, boxes: DataFrame, key: list[str], *, at: str, price: str, known: Column, top: Column, bottom: Column, prefer: Column, keep: list[str]) -> DataFrame:
    """key and box (struct v, prefer and `keep`) of the box with the largest `prefer` among those known by the point's bar that hold its price, edges included.

    `prefer` must rise with `known`.  Points in no box are left out.
    """
    told = boxes.select("series_id", F.struct(known.cast("long").alias("known"), prefer.alias("prefer"), *keep).alias("box"), F.least(top, bottom).cast("double").alias("_lo"), F.greatest(top, bottom).cast("double").alias("_hi")).where("_lo is not null and box.known is not null")
    asked = points.select(*dict.fromkeys(["series_id", *key]), F.col(at).cast("long").alias("_t"), F.col(price).cast("double").alias("_v")).where("_v is not null and _t is not null")
    names = [f"_key_{n}" for n in range(len(key))]
    flat = told.select("series_id", "box", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_lo").alias("v")), F.struct(F.lit(1).alias("side"), F.col("_hi").alias("v")))).alias("e")).select("series_id", "box", "e.side", F.col("e.v").alias("_v"))
    flat = flat.unionByName(asked.select("series_id", *(F.col(c).alias(n) for n, c in zip(names, key, strict=True)), "_t", "_v"), allowMissingColumns=True)
    flat = flat.withColumn("rank", (F.dense_rank().over(Window.partitionBy("series_id").orderBy("_v")) - 1).cast("long"))
    flat = kept(flat)
    spans = flat.where("box is not null").groupBy("series_id", "box").agg(F.min(F.when(F.col("side") == 0, F.col("rank"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("rank"))).alias("hi"))
    held, met = _dealt(spans, flat.where("box is null").drop("box", "side"), F.col("lo"), F.col("hi"), "rank")
    both = held.select(*NODE, "box", F.col("box.known").alias("_t"), F.col("box.prefer").alias("_o")).unionByName(met.select(*NODE, *names, "_t"), allowMissingColumns=True)
    by_time = Window.partitionBy(*NODE).orderBy("_t", F.col("box").isNull().cast("int"), "_o").rowsBetween(*RUN)
    seen = both.withColumn("last", F.last("box", ignorenulls=True).over(by_time)).where("box is null and last is not null")
    return seen.groupBy(*(F.col(n).alias(c) for n, c in zip(names, key, strict=True))).agg(F.max_by("last", F.col("last.prefer")).alias("box"))


def nearest_box(points: DataFrame, boxes: DataFrame, key: list[str], *, at: str, price: str, known: str, top: str, bottom: str, prefer: Column, keep: list[str]) -> DataFrame:
    """key, box (struct known, prefer and `keep`) and distance of the nearest box known by the point's bar: 0 inside, ties to the largest `prefer` (which rises with `known`)."""
    points, boxes = kept(points), kept(boxes)
    hi, lo = F.greatest(top, bottom), F.least(top, bottom)
    own = F.struct(F.col(known).cast("long").alias("known"), prefer.alias("prefer"), *keep)
    b = boxes.withColumn("_box", own).withColumn("_hi", hi).withColumn("_lo", lo).withColumn("_prefer", prefer)
    side = lambda edge: nearest_live(points, b, key, at=at, price=price, since=F.col(known), until=F.lit(None).cast("long"), value=F.col(edge), prefer=F.col("_prefer"), keep=["_box"])
    p = points.select(*key, F.col(price).cast("double").alias("_p"))
    inside = latest_around(points, boxes, key, at=at, price=price, known=F.col(known), top=F.col(top), bottom=F.col(bottom), prefer=prefer, keep=keep)
    met = p.join(inside, key, "left").join(side("_hi").select(*key, "below"), key, "left").join(side("_lo").select(*key, "above"), key, "left")
    option = lambda d, box: F.when(d.isNotNull(), F.struct(d.alias("distance"), (-box["prefer"]).alias("order"), box.alias("box")))
    first = F.array_min(F.filter(F.array(
        option(F.col("_p") - F.col("below.v"), F.struct(*(F.col(f"below._box.{c}").alias(c) for c in ("known", "prefer", *keep)))),
        option(F.col("above.v") - F.col("_p"), F.struct(*(F.col(f"above._box.{c}").alias(c) for c in ("known", "prefer", *keep)))),
    ), lambda x: x.isNotNull()))
    out = met.withColumn("_n", first)
    return out.select(*key, F.when(F.col("box").isNotNull(), F.col("box")).otherwise(F.col("_n.box")).alias("box"), F.when(F.col("box").isNotNull(), F.lit(0.0)).otherwise(F.col("_n.distance")).alias("distance")).where("box is not null")


def live_count(points: DataFrame, spans: DataFrame, key: list[str], *, at: str, since: Column, until: Column, name: str) -> DataFrame:
    """points' key and how many spans live at their bar, from `since` to before `until` (null: for ever): one running sum."""
    ends = F.filter(F.array(F.struct(since.cast("long").alias("t"), F.lit(1).alias("n")), F.struct(until.cast("long").alias("t"), F.lit(-1).alias("n"))), lambda x: x["t"].isNotNull())
    steps = spans.where(since.isNotNull() & (until.isNull() | (until > since))).select("series_id", F.explode(ends).alias("e")).select("series_id", F.col("e.t").alias("_t"), F.col("e.n").alias("_n"), F.lit(0).alias("_side"))
    names = [f"_key_{n}" for n in range(len(key))]
    asked = points.select("series_id", *(F.col(c).alias(n) for n, c in zip(names, key, strict=True)), F.col(at).cast("long").alias("_t"), F.lit(0).alias("_n"), F.lit(1).alias("_side"))
    run = Window.partitionBy("series_id").orderBy("_t", "_side").rowsBetween(*RUN)
    both = steps.unionByName(asked, allowMissingColumns=True).withColumn("_sum", F.sum("_n").over(run)).where("_side = 1")
    return both.select(*(F.col(n).alias(c) for n, c in zip(names, key, strict=True)), F.col("_sum").cast("long").alias(name))
