"""Audits of pivot tables, candle tables, levels, events and splits, and the selections that datasets are made with.

An audit is a dict of rules for quality.issues(), issue_counts() and assert_valid(),
or a table of what is broken; a rule that is null holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(*by: str, order: str):
    return Window.partitionBy(*by).orderBy(order)


def pivot_errors() -> dict[str, Column]:
    """Errors of a pivot row."""
    c = F.col
    return {
        "missing_index": c("pivot_idx").isNull() | c("confirm_idx").isNull(), "confirmation_before_pivot": c("confirm_idx") < c("pivot_idx"), "missing_price": c("price").isNull(),
        "invalid_side": ~F.coalesce(c("type"), F.lit("")).isin("HIGH", "LOW"), "invalid_target": ~F.coalesce(c("target"), F.lit("")).isin("RUN", "GRAB", "SWEEP", "NONE"), "atr_not_positive": F.coalesce(c("atr_14"), F.lit(0.0)) <= 0, "volume_not_positive": F.coalesce(c("confirm_volume"), F.lit(0.0)) <= 0,
    }


def causal_errors() -> dict[str, Column]:
    """What a causal pivot row must not show."""
    c = F.col
    return {
        "confirmed_too_early": c("confirm_idx") < c("pivot_idx"), "wrong_delay": c("confirmation_delay") != c("confirm_idx") - c("pivot_idx"), "bars_since_below_none": c("bars_since_event") < -1,
        "negative_count": (c("active_fvg_50") < 0) | (c("active_bsl") < 0) | (c("active_ssl") < 0), "direction_not_known": ~c("event_direction").isin(-1, 0, 1),
    }


def possible_duplicates(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows whose key was seen before, in order."""
    return rows.withColumn("seen_before", F.row_number().over(Window.partitionBy(*key).orderBy(order)) > 1).where("seen_before").drop("seen_before")


def leakage(df: DataFrame, columns: list[str], forbidden: list[str]) -> DataFrame:
    """(feature, mean, variance, min, max, constant, non_finite, forbidden) of numeric features; population variance, constant below 1e-12."""
    x = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    ok = F.when(~bad, F.col("value"))
    out = x.groupBy("feature").agg(F.avg(ok).alias("mean"), F.coalesce(F.var_pop(ok), F.lit(0.0)).alias("variance"), F.min(ok).alias("min"), F.max(ok).alias("max"), F.count(F.when(bad, 1)).alias("non_finite"))
    return out.withColumn("constant", F.col("variance") < 1e-12).withColumn("forbidden", F.col("feature").isin(forbidden))


def sequence_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing, is_constant) per column of any type."""
    one = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return one.groupBy("feature").agg(F.count(F.when(F.col("value").isNull() | (F.col("value") == ""), 1)).alias("missing"), (F.count_distinct("value") <= 1).alias("is_constant"))


def level_classes(levels: DataFrame, bars: DataFrame) -> DataFrame:
    """(series_id, level_id, error) where a level's class does not follow from its bars.

    levels: type, price, created_idx, swept_idx, resolved_idx, class; the bars at the
    sweep and at the resolution are looked up by their index.
    """
    at = lambda name: bars.select("series_id", F.col("bar_idx").alias(f"{name}_idx"), F.col("high").alias(f"{name}_high"), F.col("low").alias(f"{name}_low"), F.col("close").alias(f"{name}_close"))
    t = levels.join(at("swept"), ["series_id", "swept_idx"], "left").join(at("resolved"), ["series_id", "resolved_idx"], "left")
    buy = F.col("type") == "BSL"
    side = lambda up, down: F.when(buy, up).otherwise(down)
    price, none = F.col("price"), F.col("class") == "NONE"
    rules = {
        "not_taken_at_sweep": ~side(F.col("swept_high") > price, F.col("swept_low") < price), "swept_before_created": F.col("swept_idx") <= F.col("created_idx"), "resolved_before_swept": F.col("resolved_idx") < F.col("swept_idx"),
        "resolved_without_class": F.col("resolved_idx").isNotNull() & none, "class_without_resolution": F.col("resolved_idx").isNull() & ~none, "sweep_not_in_one_bar": (F.col("class") == "SWEEP") & (F.col("resolved_idx") != F.col("swept_idx")),
        "no_return_in_grab": F.col("class").isin("SWEEP", "GRAB") & ~side(F.col("resolved_close") < price, F.col("resolved_close") > price), "returned_in_run": (F.col("class") == "RUN") & ~side(F.col("resolved_close") > price, F.col("resolved_close") < price),
    }
    broken = F.array_compact(F.array(*(F.when(r, F.lit(n)) for n, r in rules.items())))
    return t.select("series_id", "level_id", F.explode(broken).alias("error"))


def event_health(events: DataFrame, bars: DataFrame, reach: int = 1500) -> DataFrame:
    """One row: events, repeated ones, those whose direction or close is not that of their name, those over `reach` bars from their pivot."""
    close = bars.select("series_id", F.col("bar_idx").alias("break_idx"), "close")
    up = F.col("event").endswith("_UP")
    n = F.count("*").over(Window.partitionBy("series_id", "event", "break_idx", "pivot_idx"))
    t = events.withColumn("n", n).join(close, ["series_id", "break_idx"], "left")
    side = F.when(up, F.col("close") > F.col("price")).otherwise(F.col("close") < F.col("price"))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return t.agg(F.count("*").alias("events"), count(F.col("n") > 1, "repeated"), count((F.col("direction") == 1) != up, "wrong_direction"), count(~side, "wrong_side"), count(F.col("break_idx") - F.col("pivot_idx") > reach, "far"))


def sequence_breaks(pivots: DataFrame) -> DataFrame:
    """One row: pivots, neighbours of one type, pivots not after the one before, and labels that their prices contradict by over 0.01."""
    w = before("series_id", order="confirm_idx")
    own = before("series_id", "type", order="confirm_idx")
    t = pivots.select("*", F.lag("type").over(w).alias("_t"), F.lag("pivot_idx").over(w).alias("_i"), F.lag("price").over(own).alias("_p"))
    wrong = F.when(F.col("label").isin("HH", "HL"), F.col("price") < F.col("_p") - 0.01).when(F.col("label").isin("LH", "LL"), F.col("price") > F.col("_p") + 0.01)
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return t.agg(F.count("*").alias("pivots"), count(F.col("_t") == F.col("type"), "not_alternating"), count(F.col("_i") >= F.col("pivot_idx"), "not_chronological"), count(wrong, "wrong_label"))


def temporal_order(df: DataFrame, split: str, ts: str, order: list[str]) -> DataFrame:
    """(earlier, later, last, first, is_ordered) of neighbouring splits: the earlier one must end before the later one begins."""
    g = df.groupBy(split).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    pairs = [(a, b) for a, b in zip(order, order[1:], strict=False)]
    out = None
    for a, b in pairs:
        one = g.where(F.col(split) == a).select(F.lit(a).alias("earlier"), "last").crossJoin(F.broadcast(g.where(F.col(split) == b).select(F.lit(b).alias("later"), "first")))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("is_ordered", F.col("last") < F.col("first"))


def beyond(df: DataFrame, index: str, until: int) -> DataFrame:
    """Rows of a result as of bar `until` that look past it: none, if it is causal."""
    return df.where(F.col(index) > until)


def same_columns(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both have the same columns in the same order."""
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns)) or 'order'}")


def selected_features(columns: list[str], excluded: list[str], forbidden: list[str]) -> list[str]:
    """Sorted columns without the excluded ones; raises if a forbidden one is left or one occurs twice."""
    left = sorted(c for c in columns if c not in set(excluded))
    if len(set(left)) < len(left):
        raise ValueError("a column occurs twice")
    if bad := sorted(set(left) & set(forbidden)):
        raise ValueError(f"forbidden features: {bad}")
    return left


def matching_features(columns: list[str], pattern: str, absolute: list[str]) -> list[str]:
    """Columns that the pattern finds, without absolute prices."""
    return [c for c in columns if re.search(pattern, c) and c not in set(absolute)]


def version_2_features(available: list[str], allowed: list[str], forbidden: list[str], least: int = 5) -> list[str]:
    """Allowed columns that are there; a distance gives way to its ATR-scaled twin; raises below `least`."""
    own = [c for c in allowed if c in set(available) and c not in set(forbidden)]
    own = [c for c in own if f"{c}_atr" not in own]
    if len(own) < least:
        raise ValueError(f"only {len(own)} predictors are left")
    return own


def version_2(df: DataFrame, features: list[str], key: list[str], order: list[str]) -> DataFrame:
    """The second version of a dataset: key and features, the first row of each key, rows without a key left out."""
    whole = df.dropna("any", subset=key)
    return whole.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").select(*dict.fromkeys([*key, *features]))


def after(df: DataFrame, ts: str, moment: Column) -> DataFrame:
    """Rows strictly after a moment; those without a time are left out."""
    return df.where(F.col(ts).isNotNull() & (F.col(ts) > moment))


def by_source(df: DataFrame, source: str, train: list[str], validation: list[str]) -> DataFrame:
    """df with split: train, validation or ignored."""
    return df.withColumn("split", F.when(F.col(source).isin(train), "train").when(F.col(source).isin(validation), "validation").otherwise("ignored"))


def supervised(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("target", F.upper(F.col(column)))


def sequence_id(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def sessions(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Counts of labels, and their shares within the other columns."""
    return df.groupBy(*by, label).agg(F.count("*").alias("count")).withColumn("ratio", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def complete_label_counts(df: DataFrame, split: str, label: str, labels: list[str]) -> DataFrame:
    """(split, label, count) for every declared label, zeros too, and OTHER; the split ALL holds all rows."""
    named = df.select(F.col(split).cast("string").alias("split"), F.when(F.col(label).isin(labels), F.col(label)).otherwise("OTHER").alias("label"))
    seen = named.groupingSets([["split", "label"], ["label"]], "split", "label").agg(F.count("*").alias("count")).withColumn("split", F.coalesce("split", F.lit("ALL")))
    grid = seen.select("split").distinct().withColumn("label", F.explode(F.array(*(F.lit(x) for x in [*labels, "OTHER"]))))
    return grid.join(seen, ["split", "label"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def quality_summary(df: DataFrame, numeric: list[str], key: list[str]) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate groups, rows per numeric feature."""
    missing = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    groups = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_groups"))
    return df.agg(F.count("*").alias("rows"), F.sum(missing).alias("missing_cells")).crossJoin(F.broadcast(groups)).select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), "missing_cells", "duplicate_groups", (F.col("rows") / max(1, len(numeric))).alias("rows_per_feature"))


def categories(df: DataFrame, column: str) -> DataFrame:
    """Sorted different values that are not empty."""
    return df.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).select(column).distinct().orderBy(column)


def grouping_candidates(df: DataFrame, columns: list[str], least: int = 2, most: int = 20) -> DataFrame:
    """(column, values) of columns with a number of different values that colours can tell apart."""
    one = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*").where("v <> ''")
    return one.groupBy("column").agg(F.count_distinct("v").alias("values")).where(F.col("values").between(least, most))


def first_examples(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group: examples for a report."""
    return df.withColumn("example", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("example") <= n)


def k_folds(df: DataFrame, folds: int, key: list[str]) -> DataFrame:
    """df with fold, by a hash of the key: the same for every layout."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*key), F.lit(folds)).cast("long"))


def ghost_state(state: Column, event: Column, confidence: Column) -> Column:
    """Whether a forecast is active."""
    taken = (state == "INTERACTION") & event.isin("GRAB", "SWEEP")
    run = (state == "EXPANSION") & event.startswith("RUN_")
    return F.coalesce((taken | run) & (confidence >= 0.55), F.lit(False))


def mitigated_share(top: Column, bottom: Column, deepest: Column, bullish: Column) -> Column:
    """Per cent of a zone that price has entered, by the deepest price in it."""
    gone = F.when(bullish, top - deepest).otherwise(deepest - bottom) / F.nullif(top - bottom, F.lit(0.0))
    return 100 * F.greatest(F.least(F.coalesce(gone, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def events_of_pivots(pivots: DataFrame, events: DataFrame) -> DataFrame:
    """pivots with the names of the events that broke them, in order; empty if none did."""
    named = events.groupBy("series_id", "pivot_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_no", "event"))), lambda e: e["event"]), ",").alias("events"))
    return pivots.join(named, ["series_id", "pivot_idx"], "left").withColumn("events", F.coalesce("events", F.lit("")))


def external_fibonacci(pivots: DataFrame, ratios: tuple[float, ...] = (0.382, 0.5, 0.618, 0.705, 0.786)) -> DataFrame:
    """(series_id, direction, ratio, price) between the last two pivots of each series, which must differ in type."""
    w = Window.partitionBy("series_id").orderBy(F.desc("confirm_idx"), F.desc("pivot_idx"))
    two = pivots.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy("series_id").agg(*(F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}") for n in (1, 2) for c in ("price", "type")))
    two = two.where("type1 <> type2").withColumn("direction", F.when(F.col("type1") == "HIGH", "UP").otherwise("DOWN"))
    span = F.abs(F.col("price1") - F.col("price2"))
    at = F.when(F.col("direction") == "UP", F.col("price1") - span * F.col("ratio")).otherwise(F.col("price1") + span * F.col("ratio"))
    return two.withColumn("ratio", F.explode(F.array(*(F.lit(r) for r in ratios)))).select("series_id", "direction", "ratio", at.alias("price"))


def zone_origins(zones: DataFrame, bars: DataFrame, volume: float = 1.5, reach: float = 0.8) -> DataFrame:
    """zones with is_valid: a pivot bar of at least so many times the mean volume of the 20 bars before, and so many ATRs high."""
    w = Window.partitionBy("series_id").orderBy("bar_idx").rowsBetween(-20, -1)
    b = bars.select("series_id", F.col("bar_idx").alias("pivot_idx"), (F.col("volume") / F.nullif(F.avg("volume").over(w), F.lit(0.0))).alias("relative_volume"), ((F.col("high") - F.col("low")) / F.when(F.col("atr") > 0, F.col("atr"))).alias("range_atr"))
    return zones.join(b, ["series_id", "pivot_idx"], "left").withColumn("is_valid", F.coalesce((F.col("relative_volume") >= volume) & (F.col("range_atr") >= reach), F.lit(False)))


def around(levels: DataFrame, bars: DataFrame, reach: int = 5) -> DataFrame:
    """The bars around each level's sweep (its creation, if it was never swept), with whether they go beyond it."""
    centre = F.coalesce("swept_idx", "created_idx")
    spots = levels.withColumn("bar_idx", F.explode(F.sequence(F.greatest(centre - reach, F.lit(0)), centre + reach)))
    met = spots.join(bars.select("series_id", "bar_idx", "high", "low", "close"), ["series_id", "bar_idx"])
    return met.select("series_id", "level_id", "bar_idx", "high", "low", "close", F.when(F.col("type") == "BSL", F.col("high") > F.col("price")).otherwise(F.col("low") < F.col("price")).alias("breaks"))
