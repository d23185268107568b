"""Column statistics, duplicates, label tables, splits and the rule tables of validators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import kept


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value) with doubles."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.feature", "x.value")


#: Ranges of values that order statistics are looked for in.
RANGES = 256


def at_places(counted: DataFrame, places: dict[str, Column]) -> DataFrame:
    """feature, total and, per name of `places`, the value at that place (from 0, of the column `total`) in the order of the values.

    counted: (feature, value, n) with each value once.  Values are dealt to RANGES by
    a sketch of the distinct ones; ranges are summed, and only within a range are
    values put in order, so no task holds a whole column.
    """
    c = counted.where("value is not null")
    shares = F.array(*(F.lit(k / RANGES) for k in range(1, RANGES)))
    cuts = c.groupBy("feature").agg(F.percentile_approx("value", shares, F.lit(20 * RANGES)).alias("cuts"), F.sum("n").alias("total"))
    b = c.join(F.broadcast(cuts), "feature").select("feature", "value", "n", "total", F.size(F.filter("cuts", lambda x: x <= F.col("value"))).alias("range"))  # a row per feature
    sums = b.groupBy("feature", "range").agg(F.sum("n").alias("s"))
    before = F.sum("s").over(Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("feature", "range", F.coalesce(before, F.lit(0)).alias("before"))  # RANGES rows per feature at most
    run = Window.partitionBy("feature", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = b.join(F.broadcast(sums), ["feature", "range"]).withColumn("upto", F.col("before") + F.sum("n").over(run))
    holds = lambda place: (place >= F.col("upto") - F.col("n")) & (place < F.col("upto"))
    return placed.groupBy("feature", "total").agg(*(F.max(F.when(holds(place), F.col("value"))).alias(name) for name, place in places.items()))


def percentiles(counted: DataFrame, shares: dict[str, float]) -> DataFrame:
    """feature, total and, per name, the interpolated value at share * (total - 1)."""
    at = {name: (F.col("total") - 1).cast("double") * p for name, p in shares.items()}
    found = at_places(counted, {f"{side}_{name}": f(place) for name, place in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))})
    between = lambda name: F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * (at[name] - F.floor(at[name]))
    return found.select("feature", "total", *(between(name).alias(name) for name in shares))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, missing, unique, extremes, mean, median, sample deviation, and moments over the sample deviation and n.

    A column is near-constant if its distinct values are at most 1 % of its rows.
    """
    # Equal values are counted first: what is shuffled and ranked is distinct values with their counts.
    x = kept(long_form(df, columns).groupBy("feature", "value").agg(F.count("*").alias("n")))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    base = x.groupBy("feature").agg(
        F.coalesce(F.sum(known), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("unique"),
        F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("n")) / F.nullif(F.sum(known), F.lit(0))).alias("mean"),
    )
    d = F.col("value") - F.col("mean")
    sums = x.join(F.broadcast(base.select("feature", "mean", "count")), "feature").groupBy("feature").agg(*(F.sum(d**k * F.col("n")).alias(f"s{k}") for k in (2, 3, 4)), F.max("count").alias("rows"))
    stddev = F.sqrt(F.col("s2") / F.nullif(F.col("rows") - 1, F.lit(0)))
    scale = F.nullif(stddev, F.lit(0.0))
    moments = sums.select("feature", F.coalesce(stddev, F.lit(0.0)).alias("stddev"), (F.col("s3") / F.col("rows") / scale**3).alias("skewness"), (F.col("s4") / F.col("rows") / scale**4 - 3).alias("kurtosis"))
    median = percentiles(x, {"median": 0.5}).drop("total")
    order = ["feature", "count", "missing", "unique", "min", "max", "mean", "median", "stddev", "skewness", "kurtosis"]
    out = base.join(moments, "feature").join(median, "feature", "left").select(*order)
    return out.withColumn("constant", F.col("unique") <= 1).withColumn("near_constant", (F.col("unique") > 1) & (F.col("unique") <= F.col("count") * 0.01))


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR], counted per column with at least four values and a positive IQR."""
    x = long_form(df, columns).where("value is not null")
    counted = x.groupBy("feature", "value").agg(F.count("*").alias("n"))
    q = percentiles(counted, {"q1": 0.25, "q3": 0.75}).where("total >= 4 and q3 > q1").drop("total")
    far = (F.col("value") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col("value") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return x.join(F.broadcast(q), "feature").groupBy("feature", "q1", "q3").agg(F.count(F.when(far, 1)).alias("outliers"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, correlation, covariance) for all pairs, i <= j, in one aggregation; 0 where a variance is 0."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = df.agg(*(f(a, b).alias(f"{n}{k}") for k, (a, b) in enumerate(pairs) for n, f in (("r", F.corr), ("c", F.covar_samp))))
    rows = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.coalesce(F.nanvl(F.col(f"r{k}"), F.lit(0.0)), F.lit(0.0)).alias("correlation"), F.coalesce(F.col(f"c{k}"), F.lit(0.0)).alias("covariance")) for k, (a, b) in enumerate(pairs)))
    return sums.select(F.explode(rows).alias("p")).select("p.*")


def label_stats(df: DataFrame, split: str, label: str) -> DataFrame:
    """Counts and shares per split and over ALL, by grouping sets."""
    both = df.groupingSets([[split, label], [label]], split, label).agg(F.count("*").alias("count"))
    named = both.withColumn(split, F.coalesce(F.col(split).cast("string"), F.lit("ALL")))
    return named.withColumn("ratio", F.col("count") / F.sum("count").over(Window.partitionBy(split)))


def transitions(df: DataFrame, session: str, order: str, label: str) -> DataFrame:
    """(from_label, to_label, count, probability) of neighbours within a session."""
    nxt = F.lead(label).over(Window.partitionBy(session).orderBy(order))
    t = df.select(F.col(label).alias("from_label"), nxt.alias("to_label")).where("to_label is not null").groupBy("from_label", "to_label").agg(F.count("*").alias("count"))
    return t.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy("from_label")))


def eta_squared(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Share of each column's variance that lies between labels."""
    x = df.select(F.col(label).alias("label"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("label", "x.*").where("value is not null")
    g = x.groupBy("feature", "label").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    total = F.sum("n")
    between = F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / total
    within = F.sum(F.col("n") * F.col("v"))
    return g.groupBy("feature").agg(F.coalesce(between / F.nullif(between + within, F.lit(0.0)), F.lit(0.0)).alias("eta_squared"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of two discrete columns, in nats; one row."""
    joint = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    pa, pb = F.sum("n").over(Window.partitionBy("a")), F.sum("n").over(Window.partitionBy("b"))
    counted = joint.withColumn("na", pa).withColumn("nb", pb)
    total = counted.agg(F.sum("n").alias("t"))
    return counted.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mutual_information"))


def quartile_bins(df: DataFrame, column: str) -> DataFrame:
    """df with column `bin`: Q1 to Q4 by the column's own quartiles."""
    counted = df.groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n")).withColumn("feature", F.lit(column))
    q = percentiles(counted, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select("q1", "q2", "q3")
    v = F.col(column)
    return df.crossJoin(F.broadcast(q)).withColumn("bin", F.when(v <= F.col("q1"), "Q1").when(v <= F.col("q2"), "Q2").when(v <= F.col("q3"), "Q3").otherwise("Q4")).drop("q1", "q2", "q3")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """df with is_kept: the first row of each key is kept, the rest are the rejects."""
    return df.withColumn("is_kept", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)


def duplicate_groups(df: DataFrame, key: list[str], line: str) -> DataFrame:
    """Keys that occur more than once, with their lines in order."""
    return df.groupBy(*key).agg(F.count("*").alias("count"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.cast("string")), ";").alias("lines")).where("count > 1")


def temporal_split(df: DataFrame, ts: Column, first: Column, second: Column) -> DataFrame:
    """train before first, validation before second, test from there on."""
    return df.withColumn("split", F.when(ts < first, "train").when(ts < second, "validation").otherwise("test"))


def walk_forward(df: DataFrame, group: Column, folds: int) -> DataFrame:
    """Rows by (fold, role): fold i trains on the groups before i and validates on group i."""
    fold = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    return df.withColumn("group_no", group).select("*", fold).where(F.col("group_no") <= F.col("fold")).withColumn("role", F.when(F.col("group_no") < F.col("fold"), "train").otherwise("validation"))


def issues(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row per broken rule: `keep` and issue; a rule that is null holds."""
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return df.select(*keep, F.explode(broken).alias("issue"))


def issue_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: rows, valid_rows and a count per rule."""
    bad = reduce(lambda a, b: a | b, (F.coalesce(r, F.lit(False)) for r in rules.values()))
    return df.agg(F.count("*").alias("rows"), F.count(F.when(~bad, 1)).alias("valid_rows"), *(F.count(F.when(r, 1)).alias(n) for n, r in rules.items()))


def assert_valid(df: DataFrame, rules: dict[str, Column]) -> None:
    """Raises if a rule is broken: a gate before what must not see bad rows."""
    row = issue_counts(df, rules).first()
    broken = {n: row[n] for n in rules if row[n]}
    if broken:
        raise ValueError(f"broken rules: {broken}")
