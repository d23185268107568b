"""The dataset validator and the causality auditor over pivot tables: every rule as a column, a row per broken one, and counts.

Rows may come from files (all strings) or from features.pivot_features().  A column
that is not there breaks no rule, but for those that the validator needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Issues that make a row invalid; the others are warnings.
WHOLE, NUMBER = r"^-?\d+$", r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"
# Columns by what they must hold.
BARS_SINCE = "bars_previous_pivot bars_since_structure_event bars_since_equal_level bars_since_fvg bars_since_ob".split()
FLAGS = "near_equal_level inside_fvg fvg_mitigated inside_order_block ob_invalidated".split()
COUNTS = "bos_count_previous_20 choch_count_previous_20 active_fvg_count_50 active_ob_count_50 bsl_count_previous_100 ssl_count_previous_100 active_bsl_count active_ssl_count equal_levels_previous_100".split()
IDENTITY = "source_file symbol timeframe pivot_index confirmation_index".split()


def text(df: DataFrame, name: str) -> Column:
    """A column as a string; null where it is not there."""
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def number(df: DataFrame, name: str) -> Column:
    """A column as a double where it reads as one, else null."""
    v = text(df, name)
    return F.when(v.rlike(NUMBER), v.cast("double"))


def given(df: DataFrame, name: str) -> Column:
    """Whether there is a value, whatever it is."""
    v = text(df, name)
    return v.isNotNull() & (v != "")


def seen_before(df: DataFrame, key: Column, order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1


def _issues(df: DataFrame, rules: list[tuple[str, str, str, Column]], order: list[str]) -> DataFrame:
    """order, level, code and column of every rule (level, code, column, broken) that a row breaks; a rule that is null holds."""
    told = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(column).alias("column"))) for level, code, column, broken in rules)))
    own = [F.col(f"`{c}`") for c in order]
    return df.select(*own, told.alias("_told")).select(*own, F.explode("_told").alias("issue")).select(*own, "issue.*")


def validator_rules(df: DataFrame, order: list[str]) -> list[tuple[str, str, str, Column]]:
    """(level, code, column, broken) of the validator."""
    upper = lambda c, other: F.upper(F.coalesce(text(df, c), F.lit(other)))
    whole = lambda c: F.coalesce(text(df, c).rlike(WHOLE), F.lit(False))
    pivot, confirm = number(df, "pivot_index"), number(df, "confirmation_index")
    both = whole("pivot_index") & whole("confirmation_index")
    key = F.concat_ws("|", *(F.coalesce(text(df, c), F.lit("")) for c in ("timeframe", "pivot_index")), upper("pivot_side", "UNKNOWN"), F.coalesce(text(df, "pivot_price"), F.lit("")))
    not_positive = lambda c: F.coalesce(number(df, c), F.lit(0.0)) <= 0
    return [
        *(("error", "missing_index", c, ~whole(c)) for c in ("pivot_index", "confirmation_index")),
        ("error", "confirmation_before_pivot", "confirmation_index", both & (confirm < pivot)),
        ("warning", "negative_confirmation_delay", "confirmation_index", both & (confirm - pivot < 0)),
        ("warning", "duplicate_rows", "", seen_before(df, key, order)),
        ("error", "invalid_pivot_side", "pivot_side", ~upper("pivot_side", "UNKNOWN").isin("HIGH", "LOW")),
        ("warning", "unknown_structure", "structure_type", upper("structure_type", "UNKNOWN").isin("UNKNOWN", "")),
        ("error", "invalid_target", "target", ~upper("target", "NONE").isin("RUN", "GRAB", "SWEEP", "NONE")),
        ("error", "missing_price", "pivot_price", ~given(df, "pivot_price")),
        ("warning", "missing_timestamp", "pivot_timestamp", ~given(df, "pivot_timestamp")),
        ("warning", "atr_zero", "atr_14", not_positive("atr_14")),
        ("warning", "volume_zero", "pivot_volume", not_positive("pivot_volume")),
    ]


def validator_issues(df: DataFrame, order: list[str]) -> DataFrame:
    """order, level, code and column: a row per broken rule of the validator."""
    return _issues(df, validator_rules(df, order), order)


def validator_report(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: total_rows, valid_rows (no error), invalid_rows, and how often each rule is broken."""
    rules = validator_rules(df, order)
    own = df.select(*(F.coalesce(broken, F.lit(False)).alias(f"r{i}") for i, (*_, broken) in enumerate(rules)))
    wrong = F.greatest(*(F.col(f"r{i}") for i, (level, *_) in enumerate(rules) if level == "error"))
    counts: dict[str, Column] = {}
    for i, (_, code, _, _) in enumerate(rules):
        one = F.count(F.when(F.col(f"r{i}"), 1))
        counts[code] = counts[code] + one if code in counts else one
    return own.agg(F.count(F.lit(1)).alias("total_rows"), F.count(F.when(~wrong, 1)).alias("valid_rows"), F.count(F.when(wrong, 1)).alias("invalid_rows"), *(c.alias(code) for code, c in counts.items()))


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, count) of sides, structures, targets and timeframes, missing ones under their name for it."""
    told = {"pivot_side": "UNKNOWN", "structure_type": "UNKNOWN", "target": "NONE"}
    each = [F.struct(F.lit(c).alias("column"), F.upper(F.coalesce(text(df, c), F.lit(other))).alias("value")) for c, other in told.items()]
    each.append(F.struct(F.lit("timeframe").alias("column"), F.coalesce(text(df, "timeframe"), F.lit("UNKNOWN")).alias("value")))
    return df.select(F.explode(F.array(*each)).alias("x")).groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("count"))


def causality_rules(df: DataFrame, order: list[str]) -> list[tuple[str, str, str, Column]]:
    """(level, code, column, broken) of the auditor; -1 bars since something means that there was none."""
    pivot, confirm, delay = (number(df, c) for c in ("pivot_index", "confirmation_index", "confirmation_delay"))
    both = pivot.isNotNull() & confirm.isNotNull()
    rules = [
        ("error", "MISSING_PIVOT_INDEX", "pivot_index", pivot.isNull()),
        ("error", "MISSING_CONFIRMATION_INDEX", "confirmation_index", confirm.isNull()),
        ("error", "CONFIRMATION_BEFORE_PIVOT", "confirmation_index", confirm < pivot),
        ("error", "INVALID_CONFIRMATION_DELAY", "confirmation_delay", F.abs(delay - (confirm - pivot)) > 1e-9),
    ]
    for c in BARS_SINCE:
        v = number(df, c)
        rules += [("error", "NON_NUMERIC_BARS_SINCE", c, both & given(df, c) & v.isNull()), ("error", "INVALID_BARS_SINCE_SENTINEL", c, both & (v < -1))]
    early = given(df, "pivot_timestamp") & given(df, "confirmation_timestamp") & (text(df, "confirmation_timestamp") < text(df, "pivot_timestamp"))
    rules.append(("error", "CONFIRMATION_TIMESTAMP_BEFORE_PIVOT", "confirmation_timestamp", early))
    for c in ("swept_index", "resolved_index"):
        v = number(df, c)
        rules += [("error", "INVALID_FUTURE_LABEL_INDEX", c, confirm.isNotNull() & given(df, c) & v.isNull()), ("warning", "LABEL_EVENT_BEFORE_CONFIRMATION", c, v < confirm)]
    rules.append(("error", "RESOLUTION_BEFORE_SWEEP", "resolved_index", confirm.isNotNull() & (number(df, "resolved_index") < number(df, "swept_index"))))
    for c in FLAGS:
        v = F.coalesce(number(df, c), F.lit(0.0))  # what is no number counts as 0 here
        rules.append(("warning", "NON_BINARY_FLAG", c, given(df, c) & ~v.isin(0.0, 1.0)))
    for c in COUNTS:
        v = number(df, c)
        rules.append(("error", "INVALID_CAUSAL_COUNT", c, given(df, c) & (v.isNull() | (v < 0))))
    identity = F.concat_ws("|", *(F.coalesce(text(df, c), F.lit("")) for c in IDENTITY))
    rules.append(("warning", "DUPLICATE_CAUSAL_ROW", "", (identity != "||||") & seen_before(df, identity, order)))
    return rules


def causality_issues(df: DataFrame, order: list[str]) -> DataFrame:
    """order, level, code and column: a row per broken rule of the auditor."""
    return _issues(df, causality_rules(df, order), order)


def column_issues(df: DataFrame, declared: list[str], *, features: list[str] = (), forbidden: list[str] = ()) -> DataFrame:
    """(level, code, column): features that tell the future, columns that were not declared, declared ones that are not there."""
    told = [("error", "FORBIDDEN_FEATURE", c) for c in sorted(set(features) & set(forbidden))]
    told += [("warning", "UNDECLARED_COLUMN", c) for c in sorted(set(df.columns) - set(declared))]
    told += [("warning", "MISSING_DECLARED_COLUMN", c) for c in declared if c not in df.columns]
    return df.sparkSession.createDataFrame(told, "level string, code string, column string")


def issue_summary(issues: DataFrame, order: list[str], examples: int = 25) -> DataFrame:
    """(level, code, count, examples): how often, and the first rows of each code as strings."""
    names = [c for c in order if c in issues.columns]
    first = F.row_number().over(Window.partitionBy("level", "code").orderBy(*names, "column"))
    row = F.concat_ws("|", *(F.col(f"`{c}`").cast("string") for c in names), "column")
    n = F.count(F.lit(1)).over(Window.partitionBy("level", "code"))
    few = issues.withColumn("_n", first).withColumn("count", n).where(F.col("_n") <= examples)
    return few.groupBy("level", "code", "count").agg(F.array_sort(F.collect_list(F.struct("_n", row.alias("row")))).alias("e")).select("level", "code", "count", F.transform("e", lambda x: x["row"]).alias("examples"))


def assert_causal(df: DataFrame, order: list[str], name: str = "dataset") -> None:
    """Raises if a row breaks a rule that is an error: a gate before training."""
    n = causality_issues(df, order).where("level = 'error'").count()
    if n:
        raise ValueError(f"{name} is not causal: {n} errors")
