"""The validator and the auditors against tables with one planted fault a rule."""

import pytest

from tidemark.functions import audits as A
from tidemark.functions import validation as V

COLUMNS = ["n", "source_file", "symbol", "timeframe", "pivot_index", "confirmation_index", "confirmation_delay", "pivot_timestamp", "confirmation_timestamp", "pivot_side", "structure_type", "target", "pivot_price", "atr_14", "pivot_volume", "swept_index", "resolved_index", *V.BARS_SINCE, *V.FLAGS, *V.COUNTS]


def good(n, **other):
    row = dict.fromkeys(COLUMNS, "0") | {"n": n, "source_file": "f", "symbol": "S", "timeframe": "1", "pivot_index": str(10 * n), "confirmation_index": str(10 * n + 5), "confirmation_delay": "5", "pivot_timestamp": "2024-01-01T00:00:00", "confirmation_timestamp": "2024-01-01T00:05:00", "pivot_side": "high", "structure_type": "HH", "target": "RUN", "pivot_price": "1.5", "atr_14": "0.5", "pivot_volume": "7", "swept_index": str(10 * n + 6), "resolved_index": str(10 * n + 7), "bars_since_ob": "-1"}
    return row | other


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], ", ".join(f"{c} {'int' if c == 'n' else 'string'}" for c in COLUMNS)).repartition(3)


VALIDATOR = {
    "missing_index": [{"pivot_index": None}, {"confirmation_index": "3.5"}],
    "confirmation_before_pivot": [{"confirmation_index": "1"}],
    "duplicate_rows": [{"pivot_index": "10", "confirmation_index": "16"}],
    "invalid_pivot_side": [{"pivot_side": "MID"}, {"pivot_side": None}],
    "unknown_structure": [{"structure_type": None}, {"structure_type": ""}],
    "invalid_target": [{"target": "JUMP"}],
    "missing_price": [{"pivot_price": ""}, {"pivot_price": None}],
    "missing_timestamp": [{"pivot_timestamp": None}],
    "atr_zero": [{"atr_14": "0"}, {"atr_14": None}],
    "volume_zero": [{"pivot_volume": "-1"}],
}
AUDITOR = {
    "MISSING_PIVOT_INDEX": [{"pivot_index": "x"}],
    "MISSING_CONFIRMATION_INDEX": [{"confirmation_index": None}],
    "CONFIRMATION_BEFORE_PIVOT": [{"confirmation_index": "1", "confirmation_delay": None}],
    "INVALID_CONFIRMATION_DELAY": [{"confirmation_delay": "4"}],
    "NON_NUMERIC_BARS_SINCE": [{c: "soon"} for c in V.BARS_SINCE],
    "INVALID_BARS_SINCE_SENTINEL": [{c: "-2"} for c in V.BARS_SINCE],
    "CONFIRMATION_TIMESTAMP_BEFORE_PIVOT": [{"confirmation_timestamp": "2023-12-31T23:59:00"}],
    "INVALID_FUTURE_LABEL_INDEX": [{"swept_index": "later"}],
    "LABEL_EVENT_BEFORE_CONFIRMATION": [{"swept_index": "2"}],
    "RESOLUTION_BEFORE_SWEEP": [{"swept_index": "900", "resolved_index": "899"}],
    "NON_BINARY_FLAG": [{c: "2"} for c in V.FLAGS],
    "INVALID_CAUSAL_COUNT": [{c: "-1"} for c in V.COUNTS] + [{c: "many"} for c in V.COUNTS],
    "DUPLICATE_CAUSAL_ROW": [{"pivot_index": "10", "confirmation_index": "15", "pivot_price": "9"}],
}


def planted(faults):
    rows, where = [good(k) for k in range(1, 6)], {}
    n = 100
    for code, own in faults.items():
        for fault in own:
            rows.append(good(n, **fault))
            where.setdefault(code, set()).add(n)
            n += 1
    return rows, where


def test_every_rule_of_the_validator(spark):
    rows, where = planted(VALIDATOR)
    df = table(spark, rows)
    got = V.validator_issues(df, ["n"]).collect()
    for code, own in where.items():
        assert {r["n"] for r in got if r["code"] == code} == own, code
    assert {r["code"] for r in got} == {*where, "negative_confirmation_delay"} and not {r["n"] for r in got} & set(range(1, 6))
    told = V.validator_report(df, ["n"]).first()
    wrong = {r["n"] for r in got if r["level"] == "error"}
    assert (told["total_rows"], told["invalid_rows"], told["valid_rows"]) == (len(rows), len(wrong), len(rows) - len(wrong))
    assert all(told[code] == len(own) for code, own in where.items())
    counts = {(r["column"], r["value"]): r["count"] for r in V.value_counts(df).collect()}
    assert counts["pivot_side", "MID"] == 1 and counts["pivot_side", "UNKNOWN"] == 1 and counts["structure_type", ""] == 1 and counts["timeframe", "1"] == len(rows)


def test_every_rule_of_the_auditor(spark):
    rows, where = planted(AUDITOR)
    df = table(spark, rows)
    issues = V.causality_issues(df, ["n"])
    got = issues.collect()
    for code, own in where.items():
        assert own <= {r["n"] for r in got if r["code"] == code}, code
        assert all(len([r for r in got if r["n"] == n and r["code"] == code]) == 1 for n in own), code
    assert {r["code"] for r in got} == set(where) and not {r["n"] for r in got} & set(range(1, 6))
    told = {r["code"]: r for r in V.issue_summary(issues, ["n"], 2).collect()}
    for code in where:
        own = [r for r in got if r["code"] == code]
        assert told[code]["count"] == len(own) and len(told[code]["examples"]) == min(2, len(own))
    with pytest.raises(ValueError):
        V.assert_causal(df, ["n"])
    V.assert_causal(table(spark, [good(k) for k in range(3)]), ["n"])


def test_columns_that_are_declared_and_those_that_are_there(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    got = {(r["level"], r["code"], r["column"]) for r in V.column_issues(df, ["b", "c"], features=["a", "target"], forbidden=["target"]).collect()}
    assert got == {("error", "FORBIDDEN_FEATURE", "target"), ("warning", "UNDECLARED_COLUMN", "a"), ("warning", "MISSING_DECLARED_COLUMN", "c")}
    assert V.validator_report(df, ["a"]).first()["missing_index"] == 2  # columns that are not there


def test_every_rule_of_the_level_audit(spark):
    bars = spark.createDataFrame([("s", i, *x) for i, x in enumerate([(10.0, 9.0, 9.5), (12.0, 9.0, 11.5), (12.0, 9.0, 9.5), (12.0, 11.2, 11.5), (10.5, 9.0, 9.5)])], "series_id string, bar_idx long, high double, low double, close double")
    levels = {
        "fine": ("BSL", 11.0, 0, 1, 2, "GRAB"), "run": ("BSL", 11.0, 0, 1, 3, "RUN"), "sell": ("SSL", 9.2, 0, 1, 1, "SWEEP"), "open": ("BSL", 20.0, 0, None, None, "NONE"),
        "not_taken_at_sweep": ("BSL", 11.0, 0, 4, None, "NONE"), "swept_before_created": ("BSL", 11.0, 1, 1, None, "NONE"), "resolved_before_swept": ("BSL", 11.0, 0, 3, 2, "GRAB"), "resolved_without_class": ("BSL", 11.0, 0, 1, 2, "NONE"),
        "class_without_resolution": ("BSL", 11.0, 0, 1, None, "RUN"), "sweep_not_in_one_bar": ("BSL", 11.0, 0, 1, 2, "SWEEP"), "no_return_in_grab": ("BSL", 11.0, 0, 1, 3, "GRAB"), "returned_in_run": ("BSL", 11.0, 0, 1, 2, "RUN"),
    }
    names = list(levels)
    df = spark.createDataFrame([("s", i, *levels[n]) for i, n in enumerate(names)], "series_id string, level_id long, type string, price double, created_idx long, swept_idx long, resolved_idx long, class string")
    got = {}
    for r in A.level_classes(df, bars).collect():
        got.setdefault(names[r["level_id"]], set()).add(r["error"])
    assert got == {n: {n} for n in names[4:]}
