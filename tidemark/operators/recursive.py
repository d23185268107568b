"""Recursions that windows can't express: one ordered fold per series, in a grouped map."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.operators.windows import with_true_range


def wilder(values, period: int, seed_short: bool = False) -> list[float | None]:
    """Mean of the first `period` values, then (prev * (period - 1) + value) / period; None before.

    seed_short: a shorter series is seeded from what there is, and the seed counts from the first bar.
    """
    n = len(values)
    if seed_short:
        period_seed = min(n, period)
    elif n < period:
        return [None] * n
    else:
        period_seed = period
    total = 0.0
    for v in values[:period_seed]:
        total += v
    seed = total / period_seed if period_seed else 0.0
    out: list[float | None] = [seed if seed_short else None] * (period_seed - 1) + [seed]
    for v in values[period_seed:]:
        out.append((out[-1] * (period - 1) + v) / period)
    return out


def atr(bars: DataFrame, period: int = 14, *, name: str = "atr", seed_short: bool = False) -> DataFrame:
    """Wilder's average true range as one more column, null for the first period - 1 bars."""
    base = with_true_range(bars)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in base.schema)}, `{name}` double"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_idx")
        part[name] = pd.array(wilder(part["tr"].tolist(), period, seed_short), dtype="Float64").to_numpy("float64", na_value=float("nan")) if len(part) else []
        part[name] = part[name].astype(object).where(part[name].notna(), None)
        return part

    return base.groupBy("series_id").applyInPandas(fold, schema)


def ema(bars: DataFrame, column: str = "volume", span: int = 9, *, name: str = "ema") -> DataFrame:
    """Exponential mean with weight 2 / (span + 1), seeded with the first value."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in bars.schema)}, `{name}` double"
    a = 2.0 / (span + 1)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_idx")
        out: list[float] = []
        for v in part[column]:
            out.append(v if not out else a * v + (1 - a) * out[-1])
        part[name] = out
        return part

    return bars.groupBy("series_id").applyInPandas(fold, schema)
