"""Queries of the bar, indicator and detector operators over bars made from `events`, with their SQL.

Bars: series = event_type, price = value, one hour, volume = number of ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import levels as L
from tidemark.operators import live
from tidemark.operators import lookups as K
from tidemark.operators import pivots as P
from tidemark.operators import profile as V
from tidemark.operators import recursive as R
from tidemark.operators import structure as S
from tidemark.operators import windows as W

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Bars as a common table expression, and Wilder's ATR over them by recursion.
BARS = """ticks AS (SELECT event_type AS series_id, CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS epoch, ts, event_id, value FROM events),
made AS (SELECT series_id, epoch, (array_agg(value ORDER BY ts, event_id))[1] AS open, max(value) AS high, min(value) AS low,
  (array_agg(value ORDER BY ts DESC, event_id DESC))[1] AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY series_id, epoch),
bars AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY epoch) - 1 AS bar_idx FROM made)"""
TR = BARS + """,
trs AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr
  FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx))"""
ATR = TR + """,
seed AS (SELECT series_id, sum(tr) / 14 AS atr FROM trs WHERE bar_idx < 14 GROUP BY series_id HAVING count(*) = 14),
wilder AS (SELECT series_id, CAST(13 AS BIGINT) AS bar_idx, atr FROM seed
  UNION ALL SELECT w.series_id, t.bar_idx, (w.atr * 13 + t.tr) / 14 FROM wilder w JOIN trs t ON t.series_id = w.series_id AND t.bar_idx = w.bar_idx + 1),
barsatr AS (SELECT t.*, w.atr FROM trs t LEFT JOIN wilder w USING (series_id, bar_idx))"""
def legs(n: int) -> str:
    return _LEGS.replace("bar_idx - 5", f"bar_idx - {n}").replace(", 5)", f", {n})").replace("4 PRECEDING", f"{n - 1} PRECEDING")


_LEGS = """,
sig AS (SELECT series_id, bar_idx, lag(high, 5) OVER w AS h, lag(low, 5) OVER w AS l,
  CASE WHEN lag(high, 5) OVER w > max(high) OVER f THEN 0 WHEN lag(low, 5) OVER w < min(low) OVER f THEN 1 END AS signal
  FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx), f AS (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
legs AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS leg FROM sig),
flips AS (SELECT *, lag(leg, 1, 0) OVER (PARTITION BY series_id ORDER BY bar_idx) AS was FROM legs WHERE h IS NOT NULL),
pivots AS (SELECT series_id, bar_idx - 5 AS pivot_idx, bar_idx AS confirm_idx, CASE WHEN leg = 1 THEN 'LOW' ELSE 'HIGH' END AS type,
  CASE WHEN leg = 1 THEN l ELSE h END AS price FROM flips WHERE leg <> was)"""
LEGS = legs(5)
def breaks_sql(up: str = "true", down: str = "true") -> str:
    return LEGS + f""",
closes AS (SELECT series_id, bar_idx, close, lag(close) OVER (PARTITION BY series_id ORDER BY bar_idx) AS before, high - greatest(open, close) AS upper, least(open, close) - low AS lower FROM bars),
live AS (SELECT *, lead(confirm_idx) OVER (PARTITION BY series_id, type ORDER BY confirm_idx) AS until FROM pivots),
firsts AS (SELECT p.series_id, p.type, p.pivot_idx, p.confirm_idx, p.price, min(c.bar_idx) AS break_idx FROM live p JOIN closes c ON c.series_id = p.series_id
  AND c.bar_idx >= p.confirm_idx AND (p.until IS NULL OR c.bar_idx < p.until)
  AND CASE WHEN p.type = 'HIGH' THEN c.before <= p.price AND c.close > p.price AND {up} ELSE c.before >= p.price AND c.close < p.price AND {down} END GROUP BY ALL),
directed AS (SELECT *, CASE WHEN type = 'HIGH' THEN 1 ELSE -1 END AS direction FROM firsts),
smc AS (SELECT series_id, CASE WHEN lag(direction) OVER w <> direction THEN 'CHOCH' ELSE 'BOS' END || CASE WHEN direction = 1 THEN '_UP' ELSE '_DOWN' END AS event,
  CAST(direction AS BIGINT) AS direction, break_idx, pivot_idx, price, row_number() OVER w AS event_no
  FROM directed WINDOW w AS (PARTITION BY series_id ORDER BY break_idx, direction DESC, pivot_idx))"""


BREAKS = breaks_sql()
GAPS = """,
lagged AS (SELECT series_id, bar_idx, lag(high, 3) OVER w AS h3, lag(low, 3) OVER w AS l3, lag(high) OVER w AS h1, lag(low) OVER w AS l1
  FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx)),
gaps AS (SELECT series_id, bar_idx AS gap_idx, CASE WHEN h3 < l1 THEN 'BULLISH_FVG' ELSE 'BEARISH_FVG' END AS type,
  CASE WHEN h3 < l1 THEN l1 ELSE l3 END AS top, CASE WHEN h3 < l1 THEN h3 ELSE h1 END AS bottom FROM lagged WHERE h3 < l1 OR l3 > h1)"""
LEVELS = LEGS + """,
levels AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY confirm_idx, type, pivot_idx) AS level_id,
  CASE WHEN type = 'HIGH' THEN 'BSL' ELSE 'SSL' END AS type, confirm_idx AS created_idx, price FROM pivots),
sweeps AS (SELECT l.*, (SELECT min(b.bar_idx) FROM bars b WHERE b.series_id = l.series_id AND b.bar_idx > l.created_idx
  AND CASE WHEN l.type = 'BSL' THEN b.high > l.price ELSE b.low < l.price END) AS swept_idx FROM levels l),
held AS (SELECT series_id, bar_idx, min(close) OVER w AS run_low, max(close) OVER w AS run_high FROM bars
  WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
ends AS (SELECT s.*, (SELECT min(b.bar_idx) FROM bars b WHERE b.series_id = s.series_id AND b.bar_idx >= s.swept_idx AND CASE WHEN s.type = 'BSL' THEN b.close < s.price ELSE b.close > s.price END) AS g,
  (SELECT min(h.bar_idx) FROM held h WHERE h.series_id = s.series_id AND h.bar_idx >= s.swept_idx + 2 AND CASE WHEN s.type = 'BSL' THEN h.run_low > s.price ELSE h.run_high < s.price END) AS r FROM sweeps s),
lifecycle AS (SELECT series_id, level_id, type, created_idx, price, swept_idx, CASE WHEN g IS NULL THEN r WHEN r IS NULL THEN g ELSE least(g, r) END AS resolved_idx,
  CASE WHEN g = swept_idx THEN 'SWEEP' WHEN g IS NOT NULL AND (r IS NULL OR g < r) THEN 'GRAB' WHEN r IS NOT NULL THEN 'RUN' ELSE 'NONE' END AS class FROM ends)"""


def bars_of(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    return B.from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), series="event_type", ts="ts", price="value", tie="event_id", seconds=seconds)


def confirmations(bars: DataFrame) -> DataFrame:
    """(series_id, event_idx): the bars at which a pivot is confirmed."""
    return P.leg_pivots(bars).select("series_id", F.col("confirm_idx").alias("event_idx")).distinct()


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places, so that the order of additions does not show."""
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c).cast("long") if t == "int" else F.col(c) for c, t in df.select(*columns).dtypes))


def query(name: str, sql: str | None = None):
    """Registers a function of (bars, spark, sf_dir) as a query over hourly bars, with its SQL."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(bars_of(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


OHLCV = ("open", "high", "low", "close", "volume")


@query("ohlcv_resample", f"WITH {BARS} SELECT series_id, bar_idx, epoch, open, high, low, close, volume FROM bars")
def _(bars, spark, d):
    return bars.select("series_id", "bar_idx", "epoch", *OHLCV)


_COARSE = "SELECT series_id, '{tf}' AS tf, {start} AS epoch, arg_min(open, epoch) AS open, max(high) AS high, min(low) AS low, arg_max(close, epoch) AS close, sum(volume) AS volume FROM bars GROUP BY series_id, {start}"
_FLOOR = "CAST(floor((epoch - {shift}) / {s}) AS BIGINT) * {s} + {shift}"


def _coarse(tf: str, s: int, shift: int = 0) -> str:
    return _COARSE.format(tf=tf, start=_FLOOR.format(s=s, shift=shift))


_FRAMES = {"60": 3600, "120": 7200, "240": 14400, "D": 86400, "W": 604800}


@query("multi_timeframe", f"WITH {BARS}, frames AS ({' UNION ALL '.join(_coarse(k, s, 345600 if k == 'W' else 0) for k, s in _FRAMES.items())}) SELECT *, row_number() OVER (PARTITION BY series_id, tf ORDER BY epoch) - 1 AS bar_idx FROM frames")
def _(bars, spark, d):
    return B.timeframes(bars, _FRAMES).select("series_id", "tf", "epoch", *OHLCV, "bar_idx")


@query("week_monday_bars", f"WITH {BARS}, w AS ({_coarse('W', 604800, 345600)}) SELECT series_id, epoch, open, high, low, close, volume, row_number() OVER (PARTITION BY series_id ORDER BY epoch) - 1 AS bar_idx FROM w")
def _(bars, spark, d):
    return B.resample(bars, B.WEEK).select("series_id", "epoch", *OHLCV, "bar_idx")


@query("week_epoch_bars", f"WITH {BARS}, w AS ({_coarse('W', 604800)}) SELECT series_id, epoch, open, high, low, close, volume, row_number() OVER (PARTITION BY series_id ORDER BY epoch) - 1 AS bar_idx FROM w")
def _(bars, spark, d):
    return B.resample(bars, B.WEEK, week="epoch").select("series_id", "epoch", *OHLCV, "bar_idx")


@query("bar_slice", f"WITH {BARS} SELECT series_id, bar_idx, close FROM bars WHERE bar_idx BETWEEN 20 AND 40")
def _(bars, spark, d):
    return B.between(bars, 20, 40).select("series_id", "bar_idx", "close")


@query("time_anchors", f"WITH {BARS}, a AS (SELECT series_id, bar_idx, epoch, CAST(floor(epoch / 86400) AS BIGINT) <> lag(CAST(floor(epoch / 86400) AS BIGINT), 1, -1) OVER (PARTITION BY series_id ORDER BY bar_idx) AS new_day FROM bars) SELECT series_id, bar_idx, new_day FROM a WHERE new_day OR CAST(floor(epoch / 60) AS BIGINT) % 15 = 0")
def _(bars, spark, d):
    return B.time_anchors(bars).select("series_id", "bar_idx", "new_day")


@query("trailing_blocks", f"WITH {BARS}{LEGS}, ev AS (SELECT DISTINCT series_id, confirm_idx AS event_idx FROM pivots), n AS (SELECT e.series_id, e.event_idx, CAST(floor((e.event_idx - b.bar_idx) / 3.0) AS BIGINT) AS block, b.bar_idx, b.open, b.high, b.low, b.close, b.volume FROM ev e JOIN bars b ON b.series_id = e.series_id AND b.bar_idx BETWEEN e.event_idx - 59 AND e.event_idx) SELECT series_id, event_idx, block, arg_min(open, bar_idx) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_idx) AS close, sum(volume) AS volume FROM n GROUP BY series_id, event_idx, block")
def _(bars, spark, d):
    return W.trailing_blocks(bars, confirmations(bars), 3).select("series_id", "event_idx", "block", *OHLCV)


@query("true_range", f"WITH {TR} SELECT series_id, bar_idx, {r6('tr')} FROM trs")
def _(bars, spark, d):
    return rounded(W.with_true_range(bars), "series_id", "bar_idx", "tr")


@query("atr_wilder", f"WITH RECURSIVE {ATR} SELECT series_id, bar_idx, {r6('atr')} FROM barsatr")
def _(bars, spark, d):
    return rounded(R.atr(bars), "series_id", "bar_idx", "atr")


@query("ema_volume", f"WITH RECURSIVE {BARS}, e AS (SELECT series_id, bar_idx, volume AS ema FROM bars WHERE bar_idx = 0 UNION ALL SELECT b.series_id, b.bar_idx, 0.2 * b.volume + 0.8 * e.ema FROM e JOIN bars b ON b.series_id = e.series_id AND b.bar_idx = e.bar_idx + 1) SELECT series_id, bar_idx, {r6('ema')} FROM e")
def _(bars, spark, d):
    return rounded(R.ema(bars), "series_id", "bar_idx", "ema")


@query("candle_anatomy", f"WITH {BARS} SELECT series_id, bar_idx, {r6('range', 'body', 'upper_wick', 'lower_wick', 'close_position')}, direction FROM (SELECT series_id, bar_idx, high - low AS range, abs(close - open) AS body, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.0 END AS close_position, CAST(sign(close - open) AS BIGINT) AS direction FROM bars)")
def _(bars, spark, d):
    return rounded(W.anatomy(bars), "series_id", "bar_idx", "range", "body", "upper_wick", "lower_wick", "close_position", "direction")


_VOL = "(PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query("rolling_volume_stats", f"WITH {BARS}, s AS (SELECT series_id, bar_idx, volume, coalesce(avg(volume) OVER {_VOL}, 0) AS volume_mean, coalesce(stddev_pop(volume) OVER {_VOL}, 0) AS volume_std FROM bars) SELECT series_id, bar_idx, {r6('volume_mean', 'volume_std')}, round(CASE WHEN volume_mean <> 0 THEN volume / volume_mean ELSE 0.0 END, 6) + 0.0 AS volume_ratio, round(CASE WHEN volume_std <> 0 THEN (volume - volume_mean) / volume_std ELSE 0.0 END, 6) + 0.0 AS volume_zscore FROM s")
def _(bars, spark, d):
    return rounded(W.volume_stats(bars), "series_id", "bar_idx", "volume_mean", "volume_std", "volume_ratio", "volume_zscore")


@query("candle_rolling", f"WITH {BARS}, s AS (SELECT series_id, bar_idx, avg(close) OVER (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS close_mean, coalesce(avg(volume) OVER {_VOL}, 0) AS volume_mean, coalesce(stddev_samp(volume) OVER {_VOL}, 0) AS volume_std FROM bars) SELECT series_id, bar_idx, {r6('close_mean', 'volume_mean', 'volume_std')} FROM s")
def _(bars, spark, d):
    return rounded(W.candle_stats(bars), "series_id", "bar_idx", "close_mean", "volume_mean", "volume_std")


_RET = "coalesce((close - lag(close, {n}) OVER w) / nullif(lag(close, {n}) OVER w, 0), 0) AS return_{n}"
_RETS = f"rets AS (SELECT *, {', '.join(_RET.format(n=n) for n in (1, 3, 5))} FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY bar_idx))"


@query("returns_1_3_5", f"WITH {BARS}, {_RETS} SELECT series_id, bar_idx, {r6('return_1', 'return_3', 'return_5')} FROM rets")
def _(bars, spark, d):
    return rounded(W.returns(bars), "series_id", "bar_idx", "return_1", "return_3", "return_5")


def _last(n: int) -> str:
    return f"(PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("realized_vol", f"WITH {BARS}, {_RETS}, v AS (SELECT series_id, bar_idx, coalesce(stddev_samp(return_1) OVER {_last(10)}, 0) AS volatility_10, coalesce(stddev_samp(return_1) OVER {_last(20)}, 0) AS volatility_20 FROM rets) SELECT series_id, bar_idx, {r6('volatility_10', 'volatility_20')} FROM v")
def _(bars, spark, d):
    return rounded(W.realized_volatility(bars), "series_id", "bar_idx", "volatility_10", "volatility_20")


@query("rolling_slope", f"WITH {BARS}, v AS (SELECT series_id, bar_idx, CASE WHEN bar_idx = 0 THEN 0 ELSE regr_slope(close, CAST(bar_idx AS DOUBLE)) OVER {_last(10)} END AS slope_10, CASE WHEN bar_idx = 0 THEN 0 ELSE regr_slope(close, CAST(bar_idx AS DOUBLE)) OVER {_last(20)} END AS slope_20 FROM bars) SELECT series_id, bar_idx, {r6('slope_10', 'slope_20')} FROM v")
def _(bars, spark, d):
    return rounded(W.slopes(bars), "series_id", "bar_idx", "slope_10", "slope_20")


def _vwap(anchor: str, start: str = "") -> str:
    w = "(PARTITION BY series_id, anchor ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""WITH {BARS}, a AS (SELECT bars.*, {anchor} AS anchor, (high + low + close) / 3 AS t FROM bars {start}),
s AS (SELECT series_id, bar_idx, anchor, sum(t * volume) OVER {w} / nullif(sum(volume) OVER {w}, 0) AS vwap, sum(t * t * volume) OVER {w} / nullif(sum(volume) OVER {w}, 0) AS sq FROM a),
v AS (SELECT series_id, bar_idx, anchor, vwap, sqrt(greatest(sq - vwap * vwap, 0)) AS stdev FROM s)
SELECT series_id, bar_idx, anchor, round(vwap + 1e-8, 6) + 0.0 AS vwap, round(stdev, 4) + 0.0 AS stdev, round(vwap + 2 * stdev, 4) + 0.0 AS upper_2, round(vwap - 2 * stdev, 4) + 0.0 AS lower_2 FROM v"""


def _vwap_rows(out):
    return out.select("series_id", "bar_idx", "anchor", (F.round(F.col("vwap") + 1e-8, 6) + 0.0).alias("vwap"), *((F.round(c, 4) + 0.0).alias(c) for c in ("stdev", "upper_2", "lower_2")))


@query("anchored_vwap_day", _vwap(_FLOOR.format(s=86400, shift=0)))
def _(bars, spark, d):
    return _vwap_rows(W.anchored_vwap(bars, B.DAY))


@query("anchored_vwap_week", _vwap(_FLOOR.format(s=604800, shift=345600)))
def _(bars, spark, d):
    return _vwap_rows(W.anchored_vwap(bars, B.WEEK))


@query("anchored_vwap_month", _vwap("CAST(epoch(date_trunc('month', TIMESTAMP '1970-01-01' + to_seconds(epoch))) AS BIGINT)"))
def _(bars, spark, d):
    return _vwap_rows(W.anchored_vwap(bars, "month"))


@query("anchored_vwap_manual", _vwap("t.at", "JOIN (SELECT series_id, min(bar_idx) AS at FROM bars b WHERE high = (SELECT max(high) FROM bars c WHERE c.series_id = b.series_id) GROUP BY series_id) t ON t.series_id = bars.series_id AND bars.bar_idx >= t.at"))
def _(bars, spark, d):
    highest = bars.groupBy("series_id").agg(F.min_by("bar_idx", F.struct(-F.col("high"), "bar_idx")).alias("anchor_idx"))
    return _vwap_rows(W.vwap_from(bars, highest))


@query("rolling_vwap", f"WITH {BARS}, v AS (SELECT series_id, bar_idx, close - coalesce(sum((high + low + close) / 3 * volume) OVER {_last(60)} / nullif(sum(volume) OVER {_last(60)}, 0), (high + low) / 2) AS vwap_distance FROM bars) SELECT series_id, bar_idx, round(vwap_distance + 1e-8, 6) + 0.0 AS vwap_distance FROM v")
def _(bars, spark, d):
    return rounded(W.rolling_vwap(bars).withColumn("vwap_distance", F.col("vwap_distance") + 1e-8), "series_id", "bar_idx", "vwap_distance")


@query("fib_distances", f"WITH {BARS}, v AS (SELECT series_id, bar_idx, close, max(high) OVER {_last(20)} AS hi, min(low) OVER {_last(20)} AS lo FROM bars) SELECT series_id, bar_idx, round(close - (lo + (hi - lo) * 0.382), 6) + 0.0 AS fib_382, round(close - (lo + (hi - lo) * 0.5), 6) + 0.0 AS fib_500, round(close - (lo + (hi - lo) * 0.618), 6) + 0.0 AS fib_618 FROM v")
def _(bars, spark, d):
    return rounded(W.fib_distances(bars), "series_id", "bar_idx", "fib_382", "fib_500", "fib_618")


@query("sr_windows", f"WITH {BARS} SELECT series_id, bar_idx, " + ", ".join(f"round(max(high) OVER {_last(n)} - (high + low) / 2, 6) + 0.0 AS resistance_{n}, round((high + low) / 2 - min(low) OVER {_last(n)}, 6) + 0.0 AS support_{n}" for n in (240, 1440, 10080)) + " FROM bars")
def _(bars, spark, d):
    return rounded(W.support_resistance(bars), "series_id", "bar_idx", *(f"{c}_{n}" for n in (240, 1440, 10080) for c in ("resistance", "support")))


@query("supply_demand_score", f"WITH {BARS}, s AS (SELECT *, abs(close - open) / greatest(high - low, 0.25) * volume AS score FROM bars), p AS (SELECT a.series_id, a.bar_idx, b.low, b.high, b.close > b.open AS up, row_number() OVER (PARTITION BY a.series_id, a.bar_idx, b.close > b.open ORDER BY b.score DESC, b.bar_idx) AS n FROM s a JOIN s b ON b.series_id = a.series_id AND b.bar_idx BETWEEN greatest(a.bar_idx - 240, 1) AND a.bar_idx AND b.close <> b.open), f AS (SELECT series_id, bar_idx, max(CASE WHEN up THEN low END) AS demand, max(CASE WHEN NOT up THEN high END) AS supply FROM p WHERE n = 1 GROUP BY series_id, bar_idx) SELECT b.series_id, b.bar_idx, coalesce(f.demand, (b.high + b.low) / 2) AS demand, coalesce(f.supply, (b.high + b.low) / 2) AS supply FROM bars b LEFT JOIN f USING (series_id, bar_idx)")
def _(bars, spark, d):
    return W.supply_demand_score(bars).select("series_id", "bar_idx", "demand", "supply")


_TRACE = " ".join(f", CAST(sum(CASE WHEN k <= {h} THEN nh + nl ELSE 0 END) AS BIGINT) AS trace_{h}" for h in (3, 5, 10, 15))


@query("trace_counts", f"WITH {BARS}, f AS (SELECT a.series_id, a.bar_idx, b.bar_idx - a.bar_idx AS k, b.high, b.low FROM bars a JOIN bars b ON b.series_id = a.series_id AND b.bar_idx BETWEEN a.bar_idx AND a.bar_idx + 15), g AS (SELECT series_id, bar_idx, k, CASE WHEN high > max(high) OVER w THEN 1 ELSE 0 END AS nh, CASE WHEN low < min(low) OVER w THEN 1 ELSE 0 END AS nl FROM f WINDOW w AS (PARTITION BY series_id, bar_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT series_id, bar_idx {_TRACE} FROM g GROUP BY series_id, bar_idx")
def _(bars, spark, d):
    return W.trace_counts(bars).select("series_id", "bar_idx", "trace_3", "trace_5", "trace_10", "trace_15")


@query("leg_pivots_5", f"WITH {BARS}{LEGS} SELECT series_id, pivot_idx, confirm_idx, type, price FROM pivots")
def _(bars, spark, d):
    return P.leg_pivots(bars)


_F10 = "(PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN {} AND {})"
_PRE, _POST = _F10.format("10 PRECEDING", "1 PRECEDING"), _F10.format("1 FOLLOWING", "10 FOLLOWING")


@query("fractal_pivots_10", f"WITH {BARS}, f AS (SELECT series_id, bar_idx, high, low, high > greatest(max(high) OVER {_PRE}, max(high) OVER {_POST}) AS top, low < least(min(low) OVER {_PRE}, min(low) OVER {_POST}) AS bottom, count(*) OVER {_PRE} = 10 AND count(*) OVER {_POST} = 10 AS whole FROM bars) SELECT series_id, bar_idx AS pivot_idx, bar_idx + 10 AS confirm_idx, CASE WHEN top THEN 'HIGH' ELSE 'LOW' END AS type, CASE WHEN top THEN high ELSE low END AS price FROM f WHERE whole AND (top OR bottom)")
def _(bars, spark, d):
    return P.fractal_pivots(bars)


@query("swing_labels", f"WITH {BARS}{LEGS}, p AS (SELECT *, lag(price) OVER (PARTITION BY series_id, type ORDER BY pivot_idx) AS b FROM pivots) SELECT series_id, pivot_idx, type, CASE WHEN type = 'HIGH' THEN CASE WHEN b IS NULL THEN 'H' WHEN price > b THEN 'HH' ELSE 'LH' END ELSE CASE WHEN b IS NULL THEN 'L' WHEN price > b THEN 'HL' ELSE 'LL' END END AS label FROM p")
def _(bars, spark, d):
    return P.labels(P.leg_pivots(bars)).select("series_id", "pivot_idx", "type", "label")


@query("zigzag_mtf", f"WITH {BARS}, n AS (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY CAST(floor(epoch / 14400) AS BIGINT)) AS nth FROM bars), s AS (SELECT series_id, nth, min(bar_idx) AS first_bar FROM n GROUP BY series_id, nth), c AS (SELECT a.series_id, a.bar_idx, a.high, a.low, a.high >= max(b.high) AS ph, a.low <= min(b.low) AS pl FROM n a JOIN s ON s.series_id = a.series_id AND s.nth = greatest(a.nth - 1, 1) JOIN n b ON b.series_id = a.series_id AND b.bar_idx BETWEEN s.first_bar AND a.bar_idx GROUP BY a.series_id, a.bar_idx, a.high, a.low), t AS (SELECT *, last_value(CASE WHEN ph AND NOT pl THEN 1 WHEN pl AND NOT ph THEN -1 END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dir FROM c), k AS (SELECT *, CASE WHEN dir = 1 THEN high ELSE low END AS price, CASE WHEN dir <> lag(dir) OVER (PARTITION BY series_id ORDER BY bar_idx) THEN 1 ELSE 0 END AS turn FROM t WHERE dir IS NOT NULL AND (ph OR pl)), i AS (SELECT *, sum(turn) OVER (PARTITION BY series_id ORDER BY bar_idx) AS island FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY series_id, island ORDER BY price * dir DESC, bar_idx) AS n FROM i) SELECT series_id, bar_idx AS pivot_idx, CASE WHEN dir = 1 THEN 'HIGH' ELSE 'LOW' END AS type, price FROM r WHERE n = 1")
def _(bars, spark, d):
    return P.zigzag_mtf(bars)


@query("external_zigzag")
def _(bars, spark, d):
    return P.swing_pivots(bars)


@query("fib_levels", f"WITH {BARS}{LEGS}, t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pivot_idx DESC) AS n FROM pivots), e AS (SELECT series_id, max(CASE WHEN n = 2 THEN price END) AS a, max(CASE WHEN n = 1 THEN price END) AS b FROM t WHERE n <= 2 GROUP BY series_id), q AS (SELECT unnest([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0]) AS x) SELECT series_id, CAST(x AS DOUBLE) AS ratio, round(b + (a - b) * CAST(x AS DOUBLE), 6) + 0.0 AS price FROM e, q WHERE a IS NOT NULL")
def _(bars, spark, d):
    return rounded(P.fibonacci(P.leg_pivots(bars)), "series_id", "ratio", "price")


@query("equal_levels", f"WITH RECURSIVE {ATR}{legs(3)}, a AS (SELECT p.*, b.atr FROM pivots p JOIN barsatr b ON b.series_id = p.series_id AND b.bar_idx = p.confirm_idx WHERE b.atr > 0), l AS (SELECT *, lag(pivot_idx) OVER w AS idx1, lag(price) OVER w AS price1 FROM a WINDOW w AS (PARTITION BY series_id, type ORDER BY confirm_idx)) SELECT series_id, CASE WHEN type = 'HIGH' THEN 'EQH' ELSE 'EQL' END AS type, idx1, pivot_idx AS idx2, confirm_idx AS confirm2, price1, price AS price2 FROM l WHERE abs(price - price1) < atr * 0.1")
def _(bars, spark, d):
    return P.equal_levels(P.leg_pivots(bars, 3), R.atr(bars))


@query("fvg", f"WITH {BARS}{GAPS} SELECT * FROM gaps")
def _(bars, spark, d):
    return S.gaps(bars)


@query("fvg_mitigation", f"WITH {BARS}{GAPS} SELECT g.*, (SELECT min(b.bar_idx) FROM bars b WHERE b.series_id = g.series_id AND b.bar_idx >= g.gap_idx AND CASE WHEN g.type = 'BULLISH_FVG' THEN b.low <= g.top ELSE b.high >= g.bottom END) AS mitigated_idx FROM gaps g")
def _(bars, spark, d):
    return S.mitigated_gaps(bars)


@query("bos_choch", f"WITH {BARS}{BREAKS} SELECT * FROM smc")
def _(bars, spark, d):
    return S.breaks(P.leg_pivots(bars), bars)


@query("order_blocks", f"""WITH {BARS}{BREAKS}, span AS (SELECT e.event_no, e.direction, e.break_idx, b.*, CASE WHEN e.direction = 1 THEN b.close < b.open ELSE b.close > b.open END AS opp FROM smc e JOIN bars b ON b.series_id = e.series_id AND b.bar_idx BETWEEN e.pivot_idx AND e.break_idx - 1 WHERE e.break_idx > e.pivot_idx),
pick AS (SELECT *, row_number() OVER (PARTITION BY series_id, event_no ORDER BY opp DESC, CASE WHEN opp THEN -bar_idx END, CASE WHEN direction = 1 THEN low ELSE -high END, bar_idx) AS n FROM span)
SELECT series_id, event_no, CASE WHEN direction = 1 THEN 'BULLISH_OB' ELSE 'BEARISH_OB' END AS type, bar_idx AS ob_idx, break_idx, high AS top, low AS bottom,
(SELECT min(b.bar_idx) FROM bars b WHERE b.series_id = p.series_id AND b.bar_idx > p.break_idx AND CASE WHEN p.direction = 1 THEN b.low <= p.high ELSE b.high >= p.low END) AS touch_idx,
(SELECT min(b.bar_idx) FROM bars b WHERE b.series_id = p.series_id AND b.bar_idx > p.break_idx AND CASE WHEN p.direction = 1 THEN b.low < p.low ELSE b.high > p.high END) AS invalid_idx FROM pick p WHERE n = 1""")
def _(bars, spark, d):
    return S.order_blocks(S.breaks(P.leg_pivots(bars), bars), bars)


@query("liquidity_lifecycle", f"WITH {BARS}{LEVELS} SELECT *, CASE WHEN resolved_idx IS NOT NULL THEN 'Resolved' WHEN swept_idx IS NOT NULL THEN 'Swept' ELSE 'Detected' END AS state FROM lifecycle")
def _(bars, spark, d):
    return S.liquidity(P.leg_pivots(bars), bars)


@query("liquidity_counts", f"WITH {BARS}{LEVELS} SELECT series_id, type, class, count(*) AS n FROM lifecycle GROUP BY series_id, type, class")
def _(bars, spark, d):
    return S.liquidity(P.leg_pivots(bars), bars).groupBy("series_id", "type", "class").agg(F.count("*").alias("n"))


@query("supply_demand_zones")
def _(bars, spark, d):
    return S.supply_demand_zones(P.fractal_pivots(bars), R.atr(bars, 50, seed_short=True), bars)


@query("first_touch_outcome", f"""WITH RECURSIVE {ATR}, e AS (SELECT a.series_id, a.bar_idx, min(CASE WHEN b.high >= a.close + a.atr THEN b.bar_idx END) AS u, min(CASE WHEN b.low <= a.close - a.atr THEN b.bar_idx END) AS d
FROM barsatr a LEFT JOIN bars b ON b.series_id = a.series_id AND b.bar_idx BETWEEN a.bar_idx + 1 AND a.bar_idx + 10 WHERE a.atr > 0 GROUP BY a.series_id, a.bar_idx)
SELECT series_id, bar_idx, CASE WHEN u IS NOT NULL AND (d IS NULL OR u < d) THEN 'RUN_UP' WHEN d IS NOT NULL AND (u IS NULL OR d < u) THEN 'RUN_DOWN' ELSE 'NONE' END AS outcome FROM e""")
def _(bars, spark, d):
    return S.outcomes(R.atr(bars), bars)


@query("asof_last_event", f"WITH {BARS}{BREAKS}, j AS (SELECT b.series_id, b.bar_idx, e.event, e.break_idx, row_number() OVER (PARTITION BY b.series_id, b.bar_idx ORDER BY e.event_no DESC) AS n FROM bars b LEFT JOIN smc e ON e.series_id = b.series_id AND e.break_idx <= b.bar_idx) SELECT series_id, bar_idx, coalesce(event, 'NONE') AS event, coalesce(bar_idx - break_idx, -1) AS bars_since FROM j WHERE n = 1")
def _(bars, spark, d):
    e = S.breaks(P.leg_pivots(bars), bars)
    out = L.as_of(bars.select("series_id", "bar_idx"), e, ["event"], at="bar_idx", when="break_idx", order="event_no")
    return out.select("series_id", "bar_idx", F.coalesce("event", F.lit("NONE")).alias("event"), F.coalesce(F.col("bar_idx") - F.col("event_idx"), F.lit(-1)).alias("bars_since"))


@query("event_counts_20", f"WITH {BARS}{BREAKS} SELECT p.series_id, p.pivot_idx, p.confirm_idx, count(CASE WHEN e.event LIKE 'BOS%' THEN 1 END) AS bos_20, count(CASE WHEN e.event LIKE 'CHOCH%' THEN 1 END) AS choch_20 FROM pivots p LEFT JOIN smc e ON e.series_id = p.series_id AND e.break_idx BETWEEN p.confirm_idx - 19 AND p.confirm_idx GROUP BY p.series_id, p.pivot_idx, p.confirm_idx")
def _(bars, spark, d):
    p = P.leg_pivots(bars)
    e, key = S.breaks(p, bars), K.KEY
    count = lambda name, kind: live.live_count(p, e.where(F.col("event").startswith(kind)), key, at="confirm_idx", since=F.col("break_idx"), until=F.col("break_idx") + 20, name=name)
    return count("bos_20", "BOS").join(count("choch_20", "CHOCH"), key)


@query("nearest_zone", f"WITH {BARS}{LEGS}{GAPS}, m AS (SELECT p.series_id, p.pivot_idx, p.confirm_idx, g.type AS zone_type, g.gap_idx, greatest(g.bottom - p.price, p.price - g.top, 0) AS distance FROM pivots p JOIN gaps g ON g.series_id = p.series_id AND g.gap_idx <= p.confirm_idx), r AS (SELECT *, row_number() OVER (PARTITION BY series_id, pivot_idx, confirm_idx ORDER BY distance, gap_idx DESC) AS n FROM m) SELECT series_id, pivot_idx, confirm_idx, zone_type, gap_idx, {r6('distance')} FROM r WHERE n = 1")
def _(bars, spark, d):
    near = K.nearest_gap(P.leg_pivots(bars), S.mitigated_gaps(bars))
    return rounded(near, "series_id", "pivot_idx", "confirm_idx", "zone_type", "gap_idx", "distance")


@query("liquidity_density", f"WITH {BARS}{LEVELS}, m AS (SELECT p.series_id, p.pivot_idx, p.confirm_idx, p.price AS own, l.type AS side, l.price, l.created_idx > p.confirm_idx - 100 AS recent, l.resolved_idx IS NULL OR l.resolved_idx > p.confirm_idx AS active FROM pivots p JOIN lifecycle l ON l.series_id = p.series_id AND l.created_idx <= p.confirm_idx) SELECT series_id, pivot_idx, confirm_idx, count(CASE WHEN side = 'BSL' AND recent THEN 1 END) AS bsl_100, count(CASE WHEN side = 'SSL' AND recent THEN 1 END) AS ssl_100, count(CASE WHEN side = 'BSL' AND active THEN 1 END) AS active_bsl, count(CASE WHEN side = 'SSL' AND active THEN 1 END) AS active_ssl, round(min(CASE WHEN side = 'BSL' AND active THEN abs(price - own) END), 6) + 0.0 AS near_bsl, round(min(CASE WHEN side = 'SSL' AND active THEN abs(price - own) END), 6) + 0.0 AS near_ssl FROM m GROUP BY series_id, pivot_idx, confirm_idx")
def _(bars, spark, d):
    p = P.leg_pivots(bars)
    out = K.liquidity_density(p, S.liquidity(p, bars)).where("active_bsl + active_ssl + bsl_100 + ssl_100 > 0 or near_bsl is not null")
    return rounded(out, "series_id", "pivot_idx", "confirm_idx", "bsl_100", "ssl_100", "active_bsl", "active_ssl", "near_bsl", "near_ssl")


_BINS = "x AS (SELECT series_id, low, high, close, volume, min(low) OVER (PARTITION BY series_id) AS fl, (max(high) OVER (PARTITION BY series_id) - min(low) OVER (PARTITION BY series_id)) / {n} AS step FROM bars), q AS (SELECT CAST(unnest(range({n})) AS BIGINT) AS bin)"


@query("volume_profile_bins", f"WITH {BARS}, {_BINS.format(n=48)}, p AS (SELECT series_id, bin, fl + bin * step AS low, CASE WHEN x.high > x.low THEN volume * greatest((least(x.high, fl + bin * step + step) - greatest(x.low, fl + bin * step)) / (x.high - x.low), 0) ELSE volume END AS v FROM x, q WHERE CASE WHEN x.high > x.low THEN bin BETWEEN least(floor((x.low - fl) / step), 47) AND least(floor((x.high - fl) / step), 47) ELSE bin = least(floor((x.close - fl) / step), 47) END) SELECT series_id, bin, round(sum(v), 6) + 0.0 AS volume, round(min(low), 6) + 0.0 AS low FROM p GROUP BY series_id, bin")
def _(bars, spark, d):
    return rounded(V.overlap_bins(bars), "series_id", "bin", "volume", "low")


@query("poc_typical", f"WITH {BARS}, {_BINS.format(n=24)}, p AS (SELECT series_id, CAST(least(floor(((high + low + close) / 3 - fl) / step), 23) AS BIGINT) AS bin, sum(volume) AS v FROM x GROUP BY series_id, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v DESC, bin) AS n FROM p) SELECT series_id, bin AS poc, v AS poc_volume FROM r WHERE n = 1")
def _(bars, spark, d):
    return V.point_of_control(V.typical_bins(bars), ties="first")


@query("value_area", f"WITH RECURSIVE {BARS}, {_BINS.format(n=24)}, b AS (SELECT series_id, CAST(least(floor(((high + low + close) / 3 - fl) / step), 23) AS BIGINT) AS bin, sum(volume) AS v FROM x GROUP BY series_id, 2), p AS (SELECT s.series_id, q.bin, coalesce(b.v, 0) AS v FROM (SELECT DISTINCT series_id FROM b) s CROSS JOIN q LEFT JOIN b ON b.series_id = s.series_id AND b.bin = q.bin), t AS (SELECT series_id, sum(v) * 0.7 AS need FROM p GROUP BY series_id), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v DESC, bin DESC) AS n FROM p), a AS (SELECT series_id, bin AS poc, bin AS lo, bin AS hi, v AS acc, 0 AS k FROM r WHERE n = 1 UNION ALL SELECT a.series_id, a.poc, CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN a.lo ELSE a.lo - 1 END, CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN a.hi + 1 ELSE a.hi END, a.acc + CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN u.v ELSE d.v END, a.k + 1 FROM a JOIN t ON t.series_id = a.series_id LEFT JOIN p u ON u.series_id = a.series_id AND u.bin = a.hi + 1 LEFT JOIN p d ON d.series_id = a.series_id AND d.bin = a.lo - 1 WHERE a.acc < t.need AND (u.v IS NOT NULL OR d.v IS NOT NULL)), m AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY k DESC) AS n FROM a) SELECT series_id, poc, lo AS val, hi AS vah FROM m WHERE n = 1")
def _(bars, spark, d):
    return V.value_area(V.typical_bins(bars), 24)
