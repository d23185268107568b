"""Queries of the point-in-time lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lookups as K
from tidemark.operators import pivots as P
from tidemark.operators import recursive as R
from tidemark.operators import structure as S
from tidemark.operators import windows as W
from tidemark.plans import market as M

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_PIVOTS = f"piv AS (WITH {M.BARS}{M.LEGS} SELECT * FROM pivots)"
_ATR = f"ba AS (WITH RECURSIVE {M.ATR} SELECT * FROM barsatr)"
_NEAREST = "SELECT {c}, {d} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY series_id, pivot_idx, confirm_idx ORDER BY distance, {o}) AS n FROM m) WHERE n = 1"


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(M.bars_of(spark, sf_dir))
        ORACLE_SQL[name] = sql
        return f

    return keep


def nearest_sql(columns: str, order: str) -> str:
    return _NEAREST.format(c=columns, d="round(distance, 6) + 0.0", o=order)


@query("nearest_equal_level", f"""WITH {_PIVOTS}, eq AS ({M.ORACLE_SQL['equal_levels']}),
m AS (SELECT p.series_id, p.pivot_idx, p.confirm_idx, e.type AS level_type, e.idx2 AS level_idx, abs(p.price - (e.price1 + e.price2) / 2) AS distance FROM piv p JOIN eq e ON e.series_id = p.series_id AND e.confirm2 <= p.confirm_idx)
{nearest_sql('series_id, pivot_idx, confirm_idx, level_type, level_idx', 'level_idx, level_type')}""")
def _(bars):
    p = P.leg_pivots(bars)
    out = K.nearest_equal_level(p, P.equal_levels(P.leg_pivots(bars, 3), R.atr(bars)))
    return M.rounded(out, *K.KEY, "level_type", "level_idx", "distance")


@query("nearest_order_block", f"""WITH {_PIVOTS}, ob AS ({M.ORACLE_SQL['order_blocks']}),
m AS (SELECT p.series_id, p.pivot_idx, p.confirm_idx, o.type AS block_type, o.event_no, coalesce(o.invalid_idx <= p.confirm_idx, false) AS invalidated, greatest(o.bottom - p.price, p.price - o.top, 0) AS distance FROM piv p JOIN ob o ON o.series_id = p.series_id AND o.break_idx <= p.confirm_idx)
{nearest_sql('series_id, pivot_idx, confirm_idx, block_type, event_no, invalidated', 'event_no DESC')}""")
def _(bars):
    p = P.leg_pivots(bars)
    out = K.nearest_order_block(p, S.order_blocks(S.breaks(p, bars), bars))
    return M.rounded(out, *K.KEY, "block_type", "event_no", "invalidated", "distance")


@query("swing_moves", f"""WITH {_PIVOTS}, {_ATR}, s AS (SELECT p.*, b.atr, abs(p.price - lag(p.price) OVER w) AS move, p.pivot_idx - lag(p.pivot_idx) OVER w AS bars FROM piv p LEFT JOIN ba b ON b.series_id = p.series_id AND b.bar_idx = p.confirm_idx WINDOW w AS (PARTITION BY p.series_id ORDER BY p.pivot_idx, p.confirm_idx))
SELECT series_id, pivot_idx, confirm_idx, round(move, 6) + 0.0 AS move, bars, round(move / CASE WHEN atr > 0 THEN atr END, 6) + 0.0 AS move_atr FROM s""")
def _(bars):
    out = K.swings(P.leg_pivots(bars), R.atr(bars))
    return M.rounded(out, *out.columns)


@query("side_distances", f"""WITH {_ATR}, lv AS ({M.ORACLE_SQL['liquidity_lifecycle']}),
d AS (SELECT b.series_id, b.bar_idx, min(CASE WHEN l.type = 'BSL' AND l.price >= b.close THEN (l.price - b.close) / b.atr END) AS up, min(CASE WHEN l.type = 'SSL' AND l.price <= b.close THEN -((l.price - b.close) / b.atr) END) AS down,
  count(CASE WHEN l.type = 'BSL' AND l.price >= b.close THEN 1 END) AS up_count, count(CASE WHEN l.type = 'SSL' AND l.price <= b.close THEN 1 END) AS down_count
FROM ba b LEFT JOIN lv l ON l.series_id = b.series_id AND l.created_idx <= b.bar_idx AND coalesce(l.resolved_idx, l.swept_idx, b.bar_idx) >= b.bar_idx WHERE b.atr > 0 GROUP BY 1, 2)
SELECT series_id, bar_idx, round(coalesce(up, -1), 6) + 0.0 AS up, round(coalesce(down, -1), 6) + 0.0 AS down, up_count, down_count FROM d""")
def _(bars):
    out = K.side_distances(R.atr(bars), S.liquidity(P.leg_pivots(bars), bars))
    return M.rounded(out, *out.columns)


@query("regression_channel", f"""WITH tb AS ({M.ORACLE_SQL['trailing_blocks']}), x AS (SELECT *, CAST(max(block) OVER w - block AS DOUBLE) AS x, count(*) OVER w AS n, greatest(high - low, coalesce(abs(high - lag(close) OVER o), 0), coalesce(abs(low - lag(close) OVER o), 0)) AS tr
  FROM tb WINDOW w AS (PARTITION BY series_id, event_idx), o AS (PARTITION BY series_id, event_idx ORDER BY block DESC)),
l AS (SELECT series_id, event_idx, regr_slope(close, x) AS slope, regr_intercept(close, x) AS base, avg(CASE WHEN block < 14 THEN tr END) AS unit FROM x GROUP BY 1, 2),
f AS (SELECT x.*, l.slope, l.unit, l.base + l.slope * x.x AS fit, x.close - (l.base + l.slope * x.x) AS e FROM x JOIN l USING (series_id, event_idx)),
s AS (SELECT *, greatest(sqrt(avg(e * e) OVER (PARTITION BY series_id, event_idx)), 0.15 * unit) AS spread FROM f),
g AS (SELECT series_id, event_idx, max(slope) AS slope, max(spread) AS spread, max(CASE WHEN block = 0 THEN fit END) AS centre, count(CASE WHEN abs(low - (fit - spread)) <= greatest(0.3 * unit, 0.25) THEN 1 END) AS low_touches, count(CASE WHEN abs(high - (fit + spread)) <= greatest(0.3 * unit, 0.25) THEN 1 END) AS high_touches, max(n) AS n FROM s GROUP BY 1, 2)
SELECT series_id, event_idx, round(CASE WHEN n < 3 THEN 0 ELSE slope END, 6) + 0.0 AS slope, round(CASE WHEN n < 3 THEN 0 ELSE spread END, 6) + 0.0 AS spread, round(CASE WHEN n < 3 THEN 0 ELSE centre END, 6) + 0.0 AS centre,
  CASE WHEN n < 3 THEN 0 ELSE low_touches END AS low_touches, CASE WHEN n < 3 THEN 0 ELSE high_touches END AS high_touches, n, greatest(low_touches, high_touches) >= 3 AND n >= 12 AS is_channel FROM g""")
def _(bars):
    out = K.regression_channel(W.trailing_blocks(bars, M.confirmations(bars), 3))
    return M.rounded(out, *out.columns)


@query("mean_crossings", f"WITH {M.BARS}, c AS (SELECT series_id, bar_idx, close, lag(close) OVER (PARTITION BY series_id ORDER BY bar_idx) AS b FROM bars) SELECT series_id, bar_idx, CAST(CASE WHEN b <= 50 AND close > 50 THEN 1 ELSE -1 END AS BIGINT) AS side FROM c WHERE (b <= 50 AND close > 50) OR (b >= 50 AND close < 50)")
def _(bars):
    return K.crossings(bars, F.lit(50.0))


@query("latest_bars", f"WITH {M.BARS} SELECT series_id, bar_idx, close FROM bars QUALIFY bar_idx > max(bar_idx) OVER (PARTITION BY series_id) - 500")
def _(bars):
    return K.latest_bars(bars).select("series_id", "bar_idx", "close")
