"""Queries of the candle and pivot tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import candles as C
from tidemark.operators import features as X
from tidemark.operators import pivots as P
from tidemark.operators import profile as V
from tidemark.operators import recursive as R
from tidemark.operators import structure as S
from tidemark.plans import market as M
from tidemark.sources.files import kept

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(M.bars_of(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def candles(bars):
    bars = kept(bars)
    p = kept(P.leg_pivots(bars))
    events = kept(S.breaks(p, bars))
    return kept(C.candle_table(kept(R.atr(bars)), kept(S.liquidity(p, bars)), kept(S.mitigated_gaps(bars)), kept(S.order_blocks(events, bars)), events))


_W = "(PARTITION BY series_id ORDER BY bar_idx)"
_PRE = "(PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_AFTER = "(PARTITION BY series_id ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"


def _ret(n: int) -> str:
    return f"coalesce((close - lag(close, {n}) OVER {_W}) / nullif(lag(close, {n}) OVER {_W}, 0), 0)"


_LIVE = "b.series_id = z.series_id AND z.{created} <= b.bar_idx AND coalesce({ended}, b.bar_idx) >= b.bar_idx"
PARTS = f"""ba AS (WITH RECURSIVE {M.ATR} SELECT * FROM barsatr), lv AS ({M.ORACLE_SQL['liquidity_lifecycle']}), fg AS ({M.ORACLE_SQL['fvg_mitigation']}), ob AS ({M.ORACLE_SQL['order_blocks']}), ev AS ({M.ORACLE_SQL['bos_choch']}),
lq AS (SELECT b.series_id, b.bar_idx, min(CASE WHEN z.type = 'BSL' AND z.price >= b.close THEN z.price - b.close END) AS up, min(CASE WHEN z.type = 'SSL' AND z.price <= b.close THEN b.close - z.price END) AS down,
  count(CASE WHEN z.type = 'BSL' AND z.price >= b.close THEN 1 END) AS nb, count(CASE WHEN z.type = 'SSL' AND z.price <= b.close THEN 1 END) AS ns FROM ba b LEFT JOIN lv z ON {_LIVE.format(created='created_idx', ended='z.resolved_idx, z.swept_idx')} GROUP BY 1, 2)"""
CANDLES = f"""{PARTS},
fz AS (SELECT b.series_id, b.bar_idx, min(CASE WHEN z.series_id IS NOT NULL THEN greatest(z.bottom - b.close, b.close - z.top, 0) END) AS d FROM ba b LEFT JOIN fg z ON {_LIVE.format(created='gap_idx', ended='z.mitigated_idx')} GROUP BY 1, 2),
oz AS (SELECT b.series_id, b.bar_idx, min(CASE WHEN z.series_id IS NOT NULL THEN greatest(z.bottom - b.close, b.close - z.top, 0) END) AS d FROM ba b LEFT JOIN ob z ON {_LIVE.format(created='break_idx', ended='z.invalid_idx, z.touch_idx')} GROUP BY 1, 2),
le AS (SELECT b.series_id, b.bar_idx, max(z.break_idx) AS seen, arg_max(CASE z.event WHEN 'BOS_UP' THEN 1 WHEN 'BOS_DOWN' THEN -1 WHEN 'CHOCH_UP' THEN 2 ELSE -2 END, z.event_no) AS code FROM ba b LEFT JOIN ev z ON z.series_id = b.series_id AND z.break_idx <= b.bar_idx GROUP BY 1, 2),
r1 AS (SELECT *, {_ret(1)} AS return_1, {_ret(3)} AS return_3, {_ret(5)} AS return_5, avg(close) OVER {M._last(20)} AS mean20, coalesce(avg(volume) OVER {_PRE}, 0) AS vmean, coalesce(stddev_samp(volume) OVER {_PRE}, 0) AS vsd,
  regr_slope(close, CAST(bar_idx AS DOUBLE)) OVER {M._last(10)} AS s10, regr_slope(close, CAST(bar_idx AS DOUBLE)) OVER {M._last(20)} AS s20, max(high) OVER {_AFTER} > high AS th, min(low) OVER {_AFTER} < low AS tl FROM ba),
r2 AS (SELECT *, stddev_samp(return_1) OVER {M._last(10)} AS volatility_10, stddev_samp(return_1) OVER {M._last(20)} AS volatility_20 FROM r1),
oc AS ({M.ORACLE_SQL['first_touch_outcome']}),
cx AS (SELECT r.series_id, r.bar_idx, r.epoch, return_1, return_3, return_5, (high - low) / atr AS range_atr, abs(close - open) / atr AS body_atr, (high - greatest(open, close)) / atr AS upper_wick_atr, (least(open, close) - low) / atr AS lower_wick_atr,
  CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_position, volatility_10, volatility_20, CASE WHEN vsd > 0 THEN (volume - vmean) / vsd ELSE 0 END AS volume_zscore, CASE WHEN vmean > 0 THEN volume / vmean ELSE 1 END AS volume_ratio,
  s10 / atr AS slope_10, s20 / atr AS slope_20, (close - mean20) / atr AS price_vs_mean_20_atr, coalesce(lq.up / atr, -1) AS distance_to_bsl_atr, coalesce(lq.down / atr, -1) AS distance_to_ssl_atr, nb AS active_bsl_count, ns AS active_ssl_count,
  CASE WHEN nb + ns > 0 THEN (nb - ns) / CAST(nb + ns AS DOUBLE) ELSE 0 END AS liquidity_imbalance, CASE WHEN fz.d = 0 THEN 1 ELSE 0 END AS inside_fvg, coalesce(fz.d / atr, -1) AS distance_fvg_atr, CASE WHEN oz.d = 0 THEN 1 ELSE 0 END AS inside_order_block, coalesce(oz.d / atr, -1) AS distance_ob_atr,
  coalesce(r.bar_idx - le.seen, -1) AS bars_since_structure_event, coalesce(le.code, 0) AS last_structure_event, th, tl, oc.outcome
  FROM r2 r JOIN lq USING (series_id, bar_idx) JOIN fz USING (series_id, bar_idx) JOIN oz USING (series_id, bar_idx) JOIN le USING (series_id, bar_idx) LEFT JOIN oc USING (series_id, bar_idx) WHERE r.bar_idx >= 20 AND r.atr > 0),
cn AS (SELECT *, list_min(list_filter([distance_to_bsl_atr, distance_to_ssl_atr, distance_fvg_atr, distance_ob_atr], lambda v: v >= 0)) AS nearest FROM cx),
cl AS (SELECT *, CASE WHEN inside_fvg = 1 OR inside_order_block = 1 THEN 'INTERACTION' WHEN abs(return_1) >= 0.0015 AND range_atr >= 1 THEN 'EXPANSION' WHEN nearest <= 1 THEN 'APPROACH' ELSE 'IDLE' END AS state_label FROM cn),
ct AS (SELECT *, CASE WHEN NOT (state_label = 'INTERACTION' OR coalesce(nearest <= 0.25, false)) THEN 'NONE' WHEN th AND tl THEN 'SWEEP' WHEN th OR tl THEN 'GRAB' ELSE 'NONE' END AS event_target FROM cl)"""
_COUNTS = ("active_bsl_count", "active_ssl_count", "inside_fvg", "inside_order_block", "bars_since_structure_event", "last_structure_event")
_REAL = [c for c in C.CANDLE_COLUMNS if c not in _COUNTS]


@query("candle_features", f"WITH {CANDLES} SELECT series_id, bar_idx, epoch, {M.r6(*_REAL)}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTS)}, state_label, event_target, coalesce(outcome, 'NONE') AS outcome FROM ct")
def _(bars):
    t = candles(bars)
    return M.rounded(t, *t.columns)


@query("candle_state_labels", f"WITH {CANDLES} SELECT series_id, bar_idx, state_label FROM ct")
def _(bars):
    return candles(bars).select("series_id", "bar_idx", "state_label")


@query("event_target", f"WITH {CANDLES} SELECT series_id, bar_idx, event_target FROM ct")
def _(bars):
    return candles(bars).select("series_id", "bar_idx", "event_target")


def pivot_rows(bars):
    """The short pivot table at leg pivots; its parts are written once, as their plans are long and read several times."""
    bars = kept(bars)
    p = kept(P.leg_pivots(bars))
    return kept(C.pivot_table(p, kept(R.atr(bars)), kept(S.liquidity(p, bars)), kept(S.breaks(p, bars)), kept(S.mitigated_gaps(bars))))


PIVOTS = f"""{PARTS}, piv AS (WITH {M.BARS}{M.LEGS} SELECT * FROM pivots),
pl AS (SELECT p.*, coalesce((SELECT l.class FROM lv l WHERE l.series_id = p.series_id AND l.created_idx = p.confirm_idx AND l.type = CASE WHEN p.type = 'HIGH' THEN 'BSL' ELSE 'SSL' END AND abs(l.price - p.price) < 1e-9 ORDER BY l.level_id LIMIT 1), 'NONE') AS target FROM piv p),
pv AS (SELECT p.*, CASE WHEN b.atr > 0 THEN b.atr END AS unit, b.atr AS atr_14, b.volume AS confirm_volume, abs(p.price - lag(p.price) OVER w) AS move, p.pivot_idx - lag(p.pivot_idx) OVER w AS bars FROM pl p LEFT JOIN ba b ON b.series_id = p.series_id AND b.bar_idx = p.confirm_idx WINDOW w AS (PARTITION BY p.series_id ORDER BY p.pivot_idx, p.confirm_idx)),
pe AS (SELECT p.series_id, p.pivot_idx, p.confirm_idx, max(e.break_idx) AS seen, arg_max(e.event, e.event_no) AS event, arg_max(e.direction, e.event_no) AS direction, arg_max(e.price, e.event_no) AS event_price FROM piv p LEFT JOIN ev e ON e.series_id = p.series_id AND e.break_idx <= p.confirm_idx GROUP BY 1, 2, 3),
pg AS (SELECT p.series_id, p.pivot_idx, p.confirm_idx, count(g.gap_idx) AS active_fvg_50 FROM piv p LEFT JOIN fg g ON g.series_id = p.series_id AND g.gap_idx BETWEEN p.confirm_idx - 49 AND p.confirm_idx AND (g.mitigated_idx IS NULL OR g.mitigated_idx > p.confirm_idx) GROUP BY 1, 2, 3),
pt AS (SELECT v.series_id, v.pivot_idx, v.confirm_idx, v.type, v.price, v.target, atr_14, confirm_volume, v.confirm_idx - v.pivot_idx AS confirmation_delay, move AS distance_previous_pivot, move / unit AS distance_previous_pivot_atr, bars AS bars_since_previous_pivot,
  coalesce(event, 'NONE') AS last_event, CAST(coalesce(direction, 0) AS BIGINT) AS event_direction, coalesce(v.confirm_idx - seen, -1) AS bars_since_event, coalesce(abs(v.price - event_price) / unit, -1) AS distance_event_atr, active_fvg_50,
  CASE WHEN unit IS NULL THEN 0 ELSE nb END AS active_bsl, CASE WHEN unit IS NULL THEN 0 ELSE ns END AS active_ssl, coalesce(lq.up / unit, -1) AS distance_bsl_atr, coalesce(lq.down / unit, -1) AS distance_ssl_atr
  FROM pv v JOIN pe USING (series_id, pivot_idx, confirm_idx) JOIN pg USING (series_id, pivot_idx, confirm_idx) JOIN lq ON lq.series_id = v.series_id AND lq.bar_idx = v.confirm_idx)"""
_PREAL = ("price", "atr_14", "confirm_volume", "distance_previous_pivot", "distance_previous_pivot_atr", "distance_event_atr", "distance_bsl_atr", "distance_ssl_atr")
_PKEEP = ("series_id", "pivot_idx", "confirm_idx", "type", "target", "confirmation_delay", "bars_since_previous_pivot", "last_event", "event_direction", "bars_since_event", "active_fvg_50", "active_bsl", "active_ssl")


@query("pivot_features", f"WITH {PIVOTS} SELECT {', '.join(_PKEEP)}, {M.r6(*_PREAL)} FROM pt")
def _(bars):
    return M.rounded(pivot_rows(bars), *_PKEEP, *_PREAL)


@query("trainable_pivots", f"WITH {PIVOTS}, la AS ({M.ORACLE_SQL['swing_labels']}) SELECT pt.series_id, pt.pivot_idx, pt.confirm_idx, target, label AS structure_type FROM pt JOIN la USING (series_id, pivot_idx, type) WHERE target IN ('RUN', 'GRAB', 'SWEEP') AND atr_14 > 0 AND label IN ('HH', 'HL', 'LH', 'LL') AND confirm_idx >= pivot_idx")
def _(bars):
    labels = P.labels(P.leg_pivots(bars)).select("series_id", "pivot_idx", "type", F.col("label").alias("structure_type"))
    return C.trainable(pivot_rows(bars).join(labels, ["series_id", "pivot_idx", "type"])).select("series_id", "pivot_idx", "confirm_idx", "target", "structure_type")


@query("pip_distances", f"WITH {PIVOTS} SELECT series_id, pivot_idx, round(CASE WHEN atr_14 > 0 THEN distance_bsl_atr * atr_14 / 0.25 ELSE 0 END, 6) + 0.0 AS distance_bsl_pips, round(CASE WHEN atr_14 > 0 THEN distance_event_atr * atr_14 / 0.25 ELSE 0 END, 6) + 0.0 AS distance_event_pips, round(CASE WHEN atr_14 > 0 THEN atr_14 / 0.25 ELSE 0 END, 6) + 0.0 AS atr_pips FROM pt")
def _(bars):
    return M.rounded(C.pips(pivot_rows(bars), ["distance_bsl_atr", "distance_event_atr"]), "series_id", "pivot_idx", "distance_bsl_pips", "distance_event_pips", "atr_pips")


_TF = 10
_EVENTS = f"events_ AS (WITH {M.BARS}{M.LEGS} SELECT DISTINCT series_id, confirm_idx AS event_idx FROM pivots), mb AS (WITH {M.BARS} SELECT * FROM bars)"
_BLOCKS = f"n AS (SELECT e.series_id, e.event_idx, CAST(floor((e.event_idx - b.bar_idx) / {_TF}.0) AS BIGINT) AS block, b.* EXCLUDE (series_id) FROM events_ e JOIN mb b ON b.series_id = e.series_id AND b.bar_idx BETWEEN e.event_idx - {20 * _TF - 1} AND e.event_idx), tb AS (SELECT series_id, event_idx, block, arg_min(open, bar_idx) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_idx) AS close, sum(volume) AS volume FROM n GROUP BY 1, 2, 3)"


@query("frame_context_10", f"""WITH {_EVENTS}, {_BLOCKS}, wh AS (SELECT e.series_id, e.event_idx, max(high) AS hi, min(low) AS lo, sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) AS vwap FROM events_ e JOIN mb b ON b.series_id = e.series_id AND b.bar_idx BETWEEN e.event_idx - {max(20 * _TF, 60) - 1} AND e.event_idx GROUP BY 1, 2),
x AS (SELECT *, max(block) OVER w - block AS k, max(block) OVER w AS top, greatest(high - low, coalesce(abs(high - lag(close) OVER o), 0), coalesce(abs(low - lag(close) OVER o), 0)) AS tr FROM tb WINDOW w AS (PARTITION BY series_id, event_idx), o AS (PARTITION BY series_id, event_idx ORDER BY block DESC)),
s AS (SELECT series_id, event_idx, avg(CASE WHEN block < 14 THEN tr END) AS atr, sum(volume * CASE WHEN k = 0 THEN pow(0.8, top) ELSE 0.2 * pow(0.8, block) END) AS ema, max(CASE WHEN block = 0 THEN volume END) AS volume, max(CASE WHEN k = 0 THEN open END) AS first_open FROM x GROUP BY 1, 2)
SELECT s.series_id, s.event_idx, round(s.atr / 0.25, 4) + 0.0 AS atr_pips, round((hi - lo) / 0.25, 4) + 0.0 AS range_pips, round((b.close - first_open) / 0.25, 4) + 0.0 AS return_pips, round(((b.high + b.low) / 2 - coalesce(vwap, (b.high + b.low) / 2)) / 0.25, 4) + 0.0 AS vwap_distance_pips, round((hi - (b.high + b.low) / 2) / 0.25, 4) + 0.0 AS resistance_distance_pips, round(((b.high + b.low) / 2 - (lo + 0.618 * (hi - lo))) / 0.25, 4) + 0.0 AS fib618_distance_pips, s.volume, round(ema, 4) + 0.0 AS volume_ema9
FROM s JOIN wh USING (series_id, event_idx) JOIN mb b ON b.series_id = s.series_id AND b.bar_idx = s.event_idx""")
def _(bars):
    t = C.frame_context(bars, M.confirmations(bars), _TF)
    real = ("atr_pips", "range_pips", "return_pips", "vwap_distance_pips", "resistance_distance_pips", "fib618_distance_pips", "volume_ema9")
    return t.select("series_id", "event_idx", "volume", *((F.round(c, 4) + 0.0).alias(c) for c in real))


def external_features(bars):
    """The full pivot table at external swings, from everything known by them."""
    bars = kept(bars)
    atr, swings = kept(R.atr(bars)), kept(P.swing_pivots(bars))
    events = S.breaks(swings, bars)
    return X.pivot_features(swings, atr, S.liquidity(swings, bars), P.equal_levels(P.leg_pivots(bars, 3), atr), S.mitigated_gaps(bars), S.order_blocks(events, bars), events)


@query("pivot_table")
def _(bars):
    return external_features(bars)


@query("ghost_table")
def _(bars):
    return X.ghost_table(external_features(bars), bars)


def _areas(frame: int) -> str:
    """Value areas of the bars before each confirmation, bin by bin, by recursion."""
    span = max(20 * frame, 60)
    return f"""(WITH RECURSIVE r{frame} AS (SELECT e.series_id, e.event_idx, min(b.low) OVER w AS lo, (max(b.high) OVER w - min(b.low) OVER w) / 24 AS step, (b.high + b.low + b.close) / 3 AS p, b.volume FROM events_ e JOIN mb b ON b.series_id = e.series_id AND b.bar_idx BETWEEN e.event_idx - {span - 1} AND e.event_idx WINDOW w AS (PARTITION BY e.series_id, e.event_idx)),
v AS (SELECT e.series_id, e.event_idx, q.bin, coalesce(sum(r.volume), 0) AS v, any_value(t.lo) AS lo, any_value(t.step) AS step FROM events_ e JOIN (SELECT DISTINCT series_id, event_idx, lo, step FROM r{frame} WHERE step > 0) t USING (series_id, event_idx) CROSS JOIN (SELECT unnest(range(24)) AS bin) q LEFT JOIN r{frame} r ON r.series_id = e.series_id AND r.event_idx = e.event_idx AND least(floor((r.p - r.lo) / r.step), 23) = q.bin GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, event_idx ORDER BY v DESC, bin) AS n, sum(v) OVER (PARTITION BY series_id, event_idx) AS total FROM v),
a AS (SELECT series_id, event_idx, bin AS poc, bin AS l, bin AS r, v AS acc, total, lo, step, 0 AS i FROM k WHERE n = 1
UNION ALL SELECT a.series_id, a.event_idx, a.poc, CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN a.l ELSE a.l - 1 END, CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN a.r + 1 ELSE a.r END, a.acc + CASE WHEN coalesce(u.v, -1) >= coalesce(d.v, -1) THEN u.v ELSE d.v END, a.total, a.lo, a.step, a.i + 1
FROM a LEFT JOIN v u ON u.series_id = a.series_id AND u.event_idx = a.event_idx AND u.bin = a.r + 1 LEFT JOIN v d ON d.series_id = a.series_id AND d.event_idx = a.event_idx AND d.bin = a.l - 1 WHERE a.acc / a.total < 0.7 AND (u.v IS NOT NULL OR d.v IS NOT NULL)),
z AS (SELECT *, row_number() OVER (PARTITION BY series_id, event_idx ORDER BY i DESC) AS n FROM a)
SELECT series_id, event_idx, CAST({frame} AS BIGINT) AS frame, round(lo + (poc + 0.5) * step, 6) + 0.0 AS poc, round(lo + (r + 0.5) * step, 6) + 0.0 AS vah, round(lo + (l + 0.5) * step, 6) + 0.0 AS val FROM z WHERE n = 1)"""


@query("event_value_areas", f"WITH {_EVENTS} SELECT * FROM ({' UNION ALL '.join(f'SELECT * FROM {_areas(n)}' for n in X.FRAMES)})")
def _(bars):
    bars = kept(bars)
    events, key, out = kept(M.confirmations(bars)), ["series_id", "event_idx"], None
    for frame in X.FRAMES:
        first = F.greatest(F.col("event_idx") - (max(20 * frame, 60) - 1), F.lit(0))
        ranges = events.select(*key, first.alias("first_idx"), F.col("event_idx").alias("last_idx"))
        got = V.range_areas(V.range_profiles(bars, ranges, key).where("volumes is not null"), key, F.lit(None).cast("double")).withColumn("frame", F.lit(frame).cast("long"))
        out = got if out is None else out.unionByName(got)
    return M.rounded(out, *key, "frame", "poc", "vah", "val")


_MODES = {
    "VISIBLE": "bar_idx BETWEEN 40 AND 260", "HISTORICAL": "bar_idx > last - 500", "SESSION": "CAST(floor(epoch / 86400) AS BIGINT) = CAST(floor(last_epoch / 86400) AS BIGINT)",
    "BOS_CHOCH": "bar_idx >= coalesce((SELECT max(break_idx) FROM smc WHERE smc.series_id = y.series_id), last - 499)",
}


@query("profile_ranges", f"""WITH {M.BARS}{M.BREAKS}, y AS (SELECT *, max(bar_idx) OVER (PARTITION BY series_id) AS last, max(epoch) OVER (PARTITION BY series_id) AS last_epoch FROM bars),
m AS ({' UNION ALL '.join(f"SELECT '{m}' AS mode, * FROM y WHERE {c}" for m, c in _MODES.items())}),
x AS (SELECT mode, series_id, low, high, close, volume, min(low) OVER w AS fl, (max(high) OVER w - min(low) OVER w) / 48 AS step FROM m WINDOW w AS (PARTITION BY mode, series_id)), q AS (SELECT CAST(unnest(range(48)) AS BIGINT) AS bin),
p AS (SELECT mode, series_id, bin, CASE WHEN x.high > x.low THEN volume * greatest((least(x.high, fl + bin * step + step) - greatest(x.low, fl + bin * step)) / (x.high - x.low), 0) ELSE volume END AS v FROM x, q WHERE step > 0 AND CASE WHEN x.high > x.low THEN bin BETWEEN least(floor((x.low - fl) / step), 47) AND least(floor((x.high - fl) / step), 47) ELSE bin = least(floor((x.close - fl) / step), 47) END)
SELECT mode, series_id, bin, round(sum(v), 6) + 0.0 AS volume FROM p GROUP BY mode, series_id, bin""")
def _(bars):
    events, out = S.breaks(P.leg_pivots(bars), bars), None
    for mode in _MODES:
        got = V.overlap_bins(V.in_range(bars, mode, first=40, last=260, events=events)).withColumn("mode", F.lit(mode))
        out = got if out is None else out.unionByName(got)
    return M.rounded(out, "mode", "series_id", "bin", "volume")
