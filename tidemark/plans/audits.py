"""Queries of the audits and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import audits as A
from tidemark.functions import learning as G
from tidemark.functions import quality as Q
from tidemark.operators import bars as B
from tidemark.operators import candles as C
from tidemark.operators import pivots as P
from tidemark.operators import recursive as R
from tidemark.operators import structure as S
from tidemark.plans import market as M
from tidemark.plans import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(M.bars_of(spark, sf_dir), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


_LV, _EV, _LA = (f"{n} AS ({M.ORACLE_SQL[q]})" for n, q in (("lv", "liquidity_lifecycle"), ("ev", "bos_choch"), ("la", "swing_labels")))
_PIV, _MB = f"piv AS (WITH {M.BARS}{M.LEGS} SELECT * FROM pivots)", f"mb AS (WITH {M.BARS} SELECT * FROM bars)"
_FLAG = "count(CASE WHEN {c} THEN 1 END) AS {n}"


def flags(**rules: str) -> str:
    return ", ".join(_FLAG.format(c=c, n=n) for n, c in rules.items())


_ERRORS = {"missing_index": "pivot_idx IS NULL OR confirm_idx IS NULL", "confirmation_before_pivot": "confirm_idx < pivot_idx", "missing_price": "price IS NULL", "invalid_side": "coalesce(type, '') NOT IN ('HIGH', 'LOW')", "invalid_target": "coalesce(target, '') NOT IN ('RUN', 'GRAB', 'SWEEP', 'NONE')", "atr_not_positive": "coalesce(atr_14, 0) <= 0", "volume_not_positive": "coalesce(confirm_volume, 0) <= 0"}


@query("pivot_validation", f"WITH {T.PIVOTS} SELECT count(*) AS rows, count(CASE WHEN NOT ({' OR '.join(f'({c})' for c in _ERRORS.values())}) THEN 1 END) AS valid_rows, {flags(**_ERRORS)} FROM pt")
def _(bars, load):
    return Q.issue_counts(T.pivot_rows(bars), A.pivot_errors())


_CAUSAL = {"confirmed_too_early": "confirm_idx < pivot_idx", "wrong_delay": "confirmation_delay <> confirm_idx - pivot_idx", "bars_since_below_none": "bars_since_event < -1", "negative_count": "active_fvg_50 < 0 OR active_bsl < 0 OR active_ssl < 0", "direction_not_known": "event_direction NOT IN (-1, 0, 1)"}


@query("pivot_causality", f"WITH {T.PIVOTS} SELECT count(*) AS rows, count(CASE WHEN NOT ({' OR '.join(f'({c})' for c in _CAUSAL.values())}) THEN 1 END) AS valid_rows, {flags(**_CAUSAL)} FROM pt")
def _(bars, load):
    return Q.issue_counts(T.pivot_rows(bars), A.causal_errors())


@query("possible_duplicates", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) > 1")
def _(bars, load):
    return A.possible_duplicates(load("orders"), ["o_custkey", "o_orderdate"], "o_orderkey").select("o_orderkey", "o_custkey", "o_orderdate")


_LEAK = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("leakage_audit", f"SELECT feature, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS variance, min(value) AS min, max(value) AS max, CAST(0 AS BIGINT) AS non_finite, var_pop(value) < 1e-12 AS constant, feature = 'l_tax' AS forbidden FROM (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _LEAK)} FROM lineitem) ON COLUMNS(*) INTO NAME feature VALUE value) GROUP BY feature")
def _(bars, load):
    t = A.leakage(load("lineitem"), _LEAK, ["l_tax"])
    return M.rounded(t, *t.columns)


@query("sequence_audit", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(CASE WHEN CAST({c} AS VARCHAR) = '' OR {c} IS NULL THEN 1 END) AS missing, count(DISTINCT {c}) <= 1 AS is_constant FROM documents" for c in ("lang", "source", "text")))
def _(bars, load):
    return A.sequence_audit(load("documents"), ["lang", "source", "text"])


@query("level_class_audit", f"WITH {_LV} SELECT series_id, level_id, '' AS error FROM lv WHERE swept_idx <= created_idx OR resolved_idx < swept_idx OR (class = 'NONE') <> (resolved_idx IS NULL) OR (class = 'SWEEP' AND resolved_idx <> swept_idx)")
def _(bars, load):
    return A.level_classes(S.liquidity(P.leg_pivots(bars), bars), bars)


@query("event_health", f"WITH {_EV}, {_MB}, t AS (SELECT e.*, b.close, count(*) OVER (PARTITION BY e.series_id, event, break_idx, pivot_idx) AS n FROM ev e LEFT JOIN mb b ON b.series_id = e.series_id AND b.bar_idx = e.break_idx) SELECT count(*) AS events, {flags(repeated='n > 1', wrong_direction="(direction = 1) <> (event LIKE '%_UP')", wrong_side="NOT CASE WHEN event LIKE '%_UP' THEN close > price ELSE close < price END", far='break_idx - pivot_idx > 1500')} FROM t")
def _(bars, load):
    return A.event_health(S.breaks(P.leg_pivots(bars), bars), bars)


@query("pivot_sequence_audit", f"WITH {_LA}, {_PIV}, t AS (SELECT p.*, l.label, lag(p.type) OVER w AS bt, lag(p.pivot_idx) OVER w AS bi, lag(p.price) OVER (PARTITION BY p.series_id, p.type ORDER BY p.confirm_idx) AS bp FROM piv p JOIN la l USING (series_id, pivot_idx, type) WINDOW w AS (PARTITION BY p.series_id ORDER BY p.confirm_idx)) SELECT count(*) AS pivots, {flags(not_alternating='bt = type', not_chronological='bi >= pivot_idx', wrong_label="CASE WHEN label IN ('HH', 'HL') THEN price < bp - 0.01 WHEN label IN ('LH', 'LL') THEN price > bp + 0.01 END")} FROM t")
def _(bars, load):
    return A.sequence_breaks(P.labels(P.leg_pivots(bars)))


_SPLIT = "CASE WHEN extract(day FROM ts) <= 15 THEN 'train' WHEN extract(day FROM ts) <= 22 THEN 'validation' ELSE 'test' END"


def split_events(load):
    day = F.dayofmonth("ts")
    return load("events").withColumn("split", F.when(day <= 15, "train").when(day <= 22, "validation").otherwise("test"))


@query("temporal_order", f"WITH g AS (SELECT {_SPLIT} AS split, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1) SELECT a.split AS earlier, b.split AS later, CAST(epoch_us(a.last) AS BIGINT) AS last, CAST(epoch_us(b.first) AS BIGINT) AS first, a.last < b.first AS is_ordered FROM g a JOIN g b ON (a.split, b.split) IN (('train', 'validation'), ('validation', 'test'))")
def _(bars, load):
    t = A.temporal_order(split_events(load), "split", "ts", ["train", "validation", "test"])
    return t.select("earlier", "later", *(F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("last", "first")), "is_ordered")


@query("label_counts_complete", f"WITH n AS (SELECT {_SPLIT} AS split, CASE WHEN event_type IN ('click', 'view', 'never') THEN event_type ELSE 'OTHER' END AS label FROM events), s AS (SELECT coalesce(split, 'ALL') AS split, label, count(*) AS c FROM n GROUP BY GROUPING SETS ((split, label), (label))) SELECT g.split, l.label, coalesce(s.c, 0) AS count FROM (SELECT DISTINCT split FROM s) g CROSS JOIN (SELECT unnest(['click', 'view', 'never', 'OTHER']) AS label) l LEFT JOIN s ON s.split = g.split AND s.label = l.label")
def _(bars, load):
    return A.complete_label_counts(split_events(load), "split", "event_type", ["click", "view", "never"])


@query("session_distribution", f"SELECT split, user_id, event_type, count, round(count / sum(count) OVER (PARTITION BY split, user_id), 6) + 0.0 AS ratio FROM (SELECT {_SPLIT} AS split, user_id, event_type, count(*) AS count FROM events GROUP BY ALL)")
def _(bars, load):
    t = A.sessions(split_events(load), ["split", "user_id"], "event_type")
    return t.withColumn("ratio", F.round("ratio", 6) + 0.0)


@query("quality_summary", "SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, CAST(sum((doc_id IS NULL)::INT + (text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT + (n_chars IS NULL)::INT) AS BIGINT) AS missing_cells, (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) AS duplicate_groups, count(*) / 2.0 AS rows_per_feature FROM documents")
def _(bars, load):
    return A.quality_summary(load("documents").select("doc_id", "text", "lang", "source", "n_chars"), ["doc_id", "n_chars"], ["text"])


@query("grouping_candidates", "SELECT * FROM (SELECT 'lang' AS column, count(DISTINCT lang) AS values FROM documents WHERE lang <> '' UNION ALL SELECT 'source', count(DISTINCT source) FROM documents WHERE source <> '' UNION ALL SELECT 'text', count(DISTINCT text) FROM documents WHERE text <> '') WHERE values BETWEEN 2 AND 20")
def _(bars, load):
    return A.grouping_candidates(load("documents"), ["lang", "source", "text"])


@query("unique_categories", "SELECT DISTINCT event_type FROM events WHERE event_type <> ''")
def _(bars, load):
    return A.categories(load("events"), "event_type")


@query("first_examples", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS example FROM events QUALIFY example <= 10")
def _(bars, load):
    return A.first_examples(load("events"), "event_type", ["event_id"], 10).select("event_type", "event_id", "example")


@query("nearest_rank_thresholds", "WITH v AS (SELECT l_extendedprice AS value, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem WHERE l_extendedprice IS NOT NULL) SELECT CAST(s AS DOUBLE) AS share, value FROM v, (SELECT unnest([0.33, 0.66]) AS s) WHERE i = floor(s * (n - 1))")
def _(bars, load):
    return G.nearest_rank(load("lineitem"), "l_extendedprice", (0.33, 0.66))


@query("minmax_scale", "SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) + 0.0 AS l_quantity FROM lineitem")
def _(bars, load):
    t = G.minmax_scale(load("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity")), ["l_quantity"])
    return t.withColumn("l_quantity", F.round("l_quantity", 6) + 0.0)


@query("after_moment", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def _(bars, load):
    return A.after(load("events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("sequence_ids", "SELECT doc_id, concat_ws('|', coalesce(source, ''), coalesce(lang, ''), '1') AS sequence_id, CASE WHEN lang = 'en' THEN 'train' WHEN lang = 'de' THEN 'validation' ELSE 'ignored' END AS split, upper(lang) AS target FROM documents")
def _(bars, load):
    d = A.supervised(A.by_source(load("documents"), "lang", ["en"], ["de"]), "lang")
    return d.select("doc_id", A.sequence_id(F.col("source"), F.col("lang"), F.lit(1)).alias("sequence_id"), "split", "target")


@query("version_2_dataset", f"WITH {T.PIVOTS} SELECT series_id, type, price, round(atr_14, 6) + 0.0 AS atr_14, round(distance_previous_pivot_atr, 6) + 0.0 AS distance_previous_pivot_atr, round(distance_event_atr, 6) + 0.0 AS distance_event_atr, active_bsl, active_ssl FROM pt QUALIFY row_number() OVER (PARTITION BY series_id, type, price ORDER BY confirm_idx) = 1")
def _(bars, load):
    t = T.pivot_rows(bars)
    own = A.version_2_features(t.columns, ["atr_14", "distance_previous_pivot", "distance_previous_pivot_atr", "distance_event_atr", "active_bsl", "active_ssl"], ["target"])
    v = A.version_2(t, own, ["series_id", "type", "price"], ["confirm_idx"])
    return v.select("series_id", "type", "price", *((F.round(c, 6) + 0.0).alias(c) if c.startswith(("atr", "distance")) else c for c in own))


@query("point_lookup", f"WITH {_MB}, s AS (SELECT series_id, count(*) AS size, max(bar_idx) AS last_index FROM mb GROUP BY 1) SELECT b.series_id, b.bar_idx, b.close, s.size, s.last_index FROM mb b JOIN s ON s.series_id = b.series_id AND b.bar_idx = s.last_index")
def _(bars, load):
    return B.point(bars, -1).join(B.sizes(bars), "series_id").select("series_id", "bar_idx", "close", "size", "last_index")


@query("value_ranges", f"WITH {_MB} SELECT series_id, min(low) AS least, max(high) AS greatest FROM mb WHERE bar_idx BETWEEN 20 AND 60 GROUP BY 1")
def _(bars, load):
    return B.value_ranges(bars, 20, 60)


@query("levels_in_view", f"WITH {_LV} SELECT series_id, level_id FROM lv WHERE created_idx <= 120 AND coalesce(resolved_idx, 120) >= 80 AND type = 'BSL'")
def _(bars, load):
    return B.in_view(S.liquidity(P.leg_pivots(bars), bars), 80, 120, start="created_idx", end="resolved_idx").where(F.col("type").isin("BSL")).select("series_id", "level_id")


@query("last_atr", f"WITH RECURSIVE {M.ATR} SELECT series_id, max(bar_idx) AS bar_idx, round(arg_max(atr, bar_idx), 6) + 0.0 AS atr FROM barsatr WHERE atr IS NOT NULL GROUP BY 1")
def _(bars, load):
    return M.rounded(B.last_defined(R.atr(bars), "atr"), "series_id", "bar_idx", "atr")


@query("axis_steps", f"WITH {_MB}, s AS (SELECT series_id, max(high) - min(low) AS span FROM mb GROUP BY 1), t AS (SELECT *, span / (100 / 70.0) AS v, pow(10, trunc(ln(span / (100 / 70.0)) / ln(10))) AS p FROM s) SELECT series_id, CASE WHEN v <= 0 THEN 1.0 WHEN v / p <= 1 THEN p WHEN v / p <= 2 THEN 2 * p WHEN v / p <= 5 THEN 5 * p ELSE 10 * p END AS step FROM t")
def _(bars, load):
    span = bars.groupBy("series_id").agg((F.max("high") - F.min("low")).alias("span"))
    return span.select("series_id", B.nice_step(F.col("span")).alias("step"))


@query("labels_of_bars", f"WITH {_MB} SELECT series_id, bar_idx, strftime(to_timestamp(epoch), '%Y-%m-%d') AS day, CASE WHEN volume * 100 >= 1000 THEN printf('%.1fK', volume * 100 / 1000) ELSE printf('%.0f', volume * 100) END AS told FROM mb")
def _(bars, load):
    return bars.select("series_id", "bar_idx", B.day_label(F.col("epoch")).alias("day"), B.thousands(F.col("volume") * 100).alias("told"))


@query("confluent_events", f"WITH {M.BARS}{M.breaks_sql('c.upper > c.lower', 'c.upper < c.lower')} SELECT series_id, event_no, event, break_idx FROM smc")
def _(bars, load):
    return S.breaks(P.leg_pivots(bars), bars, confluence=True).select("series_id", "event_no", "event", "break_idx")


@query("internal_events", None)
def _(bars, load):
    return S.breaks(P.leg_pivots(bars), bars, external=P.swing_pivots(bars)).select("series_id", "event_no", "event", "break_idx")


@query("events_of_pivots", f"WITH {_EV}, {_PIV} SELECT p.series_id, p.pivot_idx, p.type, coalesce((SELECT string_agg(event, ',' ORDER BY event_no) FROM ev e WHERE e.series_id = p.series_id AND e.pivot_idx = p.pivot_idx), '') AS events FROM piv p")
def _(bars, load):
    p = P.leg_pivots(bars)
    return A.events_of_pivots(p, S.breaks(p, bars)).select("series_id", "pivot_idx", "type", "events")


@query("external_fibonacci", None)
def _(bars, load):
    return M.rounded(A.external_fibonacci(P.swing_pivots(bars)), "series_id", "direction", "ratio", "price")


@query("external_levels", None)
def _(bars, load):
    return S.liquidity(P.swing_pivots(bars), bars)


@query("external_events", None)
def _(bars, load):
    return S.breaks(P.swing_pivots(bars), bars)


@query("external_order_blocks", None)
def _(bars, load):
    return S.order_blocks(S.breaks(P.swing_pivots(bars), bars), bars, source="close")


@query("levels_around", f"WITH {_LV}, {_MB} SELECT l.series_id, l.level_id, b.bar_idx, b.high, b.low, b.close, CASE WHEN l.type = 'BSL' THEN b.high > l.price ELSE b.low < l.price END AS breaks FROM lv l JOIN mb b ON b.series_id = l.series_id AND b.bar_idx BETWEEN coalesce(l.swept_idx, l.created_idx) - 5 AND coalesce(l.swept_idx, l.created_idx) + 5")
def _(bars, load):
    return A.around(S.liquidity(P.leg_pivots(bars), bars), bars)


@query("pivot_level_join", f"WITH {_LV}, {_PIV} SELECT p.series_id, p.pivot_idx, p.confirm_idx, p.type, coalesce(l.class, 'NONE') AS class, coalesce(l.swept_idx, -1) AS swept_idx, coalesce(l.resolved_idx, -1) AS resolved_idx FROM piv p LEFT JOIN lv l ON l.series_id = p.series_id AND l.created_idx = p.confirm_idx AND (l.type = 'BSL') = (p.type = 'HIGH') AND abs(l.price - p.price) < 1e-9")
def _(bars, load):
    p = P.leg_pivots(bars)
    return C.pivot_levels(p, S.liquidity(p, bars)).select("series_id", "pivot_idx", "confirm_idx", "type", "class", "swept_idx", "resolved_idx")


@query("cluster_labels", "WITH n AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) SELECT s.source, coalesce((SELECT lang FROM n WHERE n.source IS NOT DISTINCT FROM s.source ORDER BY n.n DESC, lang LIMIT 1), 'NONE') AS label FROM (SELECT DISTINCT source FROM documents) s")
def _(bars, load):
    return G.cluster_labels(load("documents"), "source", "lang", fallback="NONE")


@query("declared_scores", "WITH p AS (SELECT CAST(quality AS VARCHAR) AS a, CAST(toxic AS VARCHAR) AS p FROM labels), f AS (SELECT l, 2.0 * count(CASE WHEN a = l AND p = l THEN 1 END) / nullif(count(CASE WHEN a = l THEN 1 END) + count(CASE WHEN p = l THEN 1 END), 0) AS f1 FROM p, (SELECT unnest(['0', '1', '2']) AS l) GROUP BY l) SELECT (SELECT round(avg(CASE WHEN a = p THEN 1.0 ELSE 0 END), 6) + 0.0 FROM p) AS accuracy, round(sum(coalesce(f1, 0)) / 3, 6) + 0.0 AS macro_f1 FROM f")
def _(bars, load):
    t = G.scores(load("labels").select(F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("p")), "a", "p", ["0", "1", "2"])
    return t.select(*((F.round(c, 6) + 0.0).alias(c) for c in ("accuracy", "macro_f1")))
