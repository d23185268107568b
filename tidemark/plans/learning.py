"""Queries of the quality, split, metric and model operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import learning as M
from tidemark.functions import models
from tidemark.functions import quality as Q

QUERIES: dict = {}
ORACLE_SQL: dict = {}

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(name: str, sql: str | None = None):
    """Registers a function of `load` (a table by name) as a query, with its SQL."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def near(df, digits=6):
    """Doubles to some places and integers as longs, so that the order of additions and widths do not show."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


LONG = "x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in MEASURES) + ")"


@query("column_stats", f"""WITH {LONG}, b AS (SELECT feature, count(value) AS count, count(*) - count(value) AS missing, count(DISTINCT value) AS "unique", min(value) AS min, max(value) AS max, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS stddev FROM x GROUP BY feature),
m AS (SELECT x.feature, avg(pow((value - mean) / stddev, 3)) AS skewness, avg(pow((value - mean) / stddev, 4)) - 3 AS kurtosis FROM x JOIN b USING (feature) GROUP BY x.feature)
SELECT feature, count, missing, "unique", {r('min', 'min')}, {r('max', 'max')}, {r('mean + 1e-9', 'mean')}, {r('median', 'median')}, {r('stddev', 'stddev')}, {r('skewness', 'skewness')}, {r('kurtosis', 'kurtosis')}, "unique" <= 1 AS constant, "unique" > 1 AND "unique" <= count * 0.01 AS near_constant FROM b JOIN m USING (feature)""")
def _(load):
    stats = Q.column_stats(load("lineitem"), MEASURES)
    return near(stats.withColumn("mean", F.col("mean") + 1e-9))  # a mean may lie between two roundings


@query("iqr_outliers", f"WITH {LONG}, q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM x GROUP BY feature HAVING count(*) >= 4) SELECT feature, {r('q1', 'q1')}, {r('q3', 'q3')}, count(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers FROM x JOIN q USING (feature) WHERE q3 > q1 GROUP BY feature, q1, q3")
def _(load):
    return near(Q.iqr_outliers(load("lineitem"), MEASURES))


_PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i:]]


@query("pairwise_corr", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})', 'correlation')}, {r(f'covar_samp({a}, {b})', 'covariance', 4)} FROM lineitem" for a, b in _PAIRS))
def _(load):
    return Q.correlations(load("lineitem"), MEASURES).select("x", "y", (F.round("correlation", 6) + 0.0).alias("correlation"), (F.round("covariance", 4) + 0.0).alias("covariance"))


_SPLIT = "SELECT CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, CAST(quality AS BIGINT) AS label FROM labels"


@query("label_stats_grouping_sets", f"WITH s AS ({_SPLIT}), g AS (SELECT coalesce(split, 'ALL') AS split, label, count(*) AS count FROM s GROUP BY GROUPING SETS ((split, label), (label))) SELECT split, label, count, {r('count / sum(count) OVER (PARTITION BY split)', 'ratio')} FROM g")
def _(load):
    s = load("labels").select(F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train").alias("split"), F.col("quality").cast("long").alias("label"))
    return near(Q.label_stats(s, "split", "label"))


_NEXT = "SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events"


@query("label_transitions", f"WITH n AS ({_NEXT}), t AS (SELECT a AS from_label, b AS to_label, count(*) AS count FROM n WHERE b IS NOT NULL GROUP BY a, b) SELECT from_label, to_label, count, {r('count / sum(count) OVER (PARTITION BY from_label)', 'probability')} FROM t")
def _(load):
    return near(Q.transitions(load("events"), "user_id", "event_id", "event_type"))


@query("hmm_counts", f"WITH n AS ({_NEXT}), s AS (SELECT DISTINCT event_type AS k FROM events), g AS (SELECT x.k AS from_state, y.k AS to_state FROM s x CROSS JOIN s y), t AS (SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY a, b), f AS (SELECT from_state, to_state, coalesce(n, 0) + 0.5 AS n FROM g LEFT JOIN t ON a = from_state AND b = to_state) SELECT from_state, to_state, round(CAST(n AS DOUBLE) / sum(CAST(n AS DOUBLE)) OVER (PARTITION BY from_state), 6) + 0.0 AS probability FROM f")
def _(load):
    return near(M.hmm_counts(load("events"), "user_id", "event_id", "event_type", 0.5, ["click", "error", "purchase", "signup", "view"]))


@query("eta_squared", "WITH " + LONG.replace("AS value FROM", "AS value, l_returnflag AS label FROM") + f", g AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM x GROUP BY feature, label), s AS (SELECT feature, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b, sum(n * v) AS w FROM g GROUP BY feature) SELECT feature, {r('b / (b + w)', 'eta_squared')} FROM s")
def _(load):
    return near(Q.eta_squared(load("lineitem"), MEASURES, "l_returnflag"))


_MI = "SELECT round(sum(n / t * ln(n * t / (na * nb))), 6) + 0.0 AS mutual_information FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM j)"


@query("mutual_information", f"WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2) {_MI}")
def _(load):
    return near(Q.mutual_information(load("lineitem"), "l_returnflag", "l_linestatus"))


@query("mutual_information_numeric", f"WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem), d AS (SELECT CASE WHEN l_extendedprice <= q1 THEN 'Q1' WHEN l_extendedprice <= q2 THEN 'Q2' WHEN l_extendedprice <= q3 THEN 'Q3' ELSE 'Q4' END AS a, l_returnflag AS b FROM lineitem, q), j AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY a, b) {_MI}")
def _(load):
    return near(Q.mutual_information(Q.quartile_bins(load("lineitem"), "l_extendedprice"), "bin", "l_returnflag"))


@query("dedupe_keep_first", "SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1 AS is_kept FROM orders")
def _(load):
    return Q.keep_first(load("orders"), ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderpriority", "is_kept")


@query("duplicate_groups", "SELECT o_custkey, o_orderpriority, count(*) AS count, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY o_orderkey) AS lines FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1")
def _(load):
    return Q.duplicate_groups(load("orders"), ["o_custkey", "o_orderpriority"], "o_orderkey")


_CASE = "CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'validation' ELSE 'test' END"


@query("temporal_split", f"SELECT {_CASE} AS split, count(*) AS rows, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def _(load):
    day = lambda s: F.lit(s).cast("date")
    return Q.temporal_split(load("orders"), F.to_date("o_orderdate"), day("1995-01-01"), day("1997-01-01")).groupBy("split").agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first_key"))


@query("walk_forward_folds", "WITH g AS (SELECT CAST(floor((extract(day FROM ts) - 1) / 6) AS BIGINT) AS g, value FROM events) SELECT f.fold, CASE WHEN g.g < f.fold THEN 'train' ELSE 'validation' END AS role, count(*) AS rows, round(sum(value), 4) + 0.0 AS total FROM g JOIN (SELECT CAST(unnest(range(1, 5)) AS BIGINT) AS fold) f ON g.g <= f.fold GROUP BY 1, 2")
def _(load):
    out = Q.walk_forward(load("events"), F.floor((F.dayofmonth("ts") - 1) / 6), 4).groupBy(F.col("fold").cast("long").alias("fold"), "role")
    return out.agg(F.count("*").alias("rows"), (F.round(F.sum("value"), 4) + 0.0).alias("total"))


def rules() -> dict:
    return {"no_discount": F.col("l_discount") == 0, "low_price": F.col("l_extendedprice") < 2000, "ships_before_order": F.to_date("l_shipdate") < F.to_date("o_orderdate")}


_SQL_RULES = {"no_discount": "l_discount = 0", "low_price": "l_extendedprice < 2000", "ships_before_order": "CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)"}
_LO = "lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("causality_issues", " UNION ALL ".join(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, '{n}' AS issue FROM {_LO} WHERE {c}" for n, c in _SQL_RULES.items()))
def _(load):
    df = load("lineitem").join(load("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return Q.issues(df, rules(), ["l_orderkey", "l_linenumber"]).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query("dataset_validation", f"SELECT count(*) AS rows, count(CASE WHEN NOT ({' OR '.join(_SQL_RULES.values())}) THEN 1 END) AS valid_rows, {', '.join(f'count(CASE WHEN {c} THEN 1 END) AS {n}' for n, c in _SQL_RULES.items())} FROM {_LO}")
def _(load):
    return Q.issue_counts(load("lineitem").join(load("orders"), F.col("l_orderkey") == F.col("o_orderkey")), rules())


@query("confusion_matrix", "SELECT CAST(quality AS BIGINT) AS actual, CAST(1 - toxic AS BIGINT) AS predicted, count(*) AS count FROM labels GROUP BY 1, 2")
def _(load):
    return near(M.confusion(load("labels").withColumn("p", 1 - F.col("toxic")), "quality", "p"))


@query("class_metrics", "WITH d AS (SELECT quality AS a, 1 - toxic AS p FROM labels), l AS (SELECT DISTINCT a AS label FROM d UNION SELECT DISTINCT p FROM d), c AS (SELECT label, count(CASE WHEN a = label AND p = label THEN 1 END) AS tp, count(CASE WHEN a = label THEN 1 END) AS s, count(CASE WHEN p = label THEN 1 END) AS n FROM l, d GROUP BY label), m AS (SELECT label, s, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS re FROM c) SELECT CAST(label AS BIGINT) AS label, round(CAST(pr AS DOUBLE), 6) + 0.0 AS precision, round(CAST(re AS DOUBLE), 6) + 0.0 AS recall, round(CASE WHEN pr + re > 0 THEN 2.0 * pr * re / (pr + re) ELSE 0.0 END, 6) + 0.0 AS f1, s AS support FROM m")
def _(load):
    return near(M.class_metrics(load("labels").withColumn("p", 1 - F.col("toxic")), "quality", "p"))


@query("zero_rule", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type ORDER BY count DESC, event_type LIMIT 1")
def _(load):
    return M.zero_rule(load("events"), "event_type")


@query("regression_metrics", f"WITH d AS (SELECT l_linenumber AS a, l_quantity / 8 AS p FROM lineitem) SELECT {r('avg(abs(p - a))', 'mae')}, {r('sqrt(avg((p - a) * (p - a)))', 'rmse')}, {r('avg(CASE WHEN floor(p + 0.5) = a THEN 1.0 ELSE 0.0 END)', 'exact')}, {r('avg(CASE WHEN abs(floor(p + 0.5) - a) <= 1 THEN 1.0 ELSE 0.0 END)', 'within_1')} FROM d")
def _(load):
    return near(M.regression_metrics(load("lineitem").withColumn("p", F.col("l_quantity") / 8), "l_linenumber", "p"))


@query("standard_scale", "WITH f AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2 FROM lineitem) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((l_quantity - m1) / s1, 6) + 0.0 AS l_quantity, round((l_tax - m2) / s2, 6) + 0.0 AS l_tax FROM lineitem, f")
def _(load):
    return near(M.standard_scale(load("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]))


@query("one_hot", "SELECT event_id, " + ", ".join(f"CAST(event_type = '{c}' AS BIGINT) AS event_type_{c}" for c in ("click", "purchase", "view")) + " FROM events")
def _(load):
    return M.one_hot(load("events").select("event_id", "event_type"), "event_type", ["view", "click", "purchase"]).drop("event_type")


def _near(suffix: str = "", dims: int = 64) -> str:
    """The 8 nearest rows n of each query q by their first dimensions, as common table expressions."""
    q, d, n = (x + suffix for x in "qdn")
    return f"""{q} AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
{d} AS (SELECT query_id, vec_id AS id, label, embedding, list_sum(list_transform(range(1, {dims + 1}), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(qv[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(qv[i] AS DOUBLE)))) AS d2 FROM embeddings, {q} WHERE vec_id <> query_id),
{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS rank FROM {d} QUALIFY rank <= 8)"""


_NEAR = _near()


def near_of(load, k=8, dims=None):
    e = load("embeddings")
    v = F.slice("embedding", 1, dims) if dims else F.col("embedding")
    rows = e.select(F.col("vec_id").alias("id"), v.alias("vector"), "label", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return M.neighbours(rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), rows, k)


@query("knn_neighbours", f"WITH {_NEAR} SELECT query_id, id, {r('d2', 'd2')}, rank FROM n")
def _(load):
    return near(near_of(load).select("query_id", "id", "d2", "rank"))


@query("knn_classify", f"WITH {_NEAR}, v AS (SELECT query_id, label, count(*) AS votes, sum(sqrt(d2)) AS far FROM n GROUP BY query_id, label) SELECT query_id, CAST(label AS BIGINT) AS predicted, votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, far, label) = 1")
def _(load):
    return near(M.knn_vote(near_of(load), "label"))


@query("idw_projection", f"WITH {_NEAR}, w AS (SELECT query_id, CASE WHEN d2 < 1e-16 THEN 1e18 ELSE 1 / (sqrt(d2) + 1e-9) END AS w, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM n) SELECT query_id, {r('sum(w * x) / sum(w)', 'x')}, {r('sum(w * y) / sum(w)', 'y')} FROM w GROUP BY query_id")
def _(load):
    return near(M.idw_projection(near_of(load), ["x", "y"]))


@query("neighbor_preservation", f"WITH {_NEAR}, {_near('2', 2)}, p AS (SELECT query_id, count(*) AS shared FROM n JOIN n2 USING (query_id, id) GROUP BY query_id) SELECT {r('coalesce(sum(shared), 0) / 8.0 / (SELECT count(*) FROM q)', 'preservation')} FROM p")
def _(load):
    return near(M.neighbour_overlap(near_of(load), near_of(load, dims=2), 8))


@query("procrustes", f"WITH e AS (SELECT CAST(embedding[1] AS DOUBLE) AS a1, CAST(embedding[2] AS DOUBLE) AS a2, CAST(embedding[3] AS DOUBLE) AS b1, CAST(embedding[4] AS DOUBLE) AS b2 FROM embeddings), m AS (SELECT avg(a1) AS m1, avg(a2) AS m2, avg(b1) AS m3, avg(b2) AS m4 FROM e), c AS (SELECT a1 - m1 AS ax, a2 - m2 AS ay, b1 - m3 AS bx, b2 - m4 AS byy FROM e, m), s AS (SELECT sum(ax * ax + ay * ay) AS na, sum(bx * bx + byy * byy) AS nb, sum(ax * bx) AS xx, sum(ax * byy) AS xy, sum(ay * bx) AS yx, sum(ay * byy) AS yy FROM c), b AS (SELECT greatest(sqrt(pow(xx + yy, 2) + pow(xy - yx, 2)), sqrt(pow(xx - yy, 2) + pow(xy + yx, 2))) / sqrt(na * nb) AS best FROM s) SELECT {r('2 - 2 * best', 'disparity')}, {r('best', 'similarity')} FROM b")
def _(load):
    at = lambda i: F.element_at("embedding", i).cast("double")
    return near(M.procrustes(load("embeddings").select(at(1).alias("ax"), at(2).alias("ay"), at(3).alias("bx"), at(4).alias("by"))))


_GMM = """e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
c AS (SELECT label, i, avg(x) AS m, var_pop(x) + 1e-6 AS v, count(*) AS n FROM e GROUP BY label, i),
w AS (SELECT label, n * 1.0 / sum(n) OVER () AS w FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)),
l AS (SELECT e.vec_id AS id, c.label AS component, any_value(ln(w.w)) + sum(-0.5 * (ln(2 * pi()) + ln(c.v) + (e.x - c.m) * (e.x - c.m) / c.v)) AS l FROM e JOIN c ON c.i = e.i JOIN w ON w.label = c.label GROUP BY 1, 2)"""


@query("gmm_estep", f"WITH {_GMM}, t AS (SELECT *, max(l) OVER (PARTITION BY id) AS top FROM l) SELECT id, CAST(component AS BIGINT) AS component, {r('exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY id)', 'r')} FROM t")
def _(load):
    rows = load("embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    return near(M.responsibilities(rows.drop("label"), models.class_components(rows, "label", 1e-6)).select("id", F.col("component").cast("long").alias("component"), "r"))


@query("mean_baseline", f"SELECT event_type, {r('avg(value)', 'prediction')} FROM events WHERE extract(day FROM ts) <= 20 GROUP BY event_type")
def _(load):
    return near(load("events").where(F.dayofmonth("ts") <= 20).groupBy("event_type").agg(F.avg("value").alias("prediction")))


@query("gmm_fit")
def _(load):
    rows = load("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    return models.gmm_fit(rows, k=3, iterations=5)


@query("hmm_viterbi")
def _(load):
    e = load("events").select(F.col("user_id").alias("sequence"), F.col("event_id").alias("step"), F.col("event_type").alias("state"), F.array(F.ln(F.col("value") + 1)).alias("vector"))
    return models.decode(e, models.hmm_fit(e), how="viterbi")


@query("hmm_filter")
def _(load):
    e = load("events").select(F.col("user_id").alias("sequence"), F.col("event_id").alias("step"), F.col("event_type").alias("state"), F.array(F.ln(F.col("value") + 1)).alias("vector"))
    return models.decode(e, models.hmm_fit(e), how="filter")


@query("decision_tree")
def _(load):
    rows = load("embeddings").select(F.col("label").cast("string").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    return models.tree_grid(rows, depths=(2, 3, 4))


@query("tsne")
def _(load):
    rows = load("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    return models.tsne(rows, anchors=200, iterations=150)
