"""Functions without a query of their own, and the odd cases of those with one."""

import itertools
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidemark.functions import audits as A
from tidemark.functions import learning as G
from tidemark.functions import models
from tidemark.operators import bars as B
from tidemark.operators import lookups as K
from tidemark.operators import pivots as P
from tidemark.operators import structure as S
from tidemark.plans import market

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_optional_subpackage():
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, (60, 3)), r.normal(8, 1, (40, 3))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def test_mixture_of_two_groups(points):
    x, rows = points
    m = models.gmm_fit(rows, 2)
    own = sorted((r["weight"], r["mean"]) for r in m.collect())
    assert [round(w, 6) for w, _ in own] == [0.4, 0.6] and np.allclose(own[1][1], x[:60].mean(axis=0), atol=1e-6)
    got = G.mixture_score(rows, m).first()
    c = m.orderBy("component").collect()
    log = np.stack([np.log(k["weight"]) - 0.5 * (np.log(2 * np.pi * np.array(k["var"])) + (x - k["mean"]) ** 2 / np.array(k["var"])).sum(axis=1) for k in c], axis=1)
    want = np.log(np.exp(log).sum(axis=1)).sum()
    assert got["log_likelihood"] == pytest.approx(want) and got["bic"] == pytest.approx(13 * np.log(100) - 2 * want)


def test_mixture_of_few_or_no_rows(spark, points):
    _, rows = points
    assert models.gmm_fit(rows.where("id < 2"), 3).count() == 2 and models.gmm_fit(rows.where("id < 0"), 3).count() == 0


def test_responsibilities_of_repeated_ids(points):
    _, rows = points
    twice = rows.where("id < 3").withColumn("id", F.lit(7).cast("long"))
    got = G.responsibilities(twice, models.gmm_fit(rows, 2)).collect()
    assert len(got) == 6 and sum(r["r"] for r in got) == pytest.approx(3)


def test_states_without_a_label_do_not_count(spark):
    rows = spark.createDataFrame([("s", i, None if i == 2 else "ab"[i % 2], [float(i % 2)]) for i in range(8)], "sequence string, step int, state string, vector array<double>")
    m = models.hmm_fit(rows, floor=0.5)
    assert m["states"] == ["a", "b"]
    path = rows.orderBy("step").collect()

    def log(p):
        at = [m["states"].index(s) for s in p]
        dense = [-0.5 * (np.log(2 * np.pi * m["var"][a]) + (np.array(r["vector"]) - m["mean"][a]) ** 2 / m["var"][a]).sum() for a, r in zip(at, path, strict=True)]
        return m["initial"][at[0]] + sum(m["moves"][a, b] for a, b in itertools.pairwise(at)) + sum(dense)

    want = np.log(sum(np.exp(log(p)) for p in itertools.product("ab", repeat=8)))
    assert models.hmm_score(rows, m).first()["log_likelihood"] == pytest.approx(want)


def test_decisions_depend_on_those_before(spark):
    rows = [("s", 0, {"EXPANSION": 0.9, "IDLE": 0.1}), ("s", 1, {"INTERACTION": 0.8, "IDLE": 0.2}), ("s", 2, {"EXPANSION": 0.6, "IDLE": 0.4}), ("s", 3, {"EXPANSION": 0.9, "IDLE": 0.1})]
    df = spark.createDataFrame(rows, "sequence string, step int, posterior map<string, double>")
    said = lambda t, g: [r["decided"] for r in models.calibrated(df, threshold=t, guard=g).orderBy("step").collect()]
    assert said(0.5, True) == ["IDLE", "INTERACTION", "EXPANSION", "IDLE"] and said(0.7, False) == ["EXPANSION", "INTERACTION", "IDLE", "EXPANSION"]


def test_trees_are_held_against_every_row(spark, points):
    x, _ = points
    rows = spark.createDataFrame([("ab"[i >= 60], v.tolist()) for i, v in enumerate(x)], "label string, vector array<double>")
    got = models.tree_grid(rows, (1, 2), folds=3, sample=50).collect()
    assert len(got) == 6 and sum(r["rows"] for r in got) == 200 and min(r["accuracy"] for r in got) > 0.9


def test_evenly_spaced(spark):
    rows = spark.range(1000).repartition(7)
    for m in (2, 9, 90):
        want = sorted({int(np.floor(j * 999 / (m - 1) + 0.5)) for j in range(m)})
        assert sorted(r["id"] for r in models.evenly_spaced(rows, m).collect()) == want
    assert models.evenly_spaced(rows.where("id < 0"), 5).count() == 0
    with pytest.raises(ValueError):
        models.tsne(rows, anchors=models.MAX_ANCHORS + 1)


def test_an_exact_hit_is_copied(spark):
    near = spark.createDataFrame([(1, 0.0, 1, 5.0), (1, 1.0, 2, 9.0), (2, 1.0, 1, 4.0), (2, 4.0, 2, 1.0)], "query_id long, d2 double, rank long, x double")
    got = {r["query_id"]: r["x"] for r in G.idw_projection(near, ["x"]).collect()}
    assert got[1] == 5.0 and got[2] == pytest.approx((4.0 + 0.5) / 1.5)


def test_trustworthiness_of_the_same_space_is_one(spark, points):
    _, rows = points
    every = G.neighbours(rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), rows, 99)
    near = every.where("rank <= 5")
    assert G.rank_penalty(near, near, every, 5, 100).first()["score"] == 1.0
    other = every.where("rank > 94")
    assert G.rank_penalty(other, near, every, 5, 100).first()["score"] == 0.0
    with pytest.raises(ValueError):
        G.rank_penalty(near, near, every, 67, 100)


def test_small_helpers(spark):
    assert [r[0] for r in spark.createDataFrame([(0.3,), (70.0,), (1.5,), (0.0,), (230.0,)], "v double").select(B.nice_step(F.col("v"), 70)).collect()] == [1.0, 100.0, 2.0, 1.0, 500.0]
    assert A.selected_features(["b", "a", "t"], ["t"], ["x"]) == ["a", "b"]
    with pytest.raises(ValueError):
        A.selected_features(["a", "x"], [], ["x"])
    assert A.matching_features(["tf_1_x", "price", "tf_1_price"], "^tf_", ["tf_1_price"]) == ["tf_1_x"]
    with pytest.raises(ValueError):
        A.version_2_features(["a"], ["a"], [])
    with pytest.raises(ValueError):
        A.same_columns(spark.range(1), spark.range(1).toDF("x"))
    t = spark.createDataFrame([("INTERACTION", "SWEEP", 0.6), ("EXPANSION", "RUN_UP", 0.5), ("IDLE", "SWEEP", 0.9)], "s string, e string, c double")
    assert [r[0] for r in t.select(A.ghost_state(F.col("s"), F.col("e"), F.col("c"))).collect()] == [True, False, False]
    z = spark.createDataFrame([(10.0, 8.0, 9.0, True), (10.0, 8.0, 20.0, False), (8.0, 8.0, 8.0, True)], "t double, b double, d double, u boolean")
    assert [r[0] for r in z.select(A.mitigated_share(*(F.col(c) for c in "tbdu"))).collect()] == [50.0, 100.0, 0.0]
    runs = G.random_baseline(spark.range(2000).withColumn("label", F.when(F.col("id") % 4 == 0, "a").otherwise("b")), "label", 5).collect()
    assert len(runs) == 5 and all(abs(r["accuracy"] - 0.625) < 0.05 for r in runs)


def test_boxes_against_a_loop(spark):
    import random

    r = random.Random(6)
    bars = [("s", i, r.uniform(90, 110), 2.0) for i in range(200)]
    boxes = []
    for c in range(0, 200, 7):
        lo = r.uniform(85, 112)
        boxes.append(("s", c, r.choice([None, c + r.randint(0, 60)]), lo + r.uniform(0, 2), lo))
    got = K.box_distances(spark.createDataFrame(bars, "series_id string, bar_idx long, close double, atr double"), spark.createDataFrame(boxes, "series_id string, created long, ended long, top double, bottom double")).collect()
    assert len(got) == 200
    for x in got:
        p = bars[x["bar_idx"]][2]
        live = [max(lo - p, p - hi, 0) for _, c, e, hi, lo in boxes if c <= x["bar_idx"] and (e is None or e >= x["bar_idx"])]
        assert x["inside"] == int(0 in live) and x["distance"] == pytest.approx(min(live) / 2 if live else -1.0)


@pytest.mark.parametrize("until", [40, 90])
def test_results_as_of_a_bar_are_those_of_the_whole_series_up_to_it(spark, until):
    """Replay: nothing that is known at a bar changes with later bars."""
    bars = market.bars_of(spark, SF)
    seen = bars.where(F.col("bar_idx") <= until)
    told = lambda df: sorted(map(str, df.collect()))
    for make, at in ((lambda b: P.leg_pivots(b), "confirm_idx"), (lambda b: S.gaps(b), "gap_idx"), (lambda b: S.breaks(P.leg_pivots(b), b), "break_idx"), (lambda b: P.fractal_pivots(b), "confirm_idx")):
        early = make(seen)
        assert told(early) == told(make(bars).where(F.col(at) <= until)) and A.beyond(early, at, until).count() == 0


def test_nearest_rows_hold_few_candidates():
    """All pairs of queries and rows of a batch were held at once, with both vectors."""
    r = np.random.default_rng(4)
    x = np.round(r.standard_normal((4000, 16)), 1)
    x[1000:2000] = x[0]  # copies: ties by id
    x[7] = 1e200
    table = pa.table({"id": np.arange(4000), "vector": list(x)})
    told = pa.table({"query_id": np.arange(0, 4000, 8), "query_vector": list(x[::8])})
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    got = pa.Table.from_batches(list(G.nearest(told, table.to_batches(1500), 3, ["id", "vector", "query_id", "query_vector", "d2"])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20 and pa.total_allocated_bytes() - before < 20 << 20
    for q in (0, 8, 1000, 2800):
        d = ((x - x[q]) ** 2).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(4000), d)) if i != q][:3]
        own = got.filter(pc.equal(got["query_id"], q)).sort_by([("d2", "ascending"), ("id", "ascending")])
        assert own["id"].to_pylist() == want and own["d2"].to_pylist() == d[want].tolist()


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1.0, 3e5), (1e-15, 0.0), (1e13, 1e14), (1e-3, 1.0)])
def test_nearest_rows_of_any_size_are_exact(scale, offset):
    """Bounds in single precision leave none out, and are given up where they tell too little."""
    r = np.random.default_rng(9)
    x = r.standard_normal((2500, 8)) * scale + offset
    x[5], x[100:160] = 0.0, x[3]
    table = pa.table({"id": np.arange(2500), "vector": list(x), "label": [str(i) for i in range(2500)]})
    told = pa.table({"query_id": np.arange(0, 2500, 10), "query_vector": list(x[::10])})
    got = pa.Table.from_batches(list(G.nearest(told, table.to_batches(900), 4, ["id", "label", "query_id", "d2"], slim=True)))
    assert got.num_rows == 4 * 250
    for q in range(0, 2500, 10):
        d = ((x - x[q]) ** 2).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(2500), d)) if i != q][:4]
        own = got.filter(pc.equal(got["query_id"], q)).sort_by([("d2", "ascending"), ("id", "ascending")])
        assert own["id"].to_pylist() == want and own["d2"].to_pylist() == d[want].tolist() and own["label"].to_pylist() == [str(i) for i in want]


def test_neighbours_without_vectors_pass_on_none(spark):
    """Both vectors of every candidate were shuffled and written, where only its label counts."""
    df = spark.createDataFrame([(i, [float(i * i % 37), float(i % 5)], i % 3) for i in range(120)], "id long, vector array<double>, label int").repartition(3)
    asked = df.where("id < 30").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    slim, whole = (G.neighbours(asked, df, 4, block=10, slim=s) for s in (True, False))
    assert slim.columns == ["id", "label", "query_id", "d2", "rank"] and slim.schema == whole.drop("vector", "query_vector").schema
    assert sorted(slim.collect()) == sorted(whole.drop("vector", "query_vector").collect())
