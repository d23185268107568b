"""Models, searches and streams against plain loops."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import forecast, learning, models, quality, selection, trees
from tidemark.operators import bars as B
from tidemark.operators import pivots as P
from tidemark.operators import structure as S
from tidemark.sources.files import kept, shared_folder
from tidemark.streaming import lifecycle, streams

# Order statistics and neighbours


@pytest.mark.parametrize("n", [1, 2, 3, 700])
def test_percentiles_and_places_by_sorting(spark, n):
    r = np.random.default_rng(n)
    a = np.round(r.standard_normal(n) * 3, 1 if n > 3 else 6)
    b = np.where(r.random(n) < 0.7, 5.0, a)  # one value is most of the column
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)] + [(None, None)], "a double, b double").repartition(3)
    counted = quality.long_form(df, ["a", "b"]).groupBy("feature", "value").agg(F.count("*").alias("n"))
    got = {x["feature"]: x for x in quality.percentiles(counted, {"p0": 0.0, "p25": 0.25, "p66": 0.66, "p100": 1.0}).collect()}
    for name, v in (("a", a), ("b", b)):
        assert got[name]["total"] == n
        assert [got[name][c] for c in ("p0", "p25", "p66", "p100")] == pytest.approx(np.percentile(v, [0, 25, 66, 100]).tolist())
    near = {x["share"]: x["value"] for x in learning.nearest_rank(df, "b", (0.33, 0.66)).collect()}
    assert near == {s: np.sort(b)[int(s * (n - 1))] for s in (0.33, 0.66)}


@pytest.mark.parametrize("block", [1024, 3])
def test_neighbours_in_blocks(spark, block):
    r = np.random.default_rng(1)
    x = np.round(r.standard_normal((200, 3)), 1)
    df = spark.createDataFrame([(i, v.tolist(), f"l{i % 3}") for i, v in enumerate(x)] + [(None, [0.0] * 3, "n"), (900, None, "n")], "id long, vector array<double>, label string").repartition(4)
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {}
    for y in learning.neighbours(asked, df, 5, block=block).collect():
        got.setdefault(y["query_id"], []).append((y["rank"], y["id"], y["d2"], y["label"]))
    for q in range(0, 200, 20):
        d = ((x - x[q]) ** 2).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(200), d)) if i != q][:5]
        assert [(k, i, lab) for k, i, _, lab in sorted(got[q])] == [(k + 1, i, f"l{i % 3}") for k, i in enumerate(want)]
    assert set(got) == set(range(0, 200, 20))
    assert learning.neighbours(asked.where("query_id < 0"), df, 5).count() == 0


# Mixtures


def test_mixtures_fitted_together_are_those_fitted_alone(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(c, 1, (80, 2)) for c in (0, 7, 15)])
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, part int, vector array<double>").repartition(4)
    specs = [{"k": 3}, {"k": 2, "below": 2, "seed": 5}, {"k": 3, "centre": [1.0, 2.0], "scale": [2.0, 4.0]}, {"k": 4, "below": 0}]
    together = models.gmm_fit_many(df, specs, iterations=30)
    for spec, own in zip(specs, together, strict=True):
        (alone,) = models.gmm_fit_many(df.repartition(2), [spec], iterations=30)
        assert own["n"] == alone["n"] and np.allclose(own["mean"], alone["mean"]) and np.allclose(own["weight"], alone["weight"])
    assert together[3]["n"] == 0 and together[0]["converged"]
    assert sorted(np.round(together[0]["mean"][:, 0]).tolist()) == [0, 7, 15]
    assert np.allclose(np.sort(together[2]["mean"][:, 0]), (np.sort(together[0]["mean"][:, 0]) - 1) / 2, atol=1e-3)
    m = together[0]
    logs = np.stack([np.log(m["weight"][c]) - 0.5 * (np.log(2 * np.pi * m["var"][c]) + (x - m["mean"][c]) ** 2 / m["var"][c]).sum(axis=1) for c in range(3)], axis=1)
    assert m["log_likelihood"] == pytest.approx(np.log(np.exp(logs).sum(axis=1)).sum(), rel=1e-3)


# Trees


def exact(rows, features, labels, depth, limit, min_split=10, min_leaf=5):
    """The rule by trying every split on lists: nested (feature, kind, value, gain, n, left, right) or a label."""

    def gini(own):
        return 1 - sum((sum(r["y"] == c for r in own) / len(own)) ** 2 for c in labels) if own else 0.0

    counts = [sum(r["y"] == c for r in rows) for c in labels]
    top = labels[counts.index(max(counts))]
    if sum(c > 0 for c in counts) <= 1 or depth >= limit or len(rows) < min_split:
        return top
    best = None
    for f, kind in features:
        if kind == "numeric":
            values = sorted({r[f] for r in rows if r[f] is not None})
            options = [((a + b) / 2, lambda r, t=(a + b) / 2: (r[f] or 0.0) <= t) for a, b in itertools.pairwise(values)]  # noqa: B023
        else:
            options = [(c, lambda r, c=c: (r[f] or "") == c) for c in sorted({r[f] or "" for r in rows})]  # noqa: B023
        for value, goes in options:
            left, right = [r for r in rows if goes(r)], [r for r in rows if not goes(r)]
            if len(left) < min_leaf or len(right) < min_leaf:
                continue
            gain = gini(rows) - len(left) / len(rows) * gini(left) - len(right) / len(rows) * gini(right)
            key = f"{f}|{int(value) if kind == 'numeric' and value == math.floor(value) else value}"
            if best is None or gain > best[0] + 1e-12 or (abs(gain - best[0]) <= 1e-12 and key < best[1]):
                best = (gain, key, f, kind, value, left, right)
    if best is None or best[0] <= 1e-9:
        return top
    gain, _, f, kind, value, left, right = best
    return f, kind, value, gain, len(rows), exact(left, features, labels, depth + 1, limit), exact(right, features, labels, depth + 1, limit)


def nested(tree, at=0):
    node = tree.nodes[at]
    if "feature" not in node:
        return node["prediction"]
    return node["feature"], node["kind"], node["value"], node["gain"], node["n"], nested(tree, node["left"]), nested(tree, node["right"])


def same(a, b):
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    return a[:2] == b[:2] and (a[2] == b[2] if a[1] == "categorical" else a[2] == pytest.approx(b[2])) and a[3] == pytest.approx(b[3]) and a[4] == b[4] and same(a[5], b[5]) and same(a[6], b[6])


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(4)
    rows = []
    for i in range(260):
        a, b, c = r.choice([None, -1.0, 0.5, 2.0, 3.25, 7.0]), round(r.random(), 1), r.choice([None, "x", "y", "z"])
        y = "RUN" if c == "x" and (a or 0) > 0 else "GRAB" if b > 0.5 and r.random() < 0.8 else "SWEEP"
        rows.append({"id": i, "a": a, "b": b, "c": c, "d": b, "y": y})
    return rows, kept(spark.createDataFrame([(x["id"], x["a"], x["b"], x["c"], x["d"], x["y"].lower()) for x in rows], "id long, a double, b double, c string, d double, y string").repartition(3))


@pytest.mark.parametrize("depth", [1, 4])
def test_trees_level_by_level_are_the_exact_ones(mixed, depth):
    rows, df = mixed
    labels = ["RUN", "GRAB", "SWEEP"]
    tree = trees.grow(df, label="y", labels=labels, numeric=["a", "b", "d"], categorical=["c"], max_depth=depth)
    want = exact(rows, [("a", "numeric"), ("b", "numeric"), ("d", "numeric"), ("c", "categorical")], labels, 0, depth)
    assert same(nested(tree), want) and not isinstance(want, str)
    told = tree.importances()
    assert sum(told.values()) == pytest.approx(1) and ("c" in told or depth == 1) and "d" not in told  # d ties with b, which is smaller
    assert tree.top_importances(1)[0][1] == max(told.values()) and tree.depth() <= depth
    shallow = trees.grow(df, label="y", labels=labels, numeric=["a", "b", "d"], categorical=["c"], max_depth=1)
    got = df.select(tree.predicted(1).alias("p"), shallow.predicted().alias("q"), tree.place(1).alias("n")).collect()
    assert all(x["p"] == x["q"] for x in got) and {x["n"] for x in got} == {0, 1, 2} - {0}


def test_trees_of_one_class_or_few_rows(spark, mixed):
    _, df = mixed
    grow = lambda d, **how: trees.grow(d, label="y", labels=["RUN", "GRAB", "SWEEP"], numeric=["b"], **how)
    for own in (df.where("y = 'grab'"), df.limit(9), df.where("id < 0")):
        assert len(grow(own).nodes) == 1 and grow(own).importances() == {}
    with pytest.raises(ValueError):
        trees.grow(df, label="y", labels=["RUN"], numeric=[])


# Calibration


def decided(own, threshold, guard):
    out = []
    for p in own:
        ordered = sorted(models.STATES, key=lambda s: (-p.get(s, 0.0), models.STATES.index(s)))
        best = ordered[0]
        if best == "EXPANSION" and (p.get(best, 0.0) < threshold or (guard and not (out and out[-1] == "INTERACTION"))):
            best = next(s for s in ordered if s != "EXPANSION")
        out.append(best)
    return out


def test_the_search_is_thirty_two_single_runs(spark):
    r = np.random.default_rng(8)
    rows = []
    for s in range(4):
        for t in range(60):
            p = r.dirichlet([0.6, 0.5, 0.7, 0.9])
            if t % 9 == 0:
                p = np.round(p * 4) / 4  # ties
            rows.append((s, t, str(r.choice(models.STATES)), {k: float(v) for k, v in zip(models.STATES, p, strict=True)}))
    df = spark.createDataFrame(rows, "sequence long, step long, actual string, posterior map<string, double>").repartition(5)
    trials = selection.calibration_trials(df)
    assert len(trials) == 32
    for trial in trials:
        counts, single = {}, {}
        for s in range(4):
            own = [x for x in rows if x[0] == s]
            for x, p in zip(own, decided([x[3] for x in own], trial["expansion_threshold"], trial["require_interaction"]), strict=True):
                counts[x[2], p] = counts.get((x[2], p), 0) + 1
                single[s, x[1]] = p
        told = selection.report(counts, models.STATES)
        assert (trial["macro_f1"], trial["accuracy"], trial["expansion_f1"]) == pytest.approx((told["macro_f1"], told["accuracy"], told["per_class"]["EXPANSION"]["f1"]))
        if trial["expansion_threshold"] == 0.7:
            got = {(x["sequence"], x["step"]): x["decided"] for x in models.calibrated(df, threshold=0.7, guard=trial["require_interaction"]).collect()}
            assert got == single
    assert selection.best_trial(trials)["macro_f1"] == max(t["macro_f1"] for t in trials)


def test_the_first_of_equal_trials_stays():
    base = {"macro_f1": 0.5, "expansion_f1": 0.2, "accuracy": 0.3, "n": 0}
    near = base | {"macro_f1": 0.5 + 5e-13, "n": 1}
    assert selection.best_trial([base, near])["n"] == 0
    assert selection.best_trial([base, near | {"accuracy": 0.4, "n": 2}])["n"] == 2
    assert selection.best_trial([base, base | {"expansion_f1": 0.1, "accuracy": 0.9}])["n"] == 0
    with pytest.raises(ValueError):
        selection.calibration_trials(None, thresholds=(2.0,))


# The harness


def test_the_harness_by_a_loop(spark):
    r = np.random.default_rng(3)
    labels = ["GRAB", "RUN", "SWEEP"]
    x = r.normal(0, 1, (160, 3))
    y = [labels[int(v > 0.4) + int(w > 0.8)] for v, w in x[:, :2] + r.normal(0, 0.4, (160, 2))]
    part = np.arange(160) // 40
    rows = [(i, int(part[i]), int(part[i]), i, y[i], x[i].tolist()) for i in range(160)]
    df = kept(spark.createDataFrame(rows, "id long, part int, sequence int, step long, label string, vector array<double>").repartition(4))
    got = selection.select_models(df, labels, ks=(1, 5), depths=(1, 3), components=(2, 3), smoothings=(0.5,), runs=4, iterations=20).collect()
    by = {(g["family"], g["parameter"]): g for g in got}
    assert set(by) == {("zero_rule", 0.0), ("random", 4.0), ("knn", 1.0), ("knn", 5.0), ("tree", 1.0), ("tree", 3.0), ("gmm", 2.0), ("gmm", 3.0), ("hmm", 0.5)} and all(g["folds"] == 3 for g in got)
    pooled = {k: {} for k in by}
    each = {k: [] for k in by}
    for f in (1, 2, 3):
        train, test = np.flatnonzero(part < f), np.flatnonzero(part == f)
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
        z = (x - mean) / sd
        said = {("zero_rule", 0.0): [min(labels, key=lambda c: (-sum(y[i] == c for i in train), c))] * len(test)}  # noqa: B023
        for k in (1, 5):
            said["knn", float(k)] = []
            for i in test:
                d = ((z[train] - z[i]) ** 2).sum(axis=1)
                near = train[np.lexsort((train, d))[:k]]
                said["knn", float(k)].append(min({y[j] for j in near}, key=lambda c: (-sum(y[j] == c for j in near), sum(np.sqrt(((z[j] - z[i]) ** 2).sum()) for j in near if y[j] == c), c)))  # noqa: B023
        for depth in (1, 3):
            tree = exact([{"x0": x[i, 0], "x1": x[i, 1], "x2": x[i, 2], "y": y[i]} for i in train], [(f"x{c}", "numeric") for c in range(3)], labels, 0, depth)
            out = []
            for i in test:
                node = tree
                while not isinstance(node, str):
                    node = node[5] if x[i, int(node[0][1])] <= node[2] else node[6]
                out.append(node)
            said["tree", float(depth)] = out
        for k, p in said.items():
            counts = {}
            for i, c in zip(test, p, strict=True):
                counts[y[i], c] = counts.get((y[i], c), 0) + 1
                pooled[k][y[i], c] = pooled[k].get((y[i], c), 0) + 1
            each[k].append(selection.report(counts, labels))
    for k in (("zero_rule", 0.0), ("knn", 1.0), ("knn", 5.0), ("tree", 1.0), ("tree", 3.0)):
        told = selection.report(pooled[k], labels)
        assert (by[k]["accuracy"], by[k]["macro_f1"]) == pytest.approx((told["accuracy"], told["macro_f1"])), k
        assert by[k]["mean_macro_f1"] == pytest.approx(np.mean([t["macro_f1"] for t in each[k]]))
    for family in ("knn", "tree", "gmm"):
        own = sorted((g for g in got if g["family"] == family), key=lambda g: g["place"])
        assert [g["place"] for g in own] == [1, 2] and own == sorted(own, key=lambda g: (-g["macro_f1"], -g["accuracy"], g["mean_bic"] or 0, g["parameter"]))
    assert all(0 <= g["accuracy"] <= 1 for g in got) and by["gmm", 2.0]["mean_bic"] is not None


# The map


def looped(p, iterations, seed=42, early=250, calm=50, rate=200.0):
    """One point at a time."""
    state = [seed]

    def uniform():
        state[0] = (1103515245 * state[0] + 12345) % 2147483648
        return state[0] / 2147483648.0

    def normal():
        a, b = uniform(), uniform()
        return math.sqrt(-2 * math.log(max(a, 1e-12))) * math.cos(2 * 3.141592653589793 * b)

    n = len(p)
    y = [[normal() * 1e-4 for _ in range(2)] for _ in range(n)]
    v, gains, kl = [[0.0, 0.0] for _ in range(n)], [[1.0, 1.0] for _ in range(n)], 0.0
    for t in range(iterations):
        num = [[0.0 if i == j else 1 / (1 + sum((a - b) ** 2 for a, b in zip(y[i], y[j], strict=True))) for j in range(n)] for i in range(n)]
        total = max(sum(map(sum, num)), 1e-12)
        q = [[max(x / total, 1e-12) for x in row] for row in num]
        gradient = [[sum(4 * ((12 if t < early else 1) * p[i][j] - q[i][j]) * num[i][j] * (y[i][c] - y[j][c]) for j in range(n) if j != i) for c in range(2)] for i in range(n)]
        for i in range(n):
            for c in range(2):
                if t == early:
                    v[i][c] *= 0.25
                agree = gradient[i][c] * v[i][c] > 0
                gains[i][c] = max(gains[i][c] * 0.8 if agree else gains[i][c] + 0.2, 0.01)
                v[i][c] = (0.5 if t < early + calm else 0.8) * v[i][c] - rate * gains[i][c] * gradient[i][c]
                y[i][c] += v[i][c]
        for c in range(2):
            m = sum(z[c] for z in y) / n
            for z in y:
                z[c] -= m
        kl = sum(p[i][j] * math.log(p[i][j] / q[i][j]) for i in range(n) for j in range(n) if i != j and p[i][j] > 0)
    return np.asarray(y), kl


@pytest.mark.parametrize("iterations,how", [(1, {}), (40, {}), (45, {"early": 15, "calm": 10, "rate": 5.0})])
def test_the_layout_is_that_of_a_loop(iterations, how):
    """With the default schedule, and with a shorter one whose three phases all come."""
    x = np.random.default_rng(1).standard_normal((7, 3))
    p = models.affinities(((x[:, None] - x[None]) ** 2).sum(axis=2), 2.0)
    y, kl = models.layout(p, iterations, **how)
    want, divergence = looped(p.tolist(), iterations, **how)
    assert np.allclose(y, want, rtol=1e-5, atol=1e-9) and kl == pytest.approx(divergence, rel=1e-5)


def test_rows_take_the_place_of_the_anchor_they_equal(spark):
    x = np.random.default_rng(2).standard_normal((40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    fitted = models.fit_map(df, anchors=15, perplexity=4, iterations=60)
    got = {r["id"]: (r["x"], r["y"]) for r in models.placed(df, fitted).collect()}
    for a, place in zip(fitted["x"], fitted["y"], strict=True):
        assert got[int(np.flatnonzero((x == a).all(axis=1))[0])] == tuple(place)
    i = next(i for i in range(40) if not (fitted["x"] == x[i]).all(axis=1).any())
    d = ((fitted["x"] - x[i]) ** 2).sum(axis=1)
    near = np.argsort(d, kind="stable")[:8]
    w = 1 / (np.sqrt(d[near]) + 1e-9)
    assert got[i] == pytest.approx(tuple((w[:, None] * fitted["y"][near]).sum(axis=0) / w.sum()))


# The forecaster


def test_every_stage_of_the_forecaster(spark):
    r = np.random.default_rng(6)
    rows = []
    for s in ("a", "b"):
        for t in range(60):
            v = float(r.integers(0, 3))
            base = 3 * v + r.random()
            rows.append((s, t, base, None if t % 17 == 0 else float(r.normal()), "x" if v else "y", *(int(base * h / 5 + r.integers(0, 2)) for h in (3, 5, 10, 15))))
    ddl = "sequence string, step long, range_atr_ratio double, swing_size_atr double, last_structure_event string, target_trace_3 long, target_trace_5 long, target_trace_10 long, target_trace_15 long"
    df = kept(spark.createDataFrame(rows, ddl).repartition(3))
    features = forecast.feature_columns(df.columns, ("sequence", "step"))
    assert features == ["last_structure_event", "range_atr_ratio", "swing_size_atr"]
    model = forecast.fit(df, features, anchors=25, perplexity=5, map_iterations=80, sizes=(2, 3, 500), iterations=25)
    target = np.asarray([x[8] for x in rows])
    assert model["cuts"] == (np.sort(target)[int(0.33 * 119)], np.sort(target)[int(0.66 * 119)])
    state = np.where(target <= model["cuts"][0], 0, np.where(target <= model["cuts"][1], 1, 2))
    assert np.allclose(model["state_means"], [[np.mean([x[5 + i] for x, s in zip(rows, state, strict=True) if s == k]) for i in range(4)] for k in range(3)])
    assert set(model["bics"]) == {2, 3} and model["bic"] == min(model["bics"].values()) and len(model["mixture"]["weight"]) in (2, 3)
    staged = {(x["sequence"], x["step"]): x for x in forecast._staged(df, model).collect()}
    z = np.asarray([staged[x[0], x[1]]["vector"] for x in rows])
    assert z.shape[1] == 2 + 3 + 4  # place, states, two numbers and two categories
    col = np.asarray([x[3] or 0.0 for x in rows])
    assert np.allclose(z[:, 6], (col - col.mean()) / col.std())
    logs = models._logs(z, model["mixture"])
    resp = np.exp(logs - logs.max(axis=1, keepdims=True))
    resp /= resp.sum(axis=1, keepdims=True)
    y = np.asarray([x[5:9] for x in rows], float)
    assert np.allclose(model["component_means"], (resp.T @ y) / resp.sum(axis=0)[:, None])
    post = {}
    hmm = model["hmm"]
    for s in ("a", "b"):
        alpha = None
        for t in range(60):
            own = np.asarray([staged[s, t]["x"], staged[s, t]["y"]])
            d = -0.5 * (np.log(2 * np.pi * hmm["var"]) + (own - hmm["mean"]) ** 2 / hmm["var"]).sum(axis=1)
            alpha = np.exp(hmm["initial"] + d) if alpha is None else (alpha @ np.exp(hmm["moves"])) * np.exp(d)
            alpha = alpha / alpha.sum()
            post[s, t] = [alpha[hmm["states"].index(c)] for c in forecast.STATES]
    got = forecast.predict(df, model)
    for g in got.collect():
        i = next(i for i, x in enumerate(rows) if x[:2] == (g["sequence"], g["step"]))
        p = post[g["sequence"], g["step"]]
        assert [g[f"hmm_{s.lower()}_prob"] for s in forecast.STATES] == pytest.approx(p, abs=1e-9)
        for k, h in enumerate((3, 5, 10, 15)):
            by_state, by_part = float(np.dot(p, model["state_means"][:, k])), float(resp[i] @ model["component_means"][:, k])
            want = max(0.85 * (by_part if by_part > 0 else by_state) + 0.15 * by_state, 0)
            assert g[f"pred_trace_{h}"] == pytest.approx(want) and g[f"pred_trace_{h}_rounded"] == math.floor(want + 0.5)
        assert g["gmm_cluster"] == int(resp[i].argmax())
    told = {x["horizon"]: x for x in forecast.horizon_metrics(df.join(got, ["sequence", "step"])).collect()}
    assert set(told) == {3, 5, 10, 15} and told[15]["mae"] < np.abs(y[:, 3] - y[:, 3].mean()).mean()
    with pytest.raises(ValueError):
        forecast.fit(df, features, anchors=25, map_iterations=10, sizes=(500,))


# Streams


@pytest.fixture(scope="module")
def hours(spark):
    return kept(B.from_ticks(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), series="event_type", ts="ts", price="value", tie="event_id", seconds=3600).select("series_id", "bar_idx", "high", "low", "close"))


@pytest.fixture
def rocks(spark):
    spark.conf.set(lifecycle.PROVIDER, lifecycle.ROCKS)
    yield
    spark.conf.unset(lifecycle.PROVIDER)


@pytest.mark.parametrize("parts", [1, 7])
def test_levels_as_a_stream_are_those_of_the_table(spark, hours, rocks, parts):
    want = sorted(map(str, (r.asDict() for r in S.liquidity(P.leg_pivots(hours), hours).select("series_id", "level_id", "type", "created_idx", "price", "swept_idx", "class", "resolved_idx", "state").collect())))
    told = streams.drain(lifecycle.liquidity_changes(streams.in_order(hours, "bar_idx", parts)), shared_folder(spark), mode="append")
    got = sorted(map(str, (r.asDict() for r in lifecycle.last_change(told).select("series_id", "level_id", "type", "created_idx", "price", "swept_idx", "class", "resolved_idx", "state").collect())))
    assert got == want and told.select("batch").distinct().count() == parts and len(want) > 20


def test_a_stream_goes_on_after_a_restart_and_forgets_what_is_resolved(spark, hours, rocks):
    path, out = shared_folder(spark), shared_folder(spark)
    stream = lambda: lifecycle.liquidity_changes(spark.readStream.schema(hours.schema).option("maxFilesPerTrigger", 1).parquet(path))
    hours.where("bar_idx <= 60").coalesce(1).write.mode("append").parquet(path)
    streams.drain(stream(), out, mode="append")
    hours.where("bar_idx > 55").coalesce(1).write.mode("append").parquet(path)  # some bars come twice
    told = kept(streams.drain(stream(), out, mode="append"))
    want = {(r["series_id"], r["level_id"]): (r["swept_idx"], r["resolved_idx"], r["class"]) for r in S.liquidity(P.leg_pivots(hours), hours).collect()}
    assert {(r["series_id"], r["level_id"]): (r["swept_idx"], r["resolved_idx"], r["class"]) for r in lifecycle.last_change(told).collect()} == want
    state = spark.read.format("statestore").option("stateVarName", "live").load(f"{out}-progress")
    assert state.count() == sum(resolved is None for _, resolved, _ in want.values())


def test_bars_stream_with_a_watermark_that_passes(spark):
    from tidemark.plans import catalogue

    got = streams.streamed_bars(spark, "/root/testdata/sf0.001", batches=6)
    want = catalogue.QUERIES["ohlcv_resample"](spark, "/root/testdata/sf0.001").select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_values_of_a_feature_are_put_in_order_by_ranges(spark):
    """One task ordered all values of a feature at a node."""
    from tidemark.functions import trees

    df = spark.createDataFrame([(0, "AB"[i % 7 > 3], float(i * i % 97)) for i in range(200)], "_node long, c string, x double")
    plan = trees.splits(df, "c", ["x"], [], 5)._jdf.queryExecution().optimizedPlan().toString()
    ordered = [line for line in plan.splitlines() if "Window" in line and "x#" in line.split("],")[-2] + line.split("],")[-1]]
    assert ordered and all("range#" in line for line in ordered)


def test_state_models_take_a_sequence_in_pieces(spark):
    """Sequences longer than a batch: no piece holds a whole one, and paths, states and likelihoods are those of a loop over all rows."""
    r = np.random.default_rng(8)
    rows = [(s, t, [float(v) for v in r.normal(size=2)]) for s in ("a", "b", None) for t in range(230)]
    model = {"states": ["u", "v", "w"], "initial": np.log([0.5, 0.3, 0.2]), "moves": np.log([[0.8, 0.1, 0.1], [0.2, 0.6, 0.2], [0.1, 0.3, 0.6]]), "mean": np.array([[0.0, 0.0], [1.0, -1.0], [-1.0, 1.0]]), "var": np.array([[1.0, 0.5], [0.5, 1.0], [1.0, 1.0]])}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame(r.permutation(np.array(rows, object)).tolist(), "sequence string, step int, vector array<double>").repartition(4)

        class Sizes:
            def __init__(self):
                self.most = self.n = 0

            def feed(self, batch, x):
                self.most, self.n, self.own = max(self.most, len(x)), self.n + len(x), batch.column(0).slice(0, 1)
                return ()

            def end(self):
                yield pa.RecordBatch.from_arrays([self.own, pa.array([self.most]), pa.array([self.n])], names=["sequence", "most", "n"])

        assert {(x["n"], x["most"] <= 50) for x in models._in_order(df, "most long, n long", Sizes).collect()} == {(230, True)}
        path = {(x["sequence"], x["step"]): x["decoded"] for x in models.decode(df, model, how="viterbi").collect()}
        state = {(x["sequence"], x["step"]): x["decoded"] for x in models.decode(df, model, how="filter").collect()}
        post = {(x["sequence"], x["step"]): x["posterior"] for x in models.posteriors(df, model).collect()}
        score = {x["sequence"]: x["log_likelihood"] for x in models.hmm_score(df, model).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(path) == len(state) == len(post) == 690
    for s in ("a", "b", None):
        x = np.array([v for q, _, v in rows if q == s])
        d = np.array([[-0.5 * sum(np.log(2 * np.pi * q) + (a - m) ** 2 / q for a, m, q in zip(v, mean, var, strict=True)) for mean, var in zip(model["mean"], model["var"], strict=True)] for v in x])
        best, back, alpha = model["initial"] + d[0], [], model["initial"] + d[0]
        filtered = [alpha]
        for e in d[1:]:
            back.append((best[:, None] + model["moves"]).argmax(axis=0))
            best = (best[:, None] + model["moves"]).max(axis=0) + e
            alpha = np.logaddexp.reduce(alpha[:, None] + model["moves"], axis=0) + e
            filtered.append(alpha)
        want = [int(best.argmax())]
        for b in reversed(back):
            want.append(int(b[want[-1]]))
        assert [path[s, t] for t in range(230)] == [model["states"][k] for k in want[::-1]]
        assert [state[s, t] for t in range(230)] == [model["states"][int(a.argmax())] for a in filtered]
        assert np.allclose([post[s, t] for t in range(230)], [np.exp(a - np.logaddexp.reduce(a)) for a in filtered])
        assert np.isclose(score[s], np.logaddexp.reduce(filtered[-1]))


@pytest.mark.parametrize("entries", [None, 40])
def test_splits_by_arrays_are_those_of_rows(spark, entries):
    """A row per value, node and class was joined, ordered and written several times a level; now a range of a feature is one row."""
    r = np.random.default_rng(12)
    labels = ["A", "B", "C"]
    rows = []
    for i in range(600):
        a, b, c = float(r.normal()), float(r.integers(-3, 4)), float(r.integers(1, 40)) * (-1) ** i
        y = labels[int(a > 0.3) + int(b > 1)] if r.random() < 0.8 else "C"
        rows.append((int(r.choice([3, 7, 1 << 20])), y, a, None if i % 5 == 0 else b, None if i % 7 == 0 else c, None if i % 3 else -1.5, a))
    df = spark.createDataFrame(rows, "_node long, y string, a double, b double, c double, d double, e double").repartition(4)
    numeric = ["a", "b", "c", "d", "e"]
    for some in (numeric, ["e", "d"], ["b"], ["c"], ["d"]):
        bounds = trees.range_bounds(df, some, entries)
        assert bool(len(bounds[0])) == bool(entries)
        dealt = trees.number_splits(df, [1 << 20, 3, 7], "y", labels, some, 5, bounds)
        assert "Generate" not in dealt._jdf.queryExecution().optimizedPlan().toString()
        got, want = ([tuple(x) for x in t.orderBy("node").collect()] for t in (dealt, trees.splits(df, "y", some, [], 5)))
        assert got == want and (want or some == ["d"])


def test_smoothings_share_their_counts(spark):
    r = np.random.default_rng(13)
    df = spark.createDataFrame([(i // 20, i, "uvw"[int(r.integers(3))] if i % 9 else None, r.normal(size=2).tolist()) for i in range(100)], "sequence long, step long, state string, vector array<double>")
    for s, got in zip((0.1, 2.0), models.hmm_fit_many(df, [0.1, 2.0], 1e-2), strict=True):
        want = models.hmm_fit(df, s, 1e-2)
        assert got["states"] == want["states"] and all(np.allclose(got[c], want[c]) for c in ("initial", "moves", "mean", "var"))
        assert np.exp(got["moves"]).sum(axis=1) == pytest.approx(1) and (got["moves"] != models.hmm_fit(df, 1.0, 1e-2)["moves"]).any()
