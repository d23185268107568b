"""Every query of the reference's operators against its SQL, and those without SQL against small brute-force readings."""

import math

import duckdb
import pytest

from tidemark.operators import bars as B
from tidemark.operators import pivots as P
from tidemark.operators.recursive import wilder
from tidemark.plans import catalogue, market

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(told(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(told(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_wilder():
    assert wilder([1.0, 2.0], 3) == [None, None]
    assert wilder([1.0, 2.0, 3.0, 6.0], 3) == [None, None, 2.0, (2.0 * 2 + 6.0) / 3]
    assert wilder([1.0, 3.0], 5, seed_short=True) == [2.0, 2.0]
    assert wilder([], 3) == []


def test_fractal_pivots_against_a_loop(spark):
    bars = market.bars_of(spark, SF)
    series = {}
    for r in bars.orderBy("series_id", "bar_idx").collect():
        series.setdefault(r["series_id"], []).append(r)
    want = set()
    for s, own in series.items():
        for i in range(10, len(own) - 10):
            near = own[i - 10 : i] + own[i + 1 : i + 11]
            if all(own[i]["high"] > x["high"] for x in near):
                want.add((s, i, "HIGH"))
            elif all(own[i]["low"] < x["low"] for x in near):
                want.add((s, i, "LOW"))
    assert {(r["series_id"], r["pivot_idx"], r["type"]) for r in P.fractal_pivots(bars).collect()} == want


def test_bars_of_no_ticks(spark):
    ticks = spark.createDataFrame([], "event_type string, ts timestamp_ntz, event_id long, value double")
    assert B.from_ticks(ticks, series="event_type", ts="ts", price="value", tie="event_id").count() == 0


def test_viterbi_is_the_best_path(spark):
    import itertools

    import numpy as np

    from tidemark.functions import models

    rows = spark.createDataFrame([("s", i, "ab"[i % 3 == 0], [float(i % 3)]) for i in range(6)], "sequence string, step int, state string, vector array<double>")
    m = models.hmm_fit(rows, floor=0.5)
    got = [r["decoded"] for r in models.decode(rows, m, how="viterbi").orderBy("step").collect()]

    def score(path):
        at = [m["states"].index(p) for p in path]
        density = [-0.5 * (np.log(2 * math.pi * m["var"][a]) + (i % 3 - m["mean"][a]) ** 2 / m["var"][a]).sum() for i, a in enumerate(at)]
        return m["initial"][at[0]] + sum(m["moves"][x][y] for x, y in itertools.pairwise(at)) + sum(density)

    assert score(got) == pytest.approx(max(score(p) for p in itertools.product(m["states"], repeat=6)))


def test_side_distances_hold_levels_until_they_are_resolved(spark):
    import random

    from tidemark.operators import lookups

    r = random.Random(4)
    bars = [("s", i, r.uniform(90, 110), 2.0) for i in range(1300)] + [("t", 0, 100.0, 1.0), ("t", 1, 100.0, 0.0)]
    levels = [("s", "BSL", 111.0, 3, None), ("s", "SSL", 89.0, 5, 1200), ("t", "BSL", 99.0, 0, None), ("t", "SSL", 100.0, 0, 0)]
    levels += [("s", r.choice(["BSL", "SSL"]), r.uniform(85, 115), c, c + r.randint(0, 40)) for c in range(0, 1300, 60)]
    got = lookups.side_distances(spark.createDataFrame(bars, "series_id string, bar_idx long, close double, atr double"), spark.createDataFrame(levels, "series_id string, type string, price double, created_idx long, resolved_idx long"))
    want = {}
    for s, i, close, atr in bars:
        if atr > 0:
            live = [(t, p) for own, t, p, a, b in levels if own == s and a <= i and (b is None or i <= b)]
            up = min(((p - close) / atr for t, p in live if t == "BSL" and p >= close), default=-1.0)
            down = min((-((p - close) / atr) for t, p in live if t == "SSL" and p <= close), default=-1.0)
            want[s, i] = (up, down)
    found = got.collect()
    assert len(found) == len(want) and {(x["series_id"], x["bar_idx"]): (x["up"], x["down"]) for x in found} == want


def test_first_beyond_at_every_depth(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from tidemark.operators import levels

    monkeypatch.setattr(levels, "FAN", 3)
    r = random.Random(11)
    bars = []
    for s, n in (("a", 400), ("b", 1), ("c", 90)):
        x = 100.0
        for i in range(n):
            x += r.choice([-1.0, 0.0, 1.0, 3.0, -3.0])
            bars.append((s, i, x + r.randint(0, 2), x - r.randint(0, 2)))
    rows = [(r.choice("abcd"), k, r.randint(0, 410), 100.0 + r.randint(-60, 60), r.random() < 0.5) for k in range(150)] + [("a", 150, 0, None, True), ("a", 151, 0, 1e9, True), ("a", 152, 399, -1e9, True)]
    table = spark.createDataFrame(bars, "series_id string, bar_idx long, high double, low double")
    asked = spark.createDataFrame(rows, "series_id string, level_id long, s long, p double, up boolean")
    for equal in (False, True):
        got = levels.first_beyond(asked, table, start="s", price="p", above=F.col("up"), equal=equal).collect()
        assert len(got) == len(rows)
        for x in got:
            hits = [i for s, i, high, low in bars if s == x["series_id"] and i >= x["s"] and x["p"] is not None and ((high - x["p"]) * (1 if x["up"] else 0) + (x["p"] - low) * (0 if x["up"] else 1) > (-1e-12 if equal else 0))]
            assert x["first_idx"] == (min(hits) if hits else None), x


def test_supply_demand_zones_against_a_loop(spark):
    import random

    from tidemark.operators import structure

    r = random.Random(5)
    bars, pivots, series = [], [], {}
    for s, n in (("a", 500), ("b", 60)):
        x, own = 100.0, []
        for i in range(n):
            x += r.choice([-2.0, -0.5, 0.5, 2.0]) + (r.choice([-9.0, 9.0]) if r.random() < 0.03 else 0)
            own.append((x + r.random(), x - r.random(), x, r.choice([0.0, 1.0, 1.5])))
        series[s] = own
        bars += [(s, i, *b) for i, b in enumerate(own)]
        for i in range(3, n - 5, 4):
            kind = r.choice(["HIGH", "LOW"])
            pivots.append((s, i, i + r.randint(2, 4), kind, own[i][0] if kind == "HIGH" else own[i][1]))
    want = set()
    for s, own in series.items():
        held = {"SUPPLY": [], "DEMAND": []}
        for _, i, c, kind, price in sorted((p for p in pivots if p[0] == s), key=lambda p: (p[2], p[1])):
            atr = own[c][3]
            if atr <= 0:
                continue
            t = "SUPPLY" if kind == "HIGH" else "DEMAND"
            top, bottom = (price, price - atr * 0.25) if t == "SUPPLY" else (price + atr * 0.25, price)
            poi = (top + bottom) / 2
            if any(z[5] is None and abs(z[2] - poi) <= 2 * atr for z in held[t]):
                continue
            touch = broken = None
            for k in range(c + 1, len(own)):
                high, low, close, _ = own[k]
                if touch is None and k > c + 1 and high >= bottom and low <= top:
                    touch = k
                if close >= top if t == "SUPPLY" else close <= bottom:
                    broken = k
                    break
            held[t].append((i, c, poi, t, touch, broken))
            held[t] = held[t][-20:]
        for zones in held.values():
            for z in [z for z in zones if z[5] is None] + sorted((z for z in zones if z[5] is not None), key=lambda z: z[5])[-5:]:
                want.add((s, z[0], z[1], z[3], z[4], z[5], "BROKEN" if z[5] is not None else "MITIGATED" if z[4] is not None else "ACTIVE"))
    b = spark.createDataFrame(bars, "series_id string, bar_idx long, high double, low double, close double, atr double")
    p = spark.createDataFrame(pivots, "series_id string, pivot_idx long, confirm_idx long, type string, price double")
    got = structure.supply_demand_zones(p, b.select("series_id", "bar_idx", "atr"), b)
    assert {(x["series_id"], x["pivot_idx"], x["confirm_idx"], x["type"], x["mitigated_idx"], x["broken_idx"], x["state"]) for x in got.collect()} == want
    assert len(want) > 20
    assert structure.supply_demand_zones(p.where("false"), b.select("series_id", "bar_idx", "atr"), b).count() == 0
