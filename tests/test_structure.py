"""Detectors and lookups against plain loops over random bars: one bar at a time, or all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candles as C
from tidemark.operators import features as X
from tidemark.operators import live
from tidemark.operators import lookups as K
from tidemark.operators import pivots as P
from tidemark.operators import profile as V
from tidemark.operators import recursive as R
from tidemark.operators import structure as S
from tidemark.operators import windows as W
from tidemark.sources.files import kept

BARS = "series_id string, bar_idx long, epoch long, open double, high double, low double, close double, volume double"


def walk(seed, n, tick=0.25):
    r = np.random.default_rng(seed)
    out, price = [], 100.0
    for i in range(n):
        o = price
        c = o + tick * int(r.integers(-6, 7))
        h, lo = max(o, c) + tick * int(r.integers(0, 5)), min(o, c) - tick * int(r.integers(0, 5))
        out.append((i, 1_700_000_000 - 1_700_000_000 % 86400 + 3600 * i, o, h, lo, c, float(r.integers(0, 30))))
        price = c
    return out


@pytest.fixture(scope="module")
def series():
    return {"a": walk(1, 420), "b": walk(2, 300), "c": walk(3, 3)}


@pytest.fixture(scope="module")
def bars(spark, series):
    return kept(spark.createDataFrame([(s, *b) for s, own in series.items() for b in own], BARS).repartition(3))


def told(df, *columns, by="series_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[by], []).append(tuple(r[c] for c in columns))
    return out


def crossings(own, pivots, confluence=False, external=()):
    """One bar at a time: [(name, bar, pivot)] of the breaks."""
    live_, trend, out = {}, 0, []
    for i, (_, _, o, h, lo, c, _) in enumerate(own):
        for kind, at, confirmed, price in pivots:
            if confirmed == i:
                live_[kind] = [at, price, False]
        for kind, way in (("HIGH", 1), ("LOW", -1)):
            p = live_.get(kind)
            if i == 0 or p is None or p[2] or not (way * own[i - 1][5] <= way * p[1] < way * c):
                continue
            if any(k == kind and abs(x - p[1]) < 1e-7 for k, x in external):
                continue
            upper, lower = h - max(o, c), min(o, c) - lo
            if confluence and not (way * upper > way * lower):
                continue
            out.append((("CHOCH" if trend == -way else "BOS") + ("_UP" if way == 1 else "_DOWN"), i, p[0]))
            trend, p[2] = way, True
    return out


@pytest.mark.parametrize("confluence", [False, True])
@pytest.mark.parametrize("excluded", [False, True])
def test_breaks_by_a_loop(spark, bars, series, confluence, excluded):
    pivots = kept(P.leg_pivots(bars, 3))
    own = told(pivots, "type", "pivot_idx", "confirm_idx", "price")
    rows = [(s, t, p + 4e-8) for s, ps in own.items() for k, (t, _, _, p) in enumerate(ps) if k % 3 == 0]
    rows += [(s, t, p + 2e-7) for s, ps in own.items() for k, (t, _, _, p) in enumerate(ps) if k % 3 == 1]
    external = spark.createDataFrame([(s, t, 0, 0, p) for s, t, p in rows], "series_id string, type string, pivot_idx long, confirm_idx long, price double") if excluded else None
    got = told(S.breaks(pivots, bars, confluence=confluence, external=external).orderBy("event_no"), "event", "break_idx", "pivot_idx")
    want = {s: crossings(b, own.get(s, []), confluence, [(t, p) for x, t, p in rows if x == s] if excluded else []) for s, b in series.items()}
    assert {s: sorted(e) for s, e in got.items()} == {s: sorted(e) for s, e in want.items() if e}
    assert sum(map(len, want.values())) > 10


def test_gates_leave_pivots_open_and_the_trend_alone(spark):
    """A bar that leans the wrong way breaks nothing: the high breaks later, and the break of the low before it follows no trend."""
    closes = [(9, 0, 0), (11, 0, 1), (9, 0, 0), (7, 0, 1), (9, 0, 0), (11, 1, 0)]  # close, upper wick, lower wick
    own = [(i, i, c, c + up, c - down, c, 1.0) for i, (c, up, down) in enumerate(closes)]
    bars = spark.createDataFrame([("s", *(float(x) if k > 1 else x for k, x in enumerate(b))) for b in own], BARS)
    pivots = [("HIGH", 0, 0, 10.0), ("LOW", 0, 0, 8.0)]
    df = spark.createDataFrame([("s", i, c, t, p) for t, i, c, p in pivots], "series_id string, pivot_idx long, confirm_idx long, type string, price double")
    names = lambda **how: [(r["event"], r["break_idx"]) for r in S.breaks(df, bars, **how).orderBy("event_no").collect()]
    assert names() == [("BOS_UP", 1), ("CHOCH_DOWN", 3)]
    assert names(confluence=True) == [("BOS_DOWN", 3), ("CHOCH_UP", 5)]
    same = spark.createDataFrame([("s", "HIGH", 10.0)], "series_id string, type string, price double")
    assert names(external=same) == [("BOS_DOWN", 3)] and names(external=same.withColumn("type", F.lit("LOW"))) == names()
    assert crossings(own, pivots, True) == [("BOS_DOWN", 3, 0), ("CHOCH_UP", 5, 0)]


def swings(own, length):
    """External zig-zag, one bar at a time."""
    out, way, high, low = [], None, None, None
    top = lambda i: max(range(max(0, i - length + 1), i + 1), key=lambda j: (own[j][3], j))
    bottom = lambda i: min(range(max(0, i - length + 1), i + 1), key=lambda j: (own[j][4], -j))
    for i in range(1, len(own)):
        was = way
        way = 1 if top(i) == i else way
        way = 0 if bottom(i) == i else way
        if top(i - 1) == i - 1 and own[i][3] < own[top(i)][3]:
            high = ("HIGH", i - 1, own[i - 1][3])
        if bottom(i - 1) == i - 1 and own[i][4] > own[bottom(i)][4]:
            low = ("LOW", i - 1, own[i - 1][4])
        if way is None:
            continue
        if was is not None and was != way and high and low:
            out += [low, high] if way else [high, low]
        newest = high if way else low
        if newest and out and out[-1][0] == newest[0]:
            out[-1] = newest
    clean = []
    for p in out:
        if clean and clean[-1][0] == p[0]:
            if clean[-1][1] == p[1] or (p[2] > clean[-1][2] if p[0] == "HIGH" else p[2] < clean[-1][2]):
                clean[-1] = p
        else:
            clean.append(p)
    return clean


@pytest.mark.parametrize("length", [20, 150])
def test_external_swings_by_a_loop(bars, series, length):
    got = told(P.swing_pivots(bars, length).orderBy("pivot_idx"), "type", "pivot_idx", "price")
    want = {s: swings(b, length) for s, b in series.items()}
    assert got == {s: sorted(p, key=lambda x: x[1]) for s, p in want.items() if p} and sum(map(len, want.values())) > 3


def lifecycle(own, created, kind, price, run=3):
    way, swept, outside = (1 if kind == "BSL" else -1), None, 0
    for i in range(created + 1, len(own)):
        reach, c = (own[i][3] if way == 1 else own[i][4]), own[i][5]
        if swept is None:
            if not way * reach > way * price:
                continue
            swept = i
        if way * c < way * price:
            return swept, i, "SWEEP" if i == swept else "GRAB"
        outside = outside + 1 if way * c > way * price else 0
        if outside >= run:
            return swept, i, "RUN"
    return swept, None, "NONE"


def test_levels_and_order_blocks_of_external_swings(bars, series):
    pivots = kept(P.swing_pivots(bars, 40))
    for s, created, kind, price, *got in [tuple(r[c] for c in ("series_id", "created_idx", "type", "price", "swept_idx", "resolved_idx", "class")) for r in S.liquidity(pivots, bars).collect()]:
        assert tuple(got) == lifecycle(series[s], created, kind, price)
    events = kept(S.breaks(pivots, bars))
    for source in ("highlow", "close"):
        blocks = {(r["series_id"], r["event_no"]): r for r in S.order_blocks(events, bars, source=source).collect()}
        seen = 0
        for e in events.collect():
            own, up = series[e["series_id"]], e["direction"] == 1
            if e["break_idx"] <= e["pivot_idx"]:
                assert (e["series_id"], e["event_no"]) not in blocks
                continue
            r, span = blocks[e["series_id"], e["event_no"]], range(e["pivot_idx"], e["break_idx"])
            opposite = [i for i in span if (own[i][5] < own[i][2]) == up and own[i][5] != own[i][2]]
            at = opposite[-1] if opposite else (min(span, key=lambda i: (own[i][4], i)) if up else min(span, key=lambda i: (-own[i][3], i)))
            top, bottom = own[at][3], own[at][4]
            after = range(e["break_idx"] + 1, len(own))
            touch = next((i for i in after if (own[i][4] <= top if up else own[i][3] >= bottom)), None)
            edge = lambda i: (own[i][5] if source == "close" else own[i][4] if up else own[i][3])  # noqa: E731, B023
            gone = next((i for i in after if (edge(i) < bottom if up else edge(i) > top)), None)
            assert (r["ob_idx"], r["top"], r["bottom"], r["touch_idx"], r["invalid_idx"]) == (at, top, bottom, touch, gone)
            seen += 1
        assert seen
    with pytest.raises(ValueError):
        S.order_blocks(events, bars, source="body")


def test_external_fibonacci_of_the_last_two_swings(bars, series):
    from tidemark.functions import audits as A

    got = told(A.external_fibonacci(P.swing_pivots(bars, 20)).orderBy("ratio"), "direction", "ratio", "price")
    for s, own in series.items():
        two = sorted(swings(own, 20), key=lambda p: p[1])[-2:]
        if len(two) == 2 and two[0][0] != two[1][0]:
            (_, _, a), (kind, _, b) = two
            want = [("UP", r, b - abs(b - a) * r) if kind == "HIGH" else ("DOWN", r, b + abs(b - a) * r) for r in (0.382, 0.5, 0.618, 0.705, 0.786)]
            assert [(d, r) for d, r, _ in got[s]] == [(d, r) for d, r, _ in want] and np.allclose([p for *_, p in got[s]], [p for *_, p in want])


# Lookups among what is live


@pytest.mark.parametrize("equal_below,equal_above", [(True, True), (False, True), (True, False)])
def test_nearest_live_by_all_pairs(spark, equal_below, equal_above):
    r = np.random.default_rng(6)
    levels = [(s, int(k), int(a := r.integers(0, 90)), None if r.random() < 0.3 else int(a + r.integers(-2, 40)), float(r.integers(0, 40)) / 4) for s in "xy" for k in range(60)]
    points = [(s, int(t), float(r.integers(-4, 44)) / 4) for s in "xyz" for t in range(0, 100, 3)]
    lv = spark.createDataFrame(levels, "series_id string, n long, since long, until long, v double").repartition(3)
    pt = spark.createDataFrame(points, "series_id string, t long, p double")
    got = {(x["series_id"], x["t"]): x for x in live.nearest_live(pt, lv, ["series_id", "t"], at="t", price="p", since=F.col("since"), until=F.col("until"), value=F.col("v"), prefer=F.col("n"), keep=["n"], equal_below=equal_below, equal_above=equal_above).collect()}
    for s, t, p in points:
        own = [(v, n) for x, n, a, b, v in levels if x == s and a <= t and (b is None or b >= t)]
        below, above = ([x for x in own if ok(x[0])] for ok in ((lambda v: v <= p) if equal_below else (lambda v: v < p), (lambda v: v >= p) if equal_above else (lambda v: v > p)))  # noqa: B023
        x = got.get((s, t))
        if x is None:
            assert not own
            continue
        assert (x["n_below"], x["n_above"]) == (len(below), len(above))
        assert (None if x["below"] is None else (x["below"]["v"], x["below"]["n"])) == max(below, default=None)
        assert (None if x["above"] is None else (x["above"]["v"], x["above"]["n"])) == min(above, key=lambda y: (y[0], -y[1]), default=None)


def test_nearest_box_by_all_pairs(spark):
    r = np.random.default_rng(7)
    boxes = [(s, n, int(r.integers(0, 80)), float(lo := r.integers(0, 60)), float(lo + r.integers(-6, 7))) for s in "xy" for n in range(70)]
    boxes = [(s, k, known, hi, lo) for s in "xy" for k, (_, _, known, lo, hi) in enumerate(sorted((b for b in boxes if b[0] == s), key=lambda b: b[2]))]
    points = [(s, int(t), float(r.integers(-5, 70))) for s in "xyz" for t in range(0, 100, 2)]
    b = spark.createDataFrame(boxes, "series_id string, n long, known_at long, hi double, lo double").repartition(3)
    pt = spark.createDataFrame(points, "series_id string, t long, p double")
    got = {(x["series_id"], x["t"]): (x["box"]["n"], x["distance"]) for x in live.nearest_box(pt, b, ["series_id", "t"], at="t", price="p", known="known_at", top="hi", bottom="lo", prefer=F.col("n"), keep=["n"]).collect()}
    for s, t, p in points:
        own = [(max(min(hi, lo) - p, p - max(hi, lo), 0.0), -n) for x, n, known, hi, lo in boxes if x == s and known <= t]
        want = min(own, default=None)
        assert got.get((s, t)) == (None if want is None else (-want[1], want[0]))


def test_no_join_grows_with_the_square(spark):
    """Twice the pivots and zones of a series: the widest step has little more than twice the rows."""
    from pyspark.sql import functions as F

    wide = []
    for n in (400, 800):
        rows = spark.range(n).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), (F.rand(1) * 50).alias("p"))
        held, met = live._dealt(rows.withColumn("until", F.lit(None).cast("long")), rows, F.col("t"), F.col("until"), "t")
        wide.append(held.count() + met.count())
    assert wide[1] < 2.4 * wide[0]


# Windows and profiles


@pytest.mark.parametrize("n", [1, 2, 7, 64, 500])
def test_trailing_extremes_by_a_loop(bars, series, n):
    got = told(W.trailing_extremes(bars, n, {"t": (F.col("high"), F.max), "b": (F.col("low"), F.min), "v": (F.col("volume"), F.sum)}), "bar_idx", "t", "b", "v")
    for s, own in series.items():
        for i, t, b, v in got[s]:
            some = own[max(0, i - n + 1) : i + 1]
            assert (t, b, v) == (max(x[3] for x in some), min(x[4] for x in some), sum(x[6] for x in some))


def test_strongest_bars_by_a_loop(bars, series):
    got = told(W.supply_demand_score(bars, 30), "bar_idx", "demand", "supply")
    for s, own in series.items():
        for i, demand, supply in got[s]:
            mid = (own[i][3] + own[i][4]) / 2
            some = [(abs(c - o) / max(h - lo, 0.25) * v, -j, c - o, h, lo) for j, _, o, h, lo, c, v in own[max(1, i - 30) : i + 1]]
            up, down = max((x for x in some if x[2] > 0), default=None), max((x for x in some if x[2] < 0), default=None)
            assert (demand, supply) == (up[4] if up else mid, down[3] if down else mid)


def profile(own, bins=24, share=0.7):
    lo, hi = min(x[4] for x in own), max(x[3] for x in own)
    if hi <= lo:
        return None
    step, v = (hi - lo) / bins, [0.0] * bins
    for x in own:
        v[min(int(((x[3] + x[4] + x[5]) / 3 - lo) / step), bins - 1)] += x[6]
    poc = v.index(max(v))
    left = right = poc
    acc, total = v[poc], sum(v) or 1
    while acc / total < share and (left > 0 or right < bins - 1):
        a, b = v[left - 1] if left else -1, v[right + 1] if right < bins - 1 else -1
        if b >= a:
            right, acc = right + 1, acc + b
        else:
            left, acc = left - 1, acc + a
    return v, tuple(lo + (k + 0.5) * step for k in (poc, right, left))


def test_profiles_of_ranges_by_a_loop(spark, bars, series):
    r = np.random.default_rng(9)
    ranges = [(s, k, int(a := r.integers(0, len(own))), int(r.integers(a, len(own)))) for s, own in series.items() for k in range(25)]
    df = spark.createDataFrame(ranges, "series_id string, event_idx long, first_idx long, last_idx long")
    key = ["series_id", "event_idx"]
    made = kept(V.range_profiles(bars, df, key))
    volumes = {(x["series_id"], x["event_idx"]): x["volumes"] for x in made.collect()}
    areas = {(x["series_id"], x["event_idx"]): (x["poc"], x["vah"], x["val"]) for x in V.range_areas(made, key, F.lit(-1.0)).collect()}
    sums = {(x["series_id"], x["event_idx"]): x for x in V.range_sums(bars, df, key).collect()}
    for s, k, a, b in ranges:
        some = series[s][a : b + 1]
        want = profile(some)
        assert sums[s, k]["volume"] == sum(x[6] for x in some)
        if want is None:
            assert volumes[s, k] is None and areas[s, k] == (-1.0, -1.0, -1.0)
        else:
            assert volumes[s, k] == want[0] and np.allclose(areas[s, k], want[1])


def test_ranges_end_at_the_bar_that_is_replayed(bars, series):
    events = S.breaks(P.leg_pivots(bars, 3), bars)
    at = told(events, "break_idx")
    for mode in ("VISIBLE", "SESSION", "BOS_CHOCH", "HISTORICAL", "unknown"):
        got = {s: sorted(i for (i,) in rows) for s, rows in told(V.in_range(bars, mode, first=-3, last=240, events=events, until=200, recent=50), "bar_idx").items()}
        for s, own in series.items():
            last = min(200, len(own) - 1)
            if mode == "SESSION":
                want = [i for i in range(last + 1) if own[i][1] // 86400 == own[last][1] // 86400]
            elif mode in ("VISIBLE", "unknown"):
                want = list(range(last + 1))
            else:
                past = [i for (i,) in at.get(s, []) if i <= 200]
                want = list(range(max(past) if mode == "BOS_CHOCH" and past else max(0, last - 49), last + 1))
            assert got[s] == want, (mode, s)


# The pivot and ghost tables


@pytest.fixture(scope="module")
def table(bars):
    atr, pivots = kept(R.atr(bars)), kept(P.swing_pivots(bars, 20))
    events = kept(S.breaks(pivots, bars))
    parts = dict(levels=kept(S.liquidity(pivots, bars)), equal=kept(P.equal_levels(P.leg_pivots(bars, 3), atr, 0.5)), gaps=kept(S.mitigated_gaps(bars)), blocks=kept(S.order_blocks(events, bars)), events=events)
    return kept(X.pivot_features(pivots, atr, **parts)), atr, pivots, parts


def test_pivot_table_by_all_pairs(table, series):
    features, atr, pivots, parts = table
    rows = {(r["series_id"], r["pivot_index"], r["pivot_side"]): r for r in features.collect()}
    assert features.columns == ["series_id", *X.PIVOT_COLUMNS] and len(X.PIVOT_COLUMNS) == 79
    units = {(r["series_id"], r["bar_idx"]): r["atr"] or 0.0 for r in atr.collect()}
    have = {name: told(df, *df.columns) for name, df in parts.items()}
    col = {name: df.columns for name, df in parts.items()}
    of = lambda name, s: [dict(zip(col[name], x, strict=True)) for x in have[name].get(s, [])]
    number = 0
    for s, own in told(pivots.orderBy("pivot_idx"), "pivot_idx", "confirm_idx", "type", "price").items():
        before = None
        for n, (i, t, kind, price) in enumerate(own):
            r, atr_ = rows[s, i, kind], units[s, t]
            over = lambda d: d / atr_ if atr_ > 0 else 0.0  # noqa: E731, B023
            events = sorted((e for e in of("events", s) if e["break_idx"] <= t), key=lambda e: e["event_no"])
            assert r["pivot_id"] == n + 1
            if events:
                e = events[-1]
                assert (r["last_structure_event"], r["bars_since_structure_event"]) == (e["event"], t - e["break_idx"]) and r["last_structure_event_direction"] == e["event"].split("_")[1]
                assert r["distance_last_structure_event_atr"] == pytest.approx(over(abs(price - e["price"])))
            else:
                assert (r["last_structure_event"], r["bars_since_structure_event"], r["last_structure_event_direction"]) == ("NONE", -1, "NONE")
            assert (r["bos_count_previous_20"], r["choch_count_previous_20"]) == tuple(sum(e["event"].startswith(k) and e["break_idx"] > t - 20 for e in events) for k in ("BOS", "CHOCH"))
            equal = [(abs(price - (e["price1"] + e["price2"]) / 2), e["idx2"], e) for e in of("equal", s) if e["confirm2"] <= t]
            if equal:
                d, _, e = min(equal, key=lambda x: x[:2])
                assert r["distance_equal_level_atr"] == pytest.approx(over(d)) and r["bars_since_equal_level"] == t - e["confirm2"] and r["near_equal_level"] == int(atr_ > 0 and d / atr_ <= 1)
            assert r["equal_levels_previous_100"] == sum(e["confirm2"] > t - 100 for _, _, e in equal)
            for name, when, gone, order, out in (("gaps", "gap_idx", "mitigated_idx", "gap_idx", ("inside_fvg", "nearest_fvg_type", "distance_fvg_atr", "fvg_size_atr", "bars_since_fvg", "fvg_mitigated", "active_fvg_count_50")), ("blocks", "break_idx", "invalid_idx", "event_no", ("inside_order_block", "nearest_ob_type", "distance_ob_atr", "ob_size_atr", "bars_since_ob", "ob_invalidated", "active_ob_count_50"))):
                zones = [z for z in of(name, s) if z[when] <= t]
                done = lambda z: z[gone] is not None and z[gone] <= t  # noqa: E731, B023
                assert r[out[6]] == sum(z[when] > t - 50 and not done(z) for z in zones)
                if zones:
                    d, _, z = min(((max(z["bottom"] - price, price - z["top"], 0.0), -z[order], z) for z in zones), key=lambda x: x[:2])
                    assert (r[out[0]], r[out[1]], r[out[4]], r[out[5]]) == (int(d == 0), z["type"], t - z[when], int(done(z)))
                    assert (r[out[2]], r[out[3]]) == pytest.approx((over(d), over(z["top"] - z["bottom"])))
                else:
                    assert tuple(r[c] for c in out) == (0, "NONE", 0.0, 0.0, -1, 0, 0)
            known = [x for x in of("levels", s) if x["created_idx"] <= t]
            active = {k: [abs(price - x["price"]) for x in known if x["type"] == k and (x["resolved_idx"] is None or x["resolved_idx"] > t)] for k in ("BSL", "SSL")}
            for k in ("BSL", "SSL"):
                assert r[f"{k.lower()}_count_previous_100"] == sum(x["type"] == k and x["created_idx"] > t - 100 for x in known)
                assert r[f"active_{k.lower()}_count"] == len(active[k]) and r[f"distance_nearest_{k.lower()}_atr"] == pytest.approx(over(min(active[k])) if active[k] else 0.0)
            b, x = len(active["BSL"]), len(active["SSL"])
            assert r["liquidity_imbalance_100"] == pytest.approx((b - x) / (b + x) if b + x else 0.0)
            level = [x for x in known if x["created_idx"] == t and (x["type"] == "BSL") == (kind == "HIGH") and abs(x["price"] - price) < 1e-9]
            assert (r["target"], r["liquidity_state"]) == ((level[0]["class"], level[0]["state"]) if level else ("NONE", "NONE"))
            assert r["distance_previous_pivot"] == (abs(price - before[3]) if before else 0.0) and r["previous_pivot_type"] == (before[2] if before else "NONE")
            o, h, lo, c, v = series[s][i][2:7]
            assert (r["pivot_range"], r["upper_wick"], r["candle_direction"], r["pivot_volume"]) == (h - lo, h - max(o, c), int(np.sign(c - o)), v)
            past = [x[6] for x in series[s][max(0, t - 20) : t]]
            assert r["volume_mean_20"] == pytest.approx(np.mean(past) if past else 0.0) and r["volume_std_20"] == pytest.approx(np.std(past) if past else 0.0)
            before, number = own[n], number + 1
    assert number == len(rows) > 10


def test_ghost_table_by_a_loop(table, bars, series):
    features, *_ = table
    rows = X.ghost_table(features, bars).collect()
    want = {(r["series_id"], r["pivot_id"]) for r in features.collect() if 20 <= r["confirmation_index"] <= len(series[r["series_id"]]) - 16}
    assert {(r["series_id"], r["pivot_id"]) for r in rows} == want and want
    for r in rows:
        own, i = series[r["series_id"]], r["ghost_index"]
        mid = (own[i][3] + own[i][4]) / 2
        assert r["ghost_price_mid"] == mid and r["atr_1m_pips"] == pytest.approx(r["atr_14"] * 4) and r["distance_ob_pips"] == pytest.approx(r["distance_ob_atr"] * r["atr_14"] * 4)
        for h in X.HORIZONS:
            top, bottom, n = own[i][3], own[i][4], 0
            for x in own[i + 1 : i + 1 + h]:
                n += (x[3] > top) + (x[4] < bottom)
                top, bottom = max(top, x[3]), min(bottom, x[4])
            assert r[f"target_trace_{h}"] == n
        for n, name in X.WINDOWS.items():
            some = own[max(0, i - n + 1) : i + 1]
            assert r[f"sr_{name}_resistance_pips"] == (max(x[3] for x in some) - mid) * 4 and r[f"sr_{name}_support_pips"] == (mid - min(x[4] for x in some)) * 4
        for tf in X.FRAMES:
            some = own[max(0, i - max(20 * tf, 60) + 1) : i + 1]
            got = profile(some)
            assert [r[f"tf_{tf}_{c}_distance_pips"] for c in ("poc", "vah", "val")] == pytest.approx([(mid - x) * 4 for x in got[1]])
            blocks = []
            for b in range(20):
                end = i - b * tf
                if end < 0:
                    break
                part = own[max(0, end - tf + 1) : end + 1]
                blocks.insert(0, (part[0][2], max(x[3] for x in part), min(x[4] for x in part), part[-1][5], sum(x[6] for x in part)))
            ranges = [b[1] - b[2] if k == 0 else max(b[1] - b[2], abs(b[1] - blocks[k - 1][3]), abs(b[2] - blocks[k - 1][3])) for k, b in enumerate(blocks)]
            ema = blocks[0][4]
            for b in blocks[1:]:
                ema = 0.2 * b[4] + 0.8 * ema
            assert [r[f"tf_{tf}_{c}"] for c in ("atr_pips", "return_pips", "volume", "volume_ema9")] == pytest.approx([np.mean(ranges[-14:]) * 4, (own[i][5] - blocks[0][0]) * 4, blocks[-1][4], ema])


def test_windows_at_events_are_those_of_all_bars(bars):
    events = kept(bars.where("bar_idx % 7 = 3 or bar_idx in (0, 1, 11)").select("series_id", F.col("bar_idx").alias("event_idx")))
    at = {(s, i) for s, rows in told(events, "event_idx").items() for (i,) in rows}
    rows = lambda df, i, *columns: {(r["series_id"], r[i]): tuple(r[c] for c in columns) for r in df.collect() if (r["series_id"], r[i]) in at}
    sides = [f"{c}_{n}" for n in (1, 5, 12) for c in ("resistance", "support")]
    wide = W.wide_windows(events, bars, (1, 5, 12), n=30)
    assert rows(wide, "event_idx", *sides) == rows(W.support_resistance(bars, (1, 5, 12)), "bar_idx", *sides)
    assert rows(wide, "event_idx", "demand", "supply") == rows(W.supply_demand_score(bars, 30), "bar_idx", "demand", "supply")
    traces = [f"trace_{h}" for h in (3, 5, 10, 15)]
    assert rows(W.traces_at(events, bars), "event_idx", *traces) == rows(W.trace_counts(bars), "bar_idx", *traces)
    for made in (wide, W.traces_at(events, bars), W.trailing_blocks(bars, events, 5)):  # no task puts a whole series in order
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"windowspecdefinition\(series_id#\d+, bar_idx#\d+L? ", plan)


def test_frames_together_are_the_frames_one_by_one(bars):
    events = kept(bars.where("bar_idx % 37 = 5").select("series_id", F.col("bar_idx").alias("event_idx")))
    both = C.frame_contexts(bars, events, (1, 4)).collect()
    assert both
    for size in (1, 4):
        one = {(r["series_id"], r["event_idx"]): r.asDict() for r in C.frame_context(bars, events, size).collect()}
        own = {(r["series_id"], r["event_idx"]): r.asDict() for r in both if r["frame"] == size}
        assert one.keys() == own.keys()
        for k, r in one.items():
            assert {c: own[k][c] for c in r} == pytest.approx(r)
