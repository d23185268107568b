"""All pairs in tiles, and lines by number, against numpy and a plain reader."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import models, pairs, plane
from tidemark.sources import files


@pytest.mark.parametrize("tile", [1024, 13])
def test_correlation_of_all_distances(spark, tile):
    r = np.random.default_rng(1)
    a = r.standard_normal((90, 3)) + 100
    b = a[:, :2] + 0.5 * r.standard_normal((90, 2))
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(900, None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>").repartition(4)
    i, j = np.triu_indices(90, 1)
    da, db = (np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1)) for x in (a, b))
    got = pairs.distance_correlation(df, tile=tile).first()
    assert got["n"] == len(i) and got["correlation"] == pytest.approx(np.corrcoef(da, db)[0, 1])
    m = pairs.distance_moments(df, tile=tile).first()
    assert (m["mean_a"], m["square_b"]) == pytest.approx((da.mean(), ((db - db.mean()) ** 2).sum()))


def test_moments_of_several_spaces_in_one_pass(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((500, 3, 2)) + 50
    x[:, 1] = x[:, 0] + 0.3 * x[:, 1]
    df = spark.createDataFrame([(i, *v.tolist()) for i, v in enumerate(x)], "id long, a array<double>, b array<double>, c array<double>").repartition(4)
    i, j = np.triu_indices(500, 1)
    d = [np.sqrt(((x[i, s] - x[j, s]) ** 2).sum(axis=1)) for s in range(3)]
    for tile in (None, 97):
        got = pairs.space_moments(df, ["a", "b", "c"], tile=tile).first()
        assert got["n"] == len(i)
        for k, s in enumerate("abc"):
            assert (got[f"mean_{s}"], got[f"square_{s}"]) == pytest.approx((d[k].mean(), ((d[k] - d[k].mean()) ** 2).sum()))
        for p, q in ((0, 1), (0, 2), (1, 2)):
            assert got[f"product_{'abc'[p]}_{'abc'[q]}"] == pytest.approx(((d[p] - d[p].mean()) * (d[q] - d[q].mean())).sum())


def test_distances_without_spread(spark):
    one = spark.createDataFrame([(1, [0.0], [0.0])], "id long, a array<double>, b array<double>")
    assert tuple(pairs.distance_correlation(one).first()) == (0, 0.0) and tuple(pairs.distance_correlation(one.where("id < 0")).first()) == (0, 0.0)
    same = spark.createDataFrame([(k, [1.0], [float(k)]) for k in range(5)], "id long, a array<double>, b array<double>")
    assert tuple(pairs.distance_correlation(same).first()) == (10, 0.0)


def test_seeds_are_compared(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(c, 0.3, (20, 4)) for c in (0, 6)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = pairs.seed_stability(df, (7, 7, 42), k=5, anchors=20, perplexity=5, iterations=60).collect()
    assert len(got) == 4 and tuple(got[0]) == (7, 7, pytest.approx(1.0), 1.0, 0.0, "LOW")
    assert got[3]["a"] is None and got[3]["overlap"] == pytest.approx(np.mean([g["overlap"] for g in got[:3]]))
    assert [pairs.influence(*x) for x in ((0.9, 0.7), (0.9, 0.6), (0.74, 0.9))] == ["LOW", "MODERATE", "HIGH"]


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = []
    for name, n in (("a.csv", 400), ("b.csv", 3), ("c.csv", 0)):
        own = [f'{i},"v ""{i}"", x"' if i % 5 else "" for i in range(n)]
        (tmp_path / "in" / name).write_text("\n".join(["n,v", *own]) + "\n")
        want += [(name, k + 2, str(i), f'v "{i}", x') for k, i in enumerate(range(n)) if i % 5]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        df = files.read_numbered(spark, f"file://{tmp_path}/in")
        assert df.rdd.getNumPartitions() > 3
        got = df.select(F.element_at(F.split("source_file", "/"), -1).alias("f"), "line", "n", "v").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_anchors_are_evenly_spaced_whatever_ranges_are_drawn(spark):
    """Ranges were drawn twice, once to count and once to take, so that tables larger than the draw gave wrong anchors or too few."""
    rows = spark.range(12000).repartition(5)
    want = sorted({int(np.floor(j * 11999 / 89 + 0.5)) for j in range(90)})
    assert sorted(r["id"] for r in models.evenly_spaced(rows, 90).collect()) == want


@pytest.mark.parametrize("cell", [2048, 20])
def test_nearest_places_by_cells_are_those_of_all_pairs(spark, cell):
    r = np.random.default_rng(5)
    maps = [np.round(r.standard_normal((400, 2)), 1), np.concatenate([r.standard_normal((390, 2)) * 1e-6, 9 * r.standard_normal((10, 2))])]
    maps[1][7] = np.nan
    rows = [(i, [i, i + 1000][: 1 + i % 2], *(p[i].tolist() for p in maps)) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, ids array<long>, a array<double>, b array<double>").repartition(4)
    got = {x["key"]: x for x in plane.nearest_ids(df, ["a", "b"], 6, cell=cell).collect()}
    for c, p in zip("ab", maps, strict=True):
        for i in range(400):
            d2 = (p[:, 0] - p[i, 0]) ** 2 + (p[:, 1] - p[i, 1]) ** 2
            every = sorted((d2[j], n) for j in range(400) if np.isfinite(d2[j]) for n in rows[j][1])
            assert got[i][c] == ([n for _, n in every[:6]] or None)


def test_seeds_are_compared_over_rows_that_repeat(spark):
    """The whole figure by a loop, where few rows share many places; more rows than draws of ranges see."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.standard_normal((1500, 4)), np.repeat(r.standard_normal((6, 4)), 250, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (9000, None)], "id long, vector array<double>").repartition(4)
    how = {"anchors": 20, "perplexity": 5, "iterations": 60}
    fitted = models.fit_maps(df.where("vector is not null"), [7, 42], **how)
    near, far = [], []
    for p in models.places(x, fitted[0]["x"], [m["y"] for m in fitted]):
        d2 = (p[:, None, 0] - p[None, :, 0]) ** 2 + (p[:, None, 1] - p[None, :, 1]) ** 2
        far.append(np.sqrt(d2[np.triu_indices(len(x), 1)]))
        np.fill_diagonal(d2, np.inf)
        near.append(np.argsort(d2, axis=1, kind="stable")[:, :5])
    got = pairs.seed_stability(df, (7, 42), k=5, **how).first()
    assert got["correlation"] == pytest.approx(np.corrcoef(*far)[0, 1]) and got["overlap"] == pytest.approx(np.mean([len(set(a) & set(b)) / 5 for a, b in zip(*near, strict=True)]))
