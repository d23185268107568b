import pytest
from pyspark.sql import functions as F

from tidemark.sources import files


def lines(spark, path, text):
    path.mkdir()
    (path / "ES_2025_04_07.csv").write_text(text)
    return f"file://{path}"


def test_split_lines(spark, tmp_path):
    got = files.read_split(spark, lines(spark, tmp_path / "a", "h1,h2;h3\n1,2;3\n\n \n4\t5,6\n")).collect()
    assert sorted(r["fields"] for r in got) == [["1", "2", "3"], ["4", "5", "6"]]


def test_candles(spark, tmp_path):
    text = "time,open,high,low,close,volume\n2025-04-07T09:30:00-05:00,1,2,0.5,1.5,10\nbroken\n2025-04-07 09:31,1,2,0.5,1.5,10\nnever,1,1,1,1,1\n"
    got = files.read_candles(spark, lines(spark, tmp_path / "b", text)).orderBy("epoch").collect()
    assert [(r["series_id"], r["epoch"] % 86400, r["dataset_date"]) for r in got] == [("ES_2025_04_07.csv", 34200, "2025-04-07"), ("ES_2025_04_07.csv", 34260, "2025-04-07")]


def test_dates_of_names(spark):
    df = spark.createDataFrame([("x_2025_04.csv",), ("x.csv",)], "f string")
    assert [r[0] for r in df.select(files.date_of(F.col("f"))).collect()] == ["2025-04", "UNKNOWN"]


def test_quotes_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, "")], "n long, t string")
    path = files.write_csv(df, f"file://{tmp_path}/c")
    assert sorted((r["n"], r["t"]) for r in files.read_quoted(spark, path, "n long, t string").collect()) == [(1, 'a "b", c'), (2, None)]  # empty is missing


def test_strict_scan(spark, tmp_path):
    path = lines(spark, tmp_path / "d", "a,b\n1,2\n")
    assert files.read_strict(spark, path, ["a"]).collect() == [("1", "2")]
    with pytest.raises(ValueError, match="missing columns"):
        files.read_strict(spark, path, ["z"])


def test_models_and_snapshots(spark, tmp_path):
    path = files.save_model(spark, {"a": [1.5, 2], "s": "x"}, f"file://{tmp_path}/m")
    assert files.load_model(spark, path) == {"a": [1.5, 2], "s": "x"}
    a = spark.createDataFrame([("s", 1), ("s", 2)], "series_id string, epoch long")
    b = spark.createDataFrame([("s", 2), ("s", 3), ("t", 1)], "series_id string, epoch long")
    assert sorted(tuple(r) for r in files.append_after(a, b).collect()) == [("s", 1), ("s", 2), ("s", 3), ("t", 1)]
