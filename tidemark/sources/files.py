"""Delimited text, candle files and model files, in any store that Spark reads."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDLES = "time string, open double, high double, low double, close double, volume double"
#: Time as written, without a zone: an offset after it is dropped.
CLOCK = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2})?).*$"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where none is set, one of our own in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "/tmp/tidemark-checkpoints"
    return f"{where.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is read several times; what is such a table already stays."""
    if getattr(df, "_tidemark_kept", False):
        return df
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_kept = True
    return out


def date_of(path: Column) -> Column:
    """yyyy-mm or yyyy-mm-dd from a file name with yyyy_mm or yyyy_mm_dd in it, else UNKNOWN."""
    part = lambda i: F.regexp_extract(path, r"(\d{4})_(\d{2})(?:_(\d{2}))?", i)
    return F.when(part(1) == "", "UNKNOWN").when(part(3) == "", F.concat_ws("-", part(1), part(2))).otherwise(F.concat_ws("-", part(1), part(2), part(3)))


def read_split(spark: SparkSession, path: str, delimiter: str = "[,;\t]") -> DataFrame:
    """Fields of each line, split by a regular expression; header lines and blank lines are left out, nothing is quoted."""
    lines = spark.read.option("header", True).option("sep", "\0").option("quote", "").schema("value string").csv(path)
    return lines.where(F.trim("value") != "").select(F.split("value", delimiter).alias("fields"))


def read_candles(spark: SparkSession, path: str, *, series: Column | None = None) -> DataFrame:
    """Bars (series_id, epoch, open, high, low, close, volume, dataset_date) of candle files with a header; malformed rows and rows without a time are dropped."""
    rows = spark.read.schema(CANDLES).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    ts = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract("time", CLOCK, 1), F.regexp_extract("time", CLOCK, 2)))
    epoch = F.unix_timestamp(ts)
    out = rows.select((series if series is not None else file).alias("series_id"), epoch.alias("epoch"), "open", "high", "low", "close", "volume", date_of(file).alias("dataset_date"))
    return out.where("epoch is not null and close is not null")


def read_quoted(spark: SparkSession, path: str, schema: str, *, mode: str = "DROPMALFORMED") -> DataFrame:
    """Quoted files, a doubled quote inside quotes; FAILFAST to stop at a malformed row, PERMISSIVE to fill short rows with nulls.  Empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("mode", mode).csv(path)


def read_strict(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """All columns as strings; raises if a required one is missing, and when read, at a row of another width."""
    header = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(required) - set(header))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return read_quoted(spark, path, ", ".join(f"`{c}` string" for c in header), mode="FAILFAST")


#: Splits of files whose offsets may be broadcast.
BROADCAST_SPLITS = 1_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, source_file, line) of every line of text files, counted from 1 within its file.

    A task counts on within each split that it reads; the lines of the splits before
    come from one count a split, so nothing is shuffled or sorted to number lines.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("begin"))

    def number(batches):
        at, n = None, 0
        for batch in batches:
            places = []
            for own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = n + 1 if own == at else 1
                at = own
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["value", "source_file", "begin", "place"])

    sizes = kept(raw.groupBy("source_file", "begin").agg(F.count(F.lit(1)).alias("n")))  # a row per split
    before = F.sum("n").over(Window.partitionBy("source_file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("source_file", "begin", F.coalesce(before, F.lit(0)).alias("before"))
    offsets = F.broadcast(offsets) if sizes.count() <= BROADCAST_SPLITS else offsets
    placed = raw.mapInArrow(number, "value string, source_file string, begin long, place long")
    return placed.join(offsets, ["source_file", "begin"]).select("value", "source_file", (F.col("before") + F.col("place")).alias("line"))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, with source_file and the line of each row; the first line of a file is its header, blank lines count but give no row.

    All files share one header.  A row is a line: quoted fields hold no line ends.
    """
    header = spark.read.option("header", True).csv(path).columns
    kind = ", ".join(f"`{c}` string" for c in header)
    rows = numbered_lines(spark, path).where((F.col("line") > 1) & (F.trim("value") != ""))
    fields = F.from_csv("value", kind, {"quote": '"', "escape": '"'})
    return rows.select(fields.alias("f"), "source_file", "line").select("f.*", "source_file", "line")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> str:
    """The columns, or all of them sorted by name, as quoted files with a header."""
    df.select(*(columns or sorted(df.columns))).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


def save_model(spark: SparkSession, model: dict, path: str) -> str:
    """A small model (numbers, strings, nested lists) as one JSON line."""
    plain = json.loads(json.dumps(model, default=lambda x: x.tolist()))
    spark.createDataFrame([(json.dumps(plain),)], T.StructType([T.StructField("value", T.StringType())])).coalesce(1).write.text(path)
    return path


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def append_after(first: DataFrame, later: DataFrame, *, series: str = "series_id", at: str = "epoch") -> DataFrame:
    """first, and of later what is after first's end in each series: snapshots that overlap do not count rows twice."""
    end = first.groupBy(series).agg(F.max(at).alias("_end"))
    fresh = later.join(end, series, "left").where(F.col("_end").isNull() | (F.col(at) > F.col("_end"))).drop("_end")
    return first.unionByName(fresh)
