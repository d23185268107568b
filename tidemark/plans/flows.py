"""Queries that go through files and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import models
from tidemark.plans.market import BARS, bars_of
from tidemark.plans.market import ORACLE_SQL as SQL
from tidemark.sources import files
from tidemark.streaming import lifecycle, streams

_OHLCV = "series_id, epoch, open, high, low, close, volume"


def candle_files(spark, sf_dir):
    """Bars written as candle files, a folder per series, and scanned again."""
    time = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ss'-05:00'").alias("time")
    path = files.shared_folder(spark)
    b = bars_of(spark, sf_dir).select("series_id", time, "open", "high", "low", "close", "volume")
    b.repartition("series_id").write.partitionBy("series_id").option("header", True).csv(path)
    series = F.regexp_extract("_metadata.file_path", "series_id=([^/]+)/", 1)
    return files.read_candles(spark, f"{path}/*/*.csv", series=series).drop("dataset_date")


def hmm_stream(spark, sf_dir):
    """The state filter over a stream of events in several micro-batches, under a model fitted on the table."""
    shape = lambda e: e.select(F.col("user_id").alias("sequence"), F.col("event_id").alias("step"), F.col("event_type").alias("state"), F.array(F.ln(F.col("value") + 1)).alias("vector"))
    rows = shape(spark.read.parquet(f"{sf_dir}/events.parquet"))
    model = models.hmm_fit(rows)
    told = streams.filtered_states(streams.in_order(rows.drop("state"), "step", 4), model)
    return streams.drain(told, files.shared_folder(spark), mode="append").drop("batch")


def liquidity_stream(spark, sf_dir):
    """The levels of hourly bars as a stream of micro-batches."""
    bars = files.kept(bars_of(spark, sf_dir).select("series_id", "bar_idx", "high", "low", "close"))
    before = spark.conf.get(lifecycle.PROVIDER, None)
    spark.conf.set(lifecycle.PROVIDER, lifecycle.ROCKS)
    try:
        changes = lifecycle.liquidity_changes(streams.in_order(bars, "bar_idx", 4))
        told = streams.drain(changes, files.shared_folder(spark), mode="append")
    finally:
        spark.conf.unset(lifecycle.PROVIDER) if before is None else spark.conf.set(lifecycle.PROVIDER, before)
    return lifecycle.last_change(told)


QUERIES = {"candle_files": candle_files, "stream_bars": streams.streamed_bars, "stream_hmm_filter": hmm_stream, "stream_liquidity": liquidity_stream}
ORACLE_SQL = {name: f"WITH {BARS} SELECT {_OHLCV} FROM bars" for name in ("candle_files", "stream_bars")} | {"stream_liquidity": SQL["liquidity_lifecycle"]}
