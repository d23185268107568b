"""Bars, upserts and the online state filter as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.files import kept, shared_folder


def bars(ticks: DataFrame, *, series: str, ts: str, price: str, tie: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks by event time; ticks later than `late` behind the newest are dropped with their window's state."""
    at = F.struct(ts, tie)
    made = ticks.withWatermark(ts, late).groupBy(F.col(series).alias("series_id"), F.window(ts, size).alias("w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return made.select("series_id", F.unix_timestamp(F.col("w.start")).alias("epoch"), "open", "high", "low", "close", "volume")


def drain(stream: DataFrame, path: str, *, mode: str = "update") -> DataFrame:
    """Runs the stream over what is there now; every micro-batch is appended to Parquet at `path` with its number as `batch`.

    A batch that runs twice overwrites its own folder, so the table holds it once.
    """
    spark = stream.sparkSession

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(path)


#: Rows of a file that in_order() writes, about.
FILE_ROWS = 1_000_000


def in_order(df: DataFrame, by: str, parts: int) -> DataFrame:
    """df as a stream of `parts` micro-batches: written in ranges of `by`, one after the other, each in as many files as it needs and all of these read at a time."""
    spark, df = df.sparkSession, kept(df)
    low, high, rows = df.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
    path = shared_folder(spark)
    files = max(1, -(-rows // (parts * FILE_ROWS)))
    edges = [low + (high - low) * k / parts for k in range(1, parts)] if rows else []
    for a, b in zip([None, *edges], [*edges, None], strict=True):
        some = df if a is None else df.where(F.col(by) > a)
        some = some if b is None else some.where(F.col(by) <= b)
        (some.repartition(files) if files > 1 else some.coalesce(1)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key's last batch: updates replace what was told before."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")


def filtered_states(rows: DataFrame, model: dict) -> DataFrame:
    """(sequence, step, decoded) of a stream of (sequence, step, vector): the state filter, whose logs of probability are the state of each sequence.

    Rows of a sequence must arrive in order of step; within a micro-batch they are sorted.
    """
    states, n = model["states"], len(model["states"])
    kind = f"sequence {rows.schema['sequence'].dataType.simpleString()}, step {rows.schema['step'].dataType.simpleString()}, decoded string"

    def advance(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts)).sort_values("step")
        alpha = np.asarray(state.get[0]) if state.exists else None
        said = []
        for x in part["vector"]:
            d = -0.5 * (np.log(2 * np.pi * model["var"]) + (np.asarray(x) - model["mean"]) ** 2 / model["var"]).sum(axis=1)
            if alpha is None:
                alpha = model["initial"] + d
            else:
                step = alpha[:, None] + model["moves"]
                alpha = np.logaddexp.reduce(step, axis=0) + d
                alpha = alpha - np.logaddexp.reduce(alpha)
            said.append(states[int(alpha.argmax())])
        state.update((alpha.tolist(),))
        yield pd.DataFrame({"sequence": part["sequence"].to_numpy(), "step": part["step"].to_numpy(), "decoded": said})

    assert n == len(model["initial"])
    return rows.groupBy("sequence").applyInPandasWithState(advance, kind, "alpha array<double>", "append", GroupStateTimeout.NoTimeout)


def streamed_bars(spark: SparkSession, sf_dir: str, batches: int = 5) -> DataFrame:
    """Bars of the events in order of time, `batches` micro-batches of them; state goes as the watermark passes."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    made = bars(in_order(ticks, "ts", batches), series="event_type", ts="ts", price="value", tie="event_id")
    return latest(drain(made, shared_folder(spark)), ["series_id", "epoch"])
