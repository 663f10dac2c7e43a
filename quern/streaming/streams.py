"""Structured Streaming: a replayable batch stream, ledgers, a stateful detector, event-time windows and deduplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, event time as a timestamp."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def ema_alarms(stream: DataFrame, alpha: float = 0.97, z: float = 2.5, warmup: int = 100) -> DataFrame:
    """The conditional EMA detector with its state (count, mean, variance) per type kept between triggers. Rows of one
    trigger are taken by ts and event_id; alarms don't change the state."""

    def step(key, frames, state: GroupState):
        n, mean, var = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        found = []
        for event, x in zip(rows["event_id"].tolist(), rows["value"].tolist()):
            if n == 0:
                mean = x
            else:
                gap = x - mean
                if n >= warmup and gap > z * max(var, 1e-12) ** 0.5:
                    found.append((key[0], event, x))
                else:
                    mean, var = alpha * mean + (1 - alpha) * x, alpha * var + (1 - alpha) * gap * gap
            n += 1
        state.update((n, mean, var))
        yield pd.DataFrame(found, columns=["event_type", "event_id", "value"])

    return stream.groupBy("event_type").applyInPandasWithState(
        step, "event_type string, event_id long, value double", "n long, mean double, var double", "append", GroupStateTimeout.NoTimeout
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All there is now, then stop; a second call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_idempotent(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Each batch replaces its own folder, so a batch that runs again after a failure leaves one copy."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drop_after(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """What a resume from `batch` keeps."""
    return spark.read.parquet(path).where(F.col("batch") < batch)
