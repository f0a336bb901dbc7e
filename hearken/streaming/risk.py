"""Running risk of conversations as a stream, its latency, and replay of tables as streams."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningRisk(StatefulProcessor):
    """Turn rows (dialogue_id, idx, risk) -> the decaying maximum after each: state is one number and the turn count, whatever
    the dialogue's length."""

    def __init__(self, decay: float):
        self.decay = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("risk", "r double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = pd.concat(list(rows)).sort_values("idx")
        r, n = self.state.get() if self.state.exists() else (0.0, 0)
        shown = []
        for x in parts["risk"]:
            r = max(x, r * self.decay)
            shown.append(float(Decimal(repr(float(r))).quantize(Decimal("0.0001"), ROUND_HALF_UP)))  # as Spark rounds
        self.state.update((r, n + len(parts)))
        yield pd.DataFrame({"dialogue_id": [key[0]] * len(parts), "idx": parts["idx"].to_numpy(), "turn": range(n, n + len(parts)), "score": shown})

    def close(self) -> None:
        pass


def running_risk(turns: DataFrame, decay: float = 0.9) -> DataFrame:
    """A stream of scored turns -> a stream of running risk.  Turns of a micro-batch are put in their order."""
    kind = turns.schema["dialogue_id"].dataType.simpleString()
    schema = f"dialogue_id {kind}, idx int, turn long, score double"
    return turns.select("dialogue_id", "idx", "risk").groupBy("dialogue_id").transformWithStateInPandas(RunningRisk(decay), schema, "Append", "None")


def replay(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as a stream, so many a batch: how recorded input is replayed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all input there is into Parquet files, with a checkpoint; returns what the files hold.  Run again, it goes on."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def latency(turns: DataFrame) -> DataFrame:
    """Wait, queue, recognition and scoring seconds of a turn summed from the end of speech."""
    return turns.withColumn("latency_s", F.round(F.col("endpoint_wait_s") + F.col("queue_s") + F.col("asr_s") + F.col("score_s"), 3))


def windowed_alerts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window of event time; late ones count within the watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def gap_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after a gap."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
