"""Queries of streams: input is replayed from files, results are those of the same batch."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.plans import fixtures as fx
from hearken.plans.registry import query
from hearken.sources.tables import table
from hearken.streaming import risk, session

_LOCAL: list[str] = []


def _folder(s: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; in local mode, where the setting may be absent, in one of this process."""
    top = s.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not s.sparkContext.master.startswith("local") or s.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="hearken-"))
        top = _LOCAL[0]
    return os.path.join(top, f"stream-{uuid.uuid4().hex}")


def _replayed(s: SparkSession, rows: DataFrame, folder: str, files: int) -> DataFrame:
    rows.repartition(files).write.parquet(f"{folder}/in")
    return risk.replay(s, f"{folder}/in", rows.schema, 2)


def _by_key(s: SparkSession, rows: DataFrame, key: str, folder: str) -> DataFrame:
    """rows replayed with all of a key in one file and so in one micro-batch, in which the state puts them in their order."""
    rows.repartition(key).write.option("maxRecordsPerFile", 0).parquet(f"{folder}/in")
    return risk.replay(s, f"{folder}/in", rows.schema, 64)

@query(f"{fx.CONV}, {fx.SQL_FLAGS}, {fx.SQL_SCORED} SELECT dialogue_id, idx, score FROM scored")
def stream_risk(s: SparkSession, d: str) -> DataFrame:
    s.conf.set("spark.sql.streaming.stateStore.providerClass", risk.ROCKS)
    folder = _folder(s)
    turns = fx.flagged_conversations(s, d).select("dialogue_id", "idx", "risk")
    out = risk.running_risk(_by_key(s, turns, "dialogue_id", folder), 0.9)
    return risk.run_to(out, f"{folder}/out", f"{folder}/state").select("dialogue_id", "idx", "score")


_WINDOWS = "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query(_WINDOWS)
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    events = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    stream = risk.windowed_alerts(_replayed(s, events, folder, 4), "4000 days", "1 day")
    name = "w" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '1 day' THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def gap_sessions(s: SparkSession, d: str) -> DataFrame:
    events = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    rows = events.groupBy(F.session_window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def _frames(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("user_id", "event_id", (F.col("value") / 200).alias("p"))


_LIMITS = session.Limits(silence=3, short=2, long=12)


_VAD = """WITH RECURSIVE f AS (SELECT user_id, value / 200 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS f FROM events),
n AS (SELECT user_id, max(f) AS top FROM f GROUP BY 1),
m AS (SELECT user_id, CAST(-1 AS BIGINT) AS f, FALSE AS speaking, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS last, 0 AS quiet, CAST(-1 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b FROM n
UNION ALL SELECT y.user_id, y.f,
  CASE WHEN NOT y.speaking THEN y.opens ELSE NOT y.ends END,
  CASE WHEN NOT y.speaking THEN CASE WHEN y.opens THEN y.f ELSE y.start END WHEN y.ends THEN y.start WHEN y.cuts THEN y.f + 1 ELSE y.start END,
  CASE WHEN NOT y.speaking THEN CASE WHEN y.opens THEN y.f + 1 ELSE y.last END WHEN y.ends THEN y.last2 WHEN y.cuts THEN y.f + 1 ELSE y.last2 END,
  CASE WHEN NOT y.speaking OR (y.cuts AND NOT y.ends) THEN 0 ELSE y.quiet2 END,
  CASE WHEN y.speaking AND y.ends AND y.last2 - y.start >= 2 THEN y.start WHEN y.speaking AND NOT y.ends AND y.cuts AND y.f + 1 - y.start >= 2 THEN y.start ELSE -1 END,
  CASE WHEN y.speaking AND y.ends THEN y.last2 ELSE y.f + 1 END
 FROM (SELECT x.*, x.quiet2 >= 3 AS ends, x.f + 1 - x.start >= 12 AS cuts FROM (
   SELECT f.user_id, f.f, m.speaking, m.start, m.last, f.p >= 0.5 AS opens, CASE WHEN f.p >= CAST(0.35 AS DOUBLE) THEN f.f + 1 ELSE m.last END AS last2, CASE WHEN f.p >= CAST(0.35 AS DOUBLE) THEN 0 ELSE m.quiet + 1 END AS quiet2
   FROM m JOIN f ON f.user_id = m.user_id AND f.f = m.f + 1) x) y)
SELECT user_id, a AS start_frame, b AS end_frame FROM m WHERE a >= 0
UNION ALL SELECT m.user_id, m.start, m.last FROM m JOIN n ON m.user_id = n.user_id AND m.f = n.top WHERE speaking AND m.last - m.start >= 2"""


@query(_VAD)
def vad_segments(s: SparkSession, d: str) -> DataFrame:
    return session.segment(_frames(s, d), "user_id", "event_id", "p", _LIMITS).select("user_id", "start_frame", "end_frame")


@query(_VAD)
def stream_segments(s: SparkSession, d: str) -> DataFrame:
    s.conf.set("spark.sql.streaming.stateStore.providerClass", risk.ROCKS)
    folder = _folder(s)
    rows = _frames(s, d).withColumn("done", F.lit(False))
    last = rows.groupBy("user_id").agg((F.max("event_id") + 1).alias("event_id")).withColumn("p", F.lit(0.0)).withColumn("done", F.lit(True))
    both = rows.unionByName(last)
    out = session.segment_stream(_by_key(s, both, "user_id", folder), "user_id", "event_id", "p", _LIMITS)
    return risk.run_to(out, f"{folder}/out", f"{folder}/state").select("user_id", "start_frame", "end_frame")
