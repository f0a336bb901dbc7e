"""Tables, and the shapes the operators work on: turns of dialogues and timed segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hearken.functions import text as tx

CHUNK, MAX_TURNS = 20, 40

TURN = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("stage", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("intent", T.StringType()),
    T.StructField("red_flags", T.ArrayType(T.StringType())), T.StructField("rule_risk", T.DoubleType()), T.StructField("template_id", T.StringType()),
    T.StructField("filler", T.BooleanType()), T.StructField("flag_bearing_benign", T.BooleanType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()),
])
DIALOGUE = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("dialogue_id", "label", "scenario_id", "scenario_code", "topic", "victim_profile", "language_profile", "lang", "difficulty", "source", "terminated_early_at", "split")),
    T.StructField("has_flag_bearing_turn", T.BooleanType()), T.StructField("action_turn_idx", T.IntegerType()), T.StructField("n_turns_orig", T.IntegerType()), T.StructField("truncated", T.BooleanType()),
    T.StructField("turns", T.ArrayType(TURN)),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_turns(spark: SparkSession, sf_dir: str, max_turns: int | None = None) -> DataFrame:
    """documents with labels as dialogues: a turn is a chunk of CHUNK words, toxic is the label.

    dialogue_id, idx, text, label, topic, lang, difficulty, n_turns (after truncation to max_turns, if given), n_turns_orig.
    """
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    turns = tx.chunk_words(F.col("text"), CHUNK)
    rows = both.select(F.col("doc_id").alias("dialogue_id"), F.col("toxic").alias("label"), F.col("source").alias("topic"), "lang", F.col("quality").alias("difficulty"), turns.alias("t"))
    rows = rows.select("*", F.size("t").alias("n_turns_orig"), (F.size("t") if max_turns is None else F.least(F.size("t"), F.lit(max_turns))).alias("n_turns"))
    return rows.select("dialogue_id", "label", "topic", "lang", "difficulty", "n_turns", "n_turns_orig", F.posexplode("t" if max_turns is None else F.slice("t", 1, max_turns)).alias("idx", "text"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as dialogues: dialogue_id, idx, speaker, text."""
    speaker = F.create_map(*[F.lit(x) for x in ("user", "caller", "assistant", "victim", "system", "agent")])
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("dialogue_id"), F.col("turn").cast("int").alias("idx"), F.coalesce(F.try_element_at(speaker, F.col("role")), F.lit("unknown")).alias("speaker"), "text")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time as it is written, in whatever zone the session is."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timed segments: call_id, speaker, start, end in seconds since the call's first event; the last has no end."""
    of_call = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", micros(F.col("ts")).alias("us"), "ts")
    rows = rows.withColumn("first", F.first("us").over(of_call)).withColumn("next", F.lead("us").over(of_call))
    seconds = lambda c: (F.col(c) - F.col("first")) / F.lit(1e6)
    return rows.select(F.col("user_id").alias("call_id"), "event_id", F.col("event_type").alias("speaker"), "value", seconds("us").alias("start"), seconds("next").alias("end"))
