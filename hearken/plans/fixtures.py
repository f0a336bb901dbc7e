"""The shapes that queries share, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions import rules
from hearken.functions import text as tx
from hearken.operators import curves, evaluate
from hearken.sources.tables import MAX_TURNS, conversation_turns, labelled_turns

CATALOG = rules.TABLES
THRESHOLDS = (0.6, 0.7, 0.8, 0.9)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled turns with flags and risk."""
    turns = labelled_turns(spark, sf_dir).withColumn("flags", rules.detect(F.col("text"), CATALOG))
    return turns.withColumn("risk", rules.risk(F.col("flags"), CATALOG)).drop("text")


def flagged_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_turns(spark, sf_dir).withColumn("flags", rules.detect(F.col("text"), CATALOG))
    return turns.withColumn("risk", rules.risk(F.col("flags"), CATALOG))


def scored(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ("label", "topic", "lang")) -> DataFrame:
    """The rule curve of every labelled dialogue: dialogue_id, carry, idx, risk, score."""
    return curves.rule_curve(flagged(spark, sf_dir), 0.9, "risk", carry)


def with_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule curve with action_idx, the first turn that has the flag `legal`, -1 if none has."""
    turns = flagged(spark, sf_dir)
    act = turns.groupBy("dialogue_id").agg(F.coalesce(F.min(F.when(F.array_contains("flags", "legal"), F.col("idx"))), F.lit(-1)).cast("int").alias("action_idx"))
    return curves.rule_curve(turns.join(act, "dialogue_id"), 0.9, "risk", ("label", "topic", "lang", "action_idx"))


def alerts(spark: SparkSession, sf_dir: str, thresholds: tuple[float, ...] = THRESHOLDS, carry: tuple[str, ...] = ("label", "topic", "lang", "action_idx")) -> DataFrame:
    return evaluate.sweep(with_action(spark, sf_dir), thresholds, "score", carry)


def dialogues(spark: SparkSession, sf_dir: str, max_turns: int | None = None) -> DataFrame:
    """One row a dialogue: dialogue_id, label, topic, lang, difficulty, n_turns, n_turns_orig."""
    return labelled_turns(spark, sf_dir, max_turns).filter("idx = 0").drop("idx", "text")


def split_of(key: Column) -> Column:
    """train, val or test by hash: 70, 15 and 15 of a hundred."""
    u = tx.uniform(key, F.lit(42))
    return F.when(u < 0.7, "train").when(u < 0.85, "val").otherwise("test")


def sql_round(x: str, digits: int = 4) -> str:
    """Rounding of a double by its shortest decimal form, halves up, as Spark does."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"


# The same as common table expressions.
_SQUEEZED = r"trim(regexp_replace(d.text, '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_TURNS = """
w AS (SELECT d.doc_id, d.source, d.lang, l.toxic, l.quality, string_split({squeezed}, ' ') AS ws
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE {squeezed} <> ''),
turns AS (SELECT doc_id AS dialogue_id, toxic AS label, source AS topic, lang, quality AS difficulty,
                 CAST({kept} AS INTEGER) AS n_turns, CAST(ceil(len(ws) / 20.0) AS INTEGER) AS n_turns_orig,
                 CAST(i AS INTEGER) AS idx, array_to_string(ws[20 * i + 1 : 20 * i + 20], ' ') AS text
          FROM (SELECT *, unnest(range(0, CAST({kept} AS BIGINT))) AS i FROM w))"""
SQL_TURNS = _TURNS.format(squeezed=_SQUEEZED, kept="ceil(len(ws) / 20.0)")
SQL_FIRST_TURNS = _TURNS.format(squeezed=_SQUEEZED, kept=f"least({MAX_TURNS}, ceil(len(ws) / 20.0))")
SQL_CONVERSATIONS = """
turns AS (SELECT conv_id AS dialogue_id, CAST(turn AS INTEGER) AS idx, text,
                 CASE role WHEN 'user' THEN 'caller' WHEN 'assistant' THEN 'victim' WHEN 'system' THEN 'agent' ELSE 'unknown' END AS speaker
          FROM conversations)"""


def _found(patterns: list[str]) -> str:
    return f"regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in patterns)}')"


SQL_FLAGS = (
    "flagged AS MATERIALIZED (SELECT * EXCLUDE (text), [x FOR x IN ["
    + ", ".join(f"CASE WHEN {_found(p)} THEN '{f}' END" for f, p, _, _ in CATALOG)
    + "] IF x IS NOT NULL] AS flags, "
    + sql_round("1 - " + " * ".join(f"CASE WHEN {_found(p)} THEN CAST({1 - w!r} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END" for _, p, w, _ in CATALOG))
    + " AS risk FROM turns)"
)
SQL_SCORED = f"""
fold AS (SELECT dialogue_id, idx, risk AS r FROM flagged WHERE idx = 0
         UNION ALL SELECT t.dialogue_id, t.idx, greatest(t.risk, CAST(0.9 AS DOUBLE) * c.r) FROM fold c JOIN flagged t ON t.dialogue_id = c.dialogue_id AND t.idx = c.idx + 1),
scored AS MATERIALIZED (SELECT t.*, {sql_round('f.r')} AS score FROM flagged t JOIN fold f ON f.dialogue_id = t.dialogue_id AND f.idx = t.idx)"""
SQL_ACTION = """
acts AS (SELECT dialogue_id, CAST(coalesce(min(CASE WHEN list_contains(flags, 'legal') THEN idx END), -1) AS INTEGER) AS action_idx FROM flagged GROUP BY 1),
grid AS (SELECT unnest([CAST(0.6 AS DOUBLE), 0.7, 0.8, 0.9]) AS threshold),
alerts AS (SELECT threshold, s.dialogue_id, any_value(label) AS label, any_value(topic) AS topic, any_value(lang) AS lang, any_value(action_idx) AS action_idx,
                  CAST(coalesce(min(CASE WHEN score >= threshold THEN idx END), -1) AS INTEGER) AS alert_idx
           FROM scored s JOIN acts a ON s.dialogue_id = a.dialogue_id CROSS JOIN grid GROUP BY 1, 2)"""
SQL_PEAKS = "peaks AS (SELECT dialogue_id, any_value(label) AS label, max(score) AS peak FROM scored GROUP BY 1)"
SQL_DIALOGUES = "dialogues AS (SELECT dialogue_id, label, topic, lang, difficulty, n_turns, n_turns_orig FROM turns WHERE idx = 0)"
ALL = f"WITH RECURSIVE {SQL_TURNS}, {SQL_FLAGS}, {SQL_SCORED}, {SQL_ACTION}, {SQL_PEAKS}, {SQL_DIALOGUES}"
TURNS = f"WITH {SQL_TURNS}, {SQL_DIALOGUES}"
FIRST_TURNS = f"WITH {SQL_FIRST_TURNS}, {SQL_DIALOGUES}"
FLAGGED = f"WITH {SQL_TURNS}, {SQL_FLAGS}, {SQL_DIALOGUES}"
CONV = f"WITH RECURSIVE {SQL_CONVERSATIONS}"


def sql_uniform(*keys: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def sql_split(key: str) -> str:
    u = sql_uniform(key, "'42'")
    return f"CASE WHEN {u} < CAST(0.7 AS DOUBLE) THEN 'train' WHEN {u} < CAST(0.85 AS DOUBLE) THEN 'val' ELSE 'test' END"
