"""Synthetic dialogues from a taxonomy, by hashes instead of a random stream: the same seed gives the same corpus anywhere.

A taxonomy has: topics (topic, label, scenario), stages (scenario, pos, stage), pools (scenario, stage, speaker, lang, line),
slots (slot, value), profiles (profile, weight, resistance), languages (language, weight).  All are small dimensions; the
corpus grows with n only.  Scenario '*' in pools is for all: fillers, closings, replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.functions import rules
from hearken.functions import text as tx

#: How often things happen; fixed values.
P_S1, P_VICTIM, P_FILLER, P_CLOSE, P_INJECT, P_KAZAKH, SCAM_SHARE = 0.7, 0.85, 0.12, 0.7, 0.55, 0.45, 0.5
ACTION, CLOSING = "S5", "closing"
#: Stages in which two caller turns are likelier, one in three instead of one in four.
BUSY = ("S2", "S3", "S5")


def _draw(seed: int, *keys: object) -> Column:
    return tx.uniform(F.lit(seed), *[k if isinstance(k, Column) else F.lit(k) for k in keys])


def _weighted(table: DataFrame, item: str) -> DataFrame:
    """One row: steps, the cumulated weights with their items in order."""
    upto = F.sum("weight").over(Window.orderBy(item).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table.withColumn("upto", upto).agg(F.array_sort(F.collect_list(F.struct("upto", *table.columns))).alias(f"{item}_steps"))


def _pick(steps: str, draw: Column) -> Column:
    last = F.element_at(steps, -1)
    return F.coalesce(F.get(F.filter(steps, lambda x: x["upto"] >= draw * last["upto"]), 0), last)


def dialogues(spark: SparkSession, n: int, taxonomy: dict[str, DataFrame], seed: int = 42) -> DataFrame:
    """One row a dialogue: id, label, topic, scenario, profile, language, slots, and the stages it goes through."""
    rows = spark.range(n).select(F.col("id").alias("n"), F.when(F.col("id") < int(n * SCAM_SHARE), "scam").otherwise("benign").alias("label"))
    topics = taxonomy["topics"].groupBy("label", "topic").agg(F.array_sort(F.collect_set("scenario")).alias("scenarios"))
    topics = topics.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("topic", "scenarios"))).alias("topics"))
    rows = rows.join(F.broadcast(topics), "label")
    for t, item in (("profiles", "profile"), ("languages", "language")):
        rows = rows.crossJoin(F.broadcast(_weighted(taxonomy[t], item)))
    one = lambda a, u: F.get(a, F.floor(u * F.size(a)).cast("int"))
    rows = rows.withColumn("t", one(F.col("topics"), _draw(seed, "topic", F.col("n"))))
    rows = rows.withColumn("scenario", one(F.col("t.scenarios"), _draw(seed, "scenario", F.col("n"))))
    rows = rows.withColumn("p", _pick("profile_steps", _draw(seed, "profile", F.col("n")))).withColumn("language", _pick("language_steps", _draw(seed, "language", F.col("n")))["language"])
    slots = taxonomy["slots"].groupBy("slot").agg(F.array_sort(F.collect_set("value")).alias("values")).agg(F.array_sort(F.collect_list(F.struct("slot", "values"))).alias("all_slots"))
    rows = rows.crossJoin(F.broadcast(slots))
    values = F.map_from_entries(F.transform("all_slots", lambda s: F.struct(s["slot"], one(s["values"], _draw(seed, "slot", F.col("n"), s["slot"])))))
    stages = taxonomy["stages"].groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("pos", "stage")))["stage"].alias("stages"))
    rows = rows.join(F.broadcast(stages), "scenario")
    kept = F.filter("stages", lambda s: (s != "S1") | (_draw(seed, "s1", F.col("n")) < P_S1))
    # a resisting victim hangs up before the action: the stages from a random one of those before it on are left out
    action = F.array_position(kept, F.lit(ACTION)).cast("int")
    ends = (F.col("label") == "scam") & (action > 2) & (_draw(seed, "ends", F.col("n")) < F.col("p.resistance"))
    length = F.lit(2) + F.floor(_draw(seed, "cut", F.col("n")) * (action - 2)).cast("int")
    rows = rows.withColumn("ended", F.coalesce(ends, F.lit(False))).withColumn("kept", F.when(F.col("ended"), F.slice(kept, 1, length)).otherwise(kept))
    closes = ~F.col("ended") & (_draw(seed, "close", F.col("n")) < P_CLOSE)
    return rows.select(
        "n", F.format_string("DLG-%06d", F.col("n")).alias("dialogue_id"), "label", F.col("t.topic").alias("topic"), "scenario", F.col("p.profile").alias("victim_profile"),
        F.col("language").alias("language_profile"), values.alias("slots"), F.when(F.col("ended"), F.element_at("kept", -1)).alias("terminated_early_at"),
        F.when(closes, F.concat("kept", F.array(F.lit(CLOSING)))).otherwise(F.col("kept")).alias("stages"),
    )


def turns(of: DataFrame, taxonomy: dict[str, DataFrame], catalog: rules.Catalog, seed: int = 42) -> DataFrame:
    """The turns of dialogues: stage by stage one or two caller lines, replies, fillers, at most one injected line that carries a
    flag in a benign dialogue; no line twice in a stage; then flags, risk and the template's hash."""
    staged = of.select("*", F.posexplode("stages").alias("stage_pos", "stage"))
    key = [F.col("n"), F.col("stage")]
    second = _draw(seed, "second", *key) < F.when(F.col("stage").isin(*BUSY), 1 / 3).otherwise(0.25)
    inject = (F.col("label") == "benign") & (F.col("stage_pos") == 1) & (_draw(seed, "inject", F.col("n")) < P_INJECT)
    turn = lambda order, speaker, kind, k, gate: F.when(gate, F.struct(F.lit(order).alias("o"), F.lit(speaker).alias("speaker"), F.lit(kind).alias("kind"), F.lit(k).alias("k")))
    wanted = F.array_compact(F.array(
        turn(0, "caller", "line", 0, F.lit(True)),
        turn(1, "victim", "line", 0, _draw(seed, "victim0", *key) < P_VICTIM),
        turn(2, "caller", "filler", 0, _draw(seed, "filler", *key) < P_FILLER),
        turn(3, "caller", "line", 1, second & (F.col("stage") != CLOSING)),
        turn(4, "victim", "line", 1, second & (F.col("stage") != CLOSING) & (_draw(seed, "victim1", *key) < P_VICTIM)),
        turn(5, "caller", "flag_bearing", 0, inject),
    ))
    staged = staged.select("*", F.explode(wanted).alias("w"))
    switched = _draw(seed, "lang", *key, F.col("w.o")) < P_KAZAKH
    lang = F.when(F.col("language_profile") == "kk-ru", F.when(switched, "kk").otherwise("ru")).otherwise(F.col("language_profile"))
    staged = staged.withColumn("lang", lang).withColumn("pool_stage", F.when(F.col("w.kind") == "line", F.col("stage")).otherwise(F.col("w.kind")))
    pools = taxonomy["pools"].groupBy("scenario", "stage", "speaker", "lang").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    named = lambda name: F.broadcast(pools.select(F.col("scenario").alias("ps"), F.col("stage").alias("pool_stage"), F.col("speaker").alias("psp"), F.col("lang").alias("pl"), F.col("lines").alias(name)))
    for name, scenario, language in (("own", F.col("scenario"), F.col("lang")), ("common", F.lit("*"), F.col("lang")), ("fallback", F.lit("*"), F.lit("ru"))):
        p = named(name)
        staged = staged.join(p, (p["ps"] == scenario) & (p["pool_stage"] == staged["pool_stage"]) & (p["psp"] == staged["w.speaker"]) & (p["pl"] == language), "left").drop(p["ps"], p["pool_stage"], p["psp"], p["pl"])
    lines = F.coalesce("own", "common", "fallback")
    order = F.array_sort(F.transform(lines, lambda x: F.struct(_draw(seed, "line", *key, F.col("w.speaker"), F.col("w.kind"), x).alias("u"), x.alias("x"))))
    template = F.get(order, F.col("w.k") % F.size(lines))["x"]
    rows = staged.withColumn("template", template).filter(F.col("template").isNotNull())
    by = Window.partitionBy("n").orderBy("stage_pos", "w.o")
    rows = rows.withColumn("idx", F.row_number().over(by) - 1).withColumn("text", tx.fill(F.col("template"), F.col("slots")))
    rows = rows.withColumn("red_flags", rules.detect(F.col("text"), catalog))
    return rows.select(
        "n", "dialogue_id", "label", "topic", "scenario", "idx", F.col("w.speaker").alias("speaker"), "text", "stage", "lang", "red_flags", rules.risk(F.col("red_flags"), catalog).alias("rule_risk"),
        tx.short_hash(F.col("template"), 10).alias("template_id"), (F.col("w.kind") == "filler").alias("filler"), (F.col("w.kind") == "flag_bearing").alias("flag_bearing_benign"), "terminated_early_at",
    )


def corpus(rows: DataFrame) -> DataFrame:
    """Turns as nested dialogues with action_turn_idx, the first caller turn of the action's stage, -1 if there is none."""
    acts = F.min(F.when((F.col("stage") == ACTION) & (F.col("speaker") == "caller") & ~F.col("filler"), F.col("idx")))
    one = F.struct("idx", "speaker", "text", "stage", "lang", "red_flags", "rule_risk", "template_id", "filler", "flag_bearing_benign")
    keys = ["dialogue_id", "label", "topic", "scenario", "terminated_early_at"]
    return rows.groupBy(*keys).agg(F.coalesce(F.when(F.col("label") == "scam", acts), F.lit(-1)).alias("action_turn_idx"), F.max("flag_bearing_benign").alias("has_flag_bearing_turn"), F.array_sort(F.collect_list(one)).alias("turns"))
