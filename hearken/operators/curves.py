"""Risk curves over the ordered turns of a dialogue: folds, crossings, prefixes, jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = ("raw", "ewma", "maxdecay")


def fold(values: Column, mode: str, a: float) -> Column:
    """An array of scores folded in order: raw r = x; ewma r = a x + (1 - a) r', the first r = x; maxdecay r = max(x, a r')."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "raw":
        return values
    step = (lambda r, x: F.greatest(x, F.lit(a) * r)) if mode == "maxdecay" else (lambda r, x: F.lit(a) * x + F.lit(1 - a) * r)
    start = F.slice(values, 1, 1)
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) == 0, values).otherwise(F.aggregate(rest, start, lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x)))))


def accumulate(turns: DataFrame, mode: str, a: float = 1.0, score: str = "p", out: str = "r", carry: tuple[str, ...] = ()) -> DataFrame:
    """(dialogue_id, idx, score) -> with out, the folded score; one shuffle by dialogue, whose turns are few.

    carry: columns that are constant in a dialogue.
    """
    rows = turns.groupBy("dialogue_id", *carry).agg(F.array_sort(F.collect_list(F.struct("idx", F.col(score).alias("p")))).alias("t"))
    rows = rows.withColumn("c", fold(F.col("t.p"), mode, a))
    zipped = F.arrays_zip(F.col("t.idx").alias("idx"), F.col("t.p").alias(score), F.col("c").alias(out))
    return rows.select("dialogue_id", *carry, F.inline(zipped))


def rule_curve(turns: DataFrame, decay: float = 0.9, score: str = "risk", carry: tuple[str, ...] = ()) -> DataFrame:
    """Decaying maximum that carries unrounded values and shows rounded ones."""
    return accumulate(turns, "maxdecay", decay, score, "r", carry).withColumn("score", F.round("r", 4)).drop("r")


def first_alert(curve: DataFrame, threshold: Column | float, score: str = "score", by: tuple[str, ...] = ("dialogue_id",)) -> DataFrame:
    """alert_idx: the first turn that reaches the threshold, -1 if none does."""
    at = F.min(F.when(F.col(score) >= threshold, F.col("idx")))
    return curve.groupBy(*by).agg(F.coalesce(at, F.lit(-1)).cast("int").alias("alert_idx"))


def prefix_context(turns: DataFrame, budget: int) -> DataFrame:
    """What a model of bounded input sees at every turn: the turn, and before it as many whole older turns as fit.

    A turn costs its words and a separator.  The newest turn always counts, cut to the budget.  Turns older than the
    first that doesn't fit are left out; as sums only grow, that is a filter on the running sum, with no loop.
    """
    from hearken.functions.text import words

    of = Window.partitionBy("dialogue_id").orderBy("idx")
    own = turns.select("dialogue_id", "idx", (F.size(words(F.col("text"))) + 1).alias("cost")).withColumn("upto", F.sum("cost").over(of))
    newest = own.select("dialogue_id", F.col("idx").alias("t"), F.col("upto").alias("at"), F.col("cost").alias("own"))
    room = F.lit(budget) - F.least(F.col("own"), F.lit(budget))
    fits = (F.col("idx") <= F.col("t")) & ((F.col("idx") == F.col("t")) | (F.col("at") - F.col("own") - (F.col("upto") - F.col("cost")) <= room))
    return newest.join(own, "dialogue_id").filter(fits).groupBy("dialogue_id", F.col("t").alias("idx")).agg(F.min("idx").alias("from_idx"), F.count("*").alias("n_turns"), F.least(F.sum("cost"), F.lit(budget)).alias("n_words"))


def biggest_jump(curve: DataFrame, score: str = "score", least: float = 0.1) -> DataFrame:
    """The turn with the largest rise over the one before (over 0 for the first), if it is above `least`; the first of equals."""
    of = Window.partitionBy("dialogue_id").orderBy("idx")
    rises = curve.withColumn("rise", F.round(F.col(score) - F.coalesce(F.lag(score).over(of), F.lit(0.0)), 4))
    best = rises.groupBy("dialogue_id").agg(F.max(F.struct("rise", (-F.col("idx")).alias("n"))).alias("b"))
    return best.filter(F.col("b.rise") > least).select("dialogue_id", (-F.col("b.n")).alias("idx"), F.col("b.rise").alias("rise"))


def alert_position(curve: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """How far into the dialogue the first alert falls: (idx + 1) / turns."""
    at = F.min(F.when(F.col(score) >= threshold, F.col("idx")))
    rows = curve.groupBy("dialogue_id").agg(at.alias("alert_idx"), F.count("*").alias("n_turns"))
    return rows.filter("alert_idx is not null").select("dialogue_id", F.col("alert_idx").cast("int").alias("alert_idx"), F.round((F.col("alert_idx") + 1) / F.col("n_turns"), 4).alias("fraction"))


def alert_tier(curve: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """alert if any turn reaches the threshold, warn if the last is at 0.8 of it, else ok."""
    rows = curve.groupBy("dialogue_id").agg(F.max(score).alias("peak"), F.max_by(score, "idx").alias("last"))
    return rows.select("dialogue_id", F.when(F.col("peak") >= threshold, "alert").when(F.col("last") >= 0.8 * threshold, "warn").otherwise("ok").alias("tier"))


def merge_segments(segments: DataFrame, cap: float) -> DataFrame:
    """Consecutive segments of a speaker as one, as long as it spans `cap` seconds at most: the cap is measured from the start
    of the merged one, so this is a fold over the ordered segments of a call."""
    one = F.struct("start", "event_id", "end", "speaker")
    rows = segments.groupBy("call_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    kind = "array<struct<speaker:string,start:double,end:double,n:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(x["speaker"].alias("speaker"), x["start"].alias("start"), x["end"].alias("end"), F.lit(1).alias("n"))
        grown = F.struct(last["speaker"].alias("speaker"), last["start"].alias("start"), x["end"].alias("end"), (last["n"] + 1).alias("n"))
        joins = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["speaker"] == x["speaker"]) & (x["end"] - F.get(acc, F.size(acc) - 1)["start"] <= cap)
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(new))).cast(kind)

    merged = F.aggregate("s", F.array().cast(kind), step)
    return rows.select("call_id", F.posexplode(merged).alias("idx", "m")).select("call_id", "idx", "m.speaker", "m.start", "m.end", "m.n")
