"""Evaluation of curves: operating points, sweeps, ROC AUC, calibration, breakdowns, summaries.

A peaks table has (dialogue_id, label, peak); an alerts table (threshold, dialogue_id, label, alert_idx, action_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.operators import curves

GRID = (0.6, 0.7, 0.8, 0.9, 0.95)
ACCUMULATORS = [("raw", 1.0), ("ewma", 0.3), ("ewma", 0.5), ("ewma", 0.7), ("maxdecay", 0.7), ("maxdecay", 0.85), ("maxdecay", 0.95)]


def grid(spark: SparkSession, thresholds: tuple[float, ...] = GRID) -> DataFrame:
    return spark.createDataFrame([(t,) for t in thresholds], "threshold double")


def sweep(curve: DataFrame, thresholds: tuple[float, ...], score: str = "score", carry: tuple[str, ...] = ("label",)) -> DataFrame:
    """(threshold, dialogue_id, carry, alert_idx): each dialogue is grouped once, its first crossings found for all thresholds."""
    firsts = [F.struct(F.lit(t).alias("threshold"), F.coalesce(F.min(F.when(F.col(score) >= t, F.col("idx"))), F.lit(-1)).cast("int").alias("alert_idx")) for t in thresholds]
    rows = curve.groupBy("dialogue_id", *carry).agg(F.array(*firsts).alias("a"))
    return rows.select("dialogue_id", *carry, F.inline("a"))


def confusion(fired: Column, label: Column) -> list[Column]:
    return [F.count_if((label == y) & (fired if f else ~fired)).alias(name) for name, y, f in (("tp", 1, True), ("fp", 0, True), ("tn", 0, False), ("fn", 1, False))]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(counts: DataFrame, fpr_without_negatives: float | None = 0.0) -> DataFrame:
    """precision, recall, f1, fpr, rounded; f1 from unrounded ones.  Where there are no negatives, fpr is as told."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    fpr = F.when(fp + tn > 0, _ratio(fp, fp + tn)).otherwise(F.lit(fpr_without_negatives).cast("double"))
    return counts.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(_ratio(2 * p * r, p + r), 4).alias("f1"), F.round(fpr, 4).alias("fpr"))


def operating_points(alerts: DataFrame, by: tuple[str, ...] = ("threshold",)) -> DataFrame:
    """Counts and rates by threshold, with the medians of the alert turn and, where there is action_idx, of the lead."""
    fired = F.col("alert_idx") >= 0
    hit = fired & (F.col("label") == 1)
    more = [F.median(F.when(hit, F.col("alert_idx"))).alias("median_alert_turn")]
    if "action_idx" in alerts.columns:
        lead = F.when(hit & (F.col("action_idx") >= 0), F.col("action_idx") - F.col("alert_idx"))
        more += [F.median(lead).alias("median_lead_turns"), F.round(F.avg((lead > 0).cast("int")), 4).alias("share_before_action")]
    return rates(alerts.groupBy(*by).agg(*confusion(fired, F.col("label")), *more))


def best_by_f1(points: DataFrame) -> DataFrame:
    """The best f1; of equals the lowest threshold."""
    return points.orderBy(F.desc("f1"), "threshold").limit(1)


def early_share(alerts: DataFrame, by: tuple[str, ...] = ("threshold",)) -> DataFrame:
    """Of all positive dialogues with an action, fired or not, the share with an alert before it."""
    acted = (F.col("label") == 1) & (F.col("action_idx") >= 0)
    early = acted & (F.col("alert_idx") >= 0) & (F.col("alert_idx") < F.col("action_idx"))
    return alerts.groupBy(*by).agg(F.round(_ratio(F.count_if(early), F.count_if(acted)), 4).alias("early_share"), F.count_if(acted).alias("n_actioned"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "peak", by: tuple[str, ...] = ()) -> DataFrame:
    """Tie-correct area by rank sums; null with one class only.

    Scores are counted first, so the running count goes over distinct scores, not over rows.
    """
    counts = scored.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0)))
    total = counts.groupBy(*by).agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return total.select(*by, F.round(F.try_divide(F.col("u"), (F.col("n_pos") * F.col("n_neg")).cast("double")), 4).alias("auc"), "n_pos", "n_neg")


def peaks(curve: DataFrame, score: str = "score", carry: tuple[str, ...] = ("label",)) -> DataFrame:
    return curve.groupBy("dialogue_id", *carry).agg(F.coalesce(F.max(score), F.lit(0.0)).alias("peak"))


def threshold_for_fpr(peak: DataFrame, max_fpr: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The least threshold that max_fpr of the negatives at most reach: just above the (k+1)-th highest peak, 1 at most;
    0.5 without negatives, 0 if all may fire.  Ranks run over distinct peaks, not over rows."""
    negatives = peak.filter("label = 0").groupBy(*by, "peak").agg(F.count("*").alias("c"))
    down = Window.partitionBy(*by).orderBy(F.desc("peak"))
    total = Window.partitionBy(*by)
    ranked = negatives.withColumn("upto", F.sum("c").over(down)).withColumn("n", F.sum("c").over(total))
    found = ranked.filter(F.col("upto") >= F.floor(F.lit(max_fpr) * F.col("n")) + 1).groupBy(*by).agg((F.max("peak") + 1e-6).alias("at"))
    if by:
        out = peak.groupBy(*by).agg(F.count_if(F.col("label") == 0).alias("n")).join(found, list(by), "left")
    else:
        out = peak.agg(F.count_if(F.col("label") == 0).alias("n")).join(found, how="left")
    return out.select(*by, F.when(F.col("n") == 0, 0.5).otherwise(F.least(F.lit(1.0), F.coalesce("at", F.lit(0.0)))).alias("threshold"))


def calibrate(turns: DataFrame, max_fpr: float = 0.05, score: str = "p") -> DataFrame:
    """turns (dialogue_id, idx, label, action_idx, score) -> the accumulator and threshold with the largest share of alerts before
    the action, then the largest recall, at max_fpr; of equals the first in ACCUMULATORS.  One row."""
    rows = turns.groupBy("dialogue_id", "label", "action_idx").agg(F.array_sort(F.collect_list(F.struct("idx", F.col(score).alias("p")))).alias("t"))
    each = [F.struct(F.lit(i).alias("k"), F.lit(mode).alias("mode"), F.lit(a).alias("a"), curves.fold(F.col("t.p"), mode, a).alias("c")) for i, (mode, a) in enumerate(ACCUMULATORS)]
    keys = ("k", "mode", "a")
    # dialogues are gathered once; all accumulators are one projection of them
    per = rows.select("dialogue_id", "label", "action_idx", F.col("t.idx").alias("i"), F.inline(F.array(*each))).withColumn("peak", F.coalesce(F.array_max("c"), F.lit(0.0)))
    th = threshold_for_fpr(per, max_fpr, keys)
    reached = F.filter(F.arrays_zip("i", "c"), lambda x: x["c"] >= F.col("threshold"))
    alerts = per.join(F.broadcast(th), list(keys)).withColumn("alert_idx", F.coalesce(F.array_min(F.transform(reached, lambda x: x["i"])), F.lit(-1)))
    points = operating_points(alerts, (*keys, "threshold")).join(early_share(alerts, keys), list(keys))
    return points.orderBy(F.desc("early_share"), F.desc("recall"), "k").limit(1).select("mode", "a", F.round("threshold", 6).alias("threshold"), "early_share", "precision", "recall", "f1", "fpr")


def matched_threshold(peak: DataFrame, target: float, what: str) -> DataFrame:
    """The highest threshold with recall at or above the target (what = recall), or the lowest one, going down from the top,
    before the fpr exceeds it (what = fpr).  Candidates are the distinct peaks; counts are running sums over them."""
    counts = peak.groupBy(F.round("peak", 6).alias("threshold")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    down, total = Window.orderBy(F.desc("threshold")), Window.partitionBy()
    rows = counts.select("threshold", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(total).alias("ap"), F.sum("n").over(total).alias("an"))
    rows = rates(rows.select("threshold", "tp", "fp", (F.col("an") - F.col("fp")).alias("tn"), (F.col("ap") - F.col("tp")).alias("fn")), None)
    if what == "recall":
        return rows.filter(F.col("recall") >= target).orderBy(F.desc("threshold")).limit(1)
    return rows.filter(F.col("fpr") <= target).orderBy("threshold").limit(1)


def breakdown(alerts: DataFrame) -> DataFrame:
    """fired, n, share by topic, and by language and label: two independent groupings in one pass."""
    own = alerts.select("topic", "lang", "label", (F.col("alert_idx") >= 0).cast("int").alias("fired"))
    sets = own.groupingSets([["topic"], ["lang", "label"]], "topic", "lang", "label").agg(F.sum("fired").alias("fired"), F.count("*").alias("n"), F.grouping("topic").alias("g"))
    key = F.when(F.col("g") == 0, F.concat(F.lit("topic:"), F.col("topic"))).otherwise(F.concat(F.lit("lang:"), F.col("lang"), F.lit(":"), F.col("label").cast("string")))
    return sets.select(key.alias("key"), "fired", "n", F.round(F.col("fired") / F.col("n"), 3).alias("share"))


def seed_summary(runs: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Mean and sample deviation over runs without nulls; a single run has no deviation."""
    return runs.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.round(F.avg(value), 4).alias("mean"), F.round(F.when(F.count("*") > 1, F.stddev_samp(value)), 4).alias("sd"), F.count("*").alias("n_runs"))


def weighted_mean(rows: DataFrame, value: str, weight: str, by: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.greatest(F.lit(1), F.sum(weight)), 4).alias("weighted"))


def latency_summary(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Median, 90th percentile, linear between ranks, and maximum."""
    return rows.groupBy(*by).agg(F.round(F.median(value), 3).alias("median"), F.round(F.percentile(value, F.lit(0.9)), 3).alias("p90"), F.round(F.max(value), 3).alias("max"), F.count("*").alias("n"))
