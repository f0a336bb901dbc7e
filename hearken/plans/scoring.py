"""Queries of the rule engine, curves and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions import rules
from hearken.functions import text as tx
from hearken.operators import curves, evaluate
from hearken.plans import fixtures as fx
from hearken.plans.registry import query
from hearken.sources.tables import conversation_turns, labelled_turns, segments, table

_RATES = """count(*) FILTER (label = 1 AND alert_idx >= 0) AS tp, count(*) FILTER (label = 0 AND alert_idx >= 0) AS fp,
count(*) FILTER (label = 0 AND alert_idx < 0) AS tn, count(*) FILTER (label = 1 AND alert_idx < 0) AS fn"""
_OP = """op AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(fp / nullif(fp + tn, 0), 0) AS f FROM c)"""
_SHOWN = "round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round(f, 4) AS fpr"


@query(f"{fx.TURNS} SELECT dialogue_id, idx, text, label, topic, lang, difficulty, n_turns, n_turns_orig FROM turns")
def scan_turns(s: SparkSession, d: str) -> DataFrame:
    return labelled_turns(s, d)


@query(f"{fx.CONV} SELECT * FROM turns")
def scan_conversations(s: SparkSession, d: str) -> DataFrame:
    return conversation_turns(s, d)


@query(f"{fx.FLAGGED} SELECT dialogue_id, idx, array_to_string(flags, ',') AS flags FROM flagged WHERE len(flags) > 0")
def detect_flags(s: SparkSession, d: str) -> DataFrame:
    return fx.flagged(s, d).filter(F.size("flags") > 0).select("dialogue_id", "idx", F.array_join("flags", ",").alias("flags"))


@query(f"{fx.FLAGGED} SELECT dialogue_id, idx, risk FROM flagged")
def noisy_or_risk(s: SparkSession, d: str) -> DataFrame:
    return fx.flagged(s, d).select("dialogue_id", "idx", "risk")


_TEXTS = ", ".join(f"('{f}', '{e}')" for f, _, _, e in fx.CATALOG)


@query(f"{fx.FLAGGED}, x AS (SELECT dialogue_id, idx, unnest(flags) AS flag FROM flagged), t(flag, e) AS (VALUES {_TEXTS}) SELECT x.dialogue_id, x.idx, x.flag, coalesce(t.e, x.flag) AS explanation FROM x LEFT JOIN t ON x.flag = t.flag")
def explain_flags(s: SparkSession, d: str) -> DataFrame:
    rows = fx.flagged(s, d).withColumn("e", rules.explain(F.col("flags"), fx.CATALOG))
    return rows.select("dialogue_id", "idx", F.inline(F.arrays_zip(F.col("flags").alias("flag"), F.col("e").alias("explanation"))))


@query(f"{fx.ALL} SELECT dialogue_id, idx, score FROM scored")
def rule_curve(s: SparkSession, d: str) -> DataFrame:
    return fx.scored(s, d, ()).select("dialogue_id", "idx", "score")


@query(f"{fx.ALL} SELECT dialogue_id, alert_idx FROM alerts WHERE threshold = CAST(0.8 AS DOUBLE)")
def first_alert(s: SparkSession, d: str) -> DataFrame:
    return curves.first_alert(fx.scored(s, d, ()), 0.8)


@query(f"{fx.ALL} SELECT {_RATES} FROM alerts WHERE threshold = CAST(0.8 AS DOUBLE)")
def confusion(s: SparkSession, d: str) -> DataFrame:
    rows = fx.alerts(s, d, (0.8,))
    return rows.agg(*evaluate.confusion(F.col("alert_idx") >= 0, F.col("label")))


@query(f"{fx.ALL}, c AS (SELECT {_RATES} FROM alerts WHERE threshold = CAST(0.7 AS DOUBLE)), {_OP} SELECT tp, fp, tn, fn, {_SHOWN} FROM op")
def operating_point(s: SparkSession, d: str) -> DataFrame:
    rows = fx.alerts(s, d, (0.7,))
    return evaluate.rates(rows.agg(*evaluate.confusion(F.col("alert_idx") >= 0, F.col("label"))))


_SWEEP = f"c AS (SELECT threshold, {_RATES}, median(CASE WHEN label = 1 AND alert_idx >= 0 THEN alert_idx END) AS median_alert_turn FROM alerts GROUP BY 1), {_OP}"


@query(f"{fx.ALL}, {_SWEEP} SELECT threshold, tp, fp, tn, fn, median_alert_turn, {_SHOWN} FROM op")
def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    return evaluate.operating_points(evaluate.sweep(fx.scored(s, d, ("label",)), fx.THRESHOLDS))


@query(f"{fx.ALL}, {_SWEEP} SELECT threshold, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM op ORDER BY f1 DESC, threshold LIMIT 1")
def best_by_f1(s: SparkSession, d: str) -> DataFrame:
    return evaluate.best_by_f1(threshold_sweep(s, d)).select("threshold", "f1")


@query(f"""{fx.ALL}, x AS (SELECT threshold, action_idx - alert_idx AS lead FROM alerts WHERE label = 1 AND alert_idx >= 0 AND action_idx >= 0)
SELECT g.threshold, median(lead) AS median_lead_turns, round(avg(CASE WHEN lead > 0 THEN 1 WHEN lead IS NOT NULL THEN 0 END), 4) AS share_before_action FROM grid g LEFT JOIN x ON g.threshold = x.threshold GROUP BY 1""")
def lead_time(s: SparkSession, d: str) -> DataFrame:
    return evaluate.operating_points(fx.alerts(s, d)).select("threshold", "median_lead_turns", "share_before_action")


@query(f"""{fx.ALL} SELECT threshold, round(coalesce(count(*) FILTER (label = 1 AND action_idx >= 0 AND alert_idx >= 0 AND alert_idx < action_idx) / nullif(count(*) FILTER (label = 1 AND action_idx >= 0), 0), 0), 4) AS early_share,
count(*) FILTER (label = 1 AND action_idx >= 0) AS n_actioned FROM alerts GROUP BY 1""")
def early_share(s: SparkSession, d: str) -> DataFrame:
    return evaluate.early_share(fx.alerts(s, d))


@query(f"{fx.ALL} SELECT threshold, label, median(alert_idx) AS median_alert, round(quantile_cont(alert_idx, 0.9), 4) AS p90_alert FROM alerts WHERE alert_idx >= 0 GROUP BY 1, 2")
def medians(s: SparkSession, d: str) -> DataFrame:
    rows = fx.alerts(s, d).filter("alert_idx >= 0")
    return rows.groupBy("threshold", "label").agg(F.median("alert_idx").alias("median_alert"), F.round(F.percentile("alert_idx", F.lit(0.9)), 4).alias("p90_alert"))


_AUC = """c AS (SELECT {s} AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM {t} GROUP BY 1),
u AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM c)
SELECT round(sum(p * (under + n / 2)) / nullif(sum(p) * sum(n), 0), 4) AS auc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg FROM u"""


@query(f"{fx.ALL}, {_AUC.format(s='peak', t='peaks')}")
def roc_auc(s: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_auc(evaluate.peaks(fx.scored(s, d, ("label",))))


@query(f"{fx.ALL}, {_AUC.format(s='score', t='scored')}")
def turn_auc(s: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_auc(fx.scored(s, d, ("label",)), score="score")


@query(f"""{fx.ALL}, n AS (SELECT peak, row_number() OVER (ORDER BY peak DESC) AS k, count(*) OVER () AS n FROM peaks WHERE label = 0)
SELECT round(least(1.0, max(peak) + 1e-6), 6) AS threshold FROM n WHERE k = CAST(floor(0.05 * n) AS BIGINT) + 1""")
def threshold_for_fpr(s: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_for_fpr(evaluate.peaks(fx.scored(s, d, ("label",))), 0.05).select(F.round("threshold", 6).alias("threshold"))


def _fold_sql() -> str:
    parts = []
    for k, (mode, a) in enumerate(evaluate.ACCUMULATORS):
        step = {"raw": "t.risk", "ewma": f"CAST({a} AS DOUBLE) * t.risk + CAST({1 - a!r} AS DOUBLE) * c.r", "maxdecay": f"greatest(t.risk, CAST({a} AS DOUBLE) * c.r)"}[mode]
        parts.append(f"WHEN {k} THEN {step}")
    return f"""folded AS (
      SELECT k.k, t.dialogue_id, t.idx, t.label, t.risk AS r FROM flagged t, (SELECT unnest(range(0, {len(evaluate.ACCUMULATORS)})) AS k) k WHERE t.idx = 0
      UNION ALL SELECT c.k, t.dialogue_id, t.idx, t.label, CASE c.k {' '.join(parts)} END FROM folded c JOIN flagged t ON t.dialogue_id = c.dialogue_id AND t.idx = c.idx + 1)"""


_FOLDS = f"WITH RECURSIVE {fx.SQL_TURNS}, {fx.SQL_FLAGS}, {_fold_sql()}"


@query(f"{_FOLDS} SELECT dialogue_id, idx, r FROM folded WHERE k = 0")
def acc_raw(s: SparkSession, d: str) -> DataFrame:
    return curves.accumulate(fx.flagged(s, d), "raw", 1.0, "risk").select("dialogue_id", "idx", "r")


@query(f"{_FOLDS} SELECT dialogue_id, idx, r FROM folded WHERE k = 2")
def acc_ewma(s: SparkSession, d: str) -> DataFrame:
    return curves.accumulate(fx.flagged(s, d), "ewma", 0.5, "risk").select("dialogue_id", "idx", "r")


@query(f"{_FOLDS} SELECT dialogue_id, idx, r FROM folded WHERE k = 5")
def acc_maxdecay(s: SparkSession, d: str) -> DataFrame:
    return curves.accumulate(fx.flagged(s, d), "maxdecay", 0.85, "risk").select("dialogue_id", "idx", "r")


_NAMES = ", ".join(f"({k}, '{m}', CAST({a} AS DOUBLE))" for k, (m, a) in enumerate(evaluate.ACCUMULATORS))


@query(f"""{_FOLDS}, names(k, mode, a) AS (VALUES {_NAMES}),
acts AS (SELECT dialogue_id, coalesce(min(CASE WHEN list_contains(flags, 'legal') THEN idx END), -1) AS action_idx FROM flagged GROUP BY 1),
per AS (SELECT k, dialogue_id, any_value(label) AS label, max(r) AS peak FROM folded GROUP BY 1, 2),
neg AS (SELECT k, peak, row_number() OVER (PARTITION BY k ORDER BY peak DESC) AS n, count(*) OVER (PARTITION BY k) AS total FROM per WHERE label = 0),
th AS (SELECT k, least(1.0, max(peak) + 1e-6) AS threshold FROM neg WHERE n = CAST(floor(0.05 * total) AS BIGINT) + 1 GROUP BY 1),
al AS (SELECT f.k, f.dialogue_id, any_value(label) AS label, any_value(threshold) AS threshold, coalesce(min(CASE WHEN r >= threshold THEN idx END), -1) AS alert_idx FROM folded f JOIN th ON f.k = th.k GROUP BY 1, 2),
c AS (SELECT k, any_value(threshold) AS threshold, {_RATES}, count(*) FILTER (label = 1 AND action_idx >= 0 AND alert_idx >= 0 AND alert_idx < action_idx) AS early, count(*) FILTER (label = 1 AND action_idx >= 0) AS acted
      FROM al JOIN acts ON al.dialogue_id = acts.dialogue_id GROUP BY 1), {_OP}
SELECT mode, a, round(threshold, 6) AS threshold, round(coalesce(early / nullif(acted, 0), 0), 4) AS early_share, {_SHOWN} FROM op JOIN names ON op.k = names.k ORDER BY early_share DESC, recall DESC, op.k LIMIT 1""")
def calibrate(s: SparkSession, d: str) -> DataFrame:
    turns = fx.flagged(s, d)
    act = turns.groupBy("dialogue_id").agg(F.coalesce(F.min(F.when(F.array_contains("flags", "legal"), F.col("idx"))), F.lit(-1)).alias("action_idx"))
    return evaluate.calibrate(turns.join(act, "dialogue_id"), 0.05, "risk")


_MATCHED = """, k AS (SELECT DISTINCT round(peak, 6) AS threshold FROM peaks),
a AS (SELECT k.threshold, label, CASE WHEN round(peak, 6) >= k.threshold THEN 0 ELSE -1 END AS alert_idx FROM k, peaks), c AS (SELECT threshold, """ + _RATES + """ FROM a GROUP BY 1), """ + _OP


@query(f"{fx.ALL}{_MATCHED}, shown AS (SELECT threshold, tp, fp, tn, fn, {_SHOWN} FROM op) SELECT * FROM shown WHERE recall >= 0.4 ORDER BY threshold DESC LIMIT 1")
def matched_recall(s: SparkSession, d: str) -> DataFrame:
    return evaluate.matched_threshold(evaluate.peaks(fx.scored(s, d, ("label",))), 0.4, "recall")


@query(f"{fx.ALL}{_MATCHED}, shown AS (SELECT threshold, tp, fp, tn, fn, {_SHOWN} FROM op) SELECT * FROM shown WHERE fpr <= 0.05 ORDER BY threshold LIMIT 1")
def matched_fpr(s: SparkSession, d: str) -> DataFrame:
    return evaluate.matched_threshold(evaluate.peaks(fx.scored(s, d, ("label",))), 0.05, "fpr")


@query(f"""{fx.ALL}, a AS (SELECT * FROM alerts WHERE threshold = CAST(0.7 AS DOUBLE)), b AS (
SELECT 'topic:' || topic AS key, alert_idx FROM a UNION ALL SELECT 'lang:' || lang || ':' || label, alert_idx FROM a)
SELECT key, count(*) FILTER (alert_idx >= 0) AS fired, count(*) AS n, round(count(*) FILTER (alert_idx >= 0) / count(*), 3) AS share FROM b GROUP BY 1""")
def breakdown_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    return evaluate.breakdown(fx.alerts(s, d, (0.7,)))


@query(f"{fx.ALL} SELECT dialogue_id, alert_idx, round((alert_idx + 1) / n, 4) AS fraction FROM (SELECT a.dialogue_id, a.alert_idx, d.n_turns AS n FROM alerts a JOIN dialogues d ON a.dialogue_id = d.dialogue_id WHERE threshold = CAST(0.6 AS DOUBLE) AND alert_idx >= 0)")
def alert_position(s: SparkSession, d: str) -> DataFrame:
    return curves.alert_position(fx.scored(s, d, ()), 0.6)


@query(f"""{fx.ALL} SELECT dialogue_id, CASE WHEN max(score) >= CAST(0.7 AS DOUBLE) THEN 'alert' WHEN arg_max(score, idx) >= CAST(0.7 AS DOUBLE) * CAST(0.8 AS DOUBLE) THEN 'warn' ELSE 'ok' END AS tier FROM scored GROUP BY 1""")
def alert_tier(s: SparkSession, d: str) -> DataFrame:
    return curves.alert_tier(fx.scored(s, d, ()), 0.7)


@query(f"""{fx.ALL}, j AS (SELECT dialogue_id, idx, round(score - coalesce(lag(score) OVER (PARTITION BY dialogue_id ORDER BY idx), 0), 4) AS rise FROM scored)
SELECT dialogue_id, idx, rise FROM (SELECT *, row_number() OVER (PARTITION BY dialogue_id ORDER BY rise DESC, idx) AS k FROM j) WHERE k = 1 AND rise > CAST(0.1 AS DOUBLE)""")
def biggest_jump(s: SparkSession, d: str) -> DataFrame:
    return curves.biggest_jump(fx.scored(s, d, ()))


@query(f"""{fx.CONV}, c AS (SELECT dialogue_id, idx, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), ' ')) END + 1 AS cost FROM turns),
u AS (SELECT *, sum(cost) OVER (PARTITION BY dialogue_id ORDER BY idx) AS upto FROM c)
SELECT t.dialogue_id, t.idx, min(o.idx) AS from_idx, count(*) AS n_turns, CAST(least(sum(o.cost), 120) AS BIGINT) AS n_words FROM u t JOIN u o ON t.dialogue_id = o.dialogue_id AND o.idx <= t.idx
WHERE o.idx = t.idx OR t.upto - t.cost - (o.upto - o.cost) <= 120 - least(t.cost, 120) GROUP BY 1, 2""")
def prefix_context(s: SparkSession, d: str) -> DataFrame:
    return curves.prefix_context(conversation_turns(s, d), 120)


@query(f"{fx.ALL} SELECT threshold, topic, {_RATES} FROM alerts GROUP BY ALL")
def grouped_confusion(s: SparkSession, d: str) -> DataFrame:
    return fx.alerts(s, d).groupBy("threshold", "topic").agg(*evaluate.confusion(F.col("alert_idx") >= 0, F.col("label")))


_SEED = "p AS (SELECT dialogue_id, label, peak, CAST(('0x' || substr(md5(CAST(dialogue_id AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS run FROM peaks)"


@query(f"""{fx.ALL}, {_SEED}, c AS (SELECT run, peak AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM p GROUP BY 1, 2),
u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY run ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM c),
a AS (SELECT run, round(sum(p * (under + n / 2)) / nullif(sum(p) * sum(n), 0), 4) AS auc FROM u GROUP BY 1)
SELECT 'rules' AS model, round(avg(auc), 4) AS mean, round(stddev_samp(auc), 4) AS sd, count(*) AS n_runs FROM a WHERE auc IS NOT NULL""")
def seed_summary(s: SparkSession, d: str) -> DataFrame:
    run = F.pmod(F.conv(F.substring(F.md5(F.col("dialogue_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(3))
    runs = evaluate.roc_auc(evaluate.peaks(fx.scored(s, d, ("label",))).withColumn("run", run), by=("run",))
    return evaluate.seed_summary(runs.withColumn("model", F.lit("rules")), "auc", ("model",))


_SEGMENTS = """s AS (SELECT user_id AS call_id, event_id, event_type AS speaker, value, (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS start,
(lead(epoch_us(ts)) OVER w - first_value(epoch_us(ts)) OVER w) / 1e6 AS "end" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"""WITH {_SEGMENTS} SELECT speaker, round(median("end" - start), 3) AS median, round(quantile_cont("end" - start, 0.9), 3) AS p90, round(max("end" - start), 3) AS max, count(*) AS n FROM s WHERE "end" IS NOT NULL GROUP BY 1""")
def latency_summary(s: SparkSession, d: str) -> DataFrame:
    rows = segments(s, d).filter(F.col("end").isNotNull())
    return evaluate.latency_summary(rows.withColumn("gap", F.col("end") - F.col("start")), "gap", ("speaker",))


@query("SELECT event_type AS config, round(sum(value * n) / greatest(1, sum(n)), 4) AS weighted FROM (SELECT event_type, value, length(props) AS n FROM events) GROUP BY 1")
def weighted_wer(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.col("event_type").alias("config"), "value", F.length("props").alias("n"))
    return evaluate.weighted_mean(rows, "value", "n", ("config",))


@query("SELECT user_id, round(20 * log10(sqrt(avg(value * value)) + 1e-9), 6) AS level_db FROM events GROUP BY 1")
def rms_level(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("user_id").agg(F.round(20 * F.log10(F.sqrt(F.avg(F.col("value") * F.col("value"))) + 1e-9), 6).alias("level_db"))


@query(f"""WITH RECURSIVE {_SEGMENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY start, event_id) AS k FROM s),
m AS (SELECT call_id, k, speaker, start AS s0, "end" AS e0, 0 AS idx FROM o WHERE k = 1
UNION ALL SELECT o.call_id, o.k, o.speaker, CASE WHEN o.speaker = m.speaker AND o."end" - m.s0 <= 864000 THEN m.s0 ELSE o.start END, o."end",
m.idx + CASE WHEN o.speaker = m.speaker AND o."end" - m.s0 <= 864000 THEN 0 ELSE 1 END FROM m JOIN o ON o.call_id = m.call_id AND o.k = m.k + 1)
SELECT call_id, idx, any_value(speaker) AS speaker, round(min(s0), 6) AS start, round(arg_max(coalesce(e0, -1), k), 6) AS "end", count(*) AS n FROM m GROUP BY 1, 2""")
def merge_segments(s: SparkSession, d: str) -> DataFrame:
    rows = curves.merge_segments(segments(s, d), 864_000.0)
    return rows.select("call_id", "idx", "speaker", F.round("start", 6).alias("start"), F.round(F.coalesce("end", F.lit(-1.0)), 6).alias("end"), "n")


@query(f"{fx.ALL} SELECT dialogue_id, peak, CAST(label AS INTEGER) AS label FROM peaks")
def peaks(s: SparkSession, d: str) -> DataFrame:
    return evaluate.peaks(fx.scored(s, d, ("label",))).select("dialogue_id", "peak", F.col("label").cast("int").alias("label"))


@query(f"{fx.ALL} SELECT dialogue_id, idx, series, value FROM (SELECT dialogue_id, idx, risk, score FROM scored) UNPIVOT (value FOR series IN (risk, score))")
def chart_series(s: SparkSession, d: str) -> DataFrame:
    return fx.scored(s, d, ()).select("dialogue_id", "idx", "risk", "score").unpivot(["dialogue_id", "idx"], ["risk", "score"], "series", "value")


@query("""WITH c AS (SELECT conv_id, turn, text, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(text), ' ')) END AS n FROM conversations)
SELECT conv_id, turn, n <= 2 OR regexp_matches(text, '[әғқңөұүһіӘҒҚҢӨҰҮҺІ]') AS ok FROM c""")
def lang_gate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", tx.looks_kazakh(F.col("text")).alias("ok"))
