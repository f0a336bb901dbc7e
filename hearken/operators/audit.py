"""Audits of a corpus: features that give a class away, leaks between splits, lint of template pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.functions import text as tx

MIN_SHARE, MIN_DIALOGUES, TOPIC_RANGE = 0.03, 30, (0.35, 0.65)
#: Slots a template may name; fixed values.
SLOTS = (
    "victim_name patronymic agent_name bank telecom gov_org authority pension_fund city district amount_small amount_medium amount_large "
    "loan_amount card_last4 sms_code case_number app_name time_pressure_window investment_asset return_promise link"
).split()
#: Letters and words of Russian that Kazakh lacks; fixed values.
RUSSIAN_LETTERS = "ёщъЁЩЪ"
RUSSIAN_WORDS = (
    "и в на что это вы вас вам я с по для как но нет если уже только сейчас пожалуйста здравствуйте спасибо хорошо ваш ваша мне меня есть будет диктую"
).split()


def by_label(rows: DataFrame, key: str) -> DataFrame:
    """Rows of either label by key."""
    return rows.groupBy(key).agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))


def flag_by_label(flagged: DataFrame) -> DataFrame:
    """Occurrences of each flag in turns of either class, the negatives' share, and whether the flag alone gives the class away."""
    counts = by_label(flagged.select("label", F.explode("flags").alias("flag")), "flag")
    share = F.col("n_neg") / (F.col("n_pos") + F.col("n_neg"))
    verdict = F.when(F.col("n_neg") == 0, "only positive").when(share < MIN_SHARE, "almost only positive").otherwise("both")
    return counts.select("*", F.round(share, 4).alias("share_neg"), verdict.alias("verdict"))


def flag_stats(flagged: DataFrame) -> DataFrame:
    """Dialogues of each class with each flag, a flag once a dialogue."""
    return flagged.select("dialogue_id", "label", F.explode("flags").alias("flag")).distinct().groupBy("label", "flag").agg(F.count("*").alias("n_dialogues"))


def any_flag(flagged: DataFrame) -> DataFrame:
    """Dialogues with any flag, and their share, by class."""
    rows = flagged.groupBy("dialogue_id", "label").agg(F.max((F.size("flags") > 0).cast("int")).alias("any"))
    return rows.groupBy("label").agg(F.sum("any").alias("n_with_flag"), F.count("*").alias("n"), F.round(F.avg("any"), 4).alias("share"))


def topic_balance(dialogues: DataFrame) -> DataFrame:
    """Positive share of each topic, and whether it lies in TOPIC_RANGE."""
    share = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    return by_label(dialogues, "topic").select("*", F.round(share, 4).alias("share_pos"), share.between(*TOPIC_RANGE).alias("ok"))


def markers(turns: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Dialogues of either class in which a word is said, the smaller class's share, and whether it gives the class away."""
    hits = F.array(*[F.struct(F.lit(name).alias("marker"), F.max(F.rlike("text", F.lit(f"(?iU){p}")).cast("int")).alias("hit")) for name, p in patterns.items()])
    rows = turns.groupBy("dialogue_id", "label").agg(hits.alias("h")).select("label", F.inline("h")).filter("hit = 1")
    n = F.col("n_pos") + F.col("n_neg")
    share = F.least("n_pos", "n_neg") / n
    return by_label(rows, "marker").select("*", F.round(share, 4).alias("minority"), ((n >= MIN_DIALOGUES) & (share < MIN_SHARE)).alias("bad"))


def length_overlap(dialogues: DataFrame) -> DataFrame:
    """Of all lengths in turns, the share that both classes have."""
    lengths = dialogues.groupBy("n_turns").agg(F.max((F.col("label") == 1).cast("int")).alias("p"), F.max((F.col("label") == 0).cast("int")).alias("n"))
    share = F.try_divide(F.sum(F.col("p") * F.col("n")).cast("double"), F.count("*").cast("double"))
    return lengths.agg(F.round(share, 4).alias("overlap"), F.count("*").alias("n_lengths")).select("*", (F.col("overlap") > 0.5).alias("ok"))


def termination_rate(dialogues: DataFrame, ended: Column) -> DataFrame:
    """Of the positives, the share that ended early."""
    return dialogues.filter("label = 1").agg(F.count_if(ended).alias("n_ended"), F.count("*").alias("n"), F.round(F.try_divide(F.count_if(ended).cast("double"), F.count("*").cast("double")), 4).alias("share"))


def fp_by_group(alerts: DataFrame, group: str) -> DataFrame:
    """Negatives that fired, by group."""
    fired = (F.col("alert_idx") >= 0).cast("int")
    return alerts.filter("label = 0").groupBy(group).agg(F.sum(fired).alias("fired"), F.count("*").alias("n"), F.round(F.avg(fired), 4).alias("fp_rate"))


def overlap(rows: DataFrame, split: str, template: str) -> DataFrame:
    """For each two splits the templates they share and their share of the first one's."""
    own = rows.select(F.col(split).alias("s"), F.col(template).alias("t")).distinct()
    sizes = own.groupBy("s").agg(F.count("*").alias("n"))
    a, b = own.withColumnRenamed("s", "split_a"), own.withColumnRenamed("s", "split_b")
    both = a.join(b, "t").filter("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("n_shared"))
    return both.join(F.broadcast(sizes.withColumnRenamed("s", "split_a")), "split_a").select("split_a", "split_b", "n_shared", F.round(F.col("n_shared") / F.col("n"), 4).alias("share_of_a"))


def lint(pools: DataFrame) -> DataFrame:
    """Violations in pools (path, lang, pos, line): unknown slots, Russian lines among Kazakh ones, lines repeated in a pool."""
    slots = F.array_except(F.regexp_extract_all("line", F.lit(r"\{([a-z_]+)\}"), F.lit(1)), F.array(*map(F.lit, SLOTS)))
    bare = F.lower(F.regexp_replace("line", r"\{[a-z_]+\}", " "))
    said = F.regexp_extract_all(bare, F.lit(r"(?U)\w+"), F.lit(0))
    russian = (F.col("lang") == "kk") & ~F.rlike("line", F.lit(f"[{tx.KAZAKH}]")) & (F.rlike("line", F.lit(f"[{RUSSIAN_LETTERS}]")) | F.arrays_overlap(said, F.array(*map(F.lit, RUSSIAN_WORDS))))
    found = F.array_compact(F.concat(F.transform(F.array_distinct(slots), lambda s: F.concat(F.lit("unknown slot "), s)), F.array(F.when(russian, F.lit("russian line in a kazakh pool")))))
    own = pools.select("path", "lang", "line", F.explode(found).alias("violation"))
    twice = pools.groupBy("path", "lang", "line").agg(F.count("*").alias("n")).filter("n > 1").select("path", "lang", "line", F.lit("repeated line").alias("violation"))
    return own.unionByName(twice)


def flagged_fillers(pools: DataFrame, flags: Column) -> DataFrame:
    """Fillers that carry a flag, which they must not."""
    return pools.filter(F.size(flags) > 0).select("path", "lang", "line", F.lit("flag in a filler").alias("violation"))


def missing_paths(base: DataFrame, extension: DataFrame, new: tuple[str, ...] = ("closing",)) -> DataFrame:
    """Paths of an extension that its base lacks, but for those meant to be new."""
    return extension.select("path").distinct().filter(~F.col("path").isin(*new)).join(base.select("path").distinct(), "path", "left_anti")
