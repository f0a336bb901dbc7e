"""Federated averaging: banks, weighted parameter means, what the exchange costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("random", "profile", "topic")


def bank_of(mode: str, key: Column, banks: int, mapping: dict[str, int] | None = None) -> Column:
    """The bank of a dialogue: by a hash of its id, or by a map of its profile or topic (others by hash)."""
    if mode not in SPLITS:
        raise ValueError(f"unknown split {mode}")
    by_hash = F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(banks)).cast("int")
    if mode == "random" or not mapping:
        return by_hash
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key), by_hash)


def fedavg(states: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """states (bank, param, vector[, weight]) -> (param, pos, value): means weighted by the number of a bank's examples.

    Vectors are summed by position before they are shuffled, so what moves is one row a parameter and task.
    """
    own = states if sizes is None else states.join(F.broadcast(sizes), "bank")
    each = own.select("param", "weight", F.posexplode("vector").alias("pos", "v"))
    return each.groupBy("param", "pos").agg((F.sum(F.col("v").cast("double") * F.col("weight")) / F.sum("weight")).alias("value"))


def communication_mb(n_params: Column, banks: Column, rounds: Column) -> Column:
    """Megabytes of four-byte parameters that go both ways."""
    return n_params * 4 / F.lit(1e6) * 2 * banks * rounds


def bank_profile(dialogues: DataFrame) -> DataFrame:
    """Sorted distinct topics and languages of each bank, and its dialogues and prefixes."""
    return dialogues.groupBy("bank").agg(F.sort_array(F.collect_set("topic")).alias("topics"), F.sort_array(F.collect_set("lang")).alias("langs"), F.count("*").alias("n_dialogues"), F.sum("n_turns").alias("n_prefixes"))
