"""Joins, set operations, sampling and similarity."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.functions import text as tx
from hearken.operators import blocks

_LOCAL: list[str] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again, so that a loop's plans stay short and survive lost
    executors.  In local mode, where the setting may be absent, a folder of this process does."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="hearken-"))
        top = _LOCAL[0]
    path = os.path.join(top, f"step-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def asof_forward(left: DataFrame, right: DataFrame, by: str, at: str, end: str, value: str) -> DataFrame:
    """For each row of left the value of the first right row with end >= at, else of the last one, else null.

    Both sides are one stream ordered by place, in which a window looks ahead: one shuffle by key, no pair is made.
    """
    a = left.select(by, F.col(at).alias("at"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("v"))
    b = right.select(by, F.col(end).alias("at"), F.lit(2).alias("side"), F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(value).alias("v"))
    ahead = Window.partitionBy(by).orderBy("at", "side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    back = Window.partitionBy(by).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("next", F.first("v", ignorenulls=True).over(ahead)).withColumn("last", F.last("v", ignorenulls=True).over(back))
    return both.filter("side = 1").select("row.*", F.coalesce("next", "last").alias(value))


def weighted_pick(keys: DataFrame, items: DataFrame, draw: Column, item: str, weight: str) -> DataFrame:
    """A weighted choice for each key: draw in [0, 1) falls in one stretch of the cumulated weights; the last takes what is left.

    items is a small dimension; its cumulated weights are one sorted array, searched in the projection.
    """
    order = Window.orderBy(item).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = items.select(item, F.sum(weight).over(order).alias("upto")).agg(F.array_sort(F.collect_list(F.struct("upto", item))).alias("c"))
    both = keys.crossJoin(F.broadcast(steps)).withColumn("r", draw * F.element_at("c", -1)["upto"])
    hit = F.get(F.filter("c", lambda x: x["upto"] >= F.col("r")), 0)
    return both.select(*keys.columns, F.coalesce(hit, F.element_at("c", -1))[item].alias(item))


def dedupe_map_join(pieces: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None) -> DataFrame:
    """Each distinct piece goes through `work` (key -> key, result) once, unless a cache has it; results go back to all rows."""
    todo = pieces.select(key).distinct()
    if cache is not None:
        todo = todo.join(cache.select(key), key, "left_anti")
    done = work(todo)
    if cache is not None:
        done = done.unionByName(cache.select(*done.columns))
    return pieces.join(done, key)


def segment_slice(notes: DataFrame, recordings: DataFrame) -> DataFrame:
    """notes (call_id, a, b) x recordings (call_id, segments): segments a to b, both included."""
    return recordings.join(notes, "call_id").select("call_id", "a", "b", F.slice("segments", F.col("a") + 1, F.greatest(F.lit(0), F.col("b") - F.col("a") + 1)).alias("segments"))


def split_by_position(rows: DataFrame, order: Column, shares: tuple[float, float] = (0.7, 0.15), prefix: str = "DLG-") -> DataFrame:
    """Rows numbered by an order and split by place: the first share train, the next val, the rest test.

    Numbers come from two levels, the rank inside a hash bucket and the rows before it, so no task holds all rows.
    """
    keyed = rows.withColumn("o", order).withColumn("bucket", F.substring("o", 1, 2))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("c"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("total", F.sum("c").over(Window.partitionBy()))
    own = keyed.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("o")))
    both = own.join(F.broadcast(counts), "bucket").withColumn("pos", F.col("k") + F.col("before") - 1)
    cuts = [F.floor(F.col("total") * shares[0]), F.floor(F.col("total") * (shares[0] + shares[1]))]
    split = F.when(F.col("pos") < cuts[0], "train").when(F.col("pos") < cuts[1], "val").otherwise("test")
    return both.select(*rows.columns, F.format_string(f"{prefix}%06d", F.col("pos")).alias("new_id"), split.alias("split"))


def top_n_per_class(rows: DataFrame, by: str, key: Column, n: int) -> DataFrame:
    """The first n rows of each class by a hash order."""
    return rows.withColumn("o", key).withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("o"))).filter(F.col("k") <= n).drop("o", "k")


def head_and_tail(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n/2 and the last n/2 rows by an order, each once."""
    head, tail = rows.orderBy(order).limit(n // 2), rows.orderBy(F.desc(order)).limit(n // 2)
    return head.unionByName(tail).distinct()


def similar_pairs(items: DataFrame, threshold: float, pool: str = "pool", n: int = 4) -> DataFrame:
    """(pool, a, b, jaccard) of items (pool, id, text) of one pool whose shingle sets are that similar."""
    own = items.filter(F.col("text").isNotNull()).select(F.col(pool).alias("pool"), "id", tx.shingled(F.col("text")).alias("t"), F.size(tx.shingles(F.col("text"), n)).alias("n_grams"))
    return blocks.similar_in_blocks(checkpointed(own), threshold, n, link=False)


def groups(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pool, id, group): single linkage, the group being its least id.  Labels go to neighbours, and from a label's own
    label onward, until none changes; each round ends the lineage.  Rounds see only items that pairs name."""
    both = pairs.select("pool", "a", "b").unionByName(pairs.select("pool", F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both)
    now = checkpointed(both.select("pool", F.col("a").alias("id"), F.col("a").alias("group")).distinct())
    while True:
        near = both.join(now.select("pool", F.col("id").alias("b"), "group"), ["pool", "b"]).groupBy("pool", F.col("a").alias("id")).agg(F.min("group").alias("m"))
        step = now.join(near, ["pool", "id"], "left").select("pool", "id", F.least("group", F.coalesce("m", "group")).alias("group"), F.col("group").alias("old"))
        jump = step.select("pool", F.col("id").alias("group"), F.col("group").alias("via"))
        step = checkpointed(step.join(jump, ["pool", "group"]).select("pool", "id", F.least("group", "via").alias("group"), "old"))
        if step.filter("group <> old").isEmpty():
            break
        now = step.drop("old")
    return items.select("pool", "id").join(step.drop("old"), ["pool", "id"], "left").select("pool", "id", F.coalesce("group", "id").alias("group"))


def similar_groups(items: DataFrame, threshold: float, n: int = 4) -> DataFrame:
    """(pool, id, group) of items (pool, id, text) by single linkage of similar ones.  Items of one shingle set are compared as one,
    so copies make no pairs; an item without text is alone."""
    sets = F.array_sort(tx.shingles(F.col("text"), n))
    keyed = items.select("pool", "id", tx.shingled(F.col("text")).alias("t"), sets.alias("s"))
    keyed = checkpointed(keyed.select("pool", "id", "t", F.size("s").alias("n_grams"), F.md5(F.array_join("s", "\x1f").cast("binary")).alias("copy")))
    texts = keyed.filter("t is not null")
    one = checkpointed(texts.groupBy("pool", "copy").agg(F.min("id").alias("of"), F.min_by("t", "id").alias("t"), F.min("n_grams").alias("n_grams")))
    own = one.select("pool", F.col("of").alias("id"), "t", "n_grams")
    found = groups(own, blocks.similar_in_blocks(own, threshold, n, link=True)).withColumnRenamed("id", "of")
    grouped = texts.select("pool", "id", "copy").join(one.select("pool", "copy", "of"), ["pool", "copy"]).join(found, ["pool", "of"]).select("pool", "id", "group")
    return grouped.unionByName(keyed.filter("t is null").select("pool", "id", F.col("id").alias("group")))


def three_way(grouped: DataFrame, seed: str, hold: float = 0.25, val: float = 0.2) -> DataFrame:
    """(pool, id, group, split): whole groups go to holdout, then to val, then to train, in a hash order, at least one each
    where there are two; Python's rounding of halves to even.  No part of a pool is empty: where one group is left for val and
    train, both have it, and the one group of a pool is in all three, a row for each."""
    own = grouped.select("pool", "group").distinct().withColumn("o", tx.short_hash(F.concat_ws("|", F.col("pool"), F.col("group").cast("string"), F.lit(seed)), 32))
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("pool").orderBy("o"))).withColumn("n", F.count("*").over(Window.partitionBy("pool")))
    quota = lambda n, share: F.when(n > 1, F.greatest(F.lit(1), F.bround(n * share).cast("int"))).otherwise(0)
    own = own.withColumn("h", quota(F.col("n"), hold)).withColumn("v", quota(F.col("n") - F.col("h"), val))
    of = lambda *parts: F.array(*map(F.lit, parts))
    parts = F.when(F.col("n") == 1, of("holdout", "val", "train")).when(F.col("k") <= F.col("h"), of("holdout")).when(F.col("n") - F.col("h") == 1, of("val", "train"))
    parts = parts.when(F.col("k") <= F.col("h") + F.col("v"), of("val")).otherwise(of("train"))
    return grouped.join(own.select("pool", "group", F.explode(parts).alias("split")), ["pool", "group"])


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with `number`, their place from 0 on by `order` among those equal in `by`.

    Rows are sorted in ranges and written; a row's number comes from its place in its file and the counts of the files before,
    so no task holds all rows of a group, however large.
    """
    at = checkpointed(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order))
    at = at.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    counts = at.groupBy("file", *by).agg(F.count("*").alias("c"), F.min("row").alias("low"), F.min(F.struct(*order)).alias("from"))
    under = Window.partitionBy(*by).orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("c").over(under), F.lit(0)) - F.col("low")).alias("shift")
    counts = counts.select(F.col("file").alias("in_file"), *[F.col(c).alias(f"in_{c}") for c in by], shift)
    same = [F.col(c).eqNullSafe(F.col(f"in_{c}")) for c in ("file", *by)]
    return at.join(F.broadcast(counts), same).select(*rows.columns, (F.col("row") + F.col("shift")).alias("number"))


def merge_extension(base: DataFrame, extension: DataFrame) -> DataFrame:
    """Pools (path, lang, pos, line) and those of an extension: base lines first, then new ones, each once in a pool."""
    both = base.withColumn("src", F.lit(0)).unionByName(extension.withColumn("src", F.lit(1)))
    first = both.groupBy("path", "lang", "line").agg(F.min(F.struct("src", "pos")).alias("o"))
    return numbered(first.select("path", "lang", "line", "o.src", "o.pos"), ["path", "lang"], ["src", "pos"]).select("path", "lang", F.col("number").alias("pos"), "line")
