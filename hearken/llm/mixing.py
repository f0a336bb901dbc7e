"""Mixing sources to target weights with a time-varying curriculum (operator 4); DataFrame operations only.

A source has a weight and a schedule: knots (time, height) between 0 and 1, linear in between.  The schedule is scaled so
that its integral is one, hence a source's words over the whole run are its weight's share, while their density in time
follows the schedule.  Shares are targets of words; a target stops at MAX_EPOCHS times its source's words and the excess
is shared anew by weight until none is above (water filling, in closed form over the sources ordered by the level at
which they fill up).

A source's documents stand in the order of a hash of their id and follow each other epoch by epoch until the target is used
up; the last one taken may be taken in part.  The fraction of the source's demand that lies before an occurrence is put
through the inverse of the integrated schedule, which gives its training position in [0, 1); the mix is the occurrences
range-sorted by position.  ``planned`` places the occurrences, ``mixed`` writes them in that order and gathers from them what
the mix has of each document, ``mixed_rows`` gives the documents themselves in that order.

Running sums never need a source in one task: documents are dealt by (source, bucket of the hash), buckets are summed
first, and the running sum over buckets is added to that inside a bucket.  Buckets grow in number with the table.

Nulls and odd input: a null or empty text has size 0 and nothing is taken of it; a null source is a source, the last in
order; a source whose texts are all empty has target 0; rows with one doc_id are documents of their own, told apart by
size, and rows equal in all are as good as each other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.llm.common import aside, stage, table

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
WEIGHTS = [1.0, 2.0, 3.0]
#: One schedule for each weight: falling, level with a hump, rising.
SCHEDULES = [[(0.0, 1.5), (1.0, 0.5)], [(0.0, 0.75), (0.5, 1.25), (1.0, 0.75)], [(0.0, 0.5), (1.0, 1.5)]]
#: Documents of a source in a bucket, about.
BUCKET_ROWS = 20_000


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, the key of the order inside a source, and the columns to carry."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), *carry)
    return out.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))


def targets(sums: DataFrame, weights: list[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size), a row a source -> with place, target.  The table has a row a source, whatever the corpus."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    out = sums.withColumn("place", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    out = out.withColumn("full", (F.col("source_size") * max_epochs).cast("double"))
    # sources fill up in the order of full / weight; level: what a unit of weight gets once those before are full
    order = Window.orderBy(F.col("full") / F.col("weight"), "place")
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
    out = out.withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first that isn't full at its level sets the level of all that follow
    out = out.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), "place", "level"))).over(all_rows)["level"])
    return out.withColumn("target", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full")))).select("source", "place", "source_size", "target")


def _segments(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(integral before, start, height, slope) of each linear piece, scaled to integral one."""
    area = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(knots, knots[1:], strict=False))
    out, before = [], 0.0
    for (a, x), (b, y) in zip(knots, knots[1:], strict=False):
        out.append((before, a, x / area, (y - x) / area / (b - a)))
        before += (b - a) * (x + y) / 2 / area
    return out


def position(fraction: Column, place: Column, schedules: list[list[tuple[float, float]]]) -> Column:
    """The time at which the integrated schedule of the source at this place reaches the fraction."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        at = F.lit(None).cast("double")
        for before, start, height, slope in _segments(knots):
            left = fraction - F.lit(before)
            # height x + slope x**2 / 2 = left, in the form that is right for slope 0 too
            x = 2 * left / (F.lit(height) + F.sqrt(F.greatest(F.lit(0.0), F.lit(height**2) + 2 * F.lit(slope) * left)))
            at = F.when(fraction >= F.lit(before), F.lit(start) + F.coalesce(x, F.lit(0.0))).otherwise(at)
        out = F.when(place % len(schedules) == i, at).otherwise(out)
    return out


def planned(docs: DataFrame, weights: list[float] = WEIGHTS, schedules=SCHEDULES, max_epochs: int = MAX_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, place (of its source), start (the source's words before
    it), and occurrences, an array of (epoch, words, position), empty if the mix takes nothing of it; and the columns to carry,
    which tell apart documents of one id and size."""
    rows = stage(sized(docs, carry), "sized")
    sums = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    want = stage(targets(sums.select("source", "source_size"), weights, max_epochs), "targets")
    # a power of two of buckets for the largest source; the key's first digits name the bucket
    most = sums.agg(F.max("n")).first()[0] or 1
    digits = max(1, (max(1, most // BUCKET_ROWS) - 1).bit_length() // 4 + 1)
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("in_bucket").over(running), F.lit(0))).drop("in_bucket")
    named = want.withColumnRenamed("source", "s")
    buckets = buckets.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    buckets = stage(buckets.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"), "source-buckets")
    both = rows.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size", "doc_id", *carry).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # epoch e of the document covers the source's words from start + e * source_size
    words = F.round("target").cast("long")

    def occurrence(e: int) -> Column:
        at = F.col("start") + F.lit(e) * F.col("source_size")
        own = F.greatest(F.lit(0), F.least(F.col("size"), words - at))
        return F.struct(F.lit(e).alias("epoch"), own.alias("words"), position(at / F.nullif(words, F.lit(0)), F.col("place"), schedules).alias("position"))

    all_of = F.array(*[occurrence(e) for e in range(max_epochs)])
    both = both.withColumn("occurrences", F.filter(all_of, lambda x: x["words"] > 0))
    return both.select("doc_id", "source", "size", "source_size", "target", "place", "start", "occurrences", *carry)


def in_order(rows: DataFrame, position: str, *ties: str) -> DataFrame:
    """Training order: rows range-sorted by position.  Files written from them keep it, from file to file and row to row."""
    return rows.repartitionByRange(position, *ties).sortWithinPartitions(position, *ties)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, and occurrences, an array of
    (epoch, words, position), empty if the mix takes nothing of it.  Both come from the mix, which is written in training order."""
    plan = stage(planned(docs, **settings), "plan")
    key = ["place", "start", "size"]  # no two documents with words have one start in their source
    mix = stage(in_order(plan.select("doc_id", "source", *key, F.inline("occurrences")), "position", *key, "epoch"), "mix")
    own = mix.groupBy(*key).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("epoch", "words", "position"))).alias("found"))
    none = F.array().cast(plan.schema["occurrences"].dataType)
    rows = plan.drop("occurrences").join(own, key, "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("found", none).alias("occurrences"))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """docs' rows as often as the mix takes them, in training order.  The one document of a source that is taken in part
    comes whole if the mix takes half of it at least.

    A digest of all columns names a row, so rows of one name are equal and it doesn't matter which of them comes: reruns
    agree, and n equal rows come as often as the mix takes all n.
    """
    named = aside(docs, ("doc_id", "text", "source"))
    every = [F.col(c) for c in named.columns]
    every += [c.isNull() for c in every]
    rows = named.withColumn("__h1", F.xxhash64(*every)).withColumn("__h2", F.xxhash64(F.lit("2"), *every))
    mix = planned(rows, **settings, carry=("__h1", "__h2"))
    whole = F.filter("occurrences", lambda x: 2 * x["words"] >= F.col("size"))
    taken = stage(mix.select("__h1", "__h2", F.inline(whole)).select("__h1", "__h2", F.col("position").alias("__at"), "epoch"), "mix")
    joined = rows.dropDuplicates(["__h1", "__h2"]).join(taken, ["__h1", "__h2"])
    return in_order(joined, "__at", "__h1", "__h2", "epoch").select(*named.columns).toDF(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(table(spark, sf_dir, "documents"))
    first = F.round(F.array_min("occurrences.position"), 6).alias("position")
    return mix.select("doc_id", "size", "source_size", "target", "taken", first)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS filled FROM p),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(filled) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY filled / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT level FROM l WHERE level * weight <= filled ORDER BY filled / weight, place LIMIT 1),
t AS (SELECT source, place, source_size, least(filled, coalesce((SELECT level FROM v) * weight, filled)) AS target FROM l),
o AS (SELECT d.doc_id, d.size, t.place, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST(greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - source_size)) + greatest(0, least(size, words - start - 2 * source_size)) AS BIGINT) AS taken,
             start / CAST(nullif(words, 0) AS DOUBLE) AS f FROM o)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE
  WHEN place % 3 = 0 THEN 2 * f / (CAST(1.5 AS DOUBLE) + sqrt(greatest(CAST(0 AS DOUBLE), CAST(2.25 AS DOUBLE) - 2 * f)))
  WHEN place % 3 = 2 THEN 2 * f / (CAST(0.5 AS DOUBLE) + sqrt(greatest(CAST(0 AS DOUBLE), CAST(0.25 AS DOUBLE) + 2 * f)))
  WHEN f >= 0.5 THEN CAST(0.5 AS DOUBLE) + 2 * (f - 0.5) / (CAST(1.25 AS DOUBLE) + sqrt(greatest(CAST(0 AS DOUBLE), CAST(1.5625 AS DOUBLE) - 2 * (f - 0.5))))
  ELSE 2 * f / (CAST(0.75 AS DOUBLE) + sqrt(greatest(CAST(0 AS DOUBLE), CAST(0.5625 AS DOUBLE) + 2 * f))) END, 6) END AS position
FROM x
"""
