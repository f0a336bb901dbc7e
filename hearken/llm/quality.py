"""Quality rules with risk-controlled cutoffs (operator 8).

Every rule compares one measure of a text with a cutoff.  The cutoff is not set by hand: labelled good documents are a
holdout, and a cutoff is used in a stratum (a language) only if an exact binomial test shows that the rule's rate of
false rejections there is at most ``risk`` / number of rules.  Cutoffs are tested from the mildest to the strictest and
the test stops at the first that isn't shown (fixed sequence), so no correction is needed inside a sequence; over rules
and strata the level ``delta`` is divided by their number (Bonferroni).  With probability 1 - delta all cutoffs in use
hold their limit at once, so all rules together reject at most ``risk`` of a stratum's good documents.  Where a stratum
has too few labels to show anything, no rule of the method is used there.

Nulls and odd input: a null text has no words and fails the base rules; a null lang is a stratum of its own; null or
other labels than 0 and 1 are not counted; a doc_id labelled twice counts once, as good only if all its labels are.
Repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import aside, stage, table

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
RISK, DELTA = 0.03, 0.05
#: rule -> cutoffs from the mildest to the strictest; a document is rejected if its measure is above the cutoff.
RULES: dict[str, list[float]] = {
    "symbol_rate": [x / 50 for x in range(50, 0, -1)],  # symbols a word
    "dup_line_rate": [x / 50 for x in range(49, 0, -1)],  # of lines with a word
    "repeat_rate": [x / 50 for x in range(49, 0, -1)],  # of words
    "upper_rate": [x / 50 for x in range(49, 0, -1)],  # of words with two letters at least
    "bang_rate": [x / 50 for x in range(100, 0, -1)],  # ! and ? a word
    "long_words": [x / 2 for x in range(60, 10, -1)],  # code points a word
    "short_words": [-x / 4 for x in range(4, 20)],  # the same, negative
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(ids: list[int], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more; ids number a text's words, equal ones alike."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    width, now = 1, np.array(ids, np.int64)
    while width < window:  # numbers of stretches of 1, 2, 4, 8 words; exact, as pairs of numbers are numbered anew
        step = min(width, window - width)
        pairs = now[: len(now) - step] * (int(now.max()) + 1) + now[step:]
        now, width = np.unique(pairs, return_inverse=True)[1], width + step
    twice = np.flatnonzero(np.bincount(now)[now] > 1)
    if not len(twice):
        return 0
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[twice] += 1
    edges[twice + window] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measures(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts, and the measures of RULES in their order."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    dup_lines = len(lines) - len(set(lines))
    numbers: dict[bytes, int] = {}
    again = 0
    if n > WINDOW:
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        again = repeated(ids) if len(numbers) < n else 0
    chars = len(text) - spaces
    if n:
        upper = sum(w.isupper() for w in words if len(w) > 1)  # ASCII letters
        bangs = text.count("!") + text.count("?")
        rates = (symbols / n, dup_lines / len(lines), again / n, upper / n, bangs / n, chars / n, -chars / n)
    else:
        rates = (0.0,) * len(RULES)
    return (n, chars, symbols, dup_lines, again), rates


_MEASURES = pa.struct([*((c, pa.int64()) for c in BASE), ("rates", pa.list_(pa.float64()))])


def _measured(texts: pa.Array) -> pa.Array:
    base: list[tuple[int, ...]] = []
    rates: list[tuple[float, ...]] = []
    for t in texts:
        x, y = measures(t.as_py())
        base.append(x)
        rates.append(y)
    columns = [pa.array([x[i] for x in base], pa.int64()) for i in range(len(BASE))]
    return pa.StructArray.from_arrays([*columns, pa.array(rates, pa.list_(pa.float64()))], fields=list(_MEASURES))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts, the array rates, and base_failed; docs has no other column of these names.  Workers get texts
    and give measures, nothing else."""
    run = F.arrow_udf(_measured, ", ".join([*(f"{c} long" for c in BASE), "rates array<double>"]).join(["struct<", ">"])).asNondeterministic()  # not run anew for each field
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.withColumn("measures", run(F.col(text).cast("string"))).select("*", "measures.*").drop("measures").withColumn("base_failed", failed)


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from its largest term down."""
    if k >= n:
        return 1.0
    at = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total, i = 0.0, min(k, int(n * p))
    term = at(i)
    down, j = term, i
    while j >= 0 and down > 1e-18 * max(total, 1e-300):
        total += down
        down *= j * (1 - p) / ((n - j + 1) * p)
        j -= 1
    up = term
    for j in range(i + 1, k + 1):
        up *= (n - j + 1) * p / (j * (1 - p))
        total += up
        if up < 1e-18 * total:
            break
    return min(1.0, total)


def certified(n: int, false: list[int], risk: float, level: float) -> int:
    """How many cutoffs of a sequence pass one after the other, of n good documents `false` of which each rejects."""
    for i, k in enumerate(false):
        if tail(n, k, risk) > level:
            return i
    return len(false)


def _cutoffs(risk: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, (rule, cutoffs) in enumerate(RULES.items()):
            own = rows[rows["rule"] == i]
            false = dict(zip(own["cutoff"], own["false"], strict=True))
            n, level = int(rows["n"].iloc[0]), float(rows["level"].iloc[0])
            passed = certified(n, [int(false.get(j, 0)) for j in range(len(cutoffs))], risk, level) if n else 0
            out.append(cutoffs[passed - 1] if passed else math.inf)
        return pd.DataFrame({"stratum": [key[0]], "cutoffs": [out]})

    return run


def fit_cutoffs(rated: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """rated (doc_id, stratum, rates) and labels (doc_id, quality) -> (stratum, cutoffs), one row a stratum with labels.

    Counts cover every labelled document; a stratum's row of cutoffs is made from a histogram of fixed size.
    """
    good = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    held = rated.select(F.col("doc_id").cast("long").alias("doc_id"), "stratum", "rates").join(good, "doc_id")
    # the first so many cutoffs of a rule are too mild to reject a document, the others reject it
    above = lambda i: lambda x: x >= F.col("rates")[i]
    milder = F.array(*[F.size(F.filter(F.array(*map(F.lit, c)), above(i))) for i, c in enumerate(RULES.values())])
    rows = held.select("stratum", F.posexplode(milder).alias("rule", "milder"))
    counts = rows.groupBy("stratum", "rule", "milder").agg(F.count("*").alias("c"))
    steps = F.explode(F.array(*[F.struct(F.lit(j).alias("cutoff")) for j in range(max(map(len, RULES.values())))]))
    # cutoff j rejects those with milder <= j
    false = counts.select("stratum", "rule", "milder", "c", steps.alias("s")).filter("milder <= s.cutoff").groupBy("stratum", "rule", F.col("s.cutoff").alias("cutoff")).agg(F.sum("c").alias("false"))
    sizes = counts.filter("rule = 0").groupBy("stratum").agg(F.sum("c").alias("n"))
    tests = sizes.agg(F.count("*").alias("strata")).select((F.lit(delta) / F.greatest(F.lit(1), F.col("strata") * len(RULES))).alias("level"))
    per = sizes.crossJoin(tests)  # one row beside the strata
    joined = per.withColumnRenamed("stratum", "s").join(false, F.col("s").eqNullSafe(F.col("stratum")), "left")
    joined = joined.select(F.col("s").alias("stratum"), F.coalesce("rule", F.lit(-1)).alias("rule"), F.coalesce("cutoff", F.lit(-1)).alias("cutoff"), F.coalesce("false", F.lit(0)).alias("false"), "n", "level")
    return joined.groupBy("stratum").applyInPandas(_cutoffs(risk / len(RULES)), "stratum string, cutoffs array<double>")


def judged(rated: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """rated with kept: base rules first, then every rule whose cutoff holds in the row's stratum."""
    named = cutoffs.select(F.col("stratum").alias("cut_stratum"), "cutoffs")
    both = rated.join(named, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    rejected = F.exists(F.arrays_zip("rates", "cutoffs"), lambda x: x["rates"] > x["cutoffs"])
    return both.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(rejected, F.lit(False))).drop("cut_stratum", "cutoffs")


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang and others) that are kept, with docs' columns.  Texts are measured once, in a table
    with all columns, from which the cutoffs come and which is then filtered."""
    own = aside(docs, ("doc_id", "text", "lang"))
    rated = stage(measured(own).drop(*BASE).withColumn("stratum", F.col("lang").cast("string")), "rated")
    cutoffs = stage(fit_cutoffs(rated, labels), "cutoffs")
    return judged(rated, cutoffs).filter("kept").select(*own.columns).toDF(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("stratum"))
    rated = stage(measured(own).drop("text"), "rated")
    cutoffs = stage(fit_cutoffs(rated, table(spark, sf_dir, "labels")), "cutoffs")
    return judged(rated, cutoffs).select("doc_id", *BASE, "base_failed", "kept")
