"""Toxic passages by maximum-scoring segments with extreme-value calibration (operator 5).

Learning: in how many toxic and other labelled documents a word, and each beginning of PREFIXES characters, occurs.  Its
log-odds have a Dirichlet prior for each class in proportion to its frequency over both, which draws rare words to zero; those
whose log-odds stand so many standard errors above zero that less than one unit is expected to by chance make the lexicon; a word is scored as itself or as one of its
beginnings, whichever says more.  A toxic passage is taken to have DENSITY of lexicon words.  So a lexicon word scores the log of its share in such a passage over its share in other text, and any other
word a small negative amount; these are log-odds of two distributions, hence the scale of their extreme values is 1.

Search: all maximal scoring segments of a text in one pass (Ruzzo and Tompa), in linear time: each keeps a pointer to the next
one on its left that begins lower, so none is looked at twice.

Calibration: by chance a text of n words has K n exp(-lambda S) segments of a score above S.  Lambda and K are estimated from the
segments of the labelled documents that aren't toxic: scores above their median are exponential beyond it, and their number
gives K.  Every segment of which less than one is expected is a significant passage.  A document's statistic is that of
its best r segments together, for the r that makes chance least likely (sums of extreme values, Karlin and
Altschul); no number of passages bounds r.  A logistic curve of the statistic, fitted on counts of the labelled documents by
bins of it, makes it a score.

Labels are learnt only where crc32(doc_id) mod 5 is not 0, on a sample of about FIT_ROWS documents of each class, chosen by
a hash of the id; so what is broadcast to find them, and the lexicon, are bounded.  Words of all their whole texts count, and
every document is scored over its whole text.

Nulls and odd input: a null or empty text has no words and the least score of all; null labels are no labels; a doc_id labelled
twice is toxic if one label says so; a null doc_id counts as the empty text in crc32, so it is held out; without labels
of both classes every score is 0; repeated rows repeat results; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import stage, table, terms

FOLDS, FIT_ROWS = 5, 20_000
PREFIXES, MIN_DOCS = (3, 4, 5, 6), 3
PRIOR, SHARE_PRIOR, UPPER, DENSITY = 0.1, 0.01, 1.64, 0.2
#: Words a task counts before it passes its counts on; it bounds memory only.
FLUSH = 400_000
#: Words whose scores a worker remembers.
CACHE = 300_000
BINS = 400


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, y) of about fit_rows labelled documents of each class outside the held-out fold."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    own = own.filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    most = F.when(F.col("y") == 1, int(1e6 * min(1, fit_rows / max(1, n.get(1, 0))))).otherwise(int(1e6 * min(1, fit_rows / max(1, n.get(0, 0)))))
    return own.filter(at < most)


def units_of(word: bytes) -> list[str]:
    """The word, and its beginnings with their length in front; ^ is in no word."""
    w = word.decode("utf-8", "surrogatepass")
    return [w, *(f"^{k}{w[:k]}" for k in PREFIXES if len(w) > k)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        units = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.string()), "y1": pa.array([counts[1][u] for u in units], pa.int64()), "y0": pa.array([counts[0][u] for u in units], pa.int64())})
        for c in counts:
            c.clear()
        return out

    for b in batches:
        for t, y in zip(b.column("text"), b.column("y").to_pylist(), strict=True):
            words = set(terms(t.as_py()))
            counts[y].update({u for w in words for u in units_of(w)})
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield flush()
    yield flush()


def lexicon(docs: DataFrame, chosen: DataFrame) -> tuple[dict[str, float], float]:
    """Scores of lexicon units and that of other words, from documents and the labelled sample (doc_id, y)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    counts = own.select("text", "y").mapInArrow(_count, "unit string, y1 long, y0 long").groupBy("unit").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    kind = F.when(F.startswith("unit", F.lit("^")), F.substring("unit", 2, 1)).otherwise("w")
    counts = stage(counts.withColumn("kind", kind), "counts")
    sums = {r.kind: (r.n1, r.n0, r.units) for r in counts.groupBy("kind").agg(F.sum("y1").alias("n1"), F.sum("y0").alias("n0"), F.count("*").alias("units")).collect()}
    out: dict[str, float] = {}
    other = math.log(1 - DENSITY)
    for kind, (n1, n0, units) in sorted(sums.items()):
        if not n1 or not n0:
            continue
        # a class's prior: PRIOR times its units, shared out by the frequency over both classes
        share = (F.col("y1") + F.col("y0")) / (n1 + n0)
        prior = {y: PRIOR * n * share for y, n in (("y1", n1), ("y0", n0))}
        odds = {y: F.log((F.col(y) + prior[y]) / ((1 + PRIOR) * n - F.col(y) - prior[y])) for y, n in (("y1", n1), ("y0", n0))}
        delta = odds["y1"] - odds["y0"]
        z = delta / F.sqrt(1 / (F.col("y1") + prior["y1"]) + 1 / (F.col("y0") + prior["y0"]))
        rows = counts.filter((F.col("kind") == kind) & (F.col("y1") >= MIN_DOCS) & (z >= NormalDist().inv_cdf(1 - 1 / (units + 1)))).select("unit", "y1", "y0").collect()
        in_toxic = sum(r.y1 for r in rows)
        for r in rows:
            inside = DENSITY * r.y1 / in_toxic
            seen = r.y0 + SHARE_PRIOR * (r.y1 + r.y0)
            outside = (seen + UPPER * math.sqrt(seen + 1)) / n0
            if (score := math.log(inside / outside)) > 0:
                out[r.unit] = score
    return out, other


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score), in linear time."""
    # first, end, sum before first, sum up to end, and the next one on the left whose sum before first is less
    found: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        first, before = i, total
        total += s
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, i + 1, before, total, j))
                break
            first, _, before, _, left = found[j]
            del found[j:]
            j = left
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


class WordScores(dict):
    """Scores by word, 0 for words outside the lexicon; remembers CACHE of them."""

    def __init__(self, lex: dict[str, float]):
        super().__init__()
        self.lex = lex

    def __missing__(self, word: bytes) -> float:
        get = self.lex.get
        score = max(get(u, 0.0) for u in units_of(word))
        if len(self) < CACHE:
            self[word] = score
        return score


def passages(words: list[bytes], scores: WordScores, other: float) -> list[tuple[int, int, float]]:
    """Maximal segments of a text as (first word, end, score); words between hits are one step of the scan."""
    hits = [(i, s) for i, w in enumerate(words) if (s := scores[w])]
    steps: list[float] = []
    places: list[int] = []
    end = 0
    for i, s in hits:
        if i > end:
            steps.append(other * (i - end))
            places.append(end)
        steps.append(s)
        places.append(i)
        end = i + 1
    return [(places[a], places[b - 1] + 1, s) for a, b, s in maximal_segments(steps)]


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, other = model.value
        scores = WordScores(lex)
        for b in batches:
            sizes, spans = [], []
            for t in b.column("text"):
                words = terms(t.as_py())
                sizes.append(len(words))
                spans.append([{"first": a, "end": e, "score": s} for a, e, s in passages(words, scores, other)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS)], names=["doc_id", "n", "segments"])

    return run


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def chance(clean: DataFrame) -> tuple[float, float]:
    """(lambda, K) from texts (n, segments) without toxic passages; (1, 1) where they have too few segments to tell."""
    each = clean.select(F.explode("segments.score").alias("s"))
    middle = each.agg(F.percentile("s", F.lit(0.5))).first()[0]
    if middle is None:
        return 1.0, 1.0
    beyond, n, mean = each.agg(F.count_if(F.col("s") > middle), F.count("*"), F.avg(F.when(F.col("s") > middle, F.col("s") - middle))).first()
    words = clean.agg(F.sum("n")).first()[0]
    rate = 1 / max(mean or 1.0, 1e-6) if beyond >= MIN_DOCS else 1.0
    return rate, max(beyond, 1) * math.exp(rate * middle) / max(words, 1)


def statistic(n: Column, segments: Column, rate: float, k: float) -> Column:
    """-ln of the probability of a text's best segments by chance, for the number of them that makes it least; 0 without a segment."""
    level = F.log(F.lit(k) * F.greatest(n, F.lit(10)))
    normal = F.transform(F.reverse(F.array_sort(segments["score"])), lambda s: F.lit(rate) * s - level)
    first = F.coalesce(F.get(normal, F.lit(0)), -level)
    # of one segment: 1 - exp(-exp(-x)), which is exp(-x) for large x
    one = F.when(first > 30, first).otherwise(-F.log(-F.expm1(-F.exp(-F.least(first, F.lit(30.0))))))
    start = F.struct(F.lit(0).alias("r"), F.lit(0.0).alias("t"), F.lit(0.0).alias("f"), one.alias("best"))

    def step(a: Column, x: Column) -> Column:
        # of r segments with sum t: exp(-t) t^(r-1) / (r! (r-1)!)
        r, t = a["r"] + 1, a["t"] + x
        f = a["f"] + F.log(r.cast("double")) + F.when(r > 2, F.log((r - 1).cast("double"))).otherwise(0.0)
        together = t - (r - 1) * F.log(F.greatest(t, F.lit(1.0))) + f
        return F.struct(r.alias("r"), t.alias("t"), f.alias("f"), F.when((r > 1) & (x > 0), F.greatest(a["best"], together)).otherwise(a["best"]).alias("best"))

    return F.aggregate(F.filter(normal, lambda x: x > 0), start, step)["best"]


def logistic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a + b x))) for counts by bin, with a slight ridge so that separable bins converge."""
    mean, spread = np.average(x, weights=n), 1.0
    spread = math.sqrt(np.average((x - mean) ** 2, weights=n)) or 1.0
    z, w = (x - mean) / spread, np.zeros(2)
    design = np.stack([np.ones_like(z), z], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (ones - n * p) - 1e-2 * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - w[1] * mean / spread), float(w[1] / spread)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and passages: (first word, end, score) of each significant one."""
    spark = docs.sparkSession
    chosen = stage(sample(labels), "labelled")
    model = spark.sparkContext.broadcast(lexicon(docs, chosen))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage(own.mapInArrow(_score(model), "doc_id long, n long, segments array<struct<first: long, end: long, score: double>>"), "segments")
    rate, k = chance(found.join(F.broadcast(chosen.filter("y = 0")), "doc_id"))
    level = F.log(F.lit(k) * F.greatest("n", F.lit(10)))
    passages = F.filter("segments", lambda s: F.lit(rate) * s["score"] > level)
    rows = found.select("doc_id", statistic(F.col("n"), F.col("segments"), rate, k).alias("x"), passages.alias("passages"))
    known = rows.join(F.broadcast(chosen), "doc_id").select("x", "y")
    edge = known.agg(F.min("x"), F.max("x"), F.sum("y"), F.count("*")).first()
    if edge[3] and 0 < edge[2] < edge[3]:
        step = max((edge[1] - edge[0]) / BINS, 1e-9)
        bins = known.groupBy(F.floor((F.col("x") - edge[0]) / step).alias("bin")).agg(F.avg("x").alias("x"), F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()
        a, b = logistic(*(np.array([float(r[c]) for r in bins]) for c in ("x", "n", "ones")))
        score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(max(b, 1e-9)) * F.col("x"))))
    else:
        score = F.lit(0.0)
    out = rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), "passages")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
