"""Learned scores: shortcut probes, a pluggable scorer, federated logistic regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.functions import text as tx
from hearken.operators import evaluate, federate, relate


def char_grams(c: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside words, a space at both ends of each."""
    padded = F.transform(tx.words(F.lower(c)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, F.lit(n)))
    return F.flatten(F.transform(padded, lambda w: F.flatten(F.array(*[of(w, n) for n in range(low, high + 1)]))))


def _bucket(term: bytes, features: int) -> int:
    """The place of a term as HashingTF has it: Murmur3 with seed 42."""
    low, h = 0xFFFFFFFF, 42
    for i in range(0, len(term), 4):
        k = int.from_bytes(term[i : i + 4], "little") * 0xCC9E2D51 & low
        h ^= (k << 15 | k >> 17) * 0x1B873593 & low
        if i + 4 <= len(term):
            h = ((h << 13 | h >> 19) & low) * 5 + 0xE6546B64 & low
    h ^= len(term)
    h = (h ^ h >> 16) * 0x85EBCA6B & low
    h = (h ^ h >> 13) * 0xC2B2AE35 & low
    h ^= h >> 16
    return (h - (h >> 31 << 32)) % features


def _gram_counts(words: list[str], ends: list[int], known: dict[str, np.ndarray], places: dict[str, int], low: int, high: int, features: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and counts of the character n-grams of the first so many words, for each of ends."""
    for w in words:
        if w not in known:
            p = f" {w} "
            grams = [p[i : i + n] for n in range(low, high + 1) for i in range(max(1, len(p) - n + 1))]
            for g in grams:
                if g not in places:
                    places[g] = _bucket(g.encode("utf-8", "surrogatepass"), features)
            known[w] = np.array([places[g] for g in grams], dtype=np.int32)
    each = [known[w] for w in words]
    return [np.unique(np.concatenate(each[:e]), return_counts=True) for e in ends]


def staged(rows: DataFrame, vectors: list[str]) -> DataFrame:
    """rows written and read again, vectors (structs of type, size, indices, values) as ML has them."""
    out = relate.checkpointed(rows)
    kinds = T.StructType([T.StructField(f.name, VectorUDT()) if f.name in vectors else f for f in out.schema])
    return rows.sparkSession.read.schema(kinds).parquet(*out.inputFiles())


def prefix_gram_counts(rows: DataFrame, text: str, prefixes: dict[str, int | None], low: int = 2, high: int = 4, features: int = 1 << 16) -> DataFrame:
    """rows without a text of words, in lower case, between single spaces, and with a vector for each prefix (so many of the words, all
    for None): what HashingTF counts of its char_grams.  The texts are gone through once, and grams are hashed once a task."""
    vector = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        places: dict[str, int] = {}
        for b in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            found: dict[str, list] = {name: [] for name in prefixes}
            for x in b.column(text).to_pylist():
                for seen, most in ((known, 200_000), (places, 1_000_000)):  # a bound of the memory only
                    if len(seen) > most:
                        seen.clear()
                words = x.split(" ")
                ends = [len(words) if k is None else min(k, len(words)) for k in prefixes.values()]
                for name, got in zip(prefixes, _gram_counts(words, ends, known, places, low, high, features), strict=True):
                    found[name].append(got)
            own = [c for c in b.schema.names if c != text]
            columns = [b.column(c) for c in own]
            for pairs in found.values():
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(i) for i, _ in pairs])]), pa.int32())
                indices = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([i for i, _ in pairs] or [[]]), pa.int32()))
                values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([c for _, c in pairs] or [[]]), pa.float64()))
                columns.append(pa.StructArray.from_arrays([pa.array(np.zeros(len(b)), pa.int8()), pa.array(np.full(len(b), features), pa.int32()), indices, values], fields=list(vector)))
            yield pa.RecordBatch.from_arrays(columns, names=own + list(prefixes))

    kind = VectorUDT.sqlType()
    schema = T.StructType([f for f in rows.schema if f.name != text] + [T.StructField(name, kind) for name in prefixes])
    return staged(rows.mapInArrow(run, schema), list(prefixes))


def probe_counts(train: DataFrame, test: DataFrame, counts: str, c: float, min_docs: int = 2) -> DataFrame:
    """AUC on test of a logistic regression on TF-IDF of a column of counted terms, which should be at hand: it is read many times."""
    n = train.count()
    stages = [IDF(inputCol=counts, outputCol="x", minDocFreq=min_docs), LogisticRegression(featuresCol="x", labelCol="label", maxIter=100, regParam=1 / (c * max(1, n)))]
    model = Pipeline(stages=stages).fit(train.select(counts, F.col("label").cast("double").alias("label")))
    out = model.transform(test.select(counts, F.col("label").cast("double").alias("label")))
    return evaluate.roc_auc(out.select(F.col("label").cast("int").alias("label"), F.round(vector_to_array("probability")[1], 9).alias("peak")))


def probe(train: DataFrame, test: DataFrame, tokens: str, c: float, features: int = 1 << 16, min_docs: int = 2) -> DataFrame:
    """AUC on test of a logistic regression on TF-IDF of a column of tokens: above a limit, that view gives the class away."""
    hashed = HashingTF(inputCol=tokens, outputCol="tf", numFeatures=features)
    return probe_counts(*[relate.checkpointed(hashed.transform(x.select(tokens, "label")).select("tf", "label")) for x in (train, test)], "tf", c, min_docs)


def scorer(prefixes: DataFrame, score: Callable[[list[str]], list[float]], text: str = "text") -> DataFrame:
    """A model's score for each prefix: `score` gets the texts of a batch, shortest first, as padding costs least so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            order = b[text].str.len().argsort(kind="stable").to_numpy()
            got = np.empty(len(b))
            got[order] = score(b[text].iloc[order].tolist())
            yield b.assign(p=got)

    return prefixes.mapInPandas(run, prefixes.withColumn("p", F.lit(0.0)).schema)


def retried(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` on all rows (key -> key, result, ok), `again` on those not ok; ok ones of the second pass replace them."""
    first = work(rows)
    second = again(rows.join(first.filter("not ok").select(key), key, "left_semi")).select(key, F.col("result").alias("r2"), F.col("ok").alias("ok2"))
    return first.join(second, key, "left").select(key, F.when(F.col("ok2"), F.col("r2")).otherwise(F.col("result")).alias("result"), (F.col("ok") | F.coalesce("ok2", F.lit(False))).alias("ok"))


def best_epoch(reports: DataFrame) -> DataFrame:
    """The epoch with the largest (early share, recall, AUC); of equals the first."""
    return reports.orderBy(F.desc("early"), F.desc("recall"), F.desc("auc"), "epoch").limit(1)


def gradients(rows: DataFrame, weights: dict[int, list[float]], dims: int) -> dict[int, tuple[np.ndarray, int]]:
    """Sums of a logistic regression's gradients, and rows, by bank.  rows: bank, x (array), y.  Each task sums its rows, so what
    moves is a vector a bank and task, however many rows a bank has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for bank, part in b.groupby("bank"):
                x = np.column_stack([np.stack(part["x"].to_numpy()).astype(float), np.ones(len(part))])
                p = 1 / (1 + np.exp(-np.clip(x @ np.array(weights[bank]), -30, 30)))
                g = x.T @ (p - part["y"].to_numpy())
                sums[bank] = sums.get(bank, np.zeros(dims + 2)) + np.append(g, len(part))
        if sums:  # a task may have no rows, and Arrow takes no empty column as one of arrays
            yield pd.DataFrame({"bank": list(sums), "v": [v.tolist() for v in sums.values()]})

    parts = rows.select("bank", "x", "y").mapInPandas(run, "bank int, v array<double>")
    total = parts.select("bank", F.posexplode("v").alias("pos", "g")).groupBy("bank", "pos").agg(F.sum("g").alias("g")).collect()
    out: dict[int, np.ndarray] = {}
    for r in total:
        out.setdefault(r.bank, np.zeros(dims + 2))[r.pos] = r.g
    return {k: (v[:-1], int(v[-1])) for k, v in out.items()}


def federated(rows: DataFrame, banks: list[int], dims: int, rounds: int = 3, local_steps: int = 2, rate: float = 1.0) -> dict[str, list[float]]:
    """Weights of the central model, of each bank's own and of their federated average, all from one start and of equal steps."""
    spark = rows.sparkSession
    start = [0.0] * (dims + 1)

    def steps(data: DataFrame, weights: dict[int, list[float]], n: int) -> tuple[dict[int, list[float]], dict[int, int]]:
        sizes: dict[int, int] = {}
        for _ in range(n):
            for bank, (g, size) in gradients(data, weights, dims).items():
                weights = weights | {bank: (np.array(weights[bank]) - rate * g / size).tolist()}
                sizes[bank] = size
        return weights, sizes

    central, _ = steps(rows.withColumn("bank", F.lit(-1)), {-1: start}, rounds * local_steps)
    local, _ = steps(rows, dict.fromkeys(banks, start), rounds * local_steps)
    shared = start
    for _ in range(rounds):
        own, sizes = steps(rows, dict.fromkeys(banks, shared), local_steps)
        states = spark.createDataFrame([(b, "w", own[b], sizes[b]) for b in sizes], "bank int, param string, vector array<double>, weight long")
        shared = [r.value for r in federate.fedavg(states).orderBy("pos").collect()]
    return {"central": central[-1], **{f"local_{b}": local[b] for b in banks}, "fedavg": shared}


def linear_scores(rows: DataFrame, models: dict[str, list[float]]) -> DataFrame:
    """(model, label, peak) of every row and model."""
    score = lambda w: F.aggregate(F.zip_with("x", F.array(*map(F.lit, w[:-1])), lambda a, b: a * b), F.lit(w[-1]), lambda s, v: s + v)
    each = F.array(*[F.struct(F.lit(k).alias("model"), F.round(score(w), 9).alias("peak")) for k, w in models.items()])
    return rows.select(F.col("y").alias("label"), F.inline(each))
