"""Benchmark decontamination by BM25 with block-max WAND (operator 10).

The test items make an inverted index.  An item's impacts are divided by the score it would give itself, so a score is the
share of the item's BM25 weight that a passage holds, and one threshold serves all items.  Items are in classes by length, a
class being at most twice as long as the one before, and in blocks of BLOCK; a term has its largest impact for each block
it is in.  For each class a training text is cut into overlapping passages such that every stretch as long as the
class's longest item lies whole in one of them, and each passage is a query:

1. a bound from each term's largest impact anywhere; a passage below the threshold can hold no item and is passed over;
2. bounds from the block maxima; blocks below the threshold are passed over;
3. inside a block left, posting lists are walked in document order by WAND: terms in order of their current item, the pivot
   is where the maxima reach the threshold, items before it are skipped, the pivot's score is computed in full.

The bounds never fall short of a score, so all items above the threshold are retrieved.  Each is then verified on the words:
the share of the item's five-word shingles that the passage has, the same for its question (all but the last
sentence) and answer (the last).  A text is contaminated if it has 0.8 of an item's shingles, or 0.8 of the question's and
half of the answer's.

The index is broadcast in parts of at most PART_WORDS words of items (a longer item alone); it holds a number a posting, so
its memory grows with a part's words, and more items take more passes.

Nulls and odd input: a null or empty text has no hits; null and empty items, and those without a word, are left out; an item
of fewer than five words is one shingle.  Items of one text are all named.  Repeated rows each have a result;
an empty table gives none.  An item_id that is null is left out, as it can't be named.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import aside, table, terms

K1, B, THRESHOLD, SHINGLE, SIMILAR, ANSWER = 1.2, 0.75, 0.5, 5, 0.8, 0.5
#: Items in a block, words of items in a part of the index, and words of items that are all of the shortest class.
BLOCK, PART_WORDS, LEAST = 4, 200_000, 127
HITS = "array<struct<item_id: bigint, bm25: double, overlap: double, question: double, answer: double>>"
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(size)), strict=False)) or {tuple(words)}


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words before its last sentence, and those of it; a single sentence is cut in the middle."""
    parts = [terms(p) for p in _SENTENCE.split(text)]
    parts = [p for p in parts if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


class Blocks:
    """Items of like lengths in blocks of BLOCK, with their postings: impacts by term, then block, then item.

    tops: a term's largest impact anywhere; an entry is a term in a block, with its largest impact there and its postings.
    """

    def __init__(self, impacts: list[tuple[int, dict[int, float]]], n_terms: int, longest: int):
        self.stride, self.n_blocks = longest, -(-len(impacts) // BLOCK)
        rows = np.array([(t, i // BLOCK, d) for i, (d, own) in enumerate(impacts) for t in own], np.int64).reshape(-1, 3)
        score = np.array([x for _, own in impacts for x in own.values()], np.float64)
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        (term, block, self.items), self.scores = rows[order].T, score[order]
        first = np.flatnonzero(np.diff(term * self.n_blocks + block, prepend=-1))
        self.posting = np.append(first, len(term))
        self.block, self.most = block[first], np.maximum.reduceat(self.scores, first) * (1 + 1e-9)
        self.entry = np.searchsorted(term[first], np.arange(n_terms + 1))
        self.tops = np.zeros(n_terms + 1)  # the last is for unknown words
        np.maximum.at(self.tops, term[first], self.most)
        self.top, self.unknown = self.tops.tolist(), {n_terms}

    def retrieve(self, passage: list[int], threshold: float) -> dict[int, float]:
        """Items whose score is at least the threshold, for a passage's term numbers."""
        known = set(passage)
        if sum(map(self.top.__getitem__, known)) < threshold:
            return {}
        query = np.fromiter(known.difference(self.unknown), np.int64)
        low = self.entry[query]
        n = self.entry[query + 1] - low
        entries = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
        blocks = self.block[entries]
        found: dict[int, float] = {}
        bounds = np.bincount(blocks, self.most[entries], self.n_blocks)
        for b in np.flatnonzero(bounds >= threshold):
            found |= self._wand(entries[blocks == b].tolist(), threshold)
        return found

    def _wand(self, entries: list[int], threshold: float) -> dict[int, float]:
        lists = []
        for e in entries:
            a, b = self.posting[e], self.posting[e + 1]
            lists.append([0, list(zip(self.items[a:b].tolist(), self.scores[a:b].tolist(), strict=True)), self.most[e]])
        found: dict[int, float] = {}
        while lists:
            lists.sort(key=lambda x: x[1][x[0]][0])
            total = 0.0
            for x in lists:
                total += x[2]
                if total >= threshold:
                    pivot = x[1][x[0]][0]
                    break
            else:
                break
            if lists[0][1][lists[0][0]][0] == pivot:
                score = 0.0
                for x in lists:
                    if x[1][x[0]][0] == pivot:
                        score += x[1][x[0]][1]
                        x[0] += 1
                if score >= threshold:
                    found[pivot] = score
            else:
                for x in lists:
                    while x[0] < len(x[1]) and x[1][x[0]][0] < pivot:
                        x[0] += 1
            lists = [x for x in lists if x[0] < len(x[1])]
        return found


class Index:
    """Items by length, each class of them with its own blocks and its own length of passages; memory grows with the items' words."""

    def __init__(self, items: list[tuple[int, str]]):
        words = [terms(t) for _, t in items]
        # items that share words lie side by side, so block maxima are close to what one item holds
        order = sorted((i for i in range(len(items)) if words[i]), key=lambda i: (sorted(Counter(words[i]).items(), key=lambda x: (-x[1], x[0]))[0], items[i][0], i))
        self.ids = [items[i][0] for i in order]
        self.words = [words[i] for i in order]
        self.parts = [question_answer(items[i][1]) for i in order]
        n, mean = len(order), sum(map(len, self.words)) / max(1, len(order))
        seen = Counter(w for ws in self.words for w in set(ws))
        idf = {w: math.log1p((n - c + 0.5) / (c + 0.5)) for w, c in seen.items()}
        self.vocab = {w: i for i, w in enumerate(sorted(seen))}
        classes: dict[int, list[tuple[int, dict[int, float]]]] = defaultdict(list)
        for d, ws in enumerate(self.words):
            own = {self.vocab[w]: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean)) for w, tf in Counter(ws).items()}
            whole = sum(own.values())
            classes[max(LEAST, len(ws) - 1).bit_length()].append((d, {t: x / whole for t, x in own.items()}))
        self.classes = [Blocks(c, len(self.vocab), max(len(self.words[d]) for d, _ in c)) for _, c in sorted(classes.items())]

    def numbers(self, words: list[bytes]) -> list[int]:
        get, none = self.vocab.get, len(self.vocab)
        return [get(w, none) for w in words]

    def _verified(self, near: list[bytes], scores: dict[int, float]) -> Iterator[tuple[int, dict]]:
        own: dict[int, set[tuple[bytes, ...]]] = {}

        def share(want: list[bytes]) -> float:
            wanted = shingles(want)
            if not wanted:
                return 1.0
            size = min(SHINGLE, len(want))
            if size not in own:
                own[size] = shingles(near, size)
            return sum(s in own[size] for s in wanted) / len(wanted)

        for d, score in scores.items():
            overlap, (question, answer) = share(self.words[d]), map(share, self.parts[d])
            if overlap >= SIMILAR or question >= SIMILAR and answer >= ANSWER:
                yield d, {"item_id": self.ids[d], "bm25": score, "overlap": overlap, "question": question, "answer": answer}

    def hits(self, text: str | None, threshold: float = THRESHOLD) -> list[dict]:
        """Verified items of a text, by item id, each with its best passage."""
        words = terms(text)
        if not words or not self.ids:
            return []
        numbers = self.numbers(words)
        places = np.array(numbers)
        best: dict[int, dict] = {}
        for c in self.classes:
            # 1: a bound of every passage of 2 * stride words, repeats included
            starts = np.arange(0, max(1, len(words) - c.stride), c.stride)
            sums = np.append(np.add.reduceat(c.tops[places], np.arange(0, len(words), c.stride)), 0.0)
            bounds = sums[: len(starts)] + sums[1 : len(starts) + 1]
            for a in starts[bounds >= threshold].tolist():
                scores = c.retrieve(numbers[a : a + 2 * c.stride], threshold)
                for d, hit in self._verified(words[a : a + 2 * c.stride], scores) if scores else ():
                    if d not in best or (hit["overlap"], hit["bm25"]) > (best[d]["overlap"], best[d]["bm25"]):
                        best[d] = hit
        by_id: dict[int, dict] = {}
        for hit in best.values():
            if hit["item_id"] not in by_id or hit["overlap"] > by_id[hit["item_id"]]["overlap"]:
                by_id[hit["item_id"]] = hit
        return [by_id[i] for i in sorted(by_id)]


_HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), *((c, pa.float64()) for c in ("bm25", "overlap", "question", "answer"))]))


def _search(index):
    def run(texts: pa.Array) -> pa.Array:
        own = index.value
        return pa.array([own.hits(t.as_py()) for t in texts], _HIT_TYPE)

    return run


def item_parts(benchmark: DataFrame, part_words: int = PART_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of at most part_words words (a longer item alone), one part at a time on the driver.

    Only sizes come first; each part is then read by its range of ids, so the driver never holds more than a part.
    """
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = F.size(F.split("text", r"\s+")).cast("long")
    total = own.agg(F.coalesce(F.sum(size), F.lit(0)), F.min("item_id"), F.max("item_id")).first()
    todo = [(total[1], total[2], total[0])] if total[0] else []
    while todo:
        low, high, n = todo.pop()
        inside = own.filter(F.col("item_id").between(low, high))
        if n <= part_words or low == high:
            yield [(r.item_id, r.text) for r in inside.orderBy("item_id", "text").toLocalIterator()]
            continue
        middle = (low + high) // 2
        left = inside.filter(F.col("item_id") <= middle).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
        todo += [(a, b, m) for a, b, m in ((middle + 1, high, n - left), (low, middle, left)) if m]


def with_hits(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """docs with the column found, the verified items of each row's text; docs has no column of that name.  Workers get texts and
    give hits, nothing else."""
    spark = docs.sparkSession
    found = F.array().cast(HITS)
    for items in item_parts(benchmark, part_words):
        index = spark.sparkContext.broadcast(Index(items))
        found = F.concat(found, F.arrow_udf(_search(index), HITS).asNondeterministic()(F.col("text").cast("string")))  # not run twice, by the filter and for what it keeps
    return docs.withColumn("found", found)


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item."""
    own = aside(docs, ("text",))
    return with_hits(own, benchmark).filter(F.size("found") == 0).select(*own.columns).toDF(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_hits(docs, table(spark, sf_dir, "benchmark")).filter(F.size("found") > 0)
    return found.select(
        "doc_id",
        F.col("found.item_id").alias("item_ids"),
        F.size("found").cast("long").alias("n_items"),
        F.round(F.array_max("found.overlap"), 6).alias("overlap"),
        F.round(F.array_max("found.question"), 6).alias("question_overlap"),
        F.round(F.array_max("found.answer"), 6).alias("answer_overlap"),
        F.round(F.array_max("found.bm25"), 6).alias("bm25"),
    )
