"""SimHash near duplicates by covering locality-sensitive hashing (operator 7).

Each of the 64 bits gets one of the 2**(r+1) - 1 non-zero vectors of r+1 bits; for every such vector v a mask keeps the
bits whose vector has an odd product with v.  Any r differing bits have vectors that some v is orthogonal to, so under
that v's mask the two fingerprints are equal: each pair within the radius collides in some table, with certainty.

``classes`` links fingerprints of shingles within the radius and nothing else.  ``near_duplicates`` starts from these classes
and joins them further: texts that are alike by their five-word shingles, but whose fingerprints lie farther apart, are
found by an exact prefix filter.

Only distinct fingerprints are compared; copies count as one.  A bucket of more than BUCKET fingerprints is dealt anew by a
second covering of the bits its mask leaves out, after which a bucket's fingerprints agree in all but a dozen or so
bits, which bounds its size; inside a bucket every pair within the radius is found, and a spanning
forest of these links, at most one row a fingerprint, leaves the task.

Nulls and odd input: a null text is empty; a text without words has fingerprint zero, linked as any other.  A null doc_id
is never the smallest; a component of null ids only has a null component_id.  Repeated rows give repeated results; an
empty table gives none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearken.llm.common import aside, stage, table, words_of, workspace
from hearken.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Of near_duplicates: the shingles' words and the least similarity.
WORDS, SIMILAR = 5, 0.8
#: Of similar_links: slots that shingles are counted in, texts whose shingles leave Python at a time, pairs a row that are
#: compared without further rounds, and texts of a shingle that the others are held against in each round.
SLOTS, SLICE, FEW, HUBS = 1 << 22, 128, 8, (4, 64)
#: Texts of a shingle that are compared pair by pair at once; shingles of more texts go through the rounds.
WHOLE = 16
#: Bits of the filter that rows pass before an exact join by id: 8 MB, however many ids there are.
FILTER = 1 << 26
#: Distinct fingerprints that a first-level bucket may have before it is covered a second time.
BUCKET = 1024


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of 64-bit hashes, as a signed long."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 16):
        part = hashes[a : a + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def hashed(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included; of the whole sequence if it has fewer words."""
    from xxhash import xxh64_intdigest

    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.array([xxh64_intdigest(s, SEED) for s in shingles], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Of a text's shingles in A-Z lower-cased words; with shingle 0, of its distinct words."""
    words = [w.lower() for w in words_of(text)]  # bytes.lower() changes A-Z only
    if not words:
        return 0
    return majority(hashed(words, shingle) if shingle else hashed(list(set(words)), 1))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(t.as_py(), shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return run


def masks(radius: int, bits: list[int]) -> list[int]:
    """Covering masks over the given bit places: 2**(radius+1) - 1 of them, as unsigned integers.

    Any assignment of vectors covers; of a few regular ones the one is taken whose smallest mask keeps most bits.
    """
    n = 2 ** (radius + 1) - 1

    def of(step: int) -> list[int]:
        vectors = {b: 1 + (i * step) % n for i, b in enumerate(bits)}
        return [sum(1 << b for b, x in vectors.items() if (x & v).bit_count() & 1) for v in range(1, n + 1)]

    return max((of(step) for step in range(1, min(n, 16), 2)), key=lambda found: min(m.bit_count() for m in found))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@functools.cache
def _tables(radius: int) -> list[tuple[int, list[int]]]:
    """First-level masks, each with those of its second level: they keep its bits and cover the others."""
    out = []
    for m in masks(radius, list(range(BITS))):
        rest = [b for b in range(BITS) if not m >> b & 1]
        out.append((m, [m | x for x in masks(radius, rest)]))
    return out


def _keys(fp: Column, kept: list[int]) -> Column:
    all_masks = F.array(*[F.lit(_signed(m)).cast("long") for m in kept])
    return F.explode(F.transform(all_masks, lambda m, i: F.struct(i.alias("t"), fp.bitwiseAND(m).alias("k"))))


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join whatever pairs within the radius join, at most one less than there are fingerprints."""
    left = np.arange(len(fps))
    bits, links = fps.view(np.uint64), []
    while len(left):  # breadth-first from any one not yet reached
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            a = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[a]) <= radius
            reached = left[near]
            links += [(int(fps[a]), int(fps[b])) for b in reached]
            queue += reached.tolist()
            left = left[~near]
    return links


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for fps in b.column(0):
                found += forest(np.sort(fps.values.to_numpy()), radius)
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect all pairs within the radius."""
    tables = _tables(radius)
    keyed = fps.select("fp", _keys(F.col("fp"), [m for m, _ in tables])).select("fp", "col.t", "col.k")
    keyed = stage(keyed.withColumn("n", F.count("*").over(Window.partitionBy("t", "k"))).filter("n > 1"), "buckets")
    small = keyed.filter(F.col("n") <= bucket).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    # as many rows as the square of the number of tables: 49 for radius 2
    level = fps.sparkSession.createDataFrame([(i, 1000 * (i + 1) + j, _signed(m)) for i, (_, kept) in enumerate(tables) for j, m in enumerate(kept)], "t int, t2 int, mask long")
    dense = keyed.filter(F.col("n") > bucket).join(F.broadcast(level), "t").select("fp", "k", F.col("t2").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("k2"))
    large = dense.groupBy("t", "k", "k2").agg(F.collect_list("fp").alias("fps")).select("t", "k", "fps")
    groups = small.unionByName(large).filter(F.size("fps") > 1).select("fps")
    return groups.mapInArrow(_links(radius), "u long, v long")


def _nodes(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text -> (doc_id, fp) for each document, and (fp, least) for each fingerprint."""
    fps = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    return fps, stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text -> doc_id, fp (signed long), component_id: the smallest doc_id reachable over links."""
    fps, nodes = _nodes(docs, shingle)
    roots = components(links(nodes.select("fp"), radius, bucket))
    rooted = nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted")
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(whole, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def _parities(shingles: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles is i by its low bits; as many bits as the next power of two of their number."""
    bits = max(8, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount(shingles & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        yield pa.RecordBatch.from_pydict({"key": b.column("key"), "shingles": pa.array([_shingle_set(t.as_py()).view("<u8").tobytes() for t in b.column("text")], pa.binary())})


def _perhaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops pairs whose parities differ in more bits than alike sets differ in shingles; folded to the fewer bits of the two."""
    for b in batches:
        out = []
        for n, m, x, y in zip(b.column("n").to_pylist(), b.column("hub_n").to_pylist(), b.column("parities").to_pylist(), b.column("hub_parities").to_pylist(), strict=True):
            size = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, size)) for z in (x, y))
            out.append(int(np.bitwise_count(x ^ y).sum()) <= (n + m) * (1 - SIMILAR) / (1 + SIMILAR) + 1e-6)
        yield b.select(["key", "hub"]).filter(pa.array(out, pa.bool_()))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x, y in zip(b.column("shingles"), b.column("hub_shingles"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("hub"), pa.array(out, pa.bool_())], names=["key", "hub", "same"])


def _shingle_set(text: str | None) -> np.ndarray:
    return np.unique(hashed([w.lower() for w in words_of(text)], WORDS)).view("<i8")


def _shapes(slots: np.ndarray, counts: np.ndarray):
    """id, text -> a row (id, n, parities, heads) for each id of a batch: how many shingles its text has, and those of its prefix.

    The order of shingles is that of (the count of its slot if listed, h).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            at = dict(zip(b.column("id").to_pylist(), range(b.num_rows), strict=True))
            sizes, parities, heads = [], [], []
            for row in at.values():
                found = _shingle_set(b.column("text")[row].as_py())
                sizes.append(len(found))
                parities.append(_parities(found))
                of = found & (SLOTS - 1)
                place = np.minimum(np.searchsorted(slots, of), max(len(slots) - 1, 0))
                often = np.where(slots[place] == of, counts[place], 0) if len(slots) else np.zeros(len(of), np.int64)
                heads.append(found[np.lexsort((found, often))][: int(len(found) * (1 - SIMILAR) + 1e-6) + 1])
            yield pa.RecordBatch.from_pydict({"id": pa.array(list(at), pa.int64()), "n": pa.array(sizes, pa.int64()), "parities": pa.array(parities, pa.binary()), "heads": pa.array(heads, pa.list_(pa.int64()))})

    return run


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task -> counts of the slots that it meets twice or more, and of all shingles, as slot -1."""
    often, total = np.zeros(SLOTS, np.int32), 0
    for t in (t for b in batches for t in b.column("text")):
        found = _shingle_set(t.as_py())
        np.add.at(often, found & (SLOTS - 1), 1)
        total += len(found)
    for a in range(0, SLOTS, 1 << 16):
        twice = np.flatnonzero(often[a : a + (1 << 16)] > 1)
        yield pa.RecordBatch.from_pydict({"slot": twice + a, "c": often[twice + a].astype(np.int64)})
    yield pa.RecordBatch.from_pydict({"slot": pa.array([-1], pa.int64()), "c": pa.array([total], pa.int64())})


def _marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows with __maybe: whether key may be among ids (id), by one bit each of FILTER; where it is false, key certainly isn't.

    Rows that an exact join would drop needn't be shuffled for it.  The bits are at most FILTER / 2**15 rows of 4 kB, and so
    broadcast whatever the number of ids; with very many ids more rows pass, and the join drops them.
    """
    place = lambda c: F.col(c).bitwiseAND(FILTER - 1)
    low = lambda c: F.col(c).bitwiseAND((1 << 15) - 1)
    bits = stage(ids.groupBy(F.shiftright(place("id"), 15).alias("__of")).agg(F.bitmap_construct_agg(low("id")).alias("__bits")), "filter")
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(low(key), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[byte.bitwiseAND(1 << i) > 0 for i in range(8)]), (F.col(key).bitwiseAND(7) + 1).cast("int"))
    own = rows.withColumn("__of", F.shiftright(place(key), 15)).join(F.broadcast(bits), "__of", "left")
    return own.withColumn("__maybe", F.coalesce(bit, F.lit(False))).drop("__of", "__bits")


def _verified(pairs: DataFrame, shapes: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (key, hub) -> those alike, as links (u, v).  Most that aren't fall by their parities; whole shingle sets are made of
    the texts left only, one of the copies of each."""
    both = pairs.join(shapes.toDF("hub", "hub_n", "hub_parities"), "hub").join(shapes.toDF("key", "n", "parities"), "key").filter(_sizes_fit("n", "hub_n"))
    near = stage(both.select("key", "hub", "n", "hub_n", "parities", "hub_parities").mapInArrow(_perhaps, "key long, hub long"), "near")
    left = near.select("key").union(near.select("hub")).distinct()
    of = texts.join(left.withColumnRenamed("key", "id"), "id").select(F.col("id").alias("key"), F.col("least").alias("of"))
    near_rows = _marked(rows, "id", left.select(F.col("key").alias("id"))).filter("__maybe")
    chosen = near_rows.join(of, F.col("id").eqNullSafe(F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("key", "text")
    sets = stage(chosen.dropDuplicates(["key"]).mapInArrow(_sets, "key long, shingles binary"), "sets")
    hubs = sets.select(F.col("key").alias("hub"), F.col("shingles").alias("hub_shingles"))
    held = near.join(hubs, "hub").join(sets, "key").select("key", "hub", "shingles", "hub_shingles")
    return stage(held.mapInArrow(_alike, "key long, hub long, same boolean").filter("same").select(F.col("key").alias("u"), F.col("hub").alias("v")), "verified")


def _sizes_fit(n: Column | str, m: Column | str) -> Column:
    return F.least(n, m) >= SIMILAR * F.greatest(n, m)


def _places_fit(a: Column, b: Column) -> Column:
    """Whether sets of a.n and b.n shingles can be alike if their first common one is at places a.at and b.at of their orders: what
    both have from there on must be enough.  The first common shingle of two alike sets passes."""
    return _sizes_fit(a["n"], b["n"]) & (F.least(a["n"] - a["at"], b["n"] - b["at"]) >= (a["n"] + b["n"]) * (SIMILAR / (1 + SIMILAR)) - 1e-6)


def _candidates(labelled: DataFrame, hubs: int, k: int) -> DataFrame:
    """Pairs (key, hub) of ids of two labels that share a shingle at places where they can be alike: those with so many texts of
    each shingle, others for each k, or with 0 hubs all.  The join itself keeps to places that fit."""
    if hubs:
        order = Window.partitionBy("h").orderBy(F.xxhash64("id", F.lit(k)), "id")
        held = labelled.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= hubs).drop("r")
        once = F.col("a.id") != F.col("b.id")
    else:  # b has no more shingles than a; so little may stand before the shared one in b
        held = labelled.filter(F.col("n") - F.col("at") >= 2 * F.col("n") * (SIMILAR / (1 + SIMILAR)) - 1e-6)
        once = F.struct("b.n", "b.id") < F.struct("a.n", "a.id")
    a, b = ({c: F.col(f"{side}.{c}") for c in ("n", "at")} for side in "ab")
    fit = (F.col("a.h") == F.col("b.h")) & (F.col("a.label") != F.col("b.label")) & once & _places_fit(a, b)
    return labelled.alias("a").join(held.alias("b"), fit).select(F.greatest("a.id", "b.id").alias("key"), F.least("a.id", "b.id").alias("hub"))


def _frequent(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of shingles (their low bits) that are met far more often than others in a part of the texts, with counts.

    This sets the order of shingles only: any order finds all pairs, rare shingles first give fewer candidates.
    """
    part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(min(4, max(1, n >> 13)))) == 0).select("text")
    slots = stage(part.mapInArrow(_slot_counts, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")), "slots")
    mean = (slots.filter("slot < 0").agg(F.sum("c")).first()[0] or 0) / SLOTS
    got = slots.filter("slot >= 0").filter(F.col("c") > mean + 5 * mean**0.5 + 5).orderBy("slot").toPandas()
    return got["slot"].to_numpy(np.int64), got["c"].to_numpy(np.int64)


def _labelled(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries with label: the component of their id by the links found so far."""
    roots = components(found).select(F.col("u").alias("id"), F.col("v").alias("label"))
    return stage(entries.join(roots, "id", "left").select(*entries.columns, F.coalesce("label", "id").alias("label")), "labelled")


def covered_links(rows: DataFrame) -> DataFrame:
    """Rows (id, text) -> links (u, v) of ids: of those of one fingerprint to the least, and of these where the covering tables link
    their fingerprints.  Their components are those of ``classes``."""
    fps, nodes = _nodes(rows.select(F.col("id").alias("doc_id"), "text"), SHINGLE)
    same = fps.join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    u, v = (nodes.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_id")) for c in "uv")
    near = links(nodes.select("fp")).join(u, "u").join(v, "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
    return stage(same.unionByName(near).filter("u <> v").distinct(), "covered")


def similar_links(rows: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc_id, id, text), their distinct texts (id, least) and links (u, v) found before -> these and links of pairs of
    ids with SIMILAR of their shingles in common; together they connect all such pairs.

    Prefix filter: of n shingles in any common order, two alike texts share one of the first (1 - SIMILAR) * n + 1, and the first
    that they share stands early enough in both for the rest to be as much as they must have in common.  Texts of
    a shingle that at most WHOLE have are compared pair by pair.  Those of others are first held against HUBS of them, more in
    each round, which joins nearly all that belong together; then all pairs of texts that share a prefix shingle and aren't
    joined yet are compared, so no pair is left out.
    """
    slots, counts = _frequent(rows, texts.count())
    made = stage(rows.select("id", "text").mapInArrow(_shapes(slots, counts), "id long, n long, parities binary, heads array<long>"), "heads")
    prefix = made.select("id", "n", F.posexplode("heads").alias("at", "h")).repartition("h").dropDuplicates(["h", "id"])
    entries = stage(prefix.withColumn("m", F.count("*").over(Window.partitionBy("h"))).filter("m > 1").select("h", "id", "n", "at", "m"), "entries")
    shapes = stage(made.select("id", "n", "parities").join(entries.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "shapes")
    few = entries.filter(F.col("m") <= WHOLE).groupBy("h").agg(F.collect_list(F.struct("id", "n", "at")).alias("x"))
    fits = lambda a, b: (a["id"] < b["id"]) & _places_fit(a, b)
    few = few.select(F.explode("x").alias("a"), "x").select("a", F.explode(F.filter("x", lambda b: fits(F.col("a"), b))).alias("b"))
    found = found.unionByName(_verified(few.select(F.col("a.id").alias("key"), F.col("b.id").alias("hub")).distinct(), shapes, rows, texts))
    many = entries.filter(F.col("m") > WHOLE).drop("m")
    if many.isEmpty():
        return found
    labelled = _labelled(many, found)
    for k, hubs in enumerate((*HUBS, 0)):
        groups = labelled.groupBy("h", "label").agg(F.count("*").alias("c")).groupBy("h").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("joined"))
        open_ = stage(groups.filter("m * m > joined"), "open")
        size = open_.agg(F.sum(F.col("m") * F.col("m") - F.col("joined")), F.sum("m")).first()
        if not size[0]:
            break
        labelled = labelled.join(open_.select("h"), "h")
        last = not hubs or size[0] <= FEW * size[1]
        found = found.unionByName(_verified(_candidates(labelled, 0 if last else hubs, k).distinct(), shapes, rows, texts))
        if last:
            break
        labelled = _labelled(labelled.drop("label"), found)
    return found


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and id: the first 64 bits of a digest stand for a text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumn("id", _digest(F.col("text")))


def _digest(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("long")


def _groups(docs: DataFrame) -> DataFrame:
    """(id, least, n, root): a row a distinct text with the smallest doc_id that has it, its number of rows, and its group."""
    rows = _named(docs)
    with workspace(docs.sparkSession) as keep:
        texts = stage(rows.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "texts")
        roots = components(similar_links(rows, texts, covered_links(rows)))
        rooted = texts.join(roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left")
        return keep(rooted.select("id", "least", "n", F.coalesce("root", "id").alias("root")), "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text -> (doc_id, keeper): for every document the smallest doc_id of its group.

    Groups are the connected components of copies of one text, of texts whose fingerprints are within RADIUS bits (the classes of
    operator 7) and of texts with SIMILAR of their five-word shingles in common; texts without a word are one group.
    """
    groups = _groups(docs)
    keepers = groups.groupBy("root").agg(F.min("least").alias("keeper"))
    return _named(docs).select("doc_id", "id").join(groups.join(keepers, "root").select("id", "keeper"), "id").select("doc_id", "keeper")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs of each group of near duplicates: that with the smallest doc_id, null being the largest; of several such
    rows that with the least digest of its text, then of all its columns.  Rows that are alone in their group aren't shuffled."""
    groups = _groups(docs)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "id")).alias("k"))
    first = stage(first.select(F.col("k.id").alias("__id"), F.coalesce(F.col("k.least").cast("string"), F.lit("")).alias("__doc")), "first")
    own = aside(docs, ("doc_id", "text"))
    columns = [F.col(c) for c in own.columns]
    rows = own.withColumn("__id", _digest(F.coalesce(F.col("text").cast("string"), F.lit("")))).withColumn("__doc", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    several = groups.groupBy("root").agg(F.sum("n").alias("rows")).filter("rows > 1").select("root")
    rows = _marked(rows, "__id", groups.join(several, "root").select("id"))
    stays = rows.filter("__maybe").join(first, ["__id", "__doc"], "left_semi")
    one = stays.groupBy("__id", "__doc").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row"))
    return rows.filter("not __maybe").select(*columns).unionByName(one.select("row.*")).toDF(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
