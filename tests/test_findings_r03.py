"""What the review of round 3 found."""

from pyspark.sql import functions as F

from hearken import plans
from hearken.operators import learn


def test_gradients_of_tasks_without_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [3.0, 4.0], 0)], "bank int, x array<double>, y int").repartition(7, "bank")
    got = learn.gradients(rows, {0: [0.0] * 3, 1: [0.0] * 3}, 2)
    assert {k: (v.tolist(), n) for k, (v, n) in got.items()} == {0: ([-0.5, -1.0, -0.5], 1), 1: ([1.5, 2.0, 0.5], 1)}
    assert learn.gradients(rows.filter("bank > 1"), {0: [0.0] * 3}, 2) == {}


def test_lang_gate_counts_words_as_its_sql(spark, tmp_path):
    import duckdb

    texts = [None, "", "  ", "\n", "a\nb c", "a b\nc", "a  b", "a b ", " a b　", "a b \n", "a\tb\tc", "a b c ә", " \ta b", "a b\r\n ", "a b c"]
    spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string").withColumn("turn", F.lit(0)).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = {i: ok for i, _, ok in con.sql(plans.SQL["lang_gate"]).fetchall()}
    assert {r.conv_id: r.ok for r in plans.QUERIES["lang_gate"](spark, str(tmp_path)).collect()} == want


def test_blocks_find_all_pairs_and_link_all(spark, monkeypatch):
    import random

    import numpy as np

    from hearken.operators import blocks, relate

    draw = random.Random(7)
    words = ["".join(draw.choices("abcdeéßя𐐷", k=draw.randint(1, 7))) for _ in range(60)]
    texts = ["", "a", None] + [" ".join(draw.choices(words, k=draw.randint(1, 40))) for _ in range(150)]
    for i in range(150):  # chains of edits
        w = texts[-1 - draw.randrange(3)].split()
        w[draw.randrange(len(w))] = draw.choice(words)
        texts.append(" ".join(w))
    grams = [None if t is None else {f" {t} "[k : k + 4] for k in range(max(1, len(f" {t} ") - 3))} if t else {"  "} for t in texts]
    alike = lambda a, b: len(a & b) / len(a | b)
    for th in (0.1, 0.5):
        want = {(i, j): round(alike(grams[i], grams[j]), 9) for j in range(len(texts)) for i in range(j) if grams[i] and grams[j] and alike(grams[i], grams[j]) >= th}
        monkeypatch.setattr(blocks, "LEAST", 40)
        monkeypatch.setattr(blocks, "ROWS", 16)
        items = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "pool string, id long, text string")
        assert {(r.a, r.b): round(r.jaccard, 9) for r in relate.similar_pairs(items, th).collect()} == want
    group = list(range(len(texts)))
    for i, j in sorted(want):
        a, b = sorted((group[i], group[j]))
        group = [a if g == b else g for g in group]
    got = relate.similar_groups(items, 0.5).collect()
    assert {r.id: r.group for r in got} == dict(enumerate(group)) and len(got) == len(texts)
    many = blocks.shingle_sets(["".join(map(chr, range(0x4E00, 0x9FFF))) + "".join(map(chr, range(0x20000, 0x2FFFF))), "一丁"], 4)
    assert len(many[0]) == 0x9FFF - 0x4E00 + 0xFFFF - 3 and len(many[1]) == 1 and not np.isin(many[1], many[0]).any()


def test_probes_count_grams_once_and_as_hashing_does(spark):
    from pyspark.ml.feature import HashingTF

    texts = ["a", "a b a", "é 😀x straße жук abc abc", "x " * 70 + "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = learn.prefix_gram_counts(rows.repartition(7), "text", {"two": 2, "all": None})
    assert "text" not in got.columns and all(f.startswith("file:") and "/step-" in f for f in got.inputFiles())  # what is read many times is written
    for name, words in (("two", F.slice(F.split("text", " "), 1, 2)), ("all", F.split("text", " "))):
        hashed = HashingTF(inputCol="t", outputCol="tf", numFeatures=1 << 16).transform(rows.withColumn("t", learn.char_grams(F.array_join(words, " "), 2, 4)))
        assert {r.id: r[name] for r in got.collect()} == {r.id: r.tf for r in hashed.collect()}


def test_style_probe_fits_on_written_counts(spark, small, monkeypatch):
    read = []
    fit = learn.probe_counts
    monkeypatch.setattr(learn, "probe_counts", lambda train, test, *more, **named: (read.append(train), fit(train, test, *more, **named))[1])
    assert plans.QUERIES["probe_style"](spark, small).count() == 2
    assert len(read) == 2 and not any("documents" in f for x in read for f in x.inputFiles())


def test_split_keeps_turns_without_text(spark, tmp_path):
    rows = [(c, 0, "user", t) for c, t in enumerate(["the same words here", "The same words here!", None, "others altogether", None])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.QUERIES["three_way_split"](spark, str(tmp_path)).collect()
    assert {r.id: r.group for r in got} == {0: 0, 100: 0, 200: 200, 300: 300, 400: 400} and {r.split for r in got} == {"holdout", "val", "train"}


def test_merged_pools_are_numbered_in_many_tasks(spark):
    from hearken.operators import relate

    rows = [(p, "ru", i * 7919 % 3001, f"line {i * 7919 % 3001}") for p in ("a", None) for i in range(3001)]
    base = spark.createDataFrame(rows, "path string, lang string, pos long, line string")
    more = base.filter("pos < 5").withColumn("line", F.concat("line", F.lit("x"))).unionByName(base.filter("pos < 9"))
    merged = relate.merge_extension(base, more)
    want = [f"line {i}" for i in range(3001)] + [f"line {i}x" for i in range(5)]
    for p in ("a", None):
        got = {r.pos: r.line for r in merged.filter(F.col("path").eqNullSafe(p)).collect()}
        assert got == dict(enumerate(want))
    numbering = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in numbering
