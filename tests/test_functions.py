"""Column functions and operators on cases that can be checked by hand."""

import math

import pytest
from pyspark.sql import functions as F

from hearken.functions import rules
from hearken.functions import text as tx
from hearken.operators import audit, curves, evaluate, federate, learn, relate


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def test_noisy_or(spark):
    cat = [("a", ["a"], 0.95, "A"), ("b", ["b"], 0.7, "B")]
    flags = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, rules.risk(flags("a", "b"), cat), rules.risk(flags(), cat), rules.risk(flags("nope"), cat)) == (0.985, 0.0, 0.5)
    assert one(spark, rules.explain(flags("a", "nope"), cat)) == ["A", "nope"]


@pytest.mark.parametrize(("text", "flags"), [
    ("БЕЗОПАСНЫЙ счёт", ["safe_account"]), ("Продиктуйте код из SMS, никому не говорите", ["sms_code_request", "secrecy_demand"]), ("Қауіпсіз шот ашамыз", ["safe_account"]),
    ("ҚАУІПСІЗ ШОТ", ["safe_account"]), ("Установите AnyDesk", ["remote_access_request"]), ("Добрый день", []), ("", []),
])
def test_calls_catalog_in_unicode(spark, text, flags):
    assert one(spark, rules.detect(F.lit(text), rules.CALLS)) == flags
    assert len(rules.CALLS) == 20


def test_detect_of_null_is_empty(spark):
    assert one(spark, rules.detect(F.lit(None).cast("string"), rules.CALLS)) == []


def test_chunks_and_cuts(spark):
    words = " ".join(map(str, range(45)))
    assert [len(x.split()) for x in one(spark, tx.chunk_words(F.lit(words), 20))] == [20, 20, 5]
    assert one(spark, tx.chunk_words(F.lit(" \n "), 20), tx.chunk_words(F.lit(None).cast("string"), 20)) == ([], [])
    assert [len(x.split()) for x in one(spark, tx.cut(F.lit(words), 20))] == [17, 17, 11]
    assert one(spark, tx.cut(F.lit("a b"), 20)) == ["a b"]
    assert one(spark, tx.sentences(F.lit("One. Two!  Three? 3.5 ok"))) == ["One.", "Two!", "Three?", "3.5 ok"]


def test_template_and_formats(spark):
    slots = F.create_map(F.lit("bank"), F.lit("Банк"))
    assert one(spark, tx.fill(F.lit("{bank}, {nope} привет"), slots)) == "Банк, привет"
    assert one(spark, tx.thousands(F.lit(1234567)), tx.clock(F.lit(125))) == ("1 234 567", "02:05")
    assert [one(spark, tx.russian_plural(F.lit(n), "a", "b", "c")) for n in (1, 2, 5, 11, 21, 112)] == ["a", "b", "c", "c", "a", "c"]
    assert one(spark, tx.numbered_lines(F.lit("1) a\n2) b\nno\n1) c"))) == {1: "a", 2: "b"}
    assert one(spark, tx.collapse_repeats(F.array(*map(F.lit, "aab_b")), "_")) == ["a", "b", "b"]


def test_similarity_and_error_rates(spark):
    assert len(one(spark, tx.shingles(F.lit("abc")))) == 2
    assert one(spark, tx.jaccard(tx.shingles(F.lit("abc")), tx.shingles(F.lit("xyz")))) == 0.0
    e = one(spark, tx.error_rates(F.lit("a x c"), F.lit("A, b c!")))
    assert math.isclose(e.wer, 1 / 3) and e.n_words == 3
    assert one(spark, tx.error_rates(F.lit(""), F.lit(""))).wer == 0
    assert one(spark, F.levenshtein(F.lit("kitten"), F.lit("sitting"))) == 3
    assert one(spark, tx.normalize(F.lit("Ёлка, ДА!  нет"))) == "елка да нет"
    assert one(spark, tx.looks_kazakh(F.lit("Иә")), tx.looks_kazakh(F.lit("это просто текст")), tx.looks_kazakh(F.lit("бұл қазақ тілі"))) == (True, False, True)


def curve(spark, values):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(values)], "dialogue_id long, idx int, p double")


@pytest.mark.parametrize(("mode", "a", "want"), [("raw", 1.0, [0.2, 0.9, 0.1]), ("maxdecay", 0.9, [0.2, 0.9, 0.81]), ("ewma", 0.5, [0.2, 0.55, 0.325])])
def test_folds(spark, mode, a, want):
    got = [r.r for r in curves.accumulate(curve(spark, [0.2, 0.9, 0.1]), mode, a).orderBy("idx").collect()]
    assert all(math.isclose(x, y) for x, y in zip(got, want, strict=True))
    with pytest.raises(ValueError):
        curves.fold(F.array(), "other", 1.0)


def test_first_alert_and_jump(spark):
    rows = curves.rule_curve(curve(spark, [0.2, 0.9, 0.1]), 0.9, "p")
    assert [curves.first_alert(rows, t).first().alert_idx for t in (0.8, 0.95)] == [1, -1]
    assert tuple(curves.biggest_jump(rows).first()) == (1, 1, 0.7)


def test_long_fold_stays_finite(spark):
    rows = curves.accumulate(spark.range(3000).select(F.lit(1).alias("dialogue_id"), F.col("id").cast("int").alias("idx"), F.lit(0.5).alias("p")), "ewma", 0.7)
    assert all(math.isclose(r.r, 0.5) for r in rows.collect())


def test_auc(spark):
    rows = lambda *x: spark.createDataFrame(x, "label int, peak double")
    assert evaluate.roc_auc(rows((1, 0.5), (0, 0.5))).first().auc == 0.5
    assert evaluate.roc_auc(rows((1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1))).first().auc == 0.875
    assert evaluate.roc_auc(rows((1, 0.9), (1, 0.5))).first().auc is None


def test_thresholds(spark):
    peaks = spark.createDataFrame([(i, 0, x) for i, x in enumerate((0.1, 0.2, 0.3, 0.4))] + [(9, 1, 0.35)], "dialogue_id long, label int, peak double")
    at = lambda f: evaluate.threshold_for_fpr(peaks, f).first().threshold
    assert math.isclose(at(0.25), 0.3 + 1e-6) and at(1.0) == 0.0
    assert evaluate.threshold_for_fpr(peaks.filter("label = 1"), 0.25).first().threshold == 0.5
    assert evaluate.matched_threshold(peaks, 0.0, "fpr").first() is None
    assert evaluate.matched_threshold(peaks, 1.0, "recall").first().threshold == 0.35


def test_calibration_holds_its_rate(spark):
    rows = spark.range(400).select(F.col("id").alias("dialogue_id"), (F.col("id") % 4 == 0).cast("int").alias("label"), F.lit(3).alias("action_idx"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("idx"))
    rows = rows.withColumn("p", F.round(tx.uniform(F.col("dialogue_id"), F.col("idx")) * 0.8 + 0.15 * F.col("label"), 4))
    best = evaluate.calibrate(rows, 0.1).first()
    assert best.fpr <= 0.1 and best.recall > 0


def test_merge_segments_cap(spark):
    rows = spark.createDataFrame([("c", i, "A", float(a), float(b)) for i, (a, b) in enumerate([(0, 8), (8, 15), (15, 23)])], "call_id string, event_id long, speaker string, start double, end double")
    assert [(r.start, r.end) for r in curves.merge_segments(rows, 20.0).orderBy("idx").collect()] == [(0, 15), (15, 23)]


def test_similar_pairs_lose_none(spark):
    import random

    random.seed(1)
    base = ["".join(random.choices("abcde ", k=30)) for _ in range(25)]
    items = [(i, t) for i, t in enumerate(base + [t[:25] + "zzzzz" for t in base] + [t[3:] for t in base])]
    df = spark.createDataFrame(items, "id long, text string").withColumn("pool", F.lit("p"))
    sets = {r.id: set(r.s) for r in df.select("id", tx.shingles(F.col("text")).alias("s")).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    pairs = relate.similar_pairs(df, 0.5)
    assert {(r.a, r.b) for r in pairs.collect()} == want
    split = relate.three_way(relate.groups(df, pairs), "1").collect()
    assert len(split) == len(items) and len({(r.group, r.split) for r in split}) == len({r.group for r in split})


def test_asof_takes_the_last_when_none_follows(spark):
    left = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 11.0), ("z", 3, 1.0)], "k string, id int, at double")
    right = spark.createDataFrame([("k", 4.0, "a"), ("k", 5.0, "b"), ("k", 9.0, "c")], "k string, end double, v string")
    assert sorted((r.id, r.v) for r in relate.asof_forward(left, right, "k", "at", "end", "v").collect()) == [(1, "b"), (2, "c"), (3, None)]


def test_lint(spark):
    rows = [("p", "ru", 0, "Привет, {victim_name}"), ("p", "ru", 1, "{nope} да"), ("p", "kk", 0, "это ваш счёт"), ("p", "kk", 1, "бұл қате"), ("q", "ru", 0, "да"), ("q", "ru", 1, "да")]
    found = audit.lint(spark.createDataFrame(rows, "path string, lang string, pos int, line string")).collect()
    assert sorted(r.violation for r in found) == ["repeated line", "russian line in a kazakh pool", "unknown slot nope"]


def test_fedavg_weights(spark):
    states = spark.createDataFrame([(0, "w", [1.0, 0.0], 3), (1, "w", [0.0, 4.0], 1)], "bank int, param string, vector array<double>, weight long")
    assert [r.value for r in federate.fedavg(states).orderBy("pos").collect()] == [0.75, 1.0]
    with pytest.raises(ValueError):
        federate.bank_of("other", F.lit(1), 3)


def test_retry_keeps_what_was_right(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    first = lambda r: r.select("k", F.concat(F.lit("a"), "k").alias("result"), (F.col("k") == 1).alias("ok"))
    second = lambda r: r.select("k", F.concat(F.lit("b"), "k").alias("result"), (F.col("k") == 2).alias("ok"))
    assert sorted(tuple(r) for r in learn.retried(rows, "k", first, second).collect()) == [(1, "a1", True), (2, "b2", True), (3, "a3", False)]
