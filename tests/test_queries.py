"""Every query against its SQL, sources and sinks, streams against batches, and the entry's contract."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from hearken import plans
from hearken.functions import rules
from hearken.operators import generate
from hearken.plans.models import small_taxonomy
from hearken.sources import files
from hearken.streaming import session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def shown(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return float(x) if type(x).__name__ in ("int", "Decimal", "bool") else str(x)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = plans.QUERIES[name](spark, small)
    rel = duck.sql(plans.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted((tuple(shown(r[c]) for c in cols) for r in df.collect()), key=str)
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(shown(r[i]) for i in at) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - {"probe_start", "probe_style", "federated_rounds"}))
def test_other_queries_give_rows(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_word_error_rate_takes_whole_texts(spark, tmp_path):
    same = " ".join(f"w{i}" for i in range(200))  # differs from character 400 on only
    rows = [(1, 0, "user", same + " a b"), (1, 1, "assistant", same + " c d")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = plans.QUERIES["word_error_rate"](spark, str(tmp_path)).collect()
    assert [(x.wer, x.n_words) for x in r] == [(round(2 / 202, 6), 202)] and r[0].cer == round(2 / len(rows[1][3]), 6)


def test_probes_see_whole_dialogues(spark, tmp_path):
    words = " ".join(f"w{i % 7}" for i in range(160))  # 8 turns: only what comes after them tells the classes apart
    docs = [(i, words + (" stop!" if i % 2 else " stop?"), "en", "web") for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.view: r.auc for r in plans.QUERIES["probe_style"](spark, str(tmp_path)).collect()}["punctuation"] == 1.0
    assert [r.k for r in plans.QUERIES["probe_start"](spark, str(tmp_path)).collect()] == [1, 2, 3, None]


def test_small_pools_are_in_several_parts(spark):
    from hearken.operators import relate

    rows = [("one", 1, 1), ("one", 2, 1), ("two", 3, 3), ("two", 4, 4), ("three", 5, 5), ("three", 6, 6), ("three", 7, 7)]
    got = relate.three_way(spark.createDataFrame(rows, "pool string, id long, group long"), "42").collect()
    parts = {p: sorted((r.id, r.split) for r in got if r.pool == p) for p in ("one", "two", "three")}
    assert parts["one"] == sorted((i, x) for i in (1, 2) for x in ("holdout", "train", "val"))
    held = next(i for i, x in parts["two"] if x == "holdout")
    assert parts["two"] == sorted([(held, "holdout"), (7 - held, "train"), (7 - held, "val")])
    assert sorted(x for _, x in parts["three"]) == ["holdout", "train", "val"] and len({i for i, _ in parts["three"]}) == 3


def test_copies_are_one_item_of_a_group(spark):
    from hearken.operators import relate

    texts = ["the caller asks for the code"] * 50 + ["The caller asks for the code!", "the caller asked for a code", "nothing alike here at all"]
    got = relate.similar_groups(spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "pool string, id long, text string"), 0.5).collect()
    assert {r.id: r.group for r in got} == {**dict.fromkeys(range(52), 0), 52: 52}


def test_learned_queries(spark, small):
    assert all(0 <= r.auc <= 1 for r in plans.QUERIES["federated_rounds"](spark, small).collect())
    assert {r.view for r in plans.QUERIES["probe_style"](spark, small).collect()} == {"punctuation", "lengths"}


def test_files_round_trip(spark, tmp_path):
    tax = small_taxonomy(spark)
    made = generate.dialogues(spark, 40, tax)
    nested = generate.corpus(generate.turns(made, tax, rules.CALLS))
    files.write_lines(nested, f"file://{tmp_path}/d")
    back = files.read_dialogues(spark, f"file://{tmp_path}/d")
    assert back.count() == 40 and back.filter("size(turns) = 0").isEmpty()
    (tmp_path / "sets").mkdir()
    for name in ("a", "b_sample", "calls_asr"):
        (tmp_path / "sets" / f"{name}.jsonl").write_text(json.dumps({"dialogue_id": name}) + "\nbroken\n")
    assert [r.set_name for r in files.read_sets(spark, f"file://{tmp_path}/sets/*.jsonl").filter("dialogue_id is not null").collect()] == ["a"]
    (tmp_path / "x.csv").write_text('id,text\n1,"a ""b""\nc"\n')
    assert files.read_csv(spark, f"file://{tmp_path}/x.csv", "id int, text string").first().text == 'a "b"\nc'
    (tmp_path / "x.tsv").write_text("2\tb\n1\ta\n")
    assert [r.id for r in files.read_tsv(spark, f"file://{tmp_path}/x.tsv", "id int, t string", 1, ["id"]).collect()] == [1]
    (tmp_path / "t.yaml").write_text("SC01:\n  S0:\n    ru: [a, b]\n    kk: [c]\n")
    assert files.pools(spark, files.read_yaml(spark, f"file://{tmp_path}/t.yaml")).count() == 3
    assert files.existing(spark, [f"file://{tmp_path}/t.yaml", f"file://{tmp_path}/no"]) == [f"file://{tmp_path}/t.yaml"]
    assert files.markdown(spark.range(1)).splitlines()[2] == "| 0 |"


def test_resumed_append_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    for _ in range(2):
        files.append_missing(rows, f"file://{tmp_path}/out", "id")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
    assert files.signature(rows, "id") == files.signature(rows.orderBy(F.desc("id")), "id")


def test_generator_invariants(spark):
    tax = small_taxonomy(spark)
    made = generate.dialogues(spark, 400, tax)
    rows = generate.turns(made, tax, rules.CALLS)
    again = generate.turns(generate.dialogues(spark, 400, tax), tax, rules.CALLS)
    assert rows.exceptAll(again).isEmpty()
    assert made.filter("label = 'scam'").count() == 200
    assert rows.filter(F.col("text").rlike(r"[{}]")).isEmpty()
    assert rows.filter("flag_bearing_benign and label = 'scam'").isEmpty()
    assert rows.groupBy("n").agg(F.sum(F.col("flag_bearing_benign").cast("int")).alias("k")).filter("k > 1").isEmpty()
    nested = generate.corpus(rows)
    assert nested.filter("label = 'benign' and action_turn_idx <> -1").isEmpty()
    assert nested.filter("terminated_early_at is not null and action_turn_idx >= 0").isEmpty()
    assert not nested.filter("action_turn_idx >= 0").isEmpty()
    assert nested.filter("transform(turns, t -> t.idx) <> sequence(0, size(turns) - 1)").isEmpty()


def test_hysteresis_by_hand():
    def run(ps, limits):
        s, out = session.State(), []
        for p in ps:
            u = s.feed(p, limits)
            out += [u] if u else []
        u = s.flush(limits)
        return out + ([u] if u else [])

    lim = session.Limits(silence=2, short=2, long=6)
    assert run([0.4, 0.6, 0.4, 0.4, 0.1, 0.1, 0.9, 0.1, 0.1], lim) == [(1, 4)]
    assert run([0.6] * 14, lim) == [(0, 6), (6, 12), (12, 14)]
    assert run([0.1] * 5, lim) == []


def test_entry_contract(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 4


def test_rest_works_without_the_llm_folder(tmp_path):
    import shutil

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/hearken", tmp_path / "hearken", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'threshold_sweep' in q and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
