"""Queries of projections, joins, sets, sampling, similarity, audits and federation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions import text as tx
from hearken.operators import audit, federate, relate
from hearken.plans import fixtures as fx
from hearken.plans.registry import query
from hearken.sources.tables import MAX_TURNS, conversation_turns, labelled_turns, segments, table

_MD5 = "md5(CAST({} AS VARCHAR))"


# projections and predicates


@query("SELECT conv_id AS dialogue_id, string_agg(text, ' ' ORDER BY turn) FILTER (turn < 2) AS first_two, count(*) AS n_turns FROM conversations GROUP BY 1")
def first_k_text(s: SparkSession, d: str) -> DataFrame:
    rows = conversation_turns(s, d).groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t"))
    return rows.select("dialogue_id", F.array_join(F.slice("t.text", 1, 2), " ").alias("first_two"), F.size("t").cast("long").alias("n_turns"))


@query(f"{fx.FIRST_TURNS} SELECT dialogue_id, n_turns_orig, n_turns, n_turns_orig > n_turns AS truncated FROM dialogues")
def truncate_turns(s: SparkSession, d: str) -> DataFrame:
    return fx.dialogues(s, d, MAX_TURNS).select("dialogue_id", "n_turns_orig", "n_turns", (F.col("n_turns_orig") > F.col("n_turns")).alias("truncated"))


@query(f"{fx.FLAGGED} SELECT label, CAST(count(*) FILTER (f) AS BIGINT) AS n_with_flag, count(*) AS n, round(avg(CAST(f AS INTEGER)), 4) AS share FROM (SELECT dialogue_id, any_value(label) AS label, bool_or(len(flags) > 0) AS f FROM flagged GROUP BY 1) GROUP BY 1")
def dialogues_with_any_flag(s: SparkSession, d: str) -> DataFrame:
    return audit.any_flag(fx.flagged(s, d))


@query("SELECT conv_id AS dialogue_id, string_agg(text, ' ' ORDER BY turn) AS caller_text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def speaker_text(s: SparkSession, d: str) -> DataFrame:
    rows = conversation_turns(s, d).groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("idx", "speaker", "text"))).alias("t"))
    said = F.filter("t", lambda x: x["speaker"] == "caller")
    return rows.select("dialogue_id", F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("caller_text"), F.size(said).cast("long").alias("n")).filter("n > 0")


@query("SELECT event_id, value FROM events WHERE value < 70 AND value > 1.2 AND event_type <> 'error'")
def confidence_filter(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").filter("value < 70 and value > 1.2 and event_type <> 'error'").select("event_id", "value")


@query("SELECT doc_id FROM documents WHERE text IS NULL OR length(trim(text, ' \t\n\r')) = 0 UNION ALL SELECT doc_id FROM documents WHERE n_chars < 200")
def blank_or_short(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    blank = F.col("text").isNull() | (F.length(tx.squeeze(F.col("text"))) == 0)
    return docs.filter(blank).select("doc_id").unionByName(docs.filter("n_chars < 200").select("doc_id"))


@query("SELECT doc_id, CAST(toxic AS INTEGER) AS y, CASE WHEN toxic = 1 THEN 'scam' ELSE 'benign' END AS label FROM labels WHERE quality = 1")
def label_encode(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").filter("quality = 1").select("doc_id", F.col("toxic").cast("int").alias("y"), F.when(F.col("toxic") == 1, "scam").otherwise("benign").alias("label"))


@query("""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT lang AS path, 'ru' AS lang, line FROM l WHERE line <> '')
SELECT path, lang, line, 'repeated line' AS violation FROM p GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def lint_rules(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "documents").select(F.col("lang").alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return audit.lint(lines.filter("line <> ''").withColumn("lang", F.lit("ru")))


# joins


@query("""WITH o AS (SELECT * FROM (VALUES ('src0', 't0'), ('src1', 't1'), ('src2', 't0'), ('src3', 't2')) x(source, topic))
SELECT d.doc_id, o.topic FROM documents d JOIN o ON d.source = o.source""")
def topic_of(s: SparkSession, d: str) -> DataFrame:
    topics = s.createDataFrame([("t0", ["src0", "src2"]), ("t1", ["src1"]), ("t2", ["src3"])], "topic string, sources array<string>")
    inverted = topics.select("topic", F.explode("sources").alias("source"))
    return table(s, d, "documents").join(F.broadcast(inverted), "source").select("doc_id", "topic")


@query("""WITH r AS (SELECT conv_id, list(text ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id AS call_id, array_to_string(t[2:3], ' / ') AS text, len(t[2:3]) AS n FROM r WHERE n >= 3""")
def segment_slice(s: SparkSession, d: str) -> DataFrame:
    turns = conversation_turns(s, d).withColumnRenamed("dialogue_id", "call_id")
    calls = turns.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text")))["text"].alias("segments"))
    notes = calls.filter(F.size("segments") >= 3).select("call_id", F.lit(1).alias("a"), F.lit(2).alias("b"))
    cut = relate.segment_slice(notes, calls)
    return cut.select("call_id", F.array_join("segments", " / ").alias("text"), F.size("segments").cast("long").alias("n"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT DISTINCT text FROM conversations c WHERE turn < 3 AND NOT EXISTS (SELECT 1 FROM conversations o WHERE o.text = c.text AND o.turn >= 3)")
def cache_miss(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "conversations")
    return rows.filter("turn < 3").select("text").distinct().join(rows.filter("turn >= 3").select("text"), "text", "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_join(s: SparkSession, d: str) -> DataFrame:
    rich = table(s, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").select("o_orderkey", "o_custkey").join(rich, "o_custkey", "left_semi")


@query("""SELECT c_custkey, coalesce(n.n_name, 'none') AS nation FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c.c_nationkey = n.n_nationkey""")
def left_default(s: SparkSession, d: str) -> DataFrame:
    nations = table(s, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(s, d, "customer").join(nations, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


@query("""WITH p AS (SELECT conv_id, turn, pos, piece FROM (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS piece, generate_subscripts(string_split(text, '. '), 1) AS pos FROM conversations)),
m AS (SELECT DISTINCT piece, md5(piece) AS result FROM p)
SELECT conv_id, turn, string_agg(result, '. ' ORDER BY pos) AS text FROM p JOIN m USING (piece) GROUP BY 1, 2""")
def dedupe_map_joinback(s: SparkSession, d: str) -> DataFrame:
    pieces = table(s, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\. ")).alias("pos", "piece"))
    done = relate.dedupe_map_join(pieces, "piece", lambda x: x.withColumn("result", F.md5(F.col("piece").cast("binary"))))
    rows = done.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "result")))["result"].alias("r"))
    return rows.select("conv_id", "turn", F.array_join("r", ". ").alias("text"))


_SEG = """s AS (SELECT user_id AS call_id, event_id, event_type, value, (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS start,
(lead(epoch_us(ts)) OVER w - first_value(epoch_us(ts)) OVER w) / 1e6 AS "end" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"""WITH {_SEG}, a AS (SELECT call_id, event_id, start FROM s WHERE event_type = 'purchase'), b AS (SELECT call_id, "end", min(value) AS value FROM s WHERE "end" IS NOT NULL AND event_type <> 'purchase' GROUP BY 1, 2),
l AS (SELECT call_id, arg_max(value, "end") AS last FROM b GROUP BY 1)
SELECT a.event_id, coalesce(b.value, l.last) AS value FROM a ASOF LEFT JOIN b ON a.call_id = b.call_id AND a.start <= b."end" LEFT JOIN l ON a.call_id = l.call_id""")
def asof_arrival(s: SparkSession, d: str) -> DataFrame:
    rows = segments(s, d)
    right = rows.filter(F.col("end").isNotNull() & (F.col("speaker") != "purchase")).groupBy("call_id", "end").agg(F.min("value").alias("value"))
    left = rows.filter(F.col("speaker") == "purchase").select("call_id", "event_id", "start")
    return relate.asof_forward(left, right, "call_id", "start", "end", "value").select("event_id", "value")


@query(f"""WITH i AS (SELECT n_name AS item, sum(n_regionkey + 1) OVER (ORDER BY n_name) AS upto, coalesce(sum(n_regionkey + 1) OVER (ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(n_regionkey + 1) OVER () AS total FROM nation),
k AS (SELECT c_custkey, {fx.sql_uniform('CAST(c_custkey AS VARCHAR)', "'pick'")} AS u FROM customer)
SELECT c_custkey, item FROM k JOIN i ON (u * total <= upto AND (u * total > low OR low = 0))""")
def weighted_pick(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "nation").select(F.col("n_name").alias("item"), (F.col("n_regionkey") + 1).alias("w"))
    keys = table(s, d, "customer").select("c_custkey")
    return relate.weighted_pick(keys, items, tx.uniform(F.col("c_custkey"), F.lit("pick")), "item", "w").select("c_custkey", "item")


_GRAMS = """t AS (SELECT {id} AS id, {pool} AS pool, ' ' || trim(regexp_replace(regexp_replace(lower(text), '\\{{[a-z_]+\\}}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g')) || ' ' AS t FROM {source}),
g AS (SELECT DISTINCT id, pool, substr(t, CAST(i AS BIGINT), 4) AS g FROM (SELECT *, unnest(range(1, greatest(1, length(t) - 3) + 1)) AS i FROM t)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1)"""
_PAIRS = _GRAMS + """,
p AS (SELECT a.pool, a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.pool = b.pool AND a.g = b.g AND a.id < b.id GROUP BY ALL),
j AS (SELECT p.pool, a, b, c / CAST(x.n + y.n - c AS DOUBLE) AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b)"""
_BENCH = _PAIRS.format(id="item_id", pool="'bench'", source="benchmark")


@query(f"WITH {_BENCH} SELECT pool, a, b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= CAST(0.1 AS DOUBLE)")
def jaccard_pairs(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "benchmark").select(F.lit("bench").alias("pool"), F.col("item_id").alias("id"), "text")
    return relate.similar_pairs(items, 0.1).withColumn("jaccard", F.round("jaccard", 6))


_CONV_PAIRS = _PAIRS.format(id="conv_id * 100 + turn", pool="role", source="conversations")


@query(f"""WITH RECURSIVE {_CONV_PAIRS}, e AS (SELECT pool, a, b FROM j WHERE jaccard >= CAST(0.5 AS DOUBLE)), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT id, id AS reach FROM t UNION SELECT r.id, e2.b FROM r JOIN e2 ON r.reach = e2.a)
SELECT pool, r.id, min(reach) AS "group" FROM r JOIN t ON r.id = t.id GROUP BY 1, 2""")
def similarity_groups(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "conversations").select(F.col("role").alias("pool"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return relate.similar_groups(items, 0.5)


@query(f"""WITH RECURSIVE {_CONV_PAIRS}, e AS (SELECT pool, a, b FROM j WHERE jaccard >= CAST(0.5 AS DOUBLE)), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT id, id AS reach FROM t UNION SELECT r.id, e2.b FROM r JOIN e2 ON r.reach = e2.a),
gr AS (SELECT pool, r.id, min(reach) AS g FROM r JOIN t ON r.id = t.id GROUP BY 1, 2), o AS (SELECT pool, g, row_number() OVER (PARTITION BY pool ORDER BY md5(pool || '|' || g || '|42')) AS k, count(*) OVER (PARTITION BY pool) AS n FROM (SELECT DISTINCT pool, g FROM gr)),
h AS (SELECT *, CASE WHEN n > 1 THEN greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT)) ELSE 0 END AS h FROM o), v AS (SELECT *, CASE WHEN n - h > 1 THEN greatest(1, CAST(round_even((n - h) * 0.2, 0) AS BIGINT)) ELSE 0 END AS v FROM h)
SELECT gr.pool, gr.id, gr.g AS "group", unnest(CASE WHEN n = 1 THEN ['holdout', 'val', 'train'] WHEN k <= h THEN ['holdout'] WHEN n - h = 1 THEN ['val', 'train'] WHEN k <= h + v THEN ['val'] ELSE ['train'] END) AS split FROM gr JOIN v ON gr.pool = v.pool AND gr.g = v.g""")
def three_way_split(s: SparkSession, d: str) -> DataFrame:
    return relate.three_way(similarity_groups(s, d), "42").select("pool", "id", "group", "split")


_TEMPLATES = f"x AS (SELECT {fx.sql_split('CAST(doc_id AS VARCHAR)')} AS s, substr(md5(text), 1, 10) AS t FROM documents), o AS (SELECT DISTINCT s, t FROM x)"


@query(f"""WITH {_TEMPLATES} SELECT a.s AS split_a, b.s AS split_b, count(*) AS n_shared, round(count(*) / any_value(n), 4) AS share_of_a
FROM o a JOIN o b ON a.t = b.t AND a.s < b.s JOIN (SELECT s, count(*) AS n FROM o GROUP BY 1) c ON c.s = a.s GROUP BY 1, 2""")
def template_overlap(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select(fx.split_of(F.col("doc_id")).alias("split"), tx.short_hash(F.col("text"), 10).alias("template"))
    return audit.overlap(rows, "split", "template")


@query("""WITH g AS (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 0.75]) AS t) SELECT t AS threshold, count(*) FILTER (value / 500 >= t) AS n FROM events, g GROUP BY 1""")
def sweep_grid(s: SparkSession, d: str) -> DataFrame:
    grid = s.createDataFrame([(0.25,), (0.5,), (0.75,)], "threshold double")
    rows = table(s, d, "events").select("value").crossJoin(F.broadcast(grid))
    return rows.groupBy("threshold").agg(F.count_if(F.col("value") / 500 >= F.col("threshold")).alias("n"))


# aggregations and audits


@query("SELECT role, turn, count(*) AS n, count(DISTINCT conv_id) AS n_conv FROM conversations GROUP BY 1, 2")
def counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").groupBy("role", "turn").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conv"))


@query(f"""{fx.FLAGGED} SELECT flag, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round(count(*) FILTER (label = 0) / count(*), 4) AS share_neg,
CASE WHEN count(*) FILTER (label = 0) = 0 THEN 'only positive' WHEN count(*) FILTER (label = 0) / count(*) < 0.03 THEN 'almost only positive' ELSE 'both' END AS verdict FROM (SELECT label, unnest(flags) AS flag FROM flagged) GROUP BY 1""")
def flag_by_label(s: SparkSession, d: str) -> DataFrame:
    return audit.flag_by_label(fx.flagged(s, d))


@query(f"{fx.FLAGGED} SELECT label, flag, count(DISTINCT dialogue_id) AS n_dialogues FROM (SELECT dialogue_id, label, unnest(flags) AS flag FROM flagged) GROUP BY 1, 2")
def flag_stats(s: SparkSession, d: str) -> DataFrame:
    return audit.flag_stats(fx.flagged(s, d))


@query(f"""{fx.TURNS} SELECT topic, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round(count(*) FILTER (label = 1) / count(*), 4) AS share_pos,
count(*) FILTER (label = 1) / count(*) BETWEEN 0.35 AND 0.65 AS ok FROM dialogues GROUP BY 1""")
def topic_balance(s: SparkSession, d: str) -> DataFrame:
    return audit.topic_balance(fx.dialogues(s, d))


_MARKERS = {"the": "(^| )the( |$)", "und": "(^| )und( |$)", "digit": "[0-9]", "para": "(^| )para( |$)"}
_MARKER_SQL = " UNION ALL ".join(f"SELECT '{k}' AS marker, dialogue_id, any_value(label) AS label FROM turns WHERE regexp_matches(text, '(?i){p}') GROUP BY 2" for k, p in _MARKERS.items())


@query(f"""{fx.TURNS}, m AS ({_MARKER_SQL}), c AS (SELECT marker, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM m GROUP BY 1)
SELECT marker, n_pos, n_neg, round(least(n_pos, n_neg) / (n_pos + n_neg), 4) AS minority, n_pos + n_neg >= 30 AND least(n_pos, n_neg) / (n_pos + n_neg) < 0.03 AS bad FROM c""")
def separability_markers(s: SparkSession, d: str) -> DataFrame:
    return audit.markers(labelled_turns(s, d), _MARKERS)


@query(f"""{fx.TURNS}, l AS (SELECT n_turns, bool_or(label = 1) AS p, bool_or(label = 0) AS n FROM dialogues GROUP BY 1)
SELECT round(count(*) FILTER (p AND n) / count(*), 4) AS overlap, count(*) AS n_lengths, count(*) FILTER (p AND n) / count(*) > 0.5 AS ok FROM l""")
def length_overlap(s: SparkSession, d: str) -> DataFrame:
    return audit.length_overlap(fx.dialogues(s, d))


@query(f"{fx.TURNS} SELECT count(*) FILTER (n_turns < 10) AS n_ended, count(*) AS n, round(count(*) FILTER (n_turns < 10) / count(*), 4) AS share FROM dialogues WHERE label = 1")
def termination_rate(s: SparkSession, d: str) -> DataFrame:
    return audit.termination_rate(fx.dialogues(s, d), F.col("n_turns") < 10)


@query(f"{fx.ALL} SELECT topic, count(*) FILTER (alert_idx >= 0) AS fired, count(*) AS n, round(count(*) FILTER (alert_idx >= 0) / count(*), 4) AS fp_rate FROM alerts WHERE label = 0 AND threshold = CAST(0.6 AS DOUBLE) GROUP BY 1")
def fp_by_group(s: SparkSession, d: str) -> DataFrame:
    return audit.fp_by_group(fx.alerts(s, d, (0.6,)), "topic")


# federation


@query("""WITH v AS (SELECT label % 3 AS bank, vec_id, embedding FROM embeddings), z AS (SELECT bank, count(*) AS w FROM v GROUP BY 1),
m AS (SELECT bank, pos, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT bank, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM v) GROUP BY 1, 2)
SELECT 'w' AS param, CAST(pos AS INTEGER) AS pos, round(sum(x * w) / sum(w), 6) AS value FROM m JOIN z ON m.bank = z.bank GROUP BY 2""")
def fedavg(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select((F.col("label") % 3).alias("bank"), F.posexplode("embedding").alias("pos", "x"))
    means = rows.groupBy("bank", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    states = means.groupBy("bank").agg(F.array_sort(F.collect_list(F.struct("pos", "x")))["x"].alias("vector")).withColumn("param", F.lit("w"))
    sizes = table(s, d, "embeddings").groupBy((F.col("label") % 3).alias("bank")).agg(F.count("*").alias("weight"))
    return federate.fedavg(states, sizes).withColumn("value", F.round("value", 6))


@query(f"""{fx.TURNS}, b AS (SELECT *, CAST(('0x' || substr({_MD5.format('dialogue_id')}, 1, 8)) AS BIGINT) % 3 AS bank FROM dialogues)
SELECT CAST(bank AS INTEGER) AS bank, array_to_string(list_sort(list(DISTINCT topic)), ',') AS topics, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(*) AS n_dialogues, CAST(sum(n_turns) AS BIGINT) AS n_prefixes FROM b GROUP BY 1""")
def bank_profile(s: SparkSession, d: str) -> DataFrame:
    rows = fx.dialogues(s, d).withColumn("bank", federate.bank_of("random", F.col("dialogue_id"), 3))
    out = federate.bank_profile(rows)
    return out.withColumn("topics", F.array_join("topics", ",")).withColumn("langs", F.array_join("langs", ","))


@query("SELECT banks, rounds, round(1476866 * 4 / 1e6 * 2 * banks * rounds, 3) AS mb FROM (VALUES (3, 3), (5, 2)) x(banks, rounds)")
def communication_cost(s: SparkSession, d: str) -> DataFrame:
    rows = s.createDataFrame([(3, 3), (5, 2)], "banks int, rounds int")
    return rows.withColumn("mb", F.round(federate.communication_mb(F.lit(1476866), F.col("banks"), F.col("rounds")), 3))


# sorts, limits, samples, sets


@query(f"""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY {_MD5.format('c_custkey')}) - 1 AS pos, count(*) OVER () AS n FROM customer)
SELECT c_custkey, format('DLG-{{:06d}}', pos) AS new_id, CASE WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN pos < floor(n * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM o""")
def split_by_position(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "customer").select("c_custkey")
    return relate.split_by_position(rows, F.md5(F.col("c_custkey").cast("string").cast("binary")))


@query(f"SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || '|42')) AS k FROM labels) WHERE k <= 20")
def top_n_per_class(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labels").select("doc_id", "toxic")
    return relate.top_n_per_class(rows, "toxic", F.md5(F.concat_ws("|", "doc_id", F.lit("42")).cast("binary")), 20)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def most_common(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT o_orderkey FROM ((SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 5) UNION (SELECT o_orderkey FROM orders ORDER BY 1 DESC LIMIT 5))")
def head_and_tail(s: SparkSession, d: str) -> DataFrame:
    return relate.head_and_tail(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 10)


@query(f"{fx.TURNS} SELECT dialogue_id FROM dialogues WHERE label = 1 AND n_turns >= 8 ORDER BY 1 LIMIT 1")
def first_matching(s: SparkSession, d: str) -> DataFrame:
    return fx.dialogues(s, d).filter("label = 1 and n_turns >= 8").select("dialogue_id").orderBy("dialogue_id").limit(1)


@query(f"SELECT c_custkey, {fx.sql_uniform('CAST(c_custkey AS VARCHAR)', chr(39) + 'gate' + chr(39))} < CAST(0.55 AS DOUBLE) AS taken FROM customer")
def bernoulli_gate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", (tx.uniform(F.col("c_custkey"), F.lit("gate")) < 0.55).alias("taken"))


_POOL = "SELECT lang AS path, 'ru' AS lang, line, min(doc_id) AS pos, {k} AS src FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id {f}) WHERE line <> '' GROUP BY 1, 3"


@query(f"""WITH b AS ({_POOL.format(k=0, f='% 2 = 0')} UNION ALL {_POOL.format(k=1, f='% 2 = 1')}), o AS (SELECT path, lang, line, min(src * 1000000000 + pos) AS k FROM b GROUP BY ALL)
SELECT path, lang, line, row_number() OVER (PARTITION BY path ORDER BY k, line) - 1 AS pos FROM o""")
def merge_pools(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "documents").select("doc_id", F.col("lang").alias("path"), F.lit("ru").alias("lang"), F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    pool = lambda odd: lines.filter(F.col("doc_id") % 2 == odd).groupBy("path", "lang", "line").agg(F.min(F.struct("doc_id", "line")).alias("pos"))
    return relate.merge_extension(pool(0), pool(1)).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT n_turns FROM (SELECT count(*) AS n_turns FROM conversations GROUP BY conv_id) INTERSECT SELECT CAST(turn AS BIGINT) FROM conversations")
def intersect_lengths(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "conversations")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns")).select("n_turns").intersect(rows.select(F.col("turn").cast("long").alias("n_turns")))


@query("SELECT n_name FROM nation EXCEPT SELECT n_name FROM nation n JOIN supplier s ON n.n_nationkey = s.s_nationkey WHERE s_acctbal > 9000")
def except_used(s: SparkSession, d: str) -> DataFrame:
    used = table(s, d, "supplier").filter("s_acctbal > 9000").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return table(s, d, "nation").select("n_name").exceptAll(used.distinct()).distinct()


# scalar functions


@query(f"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS t, substr(md5(text), 1, 10) AS template_id, 'LEN' || least(length(text) // 20, 6) AS bucket FROM conversations""")
def text_features(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", tx.normalize(F.col("text")).alias("t"), tx.short_hash(F.col("text"), 10).alias("template_id"), tx.length_bucket(F.col("text")).alias("bucket"))


@query("SELECT o_orderkey, replace(format('{:,}', CAST(round(o_totalprice) AS BIGINT)), ',', ' ') AS price, format('{:02d}:{:02d}', CAST(o_orderkey AS INTEGER) // 60, CAST(o_orderkey AS INTEGER) % 60) AS clock FROM orders")
def number_formats(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", tx.thousands(F.round("o_totalprice").cast("long")).alias("price"), tx.clock(F.col("o_orderkey")).alias("clock"))


@query("SELECT c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment || ', hello' AS line FROM customer")
def fill_template(s: SparkSession, d: str) -> DataFrame:
    slots = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")
    return table(s, d, "customer").select("c_custkey", tx.fill(F.lit("Dear {name} of {segment},  {nope}hello"), slots).alias("line"))


@query("""WITH p AS (SELECT a.p_partkey, a.p_name AS h, b.p_name AS r FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, round(levenshtein(lower(h), lower(r)) / greatest(1, length(r)), 6) AS cer FROM p""")
def char_error_rate(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("r"))
    rows = part.select("p_partkey", F.col("p_name").alias("h")).join(other, "p_partkey")
    return rows.select("p_partkey", F.round(F.levenshtein(F.lower("h"), F.lower("r")) / F.greatest(F.lit(1), F.length("r")), 6).alias("cer"))


@query()
def word_error_rate(s: SparkSession, d: str) -> DataFrame:
    rows = conversation_turns(s, d).select("dialogue_id", "idx", "text")
    after = rows.select("dialogue_id", (F.col("idx") - 1).alias("idx"), F.col("text").alias("ref"))
    e = rows.join(after, ["dialogue_id", "idx"]).withColumn("e", tx.error_rates(F.col("text"), F.col("ref")))
    return e.select("dialogue_id", "idx", F.round("e.wer", 6).alias("wer"), F.round("e.cer", 6).alias("cer"), "e.n_words")


@query("SELECT conv_id, turn, pos, piece FROM (SELECT conv_id, turn, unnest(x) AS piece, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos FROM (SELECT conv_id, turn, string_split(regexp_replace(trim(text, chr(32)), '([.?!。])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM conversations)) WHERE trim(piece) <> ''")
def sentence_pieces(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "piece"))


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type GROUP BY 1")
def collapse_repeats(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))["event_type"].alias("e"))
    return rows.select("user_id", F.array_join(tx.collapse_repeats(F.col("e")), " ").alias("run"))
