"""The operators of hearken.llm against brute force, and what they do with odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearken.llm import decontaminate, html, mixing, pii, quality, simhash, tokens, toxicity, urls, warc
from hearken.llm.common import scratch, words_of
from hearken.llm.components import components
from hearken.llm.elias_fano import EliasFano

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 6000
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "b", 1), (2, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "b", 1),
    (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", "en", "a", 0), (6, LONG, "en", "c", len(LONG)), (None, "no id here", "en", "a", 1),
    (1, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "b", 1), (7, "x", None, "é", 1), (8, "İstanbul ß 😀 a\x1cb  c", "tr", "a", 2),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use themselves."""
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.select("*", *[F.lit("extra").alias(c) for c in ("found", "kept", "n_words", "own_size", "key", "fp", "rates", "size", "bucket", "stratum")])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (6, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")


# 1


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def spans_by_hand(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]:
                out.append((m.start(), k, m.end(), name))
    return [f"{n}:{a}:{e}" for a, _, e, n in sorted(out)]


PII = [
    "", None, "a@b.c+x@d.e f@g.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (988) 555-2485 +49 30 1234567.", "😀é +1 988 555 2485 x@y.zz",
    "1" * 20000, "a" * 20000 + "@x.y", "+" + "(" * 3000, "10.0.0.1 " * 700, "call 212-555-1234 or tel (415) 555-2671, ssn 123-45-6789; john [at] mail [dot] com", "12 34 56 78 90 12 3", "x@y-.z..q a@b",
]


def test_pii_base_spans_equal_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in pii.found(rows).collect()}
    name = lambda xs: [f"{pii.KINDS[x.kind]}:{x.start}:{x.finish}" for x in xs]
    for i, t in enumerate(PII):
        assert name(got[i].base) == spans_by_hand(t), t
        assert set(name(got[i].base)) <= set(name(got[i].spans))
    assert any(x.startswith("local_phone") for x in name(got[11].spans))


def test_pii_on_tables_and_odd_rows(spark, small, odd, none):
    rows = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: [f"{pii.KINDS[x.kind]}:{x.start}:{x.finish}" for x in r.base] for r in pii.found(rows).collect()}
    assert all(got[r.doc_id] == spans_by_hand(r.text) for r in rows.collect())
    assert pii.found(odd).count() == len(ODD)
    assert pii.found(none).count() == 0


def test_em_separates_reliable_votes(spark):
    rows = [(0, [1, 1, 1, 1, 1], 50.0), (0, [0, 0, 0, 0, 1], 80.0), (0, [1, 0, 1, 1, 1], 10.0), (0, [0, 1, 0, 0, 0], 20.0)]
    rows += [(1, [1, 0, 1, 1, 1], 60.0), (1, [0, 1, 0, 0, 1], 90.0), (1, [1, 0, 0, 1, 1], 10.0)]  # its gazetteer misleads
    out = {r.kind: r for r in pii.reliabilities(spark.createDataFrame(rows, "kind int, votes array<int>, n double")).collect()}
    q = {k: {tuple(x.votes): x.q for x in out[k].patterns} for k in out}
    assert q[0][1, 1, 1, 1, 1] > 0.95 > 0.05 > q[0][0, 0, 0, 0, 1]
    assert q[1][1, 0, 1, 1, 1] > 0.95 > 0.1 > q[1][0, 1, 0, 0, 1] and out[1].misfires[1] > 0.8 > 0.2 > out[1].fires[1]


def planted_pii(n, seed=3):
    """(text, kind or None): spans of the kinds that have no base pattern, and things that look like them."""
    rng, out = random.Random(seed), []
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    digits = lambda k: "".join(rng.choices("0123456789", k=k))

    def iban(ok):
        body = digits(18)
        check = 98 - int(body + "131400") % 97  # DE
        return f"DE{(check if ok else check % 97 + 1):02d}{body}"

    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    makers = [
        (lambda: f'token = "{hexes(40)}"', "secret"), (lambda: f"export API_KEY={hexes(32)}", "secret"), (lambda: "the token = nothinghere", None), (lambda: "password: see-below", None),
        (lambda: f"IBAN {iban(True)}", "iban"), (lambda: f"part {iban(False)}", None),
        (lambda: f"SSN {rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "national_id"), (lambda: f"order {rng.randint(900, 999)}-00-{digits(4)}", None),
        (lambda: f"call ({rng.choice([212, 415, 617])}) {rng.randint(234, 987)}-{digits(4)}", "local_phone"), (lambda: f"invoice #{rng.randint(100, 199)}-{rng.randint(100, 199)}-{digits(4)}", None),
        (lambda: f"mail {word()} [at] {word()} [dot] com", "masked_email"), (lambda: f"born on {rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1930, 2005)}", "birth_date"),
        (lambda: f"version {rng.randint(32, 99)}.{rng.randint(32, 99)}.{rng.randint(2100, 9999)}", None), (lambda: f"from Mr. {rng.choice(['John', 'Peter', 'Maria', 'Anna'])} {word().title()}", "person"),
    ]
    for i in range(n):
        make, kind = makers[i % len(makers)]
        out.append((" ".join(word() for _ in range(8)) + " " + make() + " " + " ".join(word() for _ in range(8)), kind))
    return out


def test_added_spans_on_planted_kinds(spark):
    planted = planted_pii(1400)
    got = {r.doc_id: r.spans for r in pii.found(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted)], "doc_id long, text string")).collect()}
    hits: dict = {}
    for i, (_, kind) in enumerate(planted):
        kinds = {pii.KINDS[x.kind] for x in got[i]}
        hits.setdefault(kind, []).append(kind in kinds if kind else not kinds)
    shares = {k: sum(v) / len(v) for k, v in hits.items()}
    assert all(x >= 0.95 for x in shares.values()), shares


# 2


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, and more of them, as you know, all day.</p></div>
<div id="sidebar"><p>Side text, with commas, and so on, and so on, long enough to score well.</p></div>
<div class="content"><h1>Title &amp; more</h1><p>First paragraph, with some text, and a <a href="x">link</a>,
   that goes on.<p>Second paragraph&nbsp;here,<br>also long enough, yes.</p><!-- <p>hidden</p> --><form><p>Subscribe now, please, to all our news, daily.</p></form><div class="ad">Buy, buy, buy.</div><p>Short.</p></div>
<div id="comments"><p>A reader's comment, that is long, very long, and has many commas, indeed.</p></div><footer>Footer</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE) == "Title & more First paragraph, with some text, and a link, that goes on. Second paragraph here, also long enough, yes. Short."


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div class=content>{}</div>"])
def test_html_keeps_whatever_is_the_articles_own(shell):
    body = (
        "<h1>Title of it</h1><p>A first paragraph, long enough, with commas, to be the main text, surely.</p><figure><img src=x><figcaption>A caption</figcaption></figure>"
        "<ul><li><a href=/a>A linked item</a></li><li>plain item</li></ul><p class=response>Our response, in short.</p><div class=legal>A legal remark</div><div class=share-price>Shares fell</div>"
        "<table><caption>Figures</caption><tr><td><a href=b>cell</a></td></tr></table><p><math><mi>x</mi></math> is a number</p><label>Label</label>"
        "<p>A last paragraph, also long enough, with a comma or two, and no more than that.</p>"
    )
    own = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", body.replace("<mi>", "").replace("</mi>", "").replace("<math>", "").replace("</math>", ""))).strip()
    away = "<nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><div class=ad>Buy</div><form><label>Name</label><input></form><section class=comments><p>A reader says so, and so, and so.</p></section>"
    assert html.main_text("<body><header>Site</header>" + shell.format(body + away) + "<aside>Side</aside><footer>Foot</footer></body>") == own


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), (" \n", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a b"), ("<p>one</p><script>x<", "one"), ("<div>" * 3000 + "deep", "deep"), ("a < b", "a < b")])
def test_html_odd_pages(page, text):
    assert html.main_text(page) == text


def test_html_keeps_the_article_of_tables(spark, small):
    from html import unescape

    for r in html.extracted(spark.read.parquet(f"{small}/pages.parquet")).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        assert r.text == " ".join(" ".join(unescape(x).split()) for x in re.split(r"<[^>]+>", article) if x.strip())
        assert r.n_chars == len(r.text)


def test_html_table_odd(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a</p>", "y"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted(map(str, html.extracted(rows).collect())) == sorted(map(str, [*[html.extracted(rows).filter("page_id = 1").first()] * 2, html.extracted(rows).filter("page_id is null").first()]))
    assert html.extracted(rows.limit(0)).count() == 0


# 3


URLS = [
    (1, "HTTP://WWW.Example.COM/en/7x?q", None), (2, "http://a.net/de/8", None), (3, "http://x.example.net/de/81#f", None), (4, None, None), (5, "no host", None), (6, "http://spam-farm.org/fr/", "<a href='http://victim.org/'>"),
    (7, "http://good.example.com/en/7", '<a href="//friend.org/x">'), (8, "http://friend.org/", ""), (9, "http://linker.org/", '<a href="http://spam-farm.org/1">x</a>'), (10, "http://xcom/en/", ""), (11, "http://com/en/", ""), (12, "s3://h?x", ""),
]


def test_url_rules_and_standings(spark):
    rows = spark.createDataFrame(URLS, "page_id long, url string, html string").withColumn("rule", F.lit("x"))
    got = {r.page_id: r for r in urls.judged(rows, blocked_terms=("spam", "ends")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/de/", "allow")
    assert (got[3].rule, got[3].verdict) == ("example.net/de/8", "block")
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (4, 5)] == [("", "", None, "allow")] * 2
    assert got[6].verdict == "block" and got[9].verdict == "block" and got[8].verdict == "allow"
    assert got[10].rule is None and got[11].rule == "com/en/" and (got[12].host, got[12].path) == ("h", "")
    assert urls.judged(rows.limit(0)).count() == 0


def test_rules_seed_the_host_graph_of_the_query(spark, tmp_path):
    long = "<p>x</p>" * 20_000
    pages = [
        (1, "http://bad.org/es/1", ""), (2, "http://bad.org/es/2", long + '<a href="http://victim.fr/">v</a>'), (3, "http://bad.org/fr/", None),  # rules block most of it
        (4, "http://linker.fr/a", long + "<a href='//bad.org/es/1'>b</a>"), (5, "http://victim.fr/", ""),  # links to it; is linked by it
        (6, "http://www.example.com/en/7", '<A HREF=http://friend.fr/x>f</A>'), (7, "http://friend.fr/", ""), (8, "http://mixed.com/en/1", ""), (9, "http://mixed.com/a", ""), (10, "http://mixed.com/b", ""),
        (11, "http://downloads.fr/", ""), (4, "http://linker.fr/a", None), (None, None, None),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("rule", F.lit("r")).withColumn("n", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.rule, r.verdict) for r in urls.op3_url_filters(spark, str(tmp_path)).collect()]
    assert len(got) == len(pages) and dict((p, v) for p, _, v in got) == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow", 11: "allow", None: "allow"}
    assert {p: r for p, r, _ in got if r} == {1: "org/es/", 2: "org/es/", 6: "example.com/en/7", 8: "com/en/"}


def test_standings_equal_power_iteration(spark):
    random.seed(1)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(random.choice(hosts), random.choice(hosts)): random.randint(1, 5) for _ in range(30)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    seeds = {h: (float(i in (0, 1)), float(i == 5)) for i, h in enumerate(hosts)}
    got = urls.standings(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trusted double, blocked double"), spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"), epsilon=1e-10)
    got = {r.host: (r.trust, r.distrust) for r in got.collect()}
    for v, flow in ((0, edges), (1, {(b, a): n for (a, b), n in edges.items()})):
        total = sum(s[v] for s in seeds.values())
        seed = {h: s[v] / total for h, s in seeds.items()}
        out = {h: sum(n for (a, _), n in flow.items() if a == h) for h in hosts}
        now = dict(seed)
        for _ in range(200):
            lost = sum(now[h] for h in hosts if not out[h])
            now = {h: 0.15 * seed[h] + 0.85 * (lost * seed[h] + sum(now[a] * n / out[a] for (a, b), n in flow.items() if b == h)) for h in hosts}
        assert all(abs(now[h] - got[h][v]) < 1e-4 for h in hosts)


# 4


def targets_by_hand(sizes):
    """Round after round: targets above the cap stop there, the excess is shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        want = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if want[s] > 3 * sizes[s]}
        if not over:
            return {s: want.get(s, 3.0 * sizes[s]) for s in names}
        full |= over


def test_mixing_reaches_its_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source")))
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and sorted(mixing.mixed(docs.repartition(5)).collect(), key=str) == sorted(rows, key=str)
    text = {r.doc_id: r.text for r in docs.collect()}
    sizes: dict = {}
    for r in rows:
        assert r["size"] == len(words_of(text[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
        assert r.taken == sum(x.words for x in r.occurrences) and all(0 <= x.position < 1 for x in r.occurrences)
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = targets_by_hand(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert own[0].source_size == sizes[s] and math.isclose(own[0].target, want[s], rel_tol=1e-9)
        assert abs(sum(r.taken for r in own) - want[s]) <= 1


def test_position_inverts_the_schedule(spark):
    for i, knots in enumerate(mixing.SCHEDULES):
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("f"))
        for r in rows.select("f", mixing.position(F.col("f"), F.lit(i), mixing.SCHEDULES).alias("t")).collect():
            ts = np.linspace(0, r.t, 2001)
            hs = np.interp(ts, *zip(*knots, strict=True))
            area = np.trapezoid(np.interp(np.linspace(0, 1, 2001), *zip(*knots, strict=True)), np.linspace(0, 1, 2001))
            assert abs(np.trapezoid(hs, ts) / area - r.f) < 1e-3


def test_mixing_odd_rows(odd, none):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken == 0 for r in rows if not r["size"])
    assert mixing.mixed(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    out = mixing.mixed_rows(odd)
    assert out.columns == odd.columns and {r.own_size for r in out.collect()} <= {"extra"}
    assert out.collect() == mixing.mixed_rows(odd.repartition(4)).collect()


def test_mixed_rows_leave_nothing_to_chance(spark):
    rng = random.Random(9)
    rows = [(i // 3, " ".join(rng.choices("abc", k=rng.randint(1, 9))), rng.choice(["a", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:60] + rows[:60], "doc_id long, text string, source string")  # ids shared, and rows repeated
    out = [tuple(r) for r in mixing.mixed_rows(docs).collect()]
    assert out == [tuple(r) for r in mixing.mixed_rows(docs.repartition(7)).collect()]
    taken: dict = {}
    for r in mixing.mixed(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, n in taken.items():  # but for the one document taken in part
        assert abs(sum(len(t.split()) for _, t, s in out if s == source) - n) <= 9


def test_the_query_of_the_mix_comes_from_the_mix_in_training_order(spark, small, monkeypatch):
    made = []
    monkeypatch.setattr(mixing, "stage", lambda df, name, of=mixing.stage: made.append((name, of(df, name))) or made[-1][1])
    rows = mixing.op4_mixing(spark, small).collect()
    mix = dict(made)["mix"].select("*", "_metadata.file_name", "_metadata.row_index").collect()
    mix.sort(key=lambda r: (r.file_name, r.row_index))
    assert [r.position for r in mix] == sorted(r.position for r in mix)
    taken, first = {}, {}
    for r in mix:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
        first.setdefault(r.doc_id, round(r.position, 6))
    assert len(taken) == len(first) > 100
    assert {r.doc_id: (r.taken, r.position) for r in rows if r.taken} == {d: (taken[d], first[d]) for d in taken}
    # each source's words in each third of the time are what its integrated schedule asks for
    for place, knots in enumerate(mixing.SCHEDULES):
        own = [r for r in mix if r.place == place]
        ts, words = np.linspace(0, 1, 3001), sum(r.words for r in own)
        hs = np.interp(ts, *zip(*knots, strict=True))
        for k in range(3):
            share = np.trapezoid(hs[1000 * k : 1000 * k + 1001], ts[1000 * k : 1000 * k + 1001]) / np.trapezoid(hs, ts)
            assert abs(sum(r.words for r in own if k <= 3 * r.position < k + 1) - share * words) <= 2 * max((r.words for r in own), default=0)


# 5


def segments_by_hand(scores):
    """Maximal scoring segments by their definition: the best segment, then the same on both sides of it."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a, b = -best[2], -best[2] - best[1]
    left, right = segments_by_hand(scores[:a]), segments_by_hand(scores[b:])
    return [*left, (a, b, best[0]), *((x + b, y + b, s) for x, y, s in right)]


def test_maximal_segments_equal_their_definition():
    random.seed(2)
    for _ in range(300):
        scores = [random.choice([-5, -3, -2, -1, 1, 2, 4]) + random.random() / 1000 for _ in range(random.randint(0, 14))]
        got = toxicity.maximal_segments(scores)
        want = segments_by_hand(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_toxicity_learns_planted_words(spark):
    random.seed(3)
    pool = [f"w{i}" for i in range(300)]
    rows, known = [], []
    for i in range(600):
        words = random.choices(pool, k=random.randint(30, 200))
        toxic = i % 6 == 0
        if toxic:
            words[5:5] = random.choices(["vile", "rotten"], k=3)
        rows.append((i, " ".join(words)))
        known.append((i, 1, int(toxic)))
    rows += [(1000, None), (None, "x"), (0, rows[0][1])]
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9)), spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.95 * len(held)


def test_toxicity_without_labels(spark, odd, none, labels):
    assert {r.score for r in toxicity.scored(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scored(odd, labels).count() == len(ODD)
    assert toxicity.scored(none, labels).count() == 0


# 6


PAGES = [(3, "http://a/ b", "x" * 200), (1, "http://a", "x" * 200), (2, None, "y" * 50), (5, "http://c", "y" * 50), (4, "http://d", None), (None, "http://e", "x" * 200), (1, "http://a", "x" * 200), (9, "http://f", "é\r\n\r\nWARC/1.0\r\n" * 30)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record", F.lit(1)).repartition(3)
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(pages, arc)
    warc.convert(spark, arc, out)
    rows = warc.read_warc(spark, out).collect()
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in rows) == sorted((p or -1, len((h or "").encode()), digest(h)) for p, _, h in PAGES)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in rows if r.payload_digest == digest("x" * 200))
    assert [k[:2] for k in kinds] == [(-1, "revisit"), (1, "response"), (1, "revisit"), (3, "revisit")] and all(k[2] == 1 for k in kinds if k[1] == "revisit")
    assert {r.record_type for r in rows if r.payload_bytes < 100} == {"response"}
    assert len({r.record_id for r in rows}) == len(rows)
    import glob
    import gzip

    names = glob.glob(out.removeprefix("file://") + "/*")
    assert len(names) == 3 and not glob.glob(out.removeprefix("file://") + "/.*.warc.gz")  # one WARC file for each ARC file
    by_id, infos = {}, set()
    for name in names:
        data = open(name, "rb").read()
        with gzip.open(name) as f:
            records = list(warc.warc_records(f))
        assert data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") == len(records)  # a member for each record
        by_id |= {w["warc-record-id"]: w for w, _ in records}
        infos |= {w["warc-record-id"] for w, _ in records if w["warc-type"] == "warcinfo"}
    for w in by_id.values():
        assert w["warc-type"] == "warcinfo" or w["warc-warcinfo-id"] in infos
        if w["warc-type"] == "revisit":
            first = by_id[w["warc-refers-to"]]
            assert (first["warc-type"], first["warc-target-uri"], first["warc-date"]) == ("response", w["warc-refers-to-target-uri"], w["warc-refers-to-date"])


def test_arc_versions_and_foreign_records():
    import io

    for version in (1, 2):
        name = "old.arc"
        body = b"raw \x00\xff dns answer"
        data = warc.arc_start(version, name) + b"\n" + warc.arc_header(version, "dns:x", "text/dns", len(body), name, 0, "-", "19990102030405") + body + b"\n"
        found = list(warc.arc_records(io.BytesIO(data)))
        assert [f["URL"] for _, f, _ in found] == ["filedesc://old.arc", "dns:x"] and found[1][2] == body
        record = warc.warc_record(name, found[1][0], found[1][1], body)
        (headers, block), = warc.warc_records(io.BytesIO(record + b"\r\n\r\n"))
        assert (headers["warc-type"], headers["warc-date"], block) == ("resource", "1999-01-02T03:04:05Z", body)
    with pytest.raises(EOFError):
        list(warc.arc_records(io.BytesIO(data[:-9])))


def test_warc_very_long_pages(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://a/", "<p>é</p>\r\n\r\nWARC/1.1\n" * 200_000) for i in range(2)] + [(2, None, "x" * 99), (3, None, "x" * 99)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.op6_warc(spark, str(tmp_path)).collect()}
    assert got == {0: (4_400_000, "response", None), 1: (4_400_000, "revisit", 0), 2: (99, "response", None), 3: (99, "response", None)}


def test_warc_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(pages, arc)
    warc.convert(spark, arc, out)
    assert warc.read_warc(spark, out).count() == 0


# 7


def fingerprint_by_hand(text):
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes_by_hand(rows):
    fp = {}
    for d, t in rows:
        fp.setdefault(fingerprint_by_hand(t), []).append(d)
    left, out = set(fp), {}
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            a = todo.pop()
            near = {b for b in left if (a ^ b).bit_count() <= 2}
            left -= near
            todo += near
            group += near
        ids = [d for f in group for d in fp[f] if d is not None]
        for f in group:
            for d in fp[f]:
                out.setdefault(d, set()).add((f, min(ids) if ids else None))
    return out


def test_simhash_equals_brute_force(spark, small, odd, none):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for rows in (docs, odd):
        want = classes_by_hand([(r.doc_id, r.text) for r in rows.collect()])
        for bucket in (1024, 1):
            got = simhash.classes(rows, bucket=bucket).collect()
            assert len(got) == rows.count()
            assert all((r.fp % 2**64, r.component_id) in want[r.doc_id] for r in got)
    assert simhash.classes(none).count() == 0


@pytest.mark.parametrize(("radius", "bits"), [(1, 64), (2, 64), (2, 28), (4, 64), (6, 64), (6, 32)])
def test_masks_cover(radius, bits):
    random.seed(radius)
    found = simhash.masks(radius, list(range(bits)))
    assert len(found) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        d = sum(1 << b for b in random.sample(range(bits), random.randint(0, radius)))
        assert any(not d & m for m in found)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (3, 2)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_keep_one_of_each_group(spark, odd, none):
    random.seed(4)
    rows = []
    for g in range(30):
        words = [f"g{g}w{random.randint(0, 400)}" for _ in range(300)]
        rows.append((g * 100, " ".join(words)))
        for k in range(1, 1 + g % 4):
            copy = list(words)
            for at in random.sample(range(300), 3):
                copy[at] = f"new{g}x{k}y{at}"
            rows.append((g * 100 + k, " ".join(copy)))
    got = {r.doc_id: r.keeper for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = [d for d, k in got.items() if k == d // 100 * 100]
    assert len(got) == len(rows) and len(same) >= 0.95 * len(rows) and all(k // 100 == d // 100 for d, k in got.items())
    assert simhash.keep_first(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    shared = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (0, "a b c"), (None, "g"), (None, "g"), (2, "d e f")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_first(shared).collect()), key=str) == [(0, "a b c"), (1, "d e f"), (None, "g")]


def chained(texts):
    """Groups of texts by exact similarity of all pairs, as the least index of each one's component."""
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
            lo, hi = sorted((root[i], root[j]))
            root = [lo if r == hi else r for r in root]
    return root


def test_near_duplicates_of_one_vocabulary_are_all_compared(spark):
    rng, texts = random.Random(6), []
    for _ in range(40):  # 40 groups of 2 near copies over one shared vocabulary: one component of fingerprints
        words = [f"w{i}" for i in rng.sample(range(120), 120)]
        texts += [" ".join(words), " ".join(words[:118] + ["w0", "w1"])]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.keeper for r in got} == dict(enumerate(chained(texts))) and len({r.keeper for r in got}) == 40


@pytest.mark.parametrize("whole", [1, simhash.WHOLE])  # with 1, all shingles go through the rounds
def test_near_duplicates_are_joined_over_chains_of_edits(spark, monkeypatch, whole):
    monkeypatch.setattr(simhash, "WHOLE", whole)
    rng, texts = random.Random(8), []
    for g in range(20):  # a text, five one-word edits, and a four-word edit of a four-word edit: like each other, not all like one centre
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(200)]

        def edited(words, n, name):
            out = list(words)
            for at in rng.sample(range(200), n):
                out[at] = f"{name}{at}"
            return out

        b = edited(base, 4, f"b{g}x")
        texts += [" ".join(t) for t in (edited(b, 4, f"c{g}x"), b, base, *(edited(base, 1, f"e{g}x{i}y") for i in range(5)))]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.keeper for r in got} == dict(enumerate(chained(texts))) and len({r.keeper for r in got}) < 24


def test_near_duplicates_hold_the_classes_of_the_operator(spark, odd):
    """Two texts within 2 bits whose five-word shingles are less than 0.8 alike, and a third far from both."""
    words = [f"w58x{i}" for i in range(40)]
    rows = [(3, " ".join(words)), (1, " ".join([*words[:20], "new", *words[21:]])), (2, " ".join(f"z{i}" for i in range(40)))]
    a, b = (simhash.fingerprint(t) for _, t in rows[:2])
    assert ((a ^ b) % 2**64).bit_count() <= simhash.RADIUS and chained([t for _, t in rows]) == [0, 1, 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.keeper for r in simhash.near_duplicates(docs).collect()} == {3: 1, 1: 1, 2: 2}
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [1, 2]
    for docs in (docs, odd):  # whatever the operator puts in one class is in one group
        of = simhash.classes(docs).select("doc_id", "component_id").join(simhash.near_duplicates(docs), "doc_id").filter("component_id is not null")
        assert all(r.n == 1 for r in of.groupBy("component_id").agg(F.countDistinct("keeper").alias("n")).collect())


def rows_made(node):
    """The most rows that a join or an explode of an executed plan made."""
    kind, more = node.getClass().getSimpleName(), []
    if kind == "AdaptiveSparkPlanExec":
        more = [node.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        more = [node.plan()]
    own = node.metrics().get("numOutputRows")
    n = own.get().value() if own.isDefined() and ("Join" in kind or "Generate" in kind) else 0
    return max([n, *map(rows_made, more), *(rows_made(node.children().apply(i)) for i in range(node.children().size()))])


def test_near_copies_that_are_not_alike_make_few_rows(spark, monkeypatch):
    rng, texts, made = random.Random(3), [[f"w{i}" for i in range(100)]], []
    while len(texts) < 400:  # edits of edits of one text: all share shingles, far from all are alike
        texts.append(list(rng.choice(texts)))
        for at in rng.sample(range(100), 3):
            texts[-1][at] = f"e{len(texts)}x{at}"
    texts = [" ".join(t) for t in texts]

    def verified(pairs, *rest, of=simhash._verified):
        pairs.collect()
        made.append(rows_made(pairs._jdf.queryExecution().executedPlan()))
        return of(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", verified)
    got = {r.doc_id: r.keeper for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    alike = chained(texts)
    assert all(got[i] == got[root] for i, root in enumerate(alike))
    assert max(made) < 20 * len(texts), made


# 8


def measures_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at: dict = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again))


def test_quality_measures_equal_brute_force(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [r[1] for r in ODD] + ["a b " * 40, "x\n\nx\n x\nx"]
    for t in texts:
        assert quality.measures(t)[0] == measures_by_hand(t)


def test_binomial_tail_and_fixed_sequence():
    for n, k, p in ((50, 3, 0.1), (400, 0, 0.01), (1000, 30, 0.02), (10, 10, 0.5)):
        assert math.isclose(quality.tail(n, k, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)
    assert quality.certified(10, [0, 0], 0.01, 0.001) == 0
    assert quality.certified(2000, [0, 0, 3, 40, 0], 0.01, 0.01) == 3


def test_cutoffs_keep_good_documents(spark):
    good = [(i, "en", [0.0, 0.0, 0.0, 0.0, 0.0, 5.0, -5.0]) for i in range(3000)] + [(i, "xx", [0.0] * 5 + [5.0, -5.0]) for i in range(9000, 9020)]
    rated = spark.createDataFrame(good, "doc_id long, stratum string, rates array<double>")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good], "doc_id long, quality int, toxic int")
    cut = {r.stratum: r.cutoffs for r in quality.fit_cutoffs(rated, labels).collect()}
    assert cut["en"][0] == quality.RULES["symbol_rate"][-1] and all(math.isinf(x) for x in cut["xx"])
    junk = spark.createDataFrame([(1, "en", [2.0, 0.0, 0.0, 0.0, 0.0, 8.0, -8.0], False), (2, "en", good[0][2], False), (3, "xx", [2.0] * 7, False), (4, None, [2.0] * 7, True)], "doc_id long, stratum string, rates array<double>, base_failed boolean")
    assert {r.doc_id: r.kept for r in quality.judged(junk, quality.fit_cutoffs(rated, labels)).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_quality_odd_rows(odd, none, labels):
    kept = quality.kept_rows(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(ODD)
    rated = quality.measured(odd.select("doc_id", "text"))
    assert rated.count() == len(ODD)
    assert quality.kept_rows(none, labels).count() == 0 and quality.kept_rows(odd, labels.limit(0)).count() == rated.filter("not base_failed").count()


# 9


def test_word_encoder_equals_the_library():
    e = tokens.WordEncoder(tokens.tokenizer_path())
    texts = ["", " ", "a  b", " a\n b\t c  ", "don't we'll 12 3 4", "a\x1cb c　d", "\n\n a", "x, y. (z) *** é 漢字 😀 ok", LONG[:5000], "<|endoftext|> a", "end ", " head"]
    random.seed(5)
    texts += ["".join(random.choices(" \n\t.,'aZé9漢 ", k=40)) for _ in range(500)]
    texts += ["".join(random.choices(" \n\t' \x1c\x85abÉßж7½²ªµ.,!?…—😀中a\u200b\u180e\u0301sdm  ", k=random.randrange(30))) for _ in range(3000)]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want and [x.tolist() for x in e.encode(texts)] == want
    tokens.CACHE, cache = 10, tokens.CACHE  # what is forgotten is learnt again
    assert [x.tolist() for x in e.encode(texts[::-1])] == want[::-1]
    tokens.CACHE = cache


def test_token_files_round_trip(spark, small, odd, none):
    import tempfile

    e = tokens.WordEncoder(tokens.tokenizer_path()).tokenizer
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    folder = "file://" + tempfile.mkdtemp()
    manifest = tokens.write_ids(docs, folder)
    got = sorted(tokens.read_ids(spark, folder, manifest).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*e.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert tuple(g) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    shard = tokens.Shard(folder, manifest[0][0])
    assert shard.ids(1).tolist() == [*e.encode(rows[1].text, add_special_tokens=False).ids, 2]
    odd_rows = sorted(tokens.token_files(odd).collect(), key=lambda r: r.start)
    assert len(odd_rows) == len(ODD) and odd_rows[0].doc_id is None and [r.doc_id for r in odd_rows[1:]] == sorted(r[0] for r in ODD if r[0] is not None)
    assert tokens.token_files(none).count() == 0


@pytest.mark.parametrize("values", [[], [7], [0, 0, 5, 5, 9], [-5, 3, 2**62], list(range(0, 100000, 37)), [4] * 1000])
def test_elias_fano(values):
    x, end = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.int64)).to_bytes())
    assert x.decode().tolist() == values and [x.select(i) for i in range(0, x.n, 7)] == values[::7]
    with pytest.raises(IndexError):
        x.select(len(values))


# 10


def hits_by_hand(text, items):
    """Items of which 0.8 of the five-word shingles stand in one passage, by sliding over all texts."""
    words = decontaminate.terms(text)
    out = []
    for i, t in items:
        want = decontaminate.shingles(decontaminate.terms(t))
        if want and len(want & decontaminate.shingles(words, len(next(iter(want))))) >= 0.8 * len(want):
            out.append(i)
    return sorted(set(out))


def test_decontamination_equals_brute_force(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    index = decontaminate.Index(items)
    found = 0
    for r in docs.collect():
        want = hits_by_hand(r.text, items)
        assert set(want) <= {h["item_id"] for h in index.hits(r.text)}
        found += bool(want)
    assert found
    parts = decontaminate.with_hits(docs, spark.read.parquet(f"{small}/benchmark.parquet"), part_words=300)
    assert parts.filter("size(found) > 0").count() == decontaminate.with_hits(docs, spark.read.parquet(f"{small}/benchmark.parquet")).filter("size(found) > 0").count() >= found


def test_wand_retrieves_all_above_the_threshold():
    random.seed(6)
    vocab = [f"t{i}" for i in range(60)]
    index = decontaminate.Index([(i, " ".join(random.choices(vocab, k=random.randint(1, 30)))) for i in range(50)])
    for _ in range(200):
        query = index.numbers([w.encode() for w in random.choices([*vocab, "unknown"], k=25)])
        scores: dict[int, float] = {}
        for c in index.classes:
            term = np.repeat(np.arange(len(index.vocab)), np.diff(c.posting[c.entry]))
            for t, d, w in zip(term, c.items, c.scores, strict=True):
                scores[int(d)] = scores.get(int(d), 0.0) + w * (t in query)
        got = set().union(*(c.retrieve(query, 0.5) for c in index.classes))
        assert {d for d, x in scores.items() if x >= 0.5 + 1e-9} <= got <= {d for d, x in scores.items() if x >= 0.5 - 1e-9}


def test_a_long_item_widens_its_own_passages_only():
    random.seed(7)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(random.choices(words, k=20))) for i in range(400)]
    index = decontaminate.Index([*items, (999, " ".join(random.choices(words, k=9000)))])
    assert [c.stride for c in index.classes] == [20, 9000] and sum(len(c.items) for c in index.classes) < 400 * 20 + 5000 + 1
    text = " ".join(random.choices(words, k=3000)) + " " + items[7][1] + " " + " ".join(random.choices(words, k=3000))
    assert [h["item_id"] for h in index.hits(text)] == [7]


def test_decontamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, ODD[0][1]), (2, None), (3, ""), (None, "no id here"), (4, "x"), (5, ODD[0][1]), (1, ODD[0][1])], "item_id long, text string")
    rows = {(r.doc_id, r.text): [h.item_id for h in r.found] for r in decontaminate.with_hits(odd.drop("found"), bench).collect()}
    assert rows[1, ODD[0][1]] == [1, 5] and rows[7, "x"] == [4] and rows[3, None] == []
    kept = decontaminate.clean_rows(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 8]
    assert decontaminate.clean_rows(none, bench).count() == 0 and decontaminate.clean_rows(odd, bench.limit(0)).count() == len(ODD)


# pipeline


def test_pipeline_runs_and_its_stages_take_effect(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, small)
        assert out.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and {"doc_id", "start", "n_tokens", "ids_crc32"} == set(rows[0].asDict())
    ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_token_files_follow_the_mix(spark, small):
    from hearken.llm import pipeline
    from hearken.llm.common import stage

    docs = spark.read.parquet(f"{small}/documents.parquet")
    order = [r.doc_id for r in mixing.mixed_rows(docs).collect()]
    mix = stage(mixing.mixed_rows(docs), "mix")
    rows = sorted(pipeline.token_ids(spark, mix, small).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == order != sorted(order)


def test_pipeline_with_odd_rows(spark, odd, small):
    from hearken.llm import pipeline
    from hearken.llm.common import stage

    text = " ".join(f"word{i}" for i in range(40))
    more = spark.createDataFrame([(20, text, None, None, None), (20, text, None, None, None), (21, text + " x", "en", "b", 1), (None, text.upper(), "en", None, 1), (None, "other " + " ".join(f"z{i}" for i in range(30)), None, "b", 1)], DOCS)
    docs = odd.unionByName(more.select("*", *[F.lit("extra").alias(c) for c in odd.columns[5:]]))
    kept = {}
    for name, step in pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, small), "odd")
        kept[name] = docs.collect()
        assert docs.columns == odd.columns and {r.own_size for r in kept[name]} <= {"extra"}
    assert sorted((r.doc_id or 0) for r in kept["quality rules"]) == [0, 0, 20, 20, 21]  # LONG repeats itself
    assert sorted((r.doc_id or 0) for r in kept["near duplicates"]) == [0, 20]
    assert len(pipeline.token_ids(spark, docs, small).collect()) == len(kept["mix"])


def test_pipeline_of_nothing(spark, none, small):
    import corpus_pipeline

    docs = none
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, small)
        assert docs.count() == 0, name


# queries with SQL


def test_queries_equal_their_sql(spark, small):
    import duckdb

    from hearken.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df, rel = QUERIES[name](spark, small), con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(rel.columns)
        at = [rel.columns.index(c) for c in cols]
        assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str), name
