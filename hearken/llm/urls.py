"""URL filters: rules first, then trust and distrust propagated over the host graph (operator 3); DataFrame operations only.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and the longest that fits decides.
Where none fits, the host's standing decides.  Trust is a personalised PageRank from trusted hosts along links;
distrust the same from blocked hosts along reversed links, as a page that links to bad ones is itself suspect.  Both
run in one table of hosts over one table of host edges, each weighted by the share of the source's links; mass
that a host without links would lose returns to the seeds.  A host is blocked if distrust makes up BLOCK_SHARE of what
reaches it.

Seeds come from the rules: a host is trusted by the pages that allow rules name on it, if rules block none there; it is blocked
by the pages that rules block, if they are SEED_SHARE of its pages at least and none is allowed, so that one blocked path doesn't
give up a whole host.  Further seeds can be given as tables, or as terms that a part of the host's name must equal.

Rounds go on until neither vector moves by EPSILON, each written to the shared folder; a round shrinks the movement by the
damping at least, so there is an end.  Hosts join by name; a host with very
many links is summed before it is joined, so no task gets its links together.

Nulls and odd input: a null url, or one without ://, has empty host and path, which no rule fits, and is allowed; a null
html has no links; repeated rows repeat results; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import stage, table, workspace

#: (host, path, verdict); fixed values.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DAMPING, EPSILON, BLOCK_SHARE, SEED_SHARE = 0.85, 1e-4, 0.5, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null.  Rules are parameters; their number is the caller's.

    Each host is looked up by its suffixes in a map, so the work grows with a host's labels and not with the rules.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append((p, v))
    kind = "array<struct<size:int,rule:string,path:string,verdict:string>>"
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entries = []
    for h, own in sorted(by_host.items()):
        entries += [F.lit(h), F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for p, v in own]).cast(kind)]
    lookup = F.create_map(*entries)
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(lookup, s), F.array().cast(kind))))
    best = F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links of a page table (host, html) to other hosts, counted."""
    link = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
    found = F.when(F.contains("html", F.lit("//")), F.regexp_extract_all("html", F.lit(link), F.lit(1)))
    out = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst")).withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return out.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def standings(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, epsilon: float = EPSILON) -> DataFrame:
    """hosts (host, trusted, blocked: seed weights) and edges (src, dst, n) -> (host, trust, distrust)."""
    with workspace(hosts.sparkSession) as keep:
        return keep(_propagated(hosts, edges, damping, epsilon), "standings")


def _propagated(hosts: DataFrame, edges: DataFrame, damping: float, epsilon: float) -> DataFrame:
    ends = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    known = hosts.groupBy("host").agg(F.sum("trusted").alias("trusted"), F.sum("blocked").alias("blocked"))
    known = stage(known.join(ends, "host", "full").na.fill(0.0, ["trusted", "blocked"]), "hosts")
    sums = known.agg(F.sum("trusted"), F.sum("blocked")).first()
    t, d = (max(sums[0] or 0.0, 1e-300), max(sums[1] or 0.0, 1e-300))
    known = known.select("host", (F.col("trusted") / t).alias("st"), (F.col("blocked") / d).alias("sd"))
    out_n = edges.groupBy("src").agg(F.sum("n").alias("out_n"))
    in_n = edges.groupBy("dst").agg(F.sum("n").alias("in_n"))
    # a link carries trust onward by its share of the source's links, and distrust back by its share of the target's
    both = edges.join(out_n, "src").join(in_n, "dst")
    flow = both.select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("out_n")).alias("wt"), F.lit(0.0).alias("wd"))
    flow = stage(flow.unionByName(both.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("wt"), (F.col("n") / F.col("in_n")).alias("wd"))), "flow")
    now = stage(known.select("host", "st", "sd", F.col("st").alias("trust"), F.col("sd").alias("distrust")), "standing")
    while True:
        moved = flow.join(now.select(F.col("host").alias("a"), "trust", "distrust"), "a").groupBy(F.col("b").alias("host")).agg(F.sum(F.col("wt") * F.col("trust")).alias("gt"), F.sum(F.col("wd") * F.col("distrust")).alias("gd"))
        moved = stage(moved, "moved")
        got = moved.agg(F.coalesce(F.sum("gt"), F.lit(0.0)), F.coalesce(F.sum("gd"), F.lit(0.0))).first()
        had = now.agg(F.sum("trust"), F.sum("distrust")).first()
        lost = [max(0.0, (h or 0.0) - g) for h, g in zip(had, got, strict=True)]
        new = now.drop("trust", "distrust").join(moved, "host", "left")
        after = [F.lit(damping) * (F.coalesce(g, F.lit(0.0)) + F.lit(lost[i]) * F.col(s)) + F.lit(1 - damping) * F.col(s) for i, (g, s) in enumerate((("gt", "st"), ("gd", "sd")))]
        old = now.select("host", F.col("trust").alias("ot"), F.col("distrust").alias("od"))
        now = stage(new.join(old, "host").select("host", "st", "sd", after[0].alias("trust"), after[1].alias("distrust"), "ot", "od"), "standing")
        change = now.agg(F.sum(F.abs(F.col("trust") - F.col("ot"))), F.sum(F.abs(F.col("distrust") - F.col("od")))).first()
        now = now.drop("ot", "od")
        if max(change[0] or 0.0, change[1] or 0.0) < epsilon:
            break
    return now.select("host", "trust", "distrust")


def judged(pages: DataFrame, rules=RULES, blocked_terms: tuple[str, ...] = (), trusted: DataFrame | None = None, blocked: DataFrame | None = None, block_share: float = BLOCK_SHARE) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict, trust, distrust.  trusted, blocked: (host)."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").cast("string").alias("html"))
    ruled = own.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    by_name = F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, blocked_terms)).cast("array<string>"))
    counts = ruled.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("r.verdict") == "allow").alias("a"), F.count_if(F.col("r.verdict") == "block").alias("b"), F.count("*").alias("n"))
    as_blocked = F.when(by_name, F.greatest("b", F.lit(1))).when((F.col("a") == 0) & (F.col("b") >= SEED_SHARE * F.col("n")), F.col("b")).otherwise(0)
    seeds = counts.select("host", F.when((F.col("b") == 0) & ~by_name, F.col("a")).otherwise(0).cast("double").alias("trusted"), as_blocked.cast("double").alias("blocked"))
    for more, kind in ((trusted, "trusted"), (blocked, "blocked")):
        if more is not None:
            seeds = seeds.unionByName(more.select("host", *[F.lit(float(kind == k)).alias(k) for k in ("trusted", "blocked")]))
    of_host = standings(seeds, stage(host_edges(own), "host-edges"))
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= block_share * (F.col("trust") + F.col("distrust")))
    of_host = stage(of_host.select(F.col("host").alias("h"), "trust", "distrust", bad.alias("bad")), "host-standings")
    both = ruled.drop("html").join(of_host, F.col("host") == F.col("h"), "left")
    method = F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
