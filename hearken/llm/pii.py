"""Personal data by weak supervision (operator 1); DataFrame operations only.

Base kinds have fixed patterns and checks, and what passes them is always a span.  Beyond them candidates are found by
looser patterns (a phone number without +, a national id, a masked mail address, a person after a form of address, a
key or password after its name, a bank account, a date of birth).
Labelers vote on every candidate, base matches that pass or fail their check included: a strict check of the kind, a
gazetteer, cue words of the kind before it, its isolation, and the absence of contrary cues.  Expectation-maximisation over
the counts of vote patterns, for each kind by itself, estimates how often each labeler fires on true and on other
candidates; there are a few dozen patterns a kind whatever the corpus.  The posterior of a pattern is a soft label.

On the soft labels of all candidates a naive Bayes classifier is trained, which sees what the labelers don't: the span's shape
and length, the words on both sides, and the kind's prior; words and shapes are numbered by a hash below FEATURES, so
the model's size is fixed.  Its evidence is added to that of the votes; a candidate that gets KEEP or more so, and touches
no base span, becomes a span of its own kind.

Places: Spark's functions give the matches and the pieces between them, so a start is a running sum of lengths, taken in
blocks so that a text of very many matches costs no square of their number.  Patterns are written so that no search
steps back over a run, and loops inside them take no stack.

Nulls and odd input: a null text is empty, has no span and the hash of the empty string; a null doc_id stays null; repeated
rows repeat results; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.common import stage, table

BASE = ["email", "ip", "card", "phone"]
EXTRA = ["local_phone", "national_id", "masked_email", "person", "secret", "iban", "birth_date"]
KINDS = BASE + EXTRA
KEEP, ROUNDS, CONTEXT, BLOCK, LABELERS = 0.9, 30, 40, 256, 5
#: Numbers of the classifier's features, and how many each candidate has; a feature moves the logit by SWAY at most, as a hash can bring unlike words together.
FEATURES, N_FEATURES, SWAY = 4096, 5, 3.0
#: Fixed patterns of the base kinds.  (?<!x)|\G stands for a start that is not inside a run already tried.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "masked_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[({]at[\])}]\x20?[a-z0-9-]{1,63}\x20?(?:\.|[\[({]dot[\])}])\x20?[a-z]{2,24}",
    "person": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?|Don|Doña)\.?\x20\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20})?",
    "secret": r"(?i)(?<![a-z0-9])(?:(?:api|access|secret|private|auth)[_-]?(?:key|token)|secret|token|passwd|password|pwd)[\"']?\x20?[:=]\x20?[\"']?[a-z0-9+/_=.-]{8,200}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "birth_date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9./-])",
}
#: What a text must have for its search to be worth starting: a plain string, or a digit.
NEEDS = {"email": "@", "phone": "+", "national_id": "-", "masked_email": "at", "person": " "}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$",
    "ip": rf"^{_PART}(?:\.{_PART}){{3}}$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-]?\x20?[2-9][0-9]{2}[\x20.-][0-9]{4}$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "masked_email": r"(?i)[\[({]at[\])}].*(?:\.|dot[\])}])\x20?[a-z]{2,24}$",
    "person": r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$",
    "secret": r"[:=]\x20?[\"']?(?=[^\x20]*[0-9])(?=[^\x20]*[A-Za-z])[A-Za-z0-9+/_=.-]{16,}$",
    "birth_date": r"^(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-](?:19|20)[0-9]{2})$",
}
#: Gazetteers; fixed lists.  Ends of mail domains, private and well-known networks, card issuers, country codes of phones,
#: area codes of large cities, areas of national ids that were issued, given names, issuers' shapes of keys, countries of bank accounts.
_ENDS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|de|at|ch|fr|es|it|pt|nl|be|lu|uk|ie|dk|se|no|fi|pl|cz|ru|ua|kz|tr|gr|ro|hu|eu|us|ca|mx|br|ar|cl|co|au|nz|jp|kr|cn|in|za"
_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Mark|Paul|Steven|Andrew|George|Kevin|Brian|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|"
    "Jessica|Sarah|Karen|Nancy|Lisa|Emma|Olivia|Sophie|Anna|Laura|Julia|Peter|Hans|Klaus|Jürgen|Wolfgang|Stefan|Andreas|Markus|Sabine|Ursula|Monika|Petra|Claudia|Heike|Jean|Pierre|Michel|Jacques|"
    "Philippe|Nicolas|Marie|Nathalie|Isabelle|Sylvie|Catherine|Françoise|José|Juan|Carlos|Luis|Miguel|Antonio|Francisco|Javier|Manuel|María|Carmen|Ana|Isabel|Pilar|Dolores|Elena|Lucía"
)
GAZETTEER = {
    "email": rf"(?i)\.(?:{_ENDS})$",
    "ip": r"^(?:10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|1\.1\.1\.1$|8\.8\.[48]\.[48]$|9\.9\.9\.9$)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35(?:2[89]|[3-8])|30[0-5]|3[689]|62)",
    "phone": r"^\+\x20?(?:1|7|2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[1-9]|37[0-9]|38[0-9]|42[01])",
    "local_phone": r"^\(?(?:2(?:02|06|10|12|13|14|15|16)|3(?:03|05|10|12|13|14|17)|4(?:04|05|08|10|12|13|14|15)|5(?:03|04|05|12|13)|6(?:02|12|14|15|17|19)|7(?:02|03|04|13|18)|8(?:01|04|08|16|18)|9(?:01|04|15|16|17|19))",
    "national_id": r"^(?:00[1-9]|0[1-9][0-9]|[1-5][0-9]{2}|6[0-57-9][0-9]|66[0-57-9]|7[0-6][0-9]|77[0-2])-",
    "masked_email": rf"(?i)(?:{_ENDS})$",
    "person": rf"\x20(?:{_NAMES})(?:\x20|$)",
    "secret": r"[\"'=:\x20](?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9-]{20,}|xox[abp]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_.-]{30,})$",
    "iban": r"^(?:AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SE|SI|SK|SM|TN|TR|UA|VG|XK)",
    "birth_date": r"(?:^|[./-])(?:19[2-9][0-9]|200[0-9]|201[0-5])(?:$|[./-])",
}
_CUE = r"\b[^\p{L}\p{N}]*$"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|mailto|courriel|correo|write|contact|kontakt|contacto|address|from|to|cc)" + _CUE,
    "ip": r"(?i)\b(?:ip|ipv4|address|adresse|dirección|host|server|client|from|login|at)" + _CUE,
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta|pan|number|no|nr)" + _CUE,
    "phone": r"(?i)\b(?:phone|tel|telefon|téléphone|teléfono|call|fax|mobile|mobil|cell|handy|portable|móvil|whatsapp|sms|number|at)" + _CUE,
    "national_id": r"(?i)\b(?:ssn|social|security|id|passport|number|no|nr)" + _CUE,
    "person": r"(?i)\b(?:from|by|dear|name|signed|with|von|liebe|lieber|cher|chère|estimado|estimada|de|à|to)" + _CUE,
    "secret": r"(?i)\b(?:export|set|env|config|const|let|var|my|your|new|use|with|header|authorization|bearer)" + _CUE,
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|transfer|bank)" + _CUE,
    "birth_date": r"(?i)\b(?:born|birth|birthday|dob|geb|geboren|geburtsdatum|née?|naissance|nacid[oa]|nacimiento)(?:\x20(?:on|am|le|el|date|is))?" + _CUE,
}
CUES["local_phone"], CUES["masked_email"] = CUES["phone"], CUES["email"]
CONTRARY = r"(?i)(?:\b(?:isbn|issn|doi|version|release|order|invoice|ticket|price|total|article|page|build|ref|figure|table|section|chapter|example|sample|dummy)\b\.?[^\p{L}]*|[#$€£%=/*])$"


def _running(lengths: Column) -> Column:
    """Sums of the lengths before each element."""
    inner = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")))["a"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    sums = inner(F.transform(blocks, lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)))
    parts = F.transform(F.arrays_zip(blocks.alias("b"), sums.alias("o")), lambda z: F.transform(inner(z["b"]), lambda x: x + z["o"]))
    return F.flatten(parts)


_SPAN = "array<struct<start:int,finish:int,kind:int,text:string,before:string,after:string>>"


def _found(text: Column, kind: str) -> Column:
    """All matches of a kind as an array of structs, empty if there is none."""
    pattern = F.lit(PATTERNS[kind])
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    at = _running(F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda z: F.length(z["g"]) + F.coalesce(F.length(z["h"]), F.lit(0))))
    rows = F.transform(
        F.arrays_zip(hits.alias("h"), F.slice(gaps, 1, F.size(hits)).alias("b"), F.slice(gaps, 2, F.size(hits)).alias("a"), F.slice(at, 1, F.size(hits)).alias("at")),
        lambda z: F.struct(
            (z["at"] + F.length(z["b"])).alias("start"),
            (z["at"] + F.length(z["b"]) + F.length(z["h"])).alias("finish"),
            F.lit(KINDS.index(kind)).alias("kind"),
            z["h"].alias("text"),
            F.right(z["b"], F.lit(CONTEXT)).alias("before"),
            F.left(z["a"], F.lit(CONTEXT)).alias("after"),
        ),
    )
    need = NEEDS.get(kind)
    worth = F.rlike(text, F.lit("[0-9]")) if need is None else F.contains(text, F.lit(need))
    if kind in EXTRA:
        worth = worth & F.rlike(text, pattern)
    return F.when(worth, F.when(F.rlike(text, pattern), rows)).otherwise(F.array()).cast(_SPAN)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    """A base kind's own check, or the strict check of another kind."""
    if kind == "card":
        return F.length(_digits(text)).between(12, 19) & F.call_function("luhn_check", _digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    if kind == "iban":
        signs = F.regexp_replace(text, " ", "")
        turned = F.split(F.concat(F.substring(signs, 5, 40), F.substring(signs, 1, 4)), "")
        value = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
        return F.aggregate(turned, F.lit(0), lambda m, c: F.when(c == "", m).otherwise((m * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)) == 1
    return F.lit(True) if kind == "email" else F.rlike(text, F.lit(STRICT[kind]))


def _strict(kind: str, text: Column) -> Column:
    """The first labeler: of an address it asks more than the base pattern does."""
    return F.rlike(text, F.lit(STRICT[kind])) if kind == "email" else _valid(kind, text)


def located(docs: DataFrame) -> DataFrame:
    """doc_id, and matches: every match of every kind with its text and surroundings, valid or not."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return own.select("doc_id", F.concat(*[F.coalesce(_found(F.col("t"), k), F.array().cast(_SPAN)) for k in KINDS]).alias("matches"))


def _by_kind(of, x: Column) -> Column:
    out = F.lit(False)
    for i, k in reversed(list(enumerate(KINDS))):
        out = F.when(x["kind"] == i, of(k)).otherwise(out)
    return out


def _number(name: str, kind: Column, value: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), kind, value), F.lit(FEATURES)).cast("int")


def voted(matches: DataFrame) -> DataFrame:
    """spans: start, finish, kind, valid, votes and features of each match; texts end here."""
    def one(x: Column) -> Column:
        valid = _by_kind(lambda k: _valid(k, x["text"]), x)
        strict = _by_kind(lambda k: _strict(k, x["text"]), x)
        known = _by_kind(lambda k: F.rlike(x["text"], F.lit(GAZETTEER[k])), x)
        cue = _by_kind(lambda k: F.rlike(x["before"], F.lit(CUES[k])), x)
        alone = F.rlike(x["before"], F.lit(r"(?:^|[\s(\[{\"'<:;,])$")) & F.rlike(x["after"], F.lit(r"^(?:$|[\s)\]}\"'>.,:;!?])"))
        plain = ~F.rlike(x["before"], F.lit(CONTRARY))
        votes = F.transform(F.array(strict, known, cue, alone, plain), lambda v: F.coalesce(v, F.lit(False)).cast("int"))
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["text"], r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "9")
        features = F.array(
            _number("shape", x["kind"], F.left(shape, F.lit(CONTEXT))),
            _number("length", x["kind"], F.floor(F.log2(F.length(x["text"]) + 1) * 2).cast("string")),
            _number("before", x["kind"], F.lower(F.regexp_extract(x["before"], r"(\p{L}+)[^\p{L}]*$", 1))),
            _number("after", x["kind"], F.lower(F.regexp_extract(x["after"], r"^[^\p{L}]*(\p{L}+)", 1))),
            _number("sides", x["kind"], F.concat(F.right(x["before"], F.lit(1)), F.lit("|"), F.left(x["after"], F.lit(1)))),
        )
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["finish"].alias("finish"), valid.alias("valid"), votes.alias("votes"), features.alias("features"))

    return matches.select("doc_id", F.transform("matches", one).alias("spans"))


def reliabilities(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, votes, n -> a row a kind with patterns (votes, n, q), q being the posterior of a true span, and share, fires, misfires.

    counts has a row a kind and vote pattern, at most two to the number of labelers a kind; all rounds are one expression over a
    kind's row.
    """
    rows = counts.groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("p"))
    posterior = (
        "transform(p, x -> named_struct('votes', x.votes, 'n', x.n, 'q', 1D / (1D + exp(least(50D, greatest(-50D, "
        "ln((1D - s.share) / s.share) + aggregate(sequence(0, {k}), 0D, (a, j) -> a + if(x.votes[j] = 1, "
        "ln(s.misfires[j] / s.fires[j]), ln((1D - s.misfires[j]) / (1D - s.fires[j]))))))))))"
    ).format(k=LABELERS - 1)
    total = "aggregate(e, 0D, (a, x) -> a + {v})"
    # two cases of the start's rates are added, so that a kind of few candidates stays near it
    rate = "transform(sequence(0, {k}), j -> (aggregate(e, 2D * {start}, (a, x) -> a + x.n * {w} * x.votes[j])) / (aggregate(e, 2D, (a, x) -> a + x.n * {w})))"
    step = (
        f"transform(array({posterior}), e -> named_struct('share', ({total.format(v='x.n * x.q')} + 1D) / ({total.format(v='x.n')} + 2D), "
        f"'fires', {rate.format(k=LABELERS - 1, w='x.q', start='0.8D')}, 'misfires', {rate.format(k=LABELERS - 1, w='(1D - x.q)', start='0.3D')}))[0]"
    )
    start = "named_struct('share', 0.5D, 'fires', transform(sequence(0, {k}), j -> 0.8D), 'misfires', transform(sequence(0, {k}), j -> 0.3D))".format(k=LABELERS - 1)
    fitted = rows.withColumn("s", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step})"))
    return fitted.select("kind", F.expr(posterior).alias("patterns"), "s.share", "s.fires", "s.misfires")


def classifier(spans: DataFrame) -> DataFrame:
    """One row: votes, a map from kind and vote pattern to the posterior's log-odds, and weights, the log-odds of each feature by its
    number, trained on all candidates with their soft labels."""
    each = spans.select(F.explode("spans").alias("x")).select("x.kind", "x.votes", F.explode("x.features").alias("f"))
    counts = stage(each.groupBy("kind", "votes", "f").agg(F.count("*").alias("n")), "votes")  # bounded by kinds, patterns and FEATURES
    model = stage(reliabilities(counts.groupBy("kind", "votes").agg((F.sum("n") / N_FEATURES).alias("n"))).select("kind", F.inline("patterns")), "posteriors")
    soft = counts.join(F.broadcast(model.select("kind", "votes", "q")), ["kind", "votes"])  # a few hundred rows
    sums = soft.groupBy("kind").agg((F.sum(F.col("n") * F.col("q")) / N_FEATURES + 1).alias("t1"), (F.sum(F.col("n") * (1 - F.col("q"))) / N_FEATURES + 1).alias("t0"))
    by_feature = soft.groupBy("f", "kind").agg(F.sum(F.col("n") * F.col("q")).alias("y1"), F.sum(F.col("n") * (1 - F.col("q"))).alias("y0")).join(F.broadcast(sums), "kind")
    weight = F.log((F.col("y1") + 1) / (F.col("t1") + 2)) - F.log((F.col("y0") + 1) / (F.col("t0") + 2))
    by_feature = by_feature.groupBy("f").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"), F.sum("t1").alias("t1"), F.sum("t0").alias("t0")).select("f", F.greatest(F.lit(-SWAY), F.least(F.lit(SWAY), weight)).alias("w"))
    numbers = spans.sparkSession.range(FEATURES).select(F.col("id").cast("int").alias("f"))
    weights = numbers.join(by_feature, "f", "left").agg(F.array_sort(F.collect_list(F.struct("f", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("a")).select(F.col("a.w").alias("weights"))
    odds = model.agg(F.map_from_entries(F.collect_list(F.struct(_pattern(F.col("kind"), F.col("votes")).alias("k"), F.log(F.greatest("q", F.lit(1e-12)) / F.greatest(1 - F.col("q"), F.lit(1e-12))).alias("v")))).alias("votes"))
    return weights.crossJoin(odds)  # one row each


def _pattern(kind: Column, votes: Column) -> Column:
    return F.aggregate(votes, kind, lambda a, v: a * 2 + v)


def found(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, and spans: the base spans and those the classifier adds, by start, then kind."""
    spans = stage(voted(located(docs)), "spans")
    model = stage(classifier(spans), "classifier")
    both = spans.crossJoin(F.broadcast(model))  # one row of FEATURES numbers and a few hundred patterns
    base = F.filter("spans", lambda x: (x["kind"] < len(BASE)) & x["valid"])

    def added(x: Column) -> Column:
        logit = F.aggregate(x["features"], F.coalesce(F.try_element_at("votes", _pattern(x["kind"], x["votes"])), F.lit(0.0)), lambda a, f: a + F.get("weights", f))
        return (x["kind"] >= len(BASE)) & (1 / (1 + F.exp(-logit)) >= keep)

    both = both.withColumn("base", base).withColumn("more", F.filter("spans", added))
    touching = lambda x: F.exists(F.col("base"), lambda b: (b["start"] < x["finish"]) & (x["start"] < b["finish"]))
    both = both.withColumn("more", F.filter("more", lambda x: ~touching(x)))
    return both.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "more")).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["finish"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _is(kind: int):
    return lambda x: x["kind"] == kind
