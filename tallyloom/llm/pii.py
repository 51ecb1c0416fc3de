"""Personal data by weak supervision: fixed patterns, and looser candidates judged by voting labelers whose reliabilities
expectation-maximisation estimates and on whose posteriors a span classifier is trained. Column expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, typed

# The contract's patterns. Runs are possessive and may only start where a run starts (or right after the
# last match), which finds the same matches in time linear in the text.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates, which become spans of these kinds if the classifier says so.
LOOSE = {
    "number": r"(?:(?<![0-9])|\G)[0-9]++(?:[\x20.()/-]{1,2}[0-9]++)*+",
    "handle": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
}
#: Texts without these hold no match of the kind.
_HINTS = {"email": "@", "phone": "+", "handle": "at"}
# The gazetteer of card and telephone prefixes, and context words for and against.
_PREFIX = r"^(4|5[1-5]|3[47]|6011|65|1?800|1?888|1?877|0800|00)"
_FOR = r"(?i)\b(phone|tel|telephone|call|mobile|fax|contact|card|visa|account|iban|ssn|passport|id|mail|email|write|reach)\b[^A-Za-z]*$"
_AGAINST = r"(?i)\b(version|page|isbn|figure|chapter|line|price|usd|eur|order|year|since|in|of)\b[^A-Za-z]*$"
_CONTEXT = 24


#: Elements that one inner fold of a scan walks, at least; more for a longer array, the square root of its length.
CHUNK = 128
_SPAN = "struct<start:int,end:int,s:string,before:string>"
_NO_SPANS = f"cast(array() as array<{_SPAN}>)"


def scan(column: str, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Walks an array in order: step(state, element) gives the next state and what is put out, of SQL type `kind`.

    Folds chunk by chunk, as a fold copies the list it has at every step: n elements cost n times the square root of n,
    of the cheapest kind of step.
    """
    array = F.col(column)
    size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(array))).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(array) - 1, F.lit(0)), size), lambda c: F.slice(array, c + 1, size))

    def walk(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def fold(acc: Column, chunk: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        return F.aggregate(chunk, start, walk, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    whole = F.struct(zero.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("outs"))
    return F.flatten(F.aggregate(chunks, whole, fold, lambda r: r["outs"]))


def with_matches(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """rows(text, ...) with a column array<struct<start,end,s,before>> for each pattern: its leftmost non-overlapping
    matches, in code points, end exclusive, and the text before each. Each step is a projection of its own, as its results
    are used more than once."""
    text, kept = F.col("text"), rows.columns

    def only_where(kind: str, found: Column) -> Column:
        return F.when(F.contains(text, F.lit(_HINTS[kind])) if kind in _HINTS else text.rlike("[0-9]"), found)

    found = {k: F.coalesce(only_where(k, F.regexp_extract_all(text, F.lit(p), 0)), F.expr("cast(array() as array<string>)")).alias(f"found_{k}") for k, p in patterns.items()}
    between = {k: only_where(k, F.split(text, p, -1)).alias(f"between_{k}") for k, p in patterns.items()}
    rows = rows.select(*kept, *found.values(), *between.values())
    pairs = lambda k: F.zip_with(f"found_{k}", F.slice(f"between_{k}", F.lit(1), F.size(f"found_{k}")), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    rows = rows.select(*kept, *(F.when(F.size(f"found_{k}") > 0, pairs(k)).alias(f"pairs_{k}") for k in patterns))

    def span(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        last = lambda *parts: F.right(F.concat(state["tail"], *(F.right(p, F.lit(_CONTEXT)) for p in parts)), F.lit(_CONTEXT))
        return F.struct(end.alias("at"), last(x["g"], x["m"]).alias("tail")), F.struct(start.alias("start"), end.alias("end"), x["m"].alias("s"), last(x["g"]).alias("before"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    return rows.select(*kept, *(F.coalesce(F.when(F.col(f"pairs_{k}").isNotNull(), scan(f"pairs_{k}", zero, span, _SPAN)), F.expr(_NO_SPANS)).alias(k) for k in patterns))


def without_overlap(rows: DataFrame, column: str, base: list[str]) -> DataFrame:
    """Drops the spans of a column that overlap a span of the base columns: one pass forward over all spans in order of
    their start keeps the furthest end of base spans so far, one pass backward the nearest start of a base span."""
    kept = rows.columns
    tag = lambda i: lambda x, k=None: F.struct(x["start"].alias("start"), x["end"].alias("end"), (F.lit(-1) if k is None else k).alias("i"))
    merged = F.sort_array(F.concat(*(F.transform(k, lambda x: tag(0)(x)) for k in base), F.transform(column, lambda x, k: tag(0)(x, k))))
    rows = rows.select(*kept, F.when(F.size(column) > 0, merged).alias("merged"))
    kind = "struct<start:int,end:int,i:int,clear:boolean>"

    def out(x: Column, clear: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["i"].alias("i"), clear.alias("clear"))

    ahead = scan("merged", F.lit(0), lambda reach, x: (F.when(x["i"] < 0, F.greatest(reach, x["end"])).otherwise(reach), out(x, reach <= x["start"])), kind)
    rows = rows.select(*kept, F.when(F.col("merged").isNotNull(), F.reverse(ahead)).alias("merged"))
    back = scan("merged", F.lit(2**31 - 1), lambda near, x: (F.when(x["i"] < 0, x["start"]).otherwise(near), out(x, x["clear"] & (near >= x["end"]))), kind)
    rows = rows.select(*kept, F.when(F.col("merged").isNotNull(), F.sort_array(F.transform(F.filter(back, lambda x: (x["i"] >= 0) & x["clear"]), lambda x: x["i"]))).alias("clear"))
    left = F.when(F.col("clear").isNotNull(), F.transform("clear", lambda i: F.get(F.col(column), i))).otherwise(F.col(column))
    return rows.select(*(c for c in kept if c != column), left.alias(column))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    rev = F.reverse(_digits(s))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(rev)), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(rev, i, F.lit(1)).cast("int")).otherwise(F.substring(rev, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(rev, i, F.lit(1)) > "4", 9).otherwise(0)))
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    s = x["s"]
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return s.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(s)).between(16, 19), _luhn(s)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _sign(plus: Column, minus: Column) -> Column:
    return F.when(plus, 1).when(minus, -1).otherwise(0)


def _votes(kind: str, x: Column, before: Column) -> list[Column]:
    """Regex, gazetteer and context labelers: 1 personal, -1 not, 0 no vote."""
    s, d = x["s"], _digits(x["s"])
    if kind == "handle":
        shape = _sign(s.rlike(r"\.[A-Za-z]{2,}$"), ~F.contains(s, F.lit(".")))
        known = _sign(s.rlike(r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk)$"), F.lit(False))
    else:
        shape = _sign(s.rlike(r"^([0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|([0-9]{4}[ -]?){3}[0-9]{1,7})$"), F.length(d) < 9)
        known = _sign(d.rlike(_PREFIX), s.rlike(r"^(19|20)[0-9]{2}[-/. ](19|20)?[0-9]{2}") | d.rlike(r"^([0-9])\1*$"))
    return [shape, known, _sign(before.rlike(_FOR), before.rlike(_AGAINST))]


def estimate(counts: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of `personal` by vote pattern: expectation-maximisation of each labeler's vote rates in both classes.

    counts: at most 3^labelers patterns with how many candidates showed each. A pattern starts from its majority vote.
    """
    post = {v: min(0.95, max(0.05, 0.5 + 0.3 * sum(v))) for v, _ in counts}
    if not counts:
        return post
    labelers, total = len(counts[0][0]), sum(n for _, n in counts)
    for _ in range(rounds):
        prior, rate = (1 + sum(n * post[v] for v, n in counts)) / (2 + total), {}
        for k in range(labelers):
            for say in (-1, 0, 1):
                for c in (0, 1):
                    w = lambda v, c=c: post[v] if c else 1 - post[v]
                    # one pseudo-count says that labelers are right more often than not
                    hint = 2.0 if (say == 1) == bool(c) and say else 0.5
                    rate[k, say, c] = (hint + sum(n * w(v) for v, n in counts if v[k] == say)) / (3 + sum(n * w(v) for v, n in counts))
        for v, _ in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[k, say, 1] / rate[k, say, 0]) for k, say in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


_FEATURES = ("shape", "known", "context", "digits", "groups", "dash", "dot", "space", "handle")


def find_personal(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: counts of the four base kinds, a digest of the base spans, and all spans in text form.

    Null text is empty. Base spans always stay; a looser candidate that overlaps none of them is added, as `number` or
    `handle`, if the classifier gives it at least `threshold`. Empty tables and texts without candidates have no added
    spans; repeated rows are treated alike; very long texts are scanned whole, in time that grows with their length and
    with their matches. Vote patterns are counted over all documents; what reaches the driver is one row for each
    combination of votes and of the classes of digits, groups and separators (under 25,000).
    """
    rows = typed(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_matches(rows, PATTERNS | LOOSE)
    rows = rows.select("doc_id", *(F.filter(k, partial(_valid, k)).alias(k) for k in PATTERNS), F.filter("number", lambda x: F.length(_digits(x["s"])).between(7, 20)).alias("number"), "handle")
    for kind in LOOSE:
        rows = without_overlap(rows, kind, list(PATTERNS))

    def voted(k: str, x: Column) -> Column:
        shape, known, context = _votes(k, x, x["before"])
        has = lambda mark: F.contains(x["s"], F.lit(mark)).cast("int")
        return F.struct(
            F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), shape.alias("shape"), known.alias("known"), context.alias("context"),
            F.least(F.length(_digits(x["s"])), F.lit(20)).alias("digits"), F.least(F.size(F.split(x["s"], "[^0-9]+")), F.lit(8)).alias("groups"),
            has("-").alias("dash"), has(".").alias("dot"), has(" ").alias("space"), F.lit(int(k == "handle")).alias("handle"))

    rows = rows.select("doc_id", *PATTERNS, *(F.transform(k, partial(voted, k)).alias(f"loose_{k}") for k in LOOSE))
    named = lambda k, x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string"))
    spans = [F.transform(k, partial(named, k)) for k in PATTERNS]
    rows = rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS), F.concat_ws(",", F.concat(*spans)).alias("base"), F.concat("loose_number", "loose_handle").alias("loose"))
    rows = Scratch(docs.sparkSession, "pii").save(rows, "rows")

    seen = rows.select(F.inline("loose")).groupBy(*_FEATURES).agg(F.count("*").alias("n")).collect()
    added = F.expr("cast(array() as array<string>)")
    by_votes: dict[tuple[int, ...], float] = {}
    for r in seen:
        by_votes[r.shape, r.known, r.context] = by_votes.get((r.shape, r.known, r.context), 0) + r.n
    post = estimate(list(by_votes.items()))
    if seen:
        marked = [(*(float(r[f]) for f in _FEATURES), label, r.n * (p if label else 1 - p)) for r in seen for p in [post[r.shape, r.known, r.context]] for label in (0.0, 1.0)]
        table = docs.sparkSession.createDataFrame(marked, [*_FEATURES, "label", "weight"])
        model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=200, tol=1e-9, standardization=False).fit(VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(table))
        score = lambda x: sum((float(c) * x[f] for c, f in zip(model.coefficients, _FEATURES, strict=True)), F.lit(float(model.intercept)))
        chosen = F.filter("loose", lambda x: 1 / (1 + F.exp(-score(x))) >= threshold)
        added = F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    every = F.concat(F.filter(F.array("base"), lambda x: x != ""), added)
    return rows.select("doc_id", *(f"n_{k}" for k in PATTERNS), F.sha2(F.col("base"), 256).alias("base_sha256"), F.concat_ws(",", every).alias("spans"), F.size(added).cast("long").alias("n_added"))
