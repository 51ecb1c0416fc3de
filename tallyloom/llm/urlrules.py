"""URL filters: fixed host and path rules first, then association rules mined from labelled URLs with FP-growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, typed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The contract's rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty where it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct items of a url: host labels, path segments (digits as one class), file ending, query keys."""
    digits = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path:"), digits(x)))
    query = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("query:"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"^([^:/?#]*)://", 1)))
    return F.array_distinct(F.filter(F.concat(labels, parts, query, scheme), lambda x: ~F.endswith(x, F.lit(":"))))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; rules are a short configured list, so this is one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, say).otherwise(verdict)
    return name, verdict


def mine_rules(labelled: DataFrame, support: float, confidence: float, lift: float, least_pages: int = 20, sigmas: float = 2.5) -> DataFrame | None:
    """Rules (id, antecedent, rare, confidence) `items -> block` of labelled(items, bad), best first; None if there are none.

    FP-growth, pruned by support, confidence and lift. As no rule's lift can pass 1 / (share of bad pages), a rule also
    passes if it divides the share of good pages by `lift`. Against chance, a rule also needs `least_pages` bad pages, and
    the lower bound of its confidence (Wilson's, `sigmas` standard errors wide) above the share of all bad pages. A rule is dropped if a shorter part of it is as confident,
    which blocks all that it blocks; all others stay. `rare` is the rule's item that the fewest pages have.
    """
    scratch = Scratch(labelled.sparkSession, "urlrules")
    known = scratch.save(labelled, "labelled")
    base, total = known.agg(F.avg(F.col("bad").cast("int")), F.count("*")).first()
    if not base:
        return None
    support = min(1.0, max(support, least_pages / total))
    least = max(confidence, min(lift * base, 1 - (1 - base) / lift)) - 1e-12
    baskets = known.select(F.array_union("items", F.array(F.when(F.col("bad"), "block").otherwise("allow"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets
    sets = scratch.save(sets.where(~F.array_contains("items", "allow")).withColumn("items", F.sort_array("items")), "sets")
    all_ = sets.where(~F.array_contains("items", "block")).select(F.col("items").alias("antecedent"), F.col("freq").alias("n"))
    both = sets.where(F.array_contains("items", "block") & (F.size("items") > 1)).select(F.array_remove("items", "block").alias("antecedent"), "freq")
    found = scratch.save(both.join(all_, "antecedent").select("antecedent", F.size("antecedent").alias("size"), "freq", "n", (F.col("freq") / F.col("n")).alias("confidence")), "found")
    share, spread = F.col("confidence"), sigmas * sigmas / F.col("n")
    bound = (share + spread / 2 - F.sqrt(spread * share * (1 - share) + spread * spread / 4)) / (1 + spread)
    sure = (share >= least) & (bound > base)
    longest = found.where(sure).agg(F.max("size")).first()[0]
    if not longest:
        return None
    # `top`: the best confidence of a rule and its parts, level by level, as every part of a frequent set is frequent.
    top = found.where("size = 1").withColumn("below", F.lit(-1.0))
    rules = top
    for size in range(2, longest + 1):
        level = found.where(F.col("size") == size)
        parts = level.select("antecedent", F.explode("antecedent").alias("x")).select(F.col("antecedent").alias("whole"), F.array_remove("antecedent", F.col("x")).alias("antecedent"))
        below = parts.join(top.select("antecedent", F.greatest("confidence", "below").alias("top")), "antecedent").groupBy(F.col("whole").alias("antecedent")).agg(F.max("top").alias("below"))
        top = scratch.save(level.join(below, "antecedent"), f"level{size}")
        rules = rules.unionByName(top)
    rules = rules.where(sure & (F.col("confidence") > F.col("below"))).drop("n")
    single = all_.where(F.size("antecedent") == 1).select(F.col("antecedent")[0].alias("x"), "n")
    rare = rules.select("antecedent", F.explode("antecedent").alias("x")).join(single, "x").groupBy("antecedent").agg(F.min_by("x", F.struct("n", "x")).alias("rare"))
    order = F.desc("confidence"), F.desc("freq"), F.col("size"), F.col("antecedent").cast("string")
    rules = scratch.save(rules.join(rare, "antecedent").orderBy(*order).select("antecedent", "rare", "confidence", F.monotonically_increasing_id().alias("place")), "rules")
    # consecutive ids: a place is a partition and a number in it
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    starts = rules.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return rules.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("start") + inside).cast("int").alias("id"), "antecedent", "rare", "confidence")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    sample: int = 50_000,
    support: float = 0.02,
    confidence: float = 0.6,
    lift: float = 2.0,
) -> DataFrame:
    """Judges every url: by the longest fixed rule, else block if a mined rule matches, else allow.

    labels(doc_id, toxic) label pages by page_id; rules are mined from at most `sample` labelled pages (the bound of the
    fit; chosen by a hash of page_id), counted as support and confidence there. Every rule that no
    shorter one implies is kept, and indexed by its rarest item only, as a table. Null or malformed urls have empty host and path
    and no items, hence the verdict allow; repeated pages are judged alike; empty labels mine nothing.
    """
    base = typed(pages, page_id="long", url="string")
    host, path = host_path(F.col("url"))
    base = base.withColumn("host", host).withColumn("path", path)
    marks = typed(labels, doc_id="long", toxic="int").where("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("bad"))
    known = base.join(marks, base.page_id == marks.doc_id).orderBy(F.xxhash64("page_id"), "page_id", "url").limit(sample)
    mined = mine_rules(known.select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"), "bad"), support, confidence, lift)
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    out = base.withColumn("rule", name).withColumn("fixed", verdict)
    if mined is None:
        return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.lit("allow")).alias("verdict"), F.lit(None).cast("int").alias("mined_rule"))
    hits = (
        base.select("url", "host", "path").where("url is not null").distinct()
        .select("url", tokens(F.col("url"), F.col("host"), F.col("path")).alias("items")).select("url", "items", F.explode("items").alias("rare"))
        .join(mined, "rare").where(F.size(F.array_except("antecedent", "items")) == 0)
        .groupBy(F.col("url").alias("hit_url")).agg(F.min("id").alias("mined_rule"))
    )
    return out.join(hits, out.url == hits.hit_url, "left").select(
        "page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule"
    )
