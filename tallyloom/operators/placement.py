"""Placement of items by a table of rules, of any length: an index of what rules must contain, joined with the items."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import glob_regex, range_members

#: Characters of the piece of a rule that the index is kept by, at most.
GRAM = 4
_COMPILED = "place long, disk string, literal string, regex string"


def compile_rules(rules: DataFrame) -> DataFrame:
    """(place, disk, literal, regex) of rules (place, disk, match): a text fits if it holds the literal and, where there is
    one, fits the regular expression. A range gives a row for each of its members; an empty or null match gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for place, disk, match in batch.itertuples(index=False, name=None):
                if not match:
                    continue
                if (members := range_members(match)) is not None:
                    out += [(place, disk, m, None) for m in members]
                elif re.search(r"[*?\[]", match):
                    # the longest run of characters that stand for themselves; a bracket may begin a set, so it parts runs
                    runs = re.split(r"[*?]|\[[^*?]*\]|\[", match)
                    out.append((place, disk, max(runs, key=len), glob_regex(match)))
                else:
                    out.append((place, disk, match, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _COMPILED.split(", ")])

    return rules.select(F.col("place").cast("long"), F.col("disk").cast("string"), F.col("match").cast("string")).where("place is not null").mapInPandas(run, _COMPILED)


def _grams(text: Column, n: int | Column) -> Column:
    """The distinct pieces of n characters; none of a shorter text."""
    last = F.length(text) - n + 1
    none = F.expr("cast(array() as array<string>)")
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n) if isinstance(n, int) else n)))).otherwise(none)


def norm_share(path: Column) -> Column:
    """A share in comparable form: forward slashes, small letters, no slash at its end; null where that leaves nothing."""
    return F.nullif(F.lower(F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))), F.lit(""))


def distinct_rules(rules: DataFrame) -> DataFrame:
    """compile_rules(), of those that fit the same texts only the one of the lowest place."""
    return compile_rules(rules).groupBy("literal", "regex").agg(F.min("place").alias("place"), F.min_by("disk", "place").alias("disk"))


def first_rule(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text, place, disk): of the rules that each text fits, that of the lowest place. Texts must be distinct.

    Each rule is listed under one piece of its literal, the one that the fewest rules hold; a text meets the rules of
    its own pieces only, and what it meets is verified. Globs without any literal meet every text. Repeated rules count once.
    """
    compiled = distinct_rules(rules)
    size = F.least(F.length("literal"), F.lit(GRAM))
    pieces = compiled.select("*", F.explode(F.when(size > 0, _grams(F.col("literal"), size)).otherwise(F.array(F.lit("")))).alias("gram"))
    held = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    index = pieces.join(held, "gram").groupBy("place", "disk", "literal", "regex").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    sizes = [r[0] for r in index.select(F.length("gram")).distinct().collect()]  # GRAM + 1 numbers at most
    own = F.flatten(F.array(*(_grams(F.col("text"), n) if n else F.array(F.lit("")) for n in sizes))) if sizes else F.expr("cast(array() as array<string>)")
    met = texts.select("text", F.explode(own).alias("gram")).join(index, "gram")
    fits = met.where(F.contains("text", F.col("literal")) & (F.col("regex").isNull() | F.rlike("text", F.col("regex"))))
    return fits.groupBy("text").agg(F.min("place").alias("place"), F.min_by("disk", "place").alias("disk"))


def share_owner(roots: DataFrame, topology: DataFrame) -> DataFrame:
    """(root, owner): the disk of the lowest place one of whose shares (read, write, direct_path) is the root or lies above it.
    Roots must be distinct and in comparable form; each is joined by its own ancestors."""
    shares = topology.select("place", "disk", F.explode(F.array(*(norm_share(F.col(c)) for c in ("read", "write", "direct_path") if c in topology.columns))).alias("share")).where("share is not null")
    shares = shares.groupBy("share").agg(F.min("place").alias("place"), F.min_by("disk", "place").alias("disk"))
    steps = F.split("root", "/")
    above = roots.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("share"))
    return above.join(shares, "share").groupBy("root").agg(F.min_by("disk", "place").alias("owner"))


def assign_by_topology(items: DataFrame, topology: DataFrame, columns: Sequence[str] = ("item_id",)) -> DataFrame:
    """The items with the disk of the first rule that their joined texts fit, else of the share that read_root, then
    write_root, lies under, else null.

    topology: place (the order), disk, match, and the shares read, write, direct_path; of any length. Ranges, globs and
    substrings mean what they do in assign_by_rules. Null texts count as empty.
    """
    text = items.withColumn("_text", F.concat_ws(" ", *columns))
    ruled = first_rule(text.select(F.col("_text").alias("text")).distinct(), topology).select(F.col("text").alias("_text"), F.col("disk").alias("_ruled"))
    out, found = text.join(ruled, "_text", "left"), [F.col("_ruled")]
    roots = [c for c in ("read_root", "write_root") if c in items.columns]
    if roots and {"read", "write", "direct_path"} & set(topology.columns):
        every = items.select(F.explode(F.array(*(norm_share(F.col(c)) for c in roots))).alias("root")).where("root is not null").distinct()
        owners = share_owner(every, topology)
        for c in roots:
            own = owners.select(F.col("root").alias(f"_{c}"), F.col("owner").alias(f"_{c}_owner"))
            out = out.withColumn(f"_{c}", norm_share(F.col(c))).join(own, f"_{c}", "left")
            found.append(F.col(f"_{c}_owner"))
    return out.select(*(F.col(c) for c in items.columns if c != "disk"), F.coalesce(*found).alias("disk"))
