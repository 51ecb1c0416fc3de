"""Secret scans: candidate strings of whole texts, and a random forest, trained from labelled findings, that removes false positives."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sliced, typed

# A key: a signed or encrypted web token, or key characters, with long parts joined by dots; = only as padding, so `name=` stays outside.
_CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9_+/-])(?:eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){1,3}\.[A-Za-z0-9_-]+|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|[A-Za-z0-9_+/-]{16,}(?:(?:\.[A-Za-z0-9_-]{6,})?\.[A-Za-z0-9_-]{16,})*)(?:={1,2}(?![A-Za-z0-9_+/=-]))?"
)
# Formats that issuers give their keys.
_KNOWN = re.compile(
    r"(?:A3T[A-Z0-9]|AKIA|ASIA|AGPA|AROA|AIDA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}"
    r"|[spr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{32,}|AIza[A-Za-z0-9_-]{35}|ya29\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){1,3}\.[A-Za-z0-9_-]+"
)
_PIECE, _SPELLED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
_BEFORE = re.compile(r"([A-Za-z_]+)[^A-Za-z]*$")
# Names that secrets are given to.
_NAMES = re.compile(r"(?i)token|secret|passw|api_?key|key|auth|bearer|credential|private")
_WORD_AFTER = re.compile(r"^[^A-Za-z]*([A-Za-z_]+)")
_CLASSES = "lower", "upper", "digit", "mark"
#: Buckets that the parts of a path, and the neighbouring words of either side, are hashed into.
PATHS, WORDS = 8, 16
#: What the forest sees: length, shares of the transitions between classes of characters, dictionary coverage, path, words on both sides.
FEATURES = (
    "length", *(f"{a}_{b}" for a in _CLASSES for b in _CLASSES), "covered",
    *(f"path{i}" for i in range(PATHS)), *(f"before{i}" for i in range(WORDS)), *(f"after{i}" for i in range(WORDS)),
)
#: What labels are made from where none are given; the forest doesn't see these.
EVIDENCE = ("known", "named", "assigned", "quoted", "letters", "pieces", "spelled")
#: Shortest candidate, in characters.
LEAST_LENGTH = 16
#: Findings that the forest is trained on, at most, chosen by a hash; documents that hold a word of the dictionary, at least, and as a share of all.
SAMPLE, LEAST_DOCS, LEAST_SHARE = 20_000, 5, 1e-5


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.lower().encode()) % n


def coverage(s: str, words: set[str]) -> float:
    """Share of the string that dictionary words of 3 to 8 letters cover, taken greedily, the longest first."""
    low, i, hit = s.lower(), 0, 0
    while i < len(low):
        for n in range(8, 2, -1):
            if low[i : i + n] in words and i + n <= len(low):
                hit += n
                i += n
                break
        else:
            i += 1
    return hit / max(1, len(low))


def describe(text: str, start: int, end: int, source: str) -> tuple[float, ...]:
    """The features of a candidate but for `covered`, which needs the dictionary, and the evidence for a label."""
    s, n = text[start:end], end - start
    kinds = [_class(c) for c in s]
    before, after = text[max(0, start - 32) : start], text[end : end + 32]
    name, follows = _BEFORE.search(before), _WORD_AFTER.search(after)
    moves = Counter(zip(kinds, kinds[1:], strict=False))
    paths, left, right = {_bucket(p, PATHS) for p in re.split(r"[/\\.]+", source) if p}, [0.0] * WORDS, [0.0] * WORDS
    if name:
        left[_bucket(name[1], WORDS)] = 1.0
    if follows:
        right[_bucket(follows[1], WORDS)] = 1.0
    return (
        float(n),
        *(moves[a, b] / max(1, n - 1) for a in range(4) for b in range(4)),
        *(float(i in paths) for i in range(PATHS)),
        *left,
        *right,
        float(_KNOWN.fullmatch(s) is not None),
        float(bool(name and _NAMES.search(name[1]))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        1.0 - (kinds.count(2) + kinds.count(3)) / n,
        len(_PIECE.findall(s)) / n,
        sum(map(len, _SPELLED.findall(s))) / n,
    )


def dictionary(docs: DataFrame, least: int = LEAST_DOCS, share: float = LEAST_SHARE) -> DataFrame:
    """(w): the words of 3 to 8 letters that at least `least` of the documents hold, and at least this share of all documents."""
    least = max(least, math.ceil(share * docs.count()))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b\p{L}{3,8}\b"), 0))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("w")


def candidates(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, row, start, end, fingerprint, value, features but `covered`, evidence): every run of key characters, or
    dotted token, of `least_length` (16 or more) characters with a digit or capital inside; runs of small letters alone are words."""
    names = [f for f in (*FEATURES, *EVIDENCE) if f != "covered"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in sliced(batches):
            out = []
            for doc, text, source, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for m in _CANDIDATE.finditer(text or ""):
                    if m.end() - m.start() >= least_length and re.search(r"[0-9]|.[A-Z]", m[0]):
                        out.append((doc, row, m.start(), m.end(), hashlib.sha256(m[0].encode()).hexdigest(), m[0], *describe(text, m.start(), m.end(), source or "")))
            cols = list(zip(*out, strict=True)) or [[]] * (6 + len(names))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "row", "start", "end", "fingerprint", "value", *names])

    return docs.select("doc_id", "text", "source", "row").mapInArrow(find, "doc_id long, row long, start long, end long, fingerprint string, value string, " + ", ".join(f"{f} double" for f in names))


def cover(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with `covered` for their value; each distinct value meets the words among its own pieces only."""
    values = found.groupBy("fingerprint").agg(F.first("value").alias("value"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = [], []
            for key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = value.lower()
                mine = {low[i : i + n] for n in range(3, 9) for i in range(len(low) - n + 1) if low[i : i + n].isalpha()}
                parts.extend(mine)
                keys.extend([key] * len(mine))
                if len(parts) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(parts, pa.string())], ["fingerprint", "w"])
                    keys, parts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(parts, pa.string())], ["fingerprint", "w"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [coverage(value, set(known)) for value, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], ["fingerprint", "covered"])

    known = values.mapInArrow(split, "fingerprint string, w string").join(words, "w").groupBy("fingerprint").agg(F.collect_list("w").alias("known"))
    some = values.join(known, "fingerprint").select("fingerprint", "value", "known").mapInArrow(measure, "fingerprint string, covered double")
    return found.drop("value").join(some, "fingerprint", "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def label_findings(found: DataFrame) -> DataFrame:
    """Labels where none are given, from evidence that the forest doesn't see: a key of a known format is a secret, and so
    is a string that looks random and is assigned to, or quoted after, a secret's name; one without any of these is none
    if it is made of words or of digits only. All others stay open, above all strings that look random and stand alone."""
    given = (F.col("assigned") > 0) | (F.col("quoted") > 0)
    plain = (F.col("letters") <= 0) | ((F.col("spelled") >= 0.5) & (F.col("pieces") < 0.25))
    return found.withColumn("label", F.when((F.col("known") > 0) | ((F.col("named") > 0) & given & ~plain), 1.0).when((F.col("named") == 0) & ~given & plain, 0.0))


def train(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest on at most `sample` labelled findings, one for each fingerprint (that of the smallest doc_id and place, a
    secret before a false alarm); None if they are all of one class."""
    first = F.min(F.struct(-F.col("label"), "doc_id", "start", *FEATURES)).alias("first")
    rows = labelled.where("label is not null").groupBy("fingerprint").agg(first, F.max("label").alias("label"))
    rows = rows.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(sample)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.select("label", *(f"first.{f}" for f in FEATURES)))
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=40, maxDepth=8, seed=5, featureSubsetStrategy="onethird").fit(rows)


def _scored(docs: DataFrame, least: float, findings: DataFrame | None = None, least_length: int = LEAST_LENGTH) -> DataFrame:
    base = typed(docs, doc_id="long", text="string", source="string").withColumn("row", F.xxhash64("doc_id", "text"))
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.save(cover(scratch.save(candidates(base, least_length), "candidates"), scratch.save(dictionary(base), "dictionary")), "found")
    scratch.drop("candidates", "dictionary")
    if findings is None:
        labelled = label_findings(found)
    else:
        given = typed(findings, fingerprint="string", label="double").groupBy("fingerprint").agg(F.max("label").alias("label"))
        labelled = found.join(given, "fingerprint", "left")
    model = train(labelled)
    if model is None:
        scored = labelled.withColumn("probability", F.coalesce("label", F.lit(0.0)))
    else:
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)).withColumn("probability", vector_to_array("probability")[1])
    if findings is None:
        scored = scored.withColumn("probability", F.when(F.col("known") > 0, 1.0).otherwise(F.col("probability")))
    return scored.withColumn("is_secret", F.col("probability") >= least)


def scan_secrets(docs: DataFrame, least: float = 0.5, findings: DataFrame | None = None, least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row per candidate: its span in code points, the forest's probability and whether it counts as a secret.

    findings(fingerprint, label): labelled findings, 1 for a secret and 0 for a false alarm, by the SHA-256 of the string;
    of several labels the highest holds. Without them labels come from label_findings(), and a key of a known format is a
    secret whatever the forest says. The name in `name=value` is no part of a candidate. Null and empty texts have no
    candidates; a null source is an empty path; a candidate as long as its text is one finding; repeated rows give their
    findings once each; without candidates of both classes the labels decide; an empty table gives no rows.
    """
    return _scored(docs, least, findings, least_length).select("doc_id", "start", "end", "fingerprint", F.round("probability", 9).alias("probability"), "is_secret")


def redacted(text: str, starts: list[int], ends: list[int], mark: str) -> str:
    """The text with its spans, which are in order and apart, replaced by the mark, in time in proportion to its length."""
    pieces, at = [], 0
    for start, end in zip(starts, ends, strict=True):
        pieces += [text[at:start], mark]
        at = end
    return "".join([*pieces, text[at:]])


def redact_secrets(docs: DataFrame, least: float = 0.5, mark: str = "[SECRET]", findings: DataFrame | None = None) -> DataFrame:
    """The documents with each secret replaced by a mark and n_chars set anew; all rows and columns stay, whatever their names.
    Only texts that hold a secret leave the JVM."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or s is None else redacted(t, s, e, mark) for t, s, e in zip(texts, starts, ends, strict=True)], dtype=object)

    spans = _scored(docs, least, findings).where("is_secret").groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    doc, text = F.struct(*(docs[c] for c in docs.columns)), docs["text"].cast("string")
    rows = docs.select(doc.alias("doc"), docs["doc_id"].cast("long").alias("id"), text.alias("body"), F.xxhash64(docs["doc_id"].cast("long"), text).alias("key"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("row")), "left")
    cleaned = joined.withColumn("cleaned", cut(F.when(F.col("spans").isNotNull(), F.col("body")), F.col("spans.start"), F.col("spans.end")))
    new = F.coalesce("cleaned", "body")
    swap = {"text": new, "n_chars": F.when(F.col("spans").isNull(), F.col("doc")["n_chars"]).otherwise(F.length(new).cast("long")) if "n_chars" in docs.columns else None}
    return cleaned.select(*(swap[c].cast(docs.schema[c].dataType).alias(c) if c in swap else F.col("doc")[c].alias(c) for c in docs.columns))
