"""Windows along time that split a key with many rows.

A window over a key's rows is one task's work. Here the rows of a key that has more than `rows` of them are dealt to spans
of time, cut where the table's rows are cut into equal parts. Each span is worked through by itself; what it needs of the
spans before it (their last rows; their sums, extremes and last values) is handed on by a window over one row for each
key and span. Where no key has so many rows, there is one span, and the windows are plain ones: the rows that come out are
the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a key from which on it is split, and spans at most (each takes one row for every key on its way to the next).
ROWS, SPANS = 500_000, 2_000
_LOWEST = -1e300

_TOTAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_JOINED = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest, "last": lambda a, b: F.coalesce(b, a), "first": lambda a, b: F.coalesce(a, b)}


class Spans:
    """The rows of df in the order of `order` within each key. Its methods add columns to `df`; a null key is a key, and null
    times come first."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None):
        rows = ROWS if rows is None else rows
        self.keys, self.order = list(keys), list(order)
        most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        self.split = (most[0] or 0) > rows
        if self.split:
            # one key of structs: equal where keys are null, and hashed the same way by joins and windows
            df = df.withColumn("_key", F.struct(*(F.col(k) for k in keys)) if keys else F.lit(0)).withColumn("_time", F.coalesce(F.col(order[0]).cast("double"), F.lit(_LOWEST)))
            n = min(SPANS, -(-most[1] // rows))
            cuts = df.agg(F.percentile_approx("_time", [i / n for i in range(1, n)], 20 * n)).first()[0]
            splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
            df = Bucketizer(splits=splits, inputCol="_time", outputCol="_span").transform(df).withColumn("_span", F.col("_span").cast("int")).drop("_time")
            self.parts = ["_key", "_span"]
        else:
            self.parts = self.keys
        self.df = df
        self.w = (Window.partitionBy(*self.parts) if self.parts else Window.partitionBy(F.lit(0))).orderBy(*self.order)

    def _earlier(self, per: DataFrame, **columns: Column) -> None:
        """Adds columns made from the spans before a row's own. per: one row for each key and span."""
        handed = per.select("_key", "_span", *(c.alias(name) for name, c in columns.items()))
        self.df = self.df.join(handed, ["_key", "_span"])

    @property
    def _before(self):
        return Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)

    def lag(self, **values: Column) -> Spans:
        """The value of the row before, by name; null at a key's first row."""
        if not self.split:
            self.df = self.df.withColumns({n: F.lag(v).over(self.w) for n, v in values.items()})
            return self
        last = F.max_by(F.struct(*(v.alias(n) for n, v in values.items())), F.struct(*self.order)).alias("_last")
        per = self.df.groupBy("_key", "_span").agg(last)
        self._earlier(per, _last=F.last("_last", True).over(self._before))
        first = F.row_number().over(self.w) == 1
        self.df = self.df.withColumns({n: F.when(first, F.col(f"_last.{n}")).otherwise(F.lag(v).over(self.w)) for n, v in values.items()}).drop("_last")
        return self

    def running(self, before: bool = False, **values: tuple[str, Column]) -> Spans:
        """Running sum, count, min, max, first or last (nulls passed over), by name, up to each row; before: without it."""
        upto = self.w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)

        def here(kind: str, v: Column) -> Column:
            return (_TOTAL[kind](v) if kind in _TOTAL else F.last(v, True) if kind == "last" else F.first(v, True)).over(upto)

        if not self.split:
            self.df = self.df.withColumns({n: here(k, v) for n, (k, v) in values.items()})
            return self
        place = F.struct(*self.order)
        total = {n: _TOTAL[k](v) if k in _TOTAL else (F.max_by if k == "last" else F.min_by)(v, F.when(v.isNotNull(), place)) for n, (k, v) in values.items()}
        per = self.df.groupBy("_key", "_span").agg(*(c.alias(f"_{n}") for n, c in total.items()))
        fold = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, True), "first": lambda c: F.first(c, True)}
        self._earlier(per, **{f"_{n}": fold[k](f"_{n}").over(self._before) for n, (k, _) in values.items()})
        self.df = self.df.withColumns({n: _JOINED[k](F.col(f"_{n}"), here(k, v)) for n, (k, v) in values.items()}).drop(*(f"_{n}" for n in values))
        return self

    def trailing_first(self, most: int, **values: Column) -> Spans:
        """The values of the first of the last `most` rows up to each row, its own included."""
        back = self.w.rowsBetween(1 - most, 0)
        if not self.split or most < 2:
            self.df = self.df.withColumns({n: F.first(v).over(back) for n, v in values.items()})
            return self
        # each span gets the last rows of those before it as rows of its own, marked, and the window passes over both
        names, kept = list(dict.fromkeys([*self.order, *values])), self.df.columns
        self.df = self.df.withColumns(values)
        row = F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(self.order)), *(F.col(n).alias(f"_v{n}") for n in names))
        down = Window.partitionBy("_key", "_span").orderBy(*(F.desc(c) for c in self.order))
        tail = self.df.select("_key", "_span", row.alias("_row"), F.row_number().over(down).alias("_n")).where(F.col("_n") < most)
        per = tail.groupBy("_key", "_span").agg(F.sort_array(F.collect_list("_row")).alias("_tail"))
        # of as many earlier spans as it takes
        joined = F.aggregate(F.collect_list("_tail").over(self._before.rowsBetween(1 - most, -1)), F.lit(None).cast(per.schema["_tail"].dataType), lambda a, t: F.when(a.isNull(), t).otherwise(F.slice(F.concat(a, t), -F.least(F.size(F.concat(a, t)), F.lit(most - 1)), F.lit(most - 1))))
        far = per.select("_key", "_span", joined.alias("_rows")).select("_key", "_span", F.explode("_rows").alias("_row")).select("_key", "_span", *(F.col(f"_row._v{n}").alias(n) for n in names), F.lit(True).alias("_far"))
        both = self.df.withColumn("_far", F.lit(False)).unionByName(far, allowMissingColumns=True)
        self.df = both.withColumns({n: F.first(n).over(back) for n in values}).where("not _far").select(*kept, *(n for n in values if n not in kept))
        return self

    def where(self, cond: Column | str) -> Spans:
        """Leaves rows out; the spans of the others stay."""
        self.df = self.df.where(cond)
        return self

    def rows(self) -> DataFrame:
        return self.df.drop("_key", "_span")
