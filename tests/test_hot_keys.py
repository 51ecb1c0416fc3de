"""Work on hot keys grows with the rows and no faster; the rows stay those of the plain form."""

import os

import pytest
from pyspark.sql import functions as F

from tallyloom import adapters
from tallyloom.operators.spans import Spans

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_running_sums_of_a_view_by_spans(spark):
    want = spark.sql(adapters.text("disk_samples", DATA))
    for rows in (20, None):
        got = adapters.view(spark, DATA, "disk_samples", rows)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 100


def test_last_rows_of_earlier_spans_are_not_joined_to_every_row(spark):
    df = spark.range(600).select((F.col("id") % 2).alias("k"), (F.col("id") / 7).cast("long").alias("ts"), "id")
    plain, split = (Spans(df, ["k"], ["ts", "id"], n).trailing_first(60, back=F.col("id"), ts0=F.col("ts")) for n in (10**6, 50))
    assert split.split and "Join" not in split.df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, split.rows().select(plain.df.columns).collect())) == sorted(map(str, plain.rows().collect()))
