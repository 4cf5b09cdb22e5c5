"""Latest deliveries and reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.runtime import durable, latest


def test_latest(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "x"), ("b", 1, "y"), (None, 1, "n"), (None, 3, "m")]
    df = spark.createDataFrame(rows, "k string, at int, v string").repartition(3)
    assert {(r.k, r.v) for r in latest(df, ["k"], "at").collect()} == {("a", "new"), ("b", "y"), (None, "m")}
    assert {(r.k, r.v) for r in latest(df, ["k"], F.col("at")).collect()} == {("a", "new"), ("b", "y"), (None, "m")}
    first = latest(df, ["k"]).collect()
    assert len(first) == 3 and set(first) == set(latest(df.repartition(1), ["k"]).collect())
    assert latest(df.filter("false"), ["k"], "at").count() == 0
    assert latest(df.withColumn("m", F.create_map(F.lit("x"), "v")), ["k"]).count() == 3


def test_durable(spark):
    df = durable(spark.range(10).withColumn("r", F.rand()))
    assert df.collect() == df.collect()
    where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in where
