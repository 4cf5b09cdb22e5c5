"""Session, table and durability helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session(app: str = "docloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a
    session on one machine takes a temporary folder; on a cluster, which may
    not share it, it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not (context.master or "").startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), "docloom-checkpoints")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes come to about ``most``: what an Arrow batch is worked off in."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def latest(df: DataFrame, keys: list[str], order: str | Column | None = None) -> DataFrame:
    """One row per key: the one delivered last.

    Ties, and tables without a delivery time, are settled by a hash of the
    whole row, so equal rows collapse and the choice does not depend on
    partitioning. A null key is a key like any other. Keys are near unique in
    every table (a record is delivered a few times at most), so no group is hot.
    """
    names = df.columns
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes])
    by = [F.col(order).desc_nulls_last()] if isinstance(order, str) else [order.desc_nulls_last()] if order is not None else []
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by, tie.desc()))
    return df.withColumn("__rank", rank).filter("__rank = 1").select(*[F.col(f"`{c}`") for c in names])
