"""A store of vector collections: a folder of Parquet, partitioned by collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.operators.embedding import add_vectors

SCHEMA = "id string, metadata map<string,string>, embedding array<float>, document string, collection string"


class VectorStore:
    """Collections of (id, metadata, embedding, document) under one path; a collection exists once it has a row."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self, collection: str | None = None) -> DataFrame:
        """All rows, or those of one collection; an empty store gives an empty table."""
        try:
            all_rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            all_rows = self.spark.createDataFrame([], SCHEMA)
        return all_rows if collection is None else all_rows.filter(F.col("collection") == collection)

    def collections(self) -> DataFrame:
        return self.rows().select("collection").distinct()

    def add(self, rows: DataFrame) -> None:
        """Store the rows whose (collection, id) is not there yet; rows without a vector are left out."""
        own = rows.select("id", "metadata", F.col("embedding").cast("array<float>").alias("embedding"), "document", "collection").filter("embedding is not null")
        add_vectors(self.rows(), own, ["collection", "id"]).select("id", "metadata", "embedding", "document", "collection").write.mode("append").partitionBy("collection").parquet(self.path)

    def get(self, collection: str, ids: list[str]) -> DataFrame:
        return self.rows(collection).filter(F.col("id").isin(ids))

    def query(self, queries: DataFrame, collection: str, k: int = 4, metric: str = "l2", size: int = 64) -> DataFrame:
        """The ``k`` nearest rows of a collection for queries (id, v): query, rank, id, distance, metadata, document."""
        base = self.rows(collection).withColumn("n", F.xxhash64("id"))
        hits = retrieval.nearest(queries, base.select(F.col("n").alias("id"), F.col("embedding").alias("v")), k, metric, size)
        return hits.join(base, F.col("near") == F.col("n")).select("query", "rank", "id", "distance", "metadata", "document")
