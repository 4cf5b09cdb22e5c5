"""The document pipeline: pending work, artifacts by kind, statuses and batch stages.

Documents and artifacts are tables. A stage takes the documents whose artifact
of its kind is missing (and whose input is there), computes, and appends; a
re-run does only what is left.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import parent, stem
from docloom.operators import embedding, markdown, summaries, tree
from docloom.operators.models import HashedWords, Prefix
from docloom.operators.sections import is_deck
from docloom.runtime import durable
from docloom.sources.vector_store import VectorStore

#: Artifact kinds and the suffixes of their files; states of a document.
SUFFIXES = {"ast": "_ast.json", "semantics": "_semantics.json", "embed": "_embed.json"}
STATUSES = ("PENDING", "PROCESSING", "REORGNIZED", "SEMANTICIZED", "CANCELLED", "COMPLETED", "ERROR")


def artifact_path(file_path: Column | str, kind: str) -> Column:
    return F.concat(parent(file_path), F.lit("/"), stem(file_path), F.lit(SUFFIXES[kind]))


def pending(documents: DataFrame, artifacts: DataFrame, kind: str = "semantics") -> DataFrame:
    """Documents without an artifact of the kind."""
    return documents.join(artifacts.filter(F.col("kind") == kind).select("doc_id"), "doc_id", "left_anti")


def ready(documents: DataFrame, artifacts: DataFrame, kind: str = "semantics") -> DataFrame:
    """Documents with an artifact of the kind."""
    return documents.join(artifacts.filter(F.col("kind") == kind).select("doc_id"), "doc_id", "left_semi")


def status_of(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """doc_id and the status its artifacts imply: ERROR, COMPLETED, SEMANTICIZED, REORGNIZED or PENDING."""
    kinds = artifacts.groupBy("doc_id").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in SUFFIXES])
    joined = documents.select("doc_id", "exception").join(kinds, "doc_id", "left")
    implied = F.when(F.col("exception").isNotNull(), "ERROR").when(F.col("embed"), "COMPLETED").when(F.col("semantics"), "SEMANTICIZED").when(F.col("ast"), "REORGNIZED").otherwise("PENDING")
    return joined.select("doc_id", implied.alias("implied"))


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Stored artifacts of a kind: doc_id, json, produced_at. Nothing stored is an empty table."""
    schema = "doc_id string, json string, produced_at timestamp, kind string"
    try:
        return spark.read.schema(schema).parquet(path).filter(F.col("kind") == kind)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def append(results: DataFrame, path: str, kind: str, again: bool = False) -> None:
    """Store artifacts under their kind; ``again`` replaces those of the kind."""
    out = results.filter("json is not null").select("doc_id", "json", F.current_timestamp().alias("produced_at"), F.lit(kind).alias("kind"))
    out.write.mode("overwrite" if again else "append").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)


def _slides(text: str | None) -> str | None:
    if not text:
        return None
    return json.dumps(tree.reorganise_slides(text, lambda body: [markdown.node(t, level, c) for _, t, level, c in markdown.scan(body)]), ensure_ascii=False)


def _sections(text: str | None) -> str | None:
    raw = markdown.to_ast(text)
    return None if raw is None else tree.walk_sections(raw)


def reorganised(documents: DataFrame) -> DataFrame:
    """doc_id, json, status, exception: each text as an AST of sections, decks by slide; faults mark the row."""

    def one(deck: bool, text: str | None) -> tuple[str | None, str, str | None]:
        try:
            done = (_slides if deck else _sections)(text)
            return done, "REORGNIZED" if done else "PENDING", None
        except ValueError as e:
            return None, "ERROR", str(e)

    @F.pandas_udf("struct<json:string,status:string,exception:string>")
    def apply(texts: pd.Series, decks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(d, x) for x, d in zip(texts, decks)], columns=["json", "status", "exception"])

    return documents.select("doc_id", apply("raw_markdown", is_deck(F.col("raw_markdown"))).alias("r")).select("doc_id", "r.*")


def summarised(documents: DataFrame, asts: DataFrame, factory: Callable = Prefix, slots: int | None = None, images: Callable | None = None) -> DataFrame:
    """doc_id, json, status, exception: the summaries of each document's AST, by at most ``slots`` tasks at once."""
    rows = documents.select("doc_id", "title", "file_path").join(asts.select("doc_id", F.col("json").alias("ast")), "doc_id", "left")
    return _slots(rows, slots).select("doc_id", summaries.semantics_column("ast", "title", "file_path", factory, images=images).alias("r")).select("doc_id", F.col("r.semantics_json").alias("json"), "r.status", "r.exception")


def embedded(documents: DataFrame, semantics: DataFrame, factory: Callable = HashedWords, slots: int | None = None) -> DataFrame:
    """doc_id, json, status, exception, records: ids and vectors of each document's nodes, by at most ``slots`` tasks at once."""
    rows = documents.select("doc_id", "file_path").join(semantics.select("doc_id", F.col("json").alias("s")), "doc_id", "left")
    return _slots(rows, slots).select("doc_id", embedding.embed_column("s", "file_path", factory).alias("r")).select("doc_id", F.col("r.embed_json").alias("json"), "r.status", "r.exception", "r.records")


def _slots(df: DataFrame, slots: int | None) -> DataFrame:
    """The rows in as many tasks as may call a model at once: a shuffle right before the call, so nothing spreads them again."""
    return df.repartition(slots) if slots else df


def failures(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, stage, exception of the documents whose stage failed, as last recorded."""
    schema = "doc_id string, exception string, stage string"
    try:
        return spark.read.schema(schema).parquet(f"{path}_failed")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def run_pending(documents: DataFrame, path: str, slots: int | None = None, summarizer: Callable = Prefix, embedder: Callable = HashedWords, store: VectorStore | None = None, collection: str = "documents", again: bool = False, images: Callable | None = None) -> DataFrame:
    """All three stages for all documents that lack them; stage, status and count of this run.

    ``slots`` bounds how many tasks call a model at once. Vectors go to
    ``collection`` of ``store``. A document with status ``CANCELLED`` is left
    out and reported as such. One that failed is not tried again until
    ``again``, which also computes anew what is stored. ``images`` makes the
    describer of image nodes.
    """
    spark = documents.sparkSession
    cancelled = F.coalesce(F.upper(F.trim("status")) == "CANCELLED", F.lit(False)) if "status" in documents.columns else F.lit(False)
    active = documents.filter(~cancelled)
    report = documents.filter(cancelled).groupBy().count().filter("count > 0").select(F.lit("CANCELLED").alias("status"), "count", F.lit("all").alias("stage"))
    for stage in ("ast", "semantics", "embed"):
        todo = active
        if not again:
            stored = load(spark, path, stage).select("doc_id", F.lit(stage).alias("kind"))
            todo = pending(active, stored, stage).join(failures(spark, path).filter(F.col("stage") == stage), "doc_id", "left_anti")
        if stage == "ast":
            done = reorganised(todo)
        elif stage == "semantics":
            done = summarised(todo, load(spark, path, "ast"), summarizer, slots, images)
        else:
            done = embedded(todo, load(spark, path, "semantics"), embedder, slots)
        done = durable(done)  # stored once, counted and appended: what is appended must not change what is counted
        append(done, path, stage, again)
        if stage == "embed" and store is not None:
            store.add(done.select(F.explode("records").alias("r")).select("r.*", F.lit(collection).alias("collection")))
        failed = done.filter("status = 'ERROR'").select("doc_id", "exception", F.lit(stage).alias("stage"))
        failed.write.mode("overwrite" if again else "append").option("partitionOverwriteMode", "dynamic").partitionBy("stage").parquet(f"{path}_failed")
        counted = spark.createDataFrame(done.groupBy("status").count().collect(), "status string, count long").withColumn("stage", F.lit(stage))
        report = report.unionByName(counted)
    return report
