"""Exact nearest neighbours of a query set, and the question-answer lookup on top."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.runtime import durable

#: Queries broadcast at once; larger query sets are answered in as many passes as it takes.
MOST_QUERIES = 20_000
METRICS = ("l2", "cosine")


def _partial(query_ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, names: list[str]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = vectors.shape[1]
        best_d = np.full((len(query_ids), k), np.inf)
        best_i = np.full((len(query_ids), k), -1, np.int64)
        q2 = (vectors**2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            base = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            b2 = (base**2).sum(1)
            for lo in range(0, len(query_ids), 512):
                hi = min(lo + 512, len(query_ids))
                dots = vectors[lo:hi] @ base.T
                if metric == "l2":
                    d = q2[lo:hi, None] - 2 * dots + b2[None, :]
                else:
                    d = 1 - dots / np.sqrt(np.maximum(q2[lo:hi, None] * b2[None, :], 1e-300))
                d = np.round(np.maximum(d, 0), 9)
                all_d = np.concatenate([best_d[lo:hi], d], axis=1)
                all_i = np.concatenate([best_i[lo:hi], np.broadcast_to(ids, d.shape)], axis=1)
                order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                best_d[lo:hi] = np.take_along_axis(all_d, order, 1)
                best_i[lo:hi] = np.take_along_axis(all_i, order, 1)
        got = np.isfinite(best_d)
        rows = np.broadcast_to(query_ids[:, None], got.shape)
        yield pa.RecordBatch.from_arrays([pa.array(rows[got]), pa.array(best_i[got]), pa.array(best_d[got])], names=names)

    return run


def nearest(queries: DataFrame, base: DataFrame, k: int = 4, metric: str = "l2", size: int = 64) -> DataFrame:
    """The ``k`` nearest of ``base`` for every query: query, near, distance (squared for ``l2``), rank from 1.

    Both sides have ``id`` (integer) and ``v`` (array); rows whose vector has
    not exactly ``size`` numbers are left out. Ties go to the smaller id. Each
    partition of the base keeps its own ``k`` best, so only these are shuffled.
    Queries travel in blocks of ``MOST_QUERIES``; there is one pass over the
    base for each block.
    """
    if metric not in METRICS:
        raise ValueError(f"Unsupported metric: {metric}")
    whole = lambda df: df.filter((F.size("v") == size) & F.forall("v", lambda x: x.isNotNull())).select(F.col("id").cast("long").alias("id"), "v")
    queries, base = whole(queries), whole(base)
    total = queries.count()
    passes = -(-total // MOST_QUERIES)
    found = None
    own = queries if passes <= 1 else durable(queries.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(2 * passes))))
    for block in range(1 if passes <= 1 else 2 * passes):
        some = own if passes <= 1 else own.filter(F.col("__b") == block)
        rows = some.select("id", "v").limit(2 * MOST_QUERIES).toArrow()
        if rows.num_rows == 2 * MOST_QUERIES:
            raise ValueError("a block of queries is too large: ids repeat")
        ids = rows.column("id").to_numpy()
        vectors = np.array(rows.column("v").to_pylist(), np.float64).reshape(-1, size)
        part = base.mapInArrow(_partial(ids, vectors, k, metric, ["query", "near", "distance"]), "query long, near long, distance double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "near"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def best_answers(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """From the hits of each collection to the answers: question hits only, the closest of all collections, its answer's text.

    ``hits``: query, near, distance; ``vectors``: vec_id, collection, id,
    metadata, document. Queries without a question among their hits give no row.
    """
    questions = vectors.filter("metadata['source'] = 'question'").select(F.col("vec_id").alias("near"), "collection", "id")
    kept = hits.join(questions, "near")
    best = kept.groupBy("query").agg(F.min(F.struct("distance", "near", "collection", "id")).alias("b")).select("query", F.col("b.distance").alias("distance"), F.col("b.collection").alias("collection"), F.col("b.id").alias("question_id"))
    answers = vectors.select("collection", F.col("id").alias("answer_id"), F.col("document").alias("answer"))
    named = best.withColumn("answer_id", F.regexp_replace("question_id", r"_q(\d+)$", "_a$1"))
    return named.join(answers, ["collection", "answer_id"], "left").select("query", "collection", "question_id", "answer_id", "answer", "distance")


def pair_rows(pairs: DataFrame) -> DataFrame:
    """Each pair as its two rows of a vector store: collection, id, source, document."""
    both = F.array(F.struct(F.lit("question").alias("source"), F.lit("_q").alias("mark"), F.col("question").alias("document")), F.struct(F.lit("answer").alias("source"), F.lit("_a").alias("mark"), F.col("answer").alias("document")))
    each = pairs.select("collection", "ord", F.explode(both).alias("s"))
    return each.select("collection", F.concat("collection", "s.mark", F.col("ord").cast("string")).alias("id"), "s.source", "s.document")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)
