"""The most similar vectors of every vector, by a hash-prefix forest.

Every tree gives each vector a long string of bits (signs of projections on
random hyperplanes) and keeps the vectors sorted by it. In a sorted array the
neighbours of a vector are its longest-prefix matches, of whatever length the
region's density gives; reading outward ascends to shorter prefixes. All trees
are read outward by the same number of blocks, and the best of all are merged.
The number of trees follows the counted rows, so that the chance of meeting a
neighbour does not fall as the table grows; they are built a few at a time.
Trees are range partitions of one distributed sort, so no task holds a tree,
and blocks are compared by one matrix product each. Vectors are compared once
per distinct value: copies join their class first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.runtime import durable

#: Trees at least, and built at once.
TREES = 32
BLOCK = 256
BITS = 64
#: A neighbour at cosine 0.5 shares each bit with chance 2/3 and should be met with this chance.
AGREE, TARGET = 2 / 3, 0.95


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has exactly ``size`` finite numbers, not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def trees_for(rows: int, block: int = BLOCK) -> int:
    """Trees in which a neighbour at cosine 0.5 among so many rows is met at least once with chance ``TARGET``.

    At least one block to each side is read, so a window of two holds those
    that agree on the first log2(rows / window) bits.
    """
    met = AGREE ** max(0.0, math.log2(max(rows, 1) / (2 * block)))
    return TREES if met >= 1 else max(TREES, math.ceil(math.log(1 - TARGET) / math.log1p(-met)))


def _planes(tree: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, tree]).standard_normal((size, BITS)).astype(np.float32)


def _hashes(size: int, trees: range, seed: int) -> object:
    @F.pandas_udf("array<binary>")
    def strings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = np.concatenate([_planes(t, size, seed) for t in trees], axis=1)
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            bits = np.stack(vectors.to_numpy()).astype(np.float32) @ planes > 0
            packed = np.packbits(bits.reshape(len(bits), len(trees), BITS), axis=2)
            yield pd.Series([[x.tobytes() for x in row] for row in packed], dtype=object)

    return strings


_NEAR = "id long, near array<struct<cosine:double,near:long>>"
_NEAR_ARROW = pa.schema([("id", pa.int64()), ("near", pa.list_(pa.struct([("cosine", pa.float64()), ("near", pa.int64())])))])


def _blocks(k: int, size: int, block: int) -> object:
    """Top ``k`` of each row among its own block of the sorted array and the blocks beside it."""

    def compare(ids: np.ndarray, unit: np.ndarray, lo: int, hi: int) -> pa.RecordBatch:
        a, b = max(0, lo - block), min(len(ids), hi + block)
        near, others = ids[lo:hi], ids[a:b]
        sims = unit[lo:hi].astype(np.float32) @ unit[a:b].astype(np.float32).T
        sims[np.arange(hi - lo), np.arange(lo - a, hi - a)] = -2
        n = min(k, sims.shape[1])
        top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        exact = np.einsum("ijk,ik->ij", unit[a:b][top], unit[lo:hi])
        keep = others[top] != near[:, None]
        flat = pa.StructArray.from_arrays([pa.array(exact[keep]), pa.array(others[top][keep])], names=["cosine", "near"])
        offsets = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(near), pa.ListArray.from_arrays(pa.array(offsets), flat)], schema=_NEAR_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, tree = np.empty(0, np.int64), np.empty((0, size)), -1
        done = 0  # rows at the head that have been compared and serve only as left neighbours

        for batch in batches:
            trees = batch.column(0).to_numpy()
            if not len(trees):
                continue
            own = batch.column(1).to_numpy()
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            v /= np.linalg.norm(v, axis=1)[:, None]
            edges = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1]]).tolist() + [len(trees)]
            for i, j in zip(edges, edges[1:]):
                if trees[i] != tree:
                    for lo in range(done, len(ids), block):
                        yield compare(ids, unit, lo, min(lo + block, len(ids)))
                    ids, unit, tree, done = own[i:j], v[i:j], trees[i], 0
                else:
                    ids, unit = np.concatenate([ids, own[i:j]]), np.concatenate([unit, v[i:j]])
                while len(ids) - done >= 2 * block:
                    yield compare(ids, unit, done, done + block)
                    done += block
                if done > block:
                    ids, unit, done = ids[done - block :], unit[done - block :], block
        for lo in range(done, len(ids), block):
            yield compare(ids, unit, lo, min(lo + block, len(ids)))

    return run


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4, size: int = 64, trees: int | None = None, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """The ``k`` most similar other vectors of every usable one: key, ``rank`` (from 1), ``near``, ``cosine``.

    Order is by cosine, ties by smaller id. Usable are vectors of exactly
    ``size`` finite numbers that are not all zero; the rest (null, empty,
    another size) give no rows and are never found. A key delivered again
    counts once. Equal vectors are each other's nearest, with cosine 1; of a
    large group of copies each member has the ``k`` smallest other ids. With
    fewer than ``k`` others all are listed; an empty table gives no rows.
    Keys must be integers; other columns are ignored, whatever their names.

    Approximate: a true neighbour is missed if it lies beyond the blocks beside
    the vector in every tree. ``trees`` is by default ``trees_for`` the distinct
    vectors. At a border of two range partitions a sorted
    array is cut, which costs one tree's candidates for the rows beside it.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"), size))
    once = rows.groupBy("id").agg(F.max("v").alias("v"))
    plain = durable(once.select("id", "v", F.xxhash64("v").alias("c1"), F.xxhash64(F.lit(seed), "v").alias("c2")))
    firsts = plain.withColumn("r", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("id"))).filter(F.col("r") <= k + 1)
    classes = firsts.groupBy("c1", "c2").agg(F.array_sort(F.collect_list("id")).alias("members"), F.max("v").alias("v"))
    classes = durable(classes.select("c1", "c2", F.col("members")[0].alias("rep"), "members", "v"))
    trees = trees or trees_for(classes.count(), block)
    best = None
    for first in range(0, trees, TREES):  # a few trees at a time, so the disk needed does not grow with their number
        some = range(first, min(first + TREES, trees))
        strings = _hashes(size, some, seed)
        forest = classes.select("rep", "v", strings("v").alias("h")).select("rep", "v", F.posexplode("h").alias("tree", "h"))
        forest = forest.repartitionByRange("tree", "h", "rep").sortWithinPartitions("tree", "h", "rep").select("tree", "rep", "v")
        found = forest.mapInArrow(_blocks(k, size, block), _NEAR).select("id", F.explode("near").alias("n")).select("id", "n.near", "n.cosine")
        found = found.select("id", F.struct((-F.col("cosine")).alias("far"), "near").alias("n"))
        if best is not None:
            found = found.unionByName(best.select("id", F.explode("best").alias("n")))
        best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("n")), 1, k).alias("best"))
        if trees > TREES:
            best = durable(best)
    pairs = best.select("id", F.explode("best").alias("b")).select("id", F.col("b.near").alias("rep"), (-F.col("b.far")).alias("cosine"))
    others = pairs.join(classes.select("rep", "members"), "rep").groupBy("id").agg(F.flatten(F.collect_list(F.transform(F.slice("members", 1, k), lambda m: F.struct(F.col("cosine").alias("cosine"), m.alias("near"))))).alias("others"))
    full = classes.select("c1", "c2", "rep", "members").join(others, F.col("rep") == F.col("id"), "left").select("c1", "c2", "members", "others")
    each = plain.select("id", "c1", "c2").join(full, ["c1", "c2"])
    same = F.transform(F.filter("members", lambda m: m != F.col("id")), lambda m: F.struct(F.lit(1.0).alias("cosine"), m.alias("near")))
    ranked = F.slice(F.array_sort(F.transform(F.concat(same, F.coalesce("others", F.array().cast("array<struct<cosine:double,near:bigint>>"))), lambda x: F.struct((-x.cosine).alias("far"), x.near.alias("near")))), 1, k)
    out = each.select(F.col("id").alias(key), F.posexplode(ranked).alias("rank", "n"))
    return out.select(key, (F.col("rank") + 1).alias("rank"), F.col("n.near").alias("near"), (-F.col("n.far")).alias("cosine"))


def similar_pairs(neighbours: DataFrame, key: str = "vec_id", threshold: float = 0.9) -> DataFrame:
    """Unordered pairs of the neighbour lists with a cosine of at least ``threshold``."""
    near = neighbours.filter(F.col("cosine") >= threshold)
    return near.select(F.least(key, "near").alias("vec_a"), F.greatest(key, "near").alias("vec_b")).distinct()
