"""Near-duplicate records, by an LSH forest whose dense regions are compared in blocks.

Each text has one min-hash sketch; tree number l of the forest puts together
all texts that agree on the l-th group of ``DEPTH`` values: a region. Texts of
a region are candidates, however many they are: a small region is paired in
one row, a larger one is cut into blocks that are compared two at a time, so
no task holds it and the recall does not depend on how dense it is. Narrowing
by further values would lose pairs that part there. Candidates whose sketches
rule the threshold out are dropped (within the blocks already), the others
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.runtime import durable, latest

WIDTH = 16
TREES = 40
DEPTH = 3
#: Texts of a region that are paired at once, and of a block of a larger region.
REGION = 48
#: Values of one sketch; the trees use the first TREES * DEPTH.
VALUES = 256
#: Sketches may underrate the similarity by this much: more than four standard deviations at VALUES values.
SLACK = 0.15

#: The characters that do not count.
BLANKS = " \t\r\n　"

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct strings of ``width`` code points."""
    if len(text) < width:
        return np.empty(0, np.uint64)
    h = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _M1)
    rolled, power, have, out, at = h, int(_M1), 1, None, 0
    todo = width
    while todo:  # windows of 1, 2, 4 ... code points, joined by the bits of the width
        if todo & 1:
            out = rolled if out is None else out[: len(h) - at - have + 1] * np.uint64(pow(int(_M1), have, 1 << 64)) + rolled[at : at + len(h) - at - have + 1]
            at += have
        todo >>= 1
        if todo:
            rolled = rolled[:-have] * np.uint64(power) + rolled[have:]
            power = power * power % (1 << 64)
            have *= 2
    return np.unique(_mix(out))


def sketch(hashes: np.ndarray, values: int = VALUES) -> np.ndarray:
    """Min-hash values of one set by one permutation: the least hash of each of ``values`` equal ranges.

    An empty range borrows from the range that a fixed sequence of draws
    finds first, the same for all sets.
    """
    shift = np.uint64(64 - (values - 1).bit_length())
    bins = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out = np.zeros(values, np.uint64)
    full = np.zeros(values, bool)
    out[bins[first]] = hashes[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    draw = 0
    filled = out.copy()
    while len(empty):
        draw += 1
        to = (_mix(empty.astype(np.uint64) * np.uint64(1000003) + np.uint64(draw)) % np.uint64(values)).astype(np.int64)
        ok = full[to]
        filled[empty[ok]] = _mix(out[to[ok]] + np.uint64(draw))
        empty = empty[~ok]
    return _mix(filled)


def _signatures(width: int, trees: int) -> object:
    """By text: size of its set, one byte of each value, and the region in each tree."""

    @F.pandas_udf("struct<n:int,bytes:binary,keys:array<long>>")
    def signatures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, low, keys = [], [], []
            for text in texts:
                s = shingles(text or "", width)
                n.append(len(s))
                if not len(s):
                    low.append(None)
                    keys.append(None)
                    continue
                v = sketch(s)
                low.append((v & np.uint64(255)).astype(np.uint8).tobytes())
                part = v[: trees * DEPTH].reshape(trees, DEPTH)
                key = np.arange(1, trees + 1, dtype=np.uint64)
                for d in range(DEPTH):
                    key = _mix(key * _M1 + part[:, d])
                keys.append(key.view(np.int64).tolist())
            yield pd.DataFrame({"n": np.array(n, np.int32), "bytes": low, "keys": keys})

    return signatures


def _estimated() -> object:
    """Similarity estimated from one byte of each value."""

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(a), -1) for s in (a, b))
        return pd.Series(((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256))

    return estimate


def _similarity(width: int) -> object:
    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}
        out = []
        for x, y in zip(a, b):
            s, t = (known[z] if z in known else known.setdefault(z, shingles(z, width)) for z in (x, y))
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(both / (len(s) + len(t) - both))
            if len(known) > 1000:
                known.clear()
        return pd.Series(out, dtype=float)

    return similarity


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def _close(threshold: float) -> object:
    """Places (i, j) in two blocks of the pairs that sizes and sketches do not rule out."""

    @F.pandas_udf("array<struct<i:int,j:int>>")
    def close(na: pd.Series, a: pd.Series, nb: pd.Series, b: pd.Series, same: pd.Series) -> pd.Series:
        out = []
        for m, s, n, t, one in zip(na, a, nb, b, same):
            x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(len(z), -1) for z in (s, t))
            m, n = np.asarray(m)[:, None], np.asarray(n)[None]
            ok = np.minimum(m, n) >= threshold * np.maximum(m, n)
            for i in range(len(x)):
                ok[i] &= ((x[i] == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= threshold - SLACK
            i, j = np.nonzero(np.triu(ok, 1) if one else ok)
            out.append([{"i": p, "j": q} for p, q in zip(i.tolist(), j.tolist())])
        return pd.Series(out, dtype=object)

    return close


def candidates(forest: DataFrame, side: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a < b) of the ``rep`` that share a region, less those that the sketches rule out in the dense ones.

    ``forest`` has rep and region (one row per tree), ``side`` has rep, n and bytes.
    """
    size = forest.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
    at = forest.join(size, "region")
    small = at.filter(F.col("size") <= REGION).groupBy("region").agg(F.array_sort(F.collect_list("rep")).alias("r"))
    dense = durable(at.filter(F.col("size") > REGION))
    found = _ordered(small)
    return (found if dense.isEmpty() else found.unionByName(_in_blocks(dense.join(side, "rep"), threshold))).distinct()


def _ordered(groups: DataFrame) -> DataFrame:
    """Pairs of bounded groups, as array ``r`` of sorted ids."""
    pairs = groups.select("r", F.posexplode("r").alias("i", "a"))
    return pairs.select("a", F.explode(F.slice("r", F.col("i") + 2, F.lit(4 * REGION))).alias("b"))


def _in_blocks(dense: DataFrame, threshold: float) -> DataFrame:
    """Close pairs of the dense regions, every block against every block of its region."""
    at = dense.withColumn("blocks", F.ceil(F.col("size") / REGION).cast("int"))
    at = at.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cut = durable(at.groupBy("region", "blocks", "mine").agg(F.array_sort(F.collect_list(F.struct("rep", "n", "bytes"))).alias("r")))
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = each.select("r", "mine", "region", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    left, right = cell.filter("mine = x").withColumnRenamed("r", "p"), cell.filter("mine = y").withColumnRenamed("r", "q")
    cells = left.drop("mine").join(right.drop("mine"), ["region", "x", "y"])
    hits = _close(threshold)(F.col("p.n"), F.col("p.bytes"), F.col("q.n"), F.col("q.bytes"), F.col("x") == F.col("y"))
    reps = cells.select(F.col("p.rep").alias("p"), F.col("q.rep").alias("q"), hits.alias("hits"))
    pairs = reps.select(F.explode(F.transform("hits", lambda h: F.struct(F.col("p")[h.i].alias("a"), F.col("q")[h.j].alias("b")))).alias("h"))
    return pairs.select(F.least("h.a", "h.b").alias("a"), F.greatest("h.a", "h.b").alias("b"))


def similar_texts(df: DataFrame, key: str = "doc_id", text: str = "raw_markdown", order: str | None = "ingested_at", threshold: float = 0.6, width: int = WIDTH, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(members, links): each document with its class of equal texts, and the similar pairs of classes.

    ``members``: key, ``rep`` (least key of the class), ``n`` (size of the text's
    set of strings). ``links``: ``a`` < ``b`` (representatives) and
    ``similarity`` >= ``threshold``, the share of common strings of ``width``
    code points after white space is removed. A null text, or one shorter than
    ``width``, has an empty set and takes part in nothing; a key delivered again
    counts once, as delivered last; null keys are left out. Equal texts form one
    class however many they are. Other columns are ignored, whatever their names.
    """
    order = order if order in df.columns else None
    rows = df.select(F.col(f"`{key}`").alias("id"), normalised(F.col(f"`{text}`")).alias("text"), *([F.col(f"`{order}`").alias("at")] if order else []))
    rows = rows.filter(F.col("id").isNotNull())
    at = ["at"] if order else []
    signed = rows.select("id", *at, F.sha2("text", 256).alias("digest"), _signatures(width, trees)("text").alias("s"))
    signed = durable(signed.select("id", *at, "digest", "s.n", "s.bytes", "s.keys"))
    slim = latest(signed.select("id", *at, "digest", "n"), ["id"], "at" if order else None).filter("n > 0").select("id", "digest")
    reps = slim.groupBy("digest").agg(F.min("id").alias("rep"))
    members = durable(slim.join(reps, "digest").select("id", "rep", "digest"))
    own = members.filter("id = rep").select("digest", "rep")
    sketches = signed.filter("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("bytes").alias("bytes"), F.first("keys").alias("keys")).join(own, "digest")
    sketches = durable(sketches.select("rep", "n", "bytes", "keys"))
    side = sketches.select("rep", "n", "bytes")
    pairs = candidates(sketches.select("rep", F.explode("keys").alias("region")), side, threshold)
    close = pairs.join(side.toDF("a", "na", "ba"), "a").join(side.toDF("b", "nb", "bb"), "b")
    close = close.filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    close = durable(close.filter(_estimated()("ba", "bb") >= threshold - SLACK).select("a", "b"))
    involved = close.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    # one text for each class, that of its representative: copies do not travel
    wanted = own.join(involved, "rep").select(F.col("rep").alias("id"), "digest")
    texts = rows.select("id", "text", F.sha2("text", 256).alias("digest")).join(wanted, ["id", "digest"]).groupBy(F.col("id").alias("rep")).agg(F.first("text").alias("text"))
    texts = durable(texts)
    both = close.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    links = both.select("a", "b", _similarity(width)("ta", "tb").alias("similarity")).filter(F.col("similarity") >= threshold)
    return members.select(F.col("id").alias(key), "rep").join(side.select("rep", "n"), "rep").select(key, "rep", "n"), links


def all_pairs(members: DataFrame, links: DataFrame, key: str = "doc_id") -> DataFrame:
    """The similar pairs of documents, ``doc_a`` < ``doc_b``, copies of one text included."""
    m = members.select(F.col(key).alias("id"), "rep")
    across = links.select("a", "b").join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b").select("x", "y")
    within = m.toDF("x", "rep").join(m.toDF("y", "rep"), "rep").filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def groups(members: DataFrame, links: DataFrame, key: str = "doc_id", rounds: int = 100) -> DataFrame:
    """One row per document: key, ``group_id`` (least key of its group), ``class_id`` and ``n_links`` of its class.

    Groups are the connected components of the links, found by alternating
    large-star and small-star steps on the representatives only; each round is
    checkpointed, and it ends when no edge changes (after a few rounds, as their
    number grows with the logarithm of the longest chain).
    """
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.groupBy("a").agg(F.count("*").alias("n_links"))
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "u", "m")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small.select("u", F.col("m").alias("v")).filter("u <> v")).distinct()
        nxt = durable(nxt)
        same = nxt.count() == edges.count() and nxt.exceptAll(edges).isEmpty()
        edges = nxt
        if same:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    label = edges.groupBy("u").agg(F.min("v").alias("g"))
    out = members.join(label, F.col("rep") == F.col("u"), "left").join(degree, F.col("rep") == F.col("a"), "left")
    return out.select(key, F.coalesce("g", "rep").alias("group_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
