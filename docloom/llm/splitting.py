"""Oversized items cut at natural boundaries, by pointer doubling.

Every boundary of an item (paragraph, line, sentence, clause or word end, and a
grid of forced cuts inside runs that have none) is joined to its farthest legal
successor: the end of the piece that starts the overlap before it. The
successors of all items of an Arrow batch form one table; squaring it
log2(longest chain) times marks every cut of every item at once, without a
sequential scan over pieces. Nothing but the rows over their limit leaves the
JVM, and no shuffle is needed for the cuts themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.runtime import latest, portions

#: Kinds of boundary by rank, the most natural first.
KINDS = ("paragraph", "line", "sentence", "clause", "word", "forced", "end")
FORCED, END = 5, 6

#: A cut falls after the match. Sentence and clause marks of the scripts in use.
_PATTERNS = (
    re.compile(r"(?:\r\n|\n|\r)(?:[ \t　]*(?:\r\n|\n|\r))+"),
    re.compile(r"\r\n|\n|\r"),
    re.compile(r"[。！？；…]+[”’」』）)\"']*|[.!?;]+[\"'”’)\]]*[ \t　]+"),
    re.compile(r"[，、：]|[,:][ \t]+"),
    re.compile(r"\s+"),
)

PIECE = T.ArrayType(T.StructType([T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cut", T.StringType()), T.StructField("piece", T.StringType())]))


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ranks of the boundaries of one text, its two ends included.

    Where two neighbours are more than ``step`` apart, forced cuts fill the gap
    every ``step`` characters, so that the table is closed: every legal
    successor is in it. A cut never parts ``\\r`` from ``\\n``.
    """
    n = len(text)
    rank = np.full(n + 1, len(_PATTERNS), np.int8)
    for k in range(len(_PATTERNS) - 1, -1, -1):
        at = np.fromiter((m.end() for m in _PATTERNS[k].finditer(text)), np.int64)
        rank[at] = k
    rank[0] = 0
    rank[n] = END
    pos = np.flatnonzero(rank != FORCED)
    gap = np.diff(pos)
    wide = np.flatnonzero(gap > step)
    if len(wide):
        extra = np.concatenate([np.arange(pos[i] + step, pos[i + 1], step) for i in wide])
        pos = np.sort(np.concatenate([pos, extra]))
    return pos, rank[pos]


def successors(pos: np.ndarray, rank: np.ndarray, limit: int, overlap: int, first: int) -> np.ndarray:
    """Index of the farthest legal end of the piece that follows each boundary.

    The piece after boundary ``e`` starts at ``e - overlap`` (at 0 for the first)
    and may reach ``e - overlap + limit``. Of the ends in reach, the farthest of
    the most natural kind wins, looking in the latter half of the reach first;
    a forced cut is taken only where nothing natural is in reach. The last
    boundary is its own successor.
    """
    n = len(pos)
    step = limit - overlap
    reach = pos + step
    reach[first] = pos[first] + limit
    far = np.searchsorted(pos, reach, side="right") - 1
    i = np.arange(n)
    half = pos + np.maximum((reach - pos) // 2, 1)
    best = np.full(n, -1)
    for window in (half, pos + 1):
        for k in range(FORCED):
            own = np.flatnonzero(rank == k)
            if not len(own):
                continue
            j = np.searchsorted(own, far, side="right") - 1
            cand = np.where(j >= 0, own[np.maximum(j, 0)], -1)
            ok = (best < 0) & (cand > i) & (pos[np.maximum(cand, 0)] >= window)
            best[ok] = cand[ok]
    best = np.where(far == n - 1, n - 1, best)
    return np.where(best < 0, np.maximum(far, np.minimum(i + 1, n - 1)), best)


def cuts(texts: list[str], limits: np.ndarray, overlaps: np.ndarray) -> list[np.ndarray]:
    """For each text the (start, end, rank of the cut) of its pieces, all texts at once."""
    tables, ranks, bases, base = [], [], [], 0
    places = []
    for text, limit, overlap in zip(texts, limits, overlaps):
        pos, rank = boundaries(text, int(limit - overlap))
        succ = successors(pos, rank, int(limit), int(overlap), 0)
        tables.append(succ + base)
        ranks.append(rank)
        places.append(pos)
        bases.append(base)
        base += len(pos)
    jump = np.concatenate(tables)
    reached = np.zeros(base, bool)
    reached[bases] = True
    while True:  # squaring: after k rounds all cuts up to 2**k pieces from the start are marked
        before = reached.sum()
        reached[jump[reached]] = True
        jump = jump[jump]
        if reached.sum() == before:
            break
    out = []
    for b, pos, rank, overlap in zip(bases, places, ranks, overlaps):
        at = np.flatnonzero(reached[b : b + len(pos)])
        ends = pos[at[1:]]
        starts = np.concatenate([[0], ends[:-1] - overlap]) if len(ends) else ends
        out.append(np.stack([starts, ends, rank[at[1:]]], axis=1))
    return out


#: Characters whose successor tables are held at once.
TOGETHER = 2_000_000


@F.pandas_udf(PIECE)
def _pieces(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, limit, overlap, whole in batches:
        texts = text.tolist()
        sizes, shared = limit.to_numpy(np.int64), overlap.to_numpy(np.int64)
        found = [x for i, j in portions([len(s) for s in texts], TOGETHER) for x in cuts(texts[i:j], sizes[i:j], shared[i:j])]
        yield pd.Series([[(k, int(a), int(b), KINDS[r], s[a:b] if w else None) for k, (a, b, r) in enumerate(rows)] for rows, s, w in zip(found, texts, whole)], dtype=object)


def split_oversized(df: DataFrame, key: list[str], text: str = "text", limit: str = "max_chars", overlap: str = "overlap_chars", order: str | None = None, with_text: bool = True) -> DataFrame:
    """The pieces of every item longer than its limit.

    Columns: the key, ``piece_no`` (from 0), ``start`` and ``end`` (code points,
    end exclusive), ``cut`` (kind of boundary at the end) and ``piece``. Pieces
    are at most ``limit`` long, the next one starts exactly ``overlap`` before
    the end of the last, and together they cover the text.

    Items that are null, or not longer than their limit, or without a limit
    (null, below 1) give no rows. An overlap that is null or negative counts as
    0, one that leaves no advance as ``limit - 1``. An item delivered again
    (same key) counts once, as delivered last by ``order``. Other columns are
    dropped, whatever their names.
    """
    kept = list(dict.fromkeys([*key, *([order] if order else [])]))
    slim = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"), F.col(limit).cast("long").alias("__limit"), F.coalesce(F.col(overlap), F.lit(0)).cast("long").alias("__overlap"))
    # an item that was short at one delivery may be long at the next: whichever came last counts, but texts that
    # are short at every delivery need not travel
    long_ = F.coalesce(F.length("__text") > F.col("__limit"), F.lit(False))
    slim = slim.withColumn("__over", long_).withColumn("__hash", F.xxhash64("__text", "__limit", "__overlap")).withColumn("__text", F.when(long_, F.col("__text")))
    over = latest(slim, key, order).filter(F.col("__over") & (F.col("__limit") >= 1))
    over = over.withColumn("__overlap", F.least(F.greatest("__overlap", F.lit(0)), F.col("__limit") - 1))
    cut = over.select(*key, F.explode(_pieces("__text", "__limit", "__overlap", F.lit(with_text))).alias("p"))
    return cut.select(*key, "p.piece_no", "p.start", "p.end", "p.cut", "p.piece")


#: A table of limits is configuration; it must not be longer.
MOST_LIMITS = 1000


def with_limits(items: DataFrame, limits: DataFrame, field: str, kind: Column | None = None) -> DataFrame:
    """Attach ``max_chars`` and ``overlap_chars``: those of the item's kind, else those of ``*``.

    The limits are configuration (one row per field and kind, at most
    ``MOST_LIMITS``, else ``ValueError``) and become literals of the plan. Without a row that
    fits, both columns are null; of repeated rows the largest values count.
    """
    rows = limits.filter(F.col("item_field") == field).groupBy("t").agg(F.max("max_chars"), F.max("overlap_chars")).limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits for {field}")
    by = {t: (most, shared) for t, most, shared in rows}

    def chosen(i: int) -> Column:
        out = F.lit(by["*"][i] if "*" in by else None).cast("int")
        for t, pair in by.items():
            if kind is not None and t not in (None, "*"):
                out = F.when(kind == t, F.lit(pair[i]).cast("int")).otherwise(out)
        return out

    return items.withColumn("max_chars", chosen(0)).withColumn("overlap_chars", chosen(1))
