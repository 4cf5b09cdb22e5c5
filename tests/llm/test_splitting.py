"""Pointer doubling against a sequential greedy cut, and its edge cases."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import splitting


def sequential(text, limit, overlap):
    pos, rank = splitting.boundaries(text, limit - overlap)
    succ = splitting.successors(pos, rank, limit, overlap, 0)
    out, at = [], 0
    while pos[at] < len(text):
        start = 0 if at == 0 else pos[at] - overlap
        at = int(succ[at])
        out.append((start, int(pos[at])))
    return out


TEXTS = st.text(alphabet="ab \n。，.\t　漢", min_size=1, max_size=120)


@given(st.lists(st.tuples(TEXTS, st.integers(2, 30), st.integers(0, 10)), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_equals_sequential(items):
    items = [(t, lim, min(o, lim - 1)) for t, lim, o in items if len(t) > lim]
    if not items:
        return
    texts, limits, overlaps = zip(*items)
    for rows, (text, limit, overlap) in zip(splitting.cuts(list(texts), np.array(limits), np.array(overlaps)), items):
        got = [(int(a), int(b)) for a, b, _ in rows]
        assert got == sequential(text, limit, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in got)
        assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(got, got[1:]))


def test_prefers_natural_boundaries():
    text = "First paragraph here.\n\nSecond one is here. It goes on and on without an end"
    (rows,) = splitting.cuts([text], np.array([30]), np.array([0]))
    pieces = [text[a:b] for a, b, _ in rows]
    assert pieces[0] == "First paragraph here.\n\n" and pieces[1] == "Second one is here. "
    (rows,) = splitting.cuts(["x" * 100], np.array([30]), np.array([10]))
    assert [splitting.KINDS[r] for _, _, r in rows] == ["forced"] * 4 + ["end"]


def test_operator_edges(spark):
    rows = [("a", "x" * 50, 20, 5, 1), ("a", "y" * 50, 20, 5, 2), ("n", None, 20, 5, 1), ("s", "short", 20, 5, 1), ("e", "", 20, 5, 1), ("l", "z" * 50, None, 5, 1), ("z", "z" * 50, 0, 5, 1), ("o", "z" * 5, 2, 9, 1), ("u", "z" * 5, 2, None, 1), (None, "q" * 30, 20, 0, 1), ("x", "exactly twenty chars", 20, 0, 1)]
    df = spark.createDataFrame(rows, "id string, text string, max_chars int, overlap_chars int, at int").selectExpr("*", "1 AS piece", "2 AS start")
    got = splitting.split_oversized(df, ["id"], order="at").collect()
    ids = {r.id for r in got}
    assert ids == {"a", "o", "u", None}
    assert all("y" in r.piece for r in got if r.id == "a")
    assert [r.piece for r in sorted((r for r in got if r.id == "o"), key=lambda r: r.piece_no)] == ["zz"] * 4
    assert splitting.split_oversized(df.filter("false"), ["id"]).count() == 0


def test_very_long(spark):
    df = spark.createDataFrame([("d", "word " * 200_000, 4000, 200)], "id string, text string, max_chars int, overlap_chars int")
    got = splitting.split_oversized(df, ["id"]).selectExpr("count(*) n", "max(length(piece)) m", "max(end) e").first()
    assert got.m <= 4000 and got.e == 1_000_000 and got.n >= 263


def test_limits(spark):
    limits = spark.createDataFrame([("c", "Para", 10, 1), ("c", "*", 5, 0), ("r", "*", 7, 2)], "item_field string, t string, max_chars int, overlap_chars int")
    from pyspark.sql import functions as F

    items = spark.createDataFrame([("Para",), ("Other",), (None,)], "t string")
    got = [(r.t, r.max_chars, r.overlap_chars) for r in splitting.with_limits(items, limits, "c", F.col("t")).collect()]
    assert got == [("Para", 10, 1), ("Other", 5, 0), (None, 5, 0)]
    assert splitting.with_limits(items, limits, "none").first().max_chars is None


def test_last_delivery_counts_whatever_its_length(spark):
    """An item last delivered short has no pieces; one last delivered long has those of its last text."""
    rows = [("a", "x" * 50, 1), ("a", "y", 2), ("b", "y", 1), ("b", "z" * 30, 2), ("c", "w" * 30, 1), ("c", None, 2)]
    df = spark.createDataFrame(rows, "k string, text string, at int").selectExpr("*", "10 AS max_chars", "2 AS overlap_chars")
    got = {r.k for r in splitting.split_oversized(df, ["k"], order="at").collect()}
    assert got == {"b"}
