"""Nested records against a plain recursive walk, and their edge cases."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions.jsontext import Invalid, _flat, loads
from docloom.operators import nested

SCHEMA = "doc_id string, ast_json string, ingested_at int"


def brute(root):
    """(node_path, parent_path, t) by recursion."""
    out = []

    def go(x, path, parent):
        if isinstance(x, dict):
            t = x.get("t")
            if isinstance(t, str):
                if t not in nested.TEXT_TYPES:
                    out.append(("/".join(path), parent, t))
                parent = "/".join(path)
            for k, v in x.items():
                go(v, [*path, k], parent)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                go(v, [*path, str(i)], parent)

    go(root, [], "")
    return sorted(out)


def found(spark, rows, **kw):
    got = nested.flatten(spark.createDataFrame(rows, SCHEMA), tags=["node"], payload=False, **kw).collect()
    return sorted((r.node_path, r.parent_path, r.t) for r in got)


TREE = {
    "t": "Top",
    "meta": {"title": {"t": "MetaInlines", "c": [{"t": "Str", "c": "x"}]}},
    "blocks": [{"t": "Para", "c": [{"t": "Str", "c": "a", "alt": {"t": "Note", "c": []}}, {"t": "Space"}, [[{"t": "Link", "c": {"t": "Deep"}}]]]}, {"t": 5, "c": {"t": "Under"}}, {"t": {"t": "AsKey"}}, {"t": "Space", "m": [{"t": "InSpace"}]}],
}


def test_matches_recursion(spark):
    assert found(spark, [("d", json.dumps(TREE), 1)]) == brute(TREE)


def test_every_tree_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/dom_documents.parquet")
    want = set()
    for r in df.select("doc_id", "ast_json").collect():
        try:
            want |= {(r.doc_id, *x) for x in brute(json.loads(r.ast_json))}
        except (TypeError, ValueError):
            pass
    got = nested.flatten(df, tags=["node"], payload=False).select("doc_id", "node_path", "parent_path", "t").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_edge_cases(spark):
    bad = [("n", None, 1), ("e", "", 1), ("b", "  ", 1), ("x", '{"t": "A"', 1), ("y", '{"t": NaN}', 1), ("s", '"text"', 1), ("c", '{"t":"A"} x', 1)]
    assert found(spark, bad) == []
    assert found(spark, []) == []
    assert found(spark, [(None, '{"t":"A"}', 1)]) == [("", "", "A")]
    twice = [("d", '{"t":"Old"}', 1), ("d", '{"t":"New"}', 2), ("d", '{"t":"New"}', 2)]
    assert found(spark, twice) == [("", "", "New")]
    deep = '{"c":[' * 30_000 + '{"t":"Bottom"}' + "]}" * 30_000
    assert [x[2] for x in found(spark, [("d", deep, 1)])] == ["Bottom"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([("d", '{"t":"A"}', 1, "x", "y")], SCHEMA + ", t string, node_path string")
    assert nested.flatten(df, tags=["node"], payload=False).count() == 1


def test_tables_round_trip(spark, tmp_path):
    rows = [("d", json.dumps(TREE | {"summary": "s", "pandoc-api-version": [1, 23]}), 1)]
    tagged = nested.flatten(spark.createDataFrame(rows, SCHEMA))
    nested.write_tables(tagged, str(tmp_path / "t"))
    doc = nested.read_table(spark, str(tmp_path / "t"), "document").first()
    assert (doc.version, doc.summary) == ("1.23", "s")
    nodes = nested.read_table(spark, str(tmp_path / "t"), "node")
    assert nodes.filter("t = 'Para'").first().text.startswith("a")
    keys = {r.node_path for r in nodes.collect()} | {r.node_path for r in nested.read_table(spark, str(tmp_path / "t"), "inline").collect()} | {""}
    assert {r.parent_path for r in nodes.collect()} <= keys
    with pytest.raises(ValueError):
        nested.flatten(tagged, content="payload", tags=["none"])


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=20)


@given(VALUES, st.booleans())
@settings(max_examples=150, deadline=None)
def test_flat_reader_agrees(value, ascii_only):
    text = json.dumps(value, ensure_ascii=ascii_only)
    assert loads(text) == value and _flat(text) == value


@given(st.text(alphabet='{}[]:,"ab1 ', max_size=12))
@settings(max_examples=400, deadline=None)
def test_flat_reader_refuses_alike(text):
    def outcome(f):
        try:
            return f(text)
        except Invalid:
            return Invalid

    assert outcome(_flat) == outcome(loads)
