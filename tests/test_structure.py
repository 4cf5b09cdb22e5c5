"""Blocks, contents tables, packing, slides and trees."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import markdown, sections, tree

BLOCK = "doc_id string, pos int, t string, level int, c string"


def test_blocks():
    md = "# Head\r\npara one\nmore\n\n- a\n- b\n\n1. x\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```py\n# no header\n\nx\n```\n\n> quote\n\n![i](a.png)\n<!-- c -->\n"
    assert [(t, lv) for _, t, lv, _ in markdown.scan(md)] == [("Header", 1), ("Para", None), ("BulletList", None), ("OrderedList", None), ("Table", None), ("CodeBlock", None), ("BlockQuote", None), ("Image", None), ("RawBlock", None)]
    assert markdown.scan(None) == [] and markdown.scan(" \n　\n") == []


def test_ast_and_rendering():
    md = "# T *e* **s**\n\nA `c` [l](u) ![p](q.png \"t\")\n\n3. x\n4. y\n\n| a |\n| --- |\n| <b> |\n\n```\ncode\n```"
    ast = json.loads(markdown.to_ast(md))
    assert [b["t"] for b in ast["blocks"]] == ["Header", "Para", "OrderedList", "Table", "CodeBlock"]
    assert ast["blocks"][2]["c"][0][0] == 3 and ast["blocks"][0]["c"][0] == 1
    out = markdown.render(md, "html")
    assert "<em>e</em>" in out and '<ol start="3">' in out and "&lt;b&gt;" in out and '<img src="q.png"' in out
    assert "\\section{" in markdown.render(md, "latex") and markdown.render(None, "html") is None and markdown.render("", "latex") is None
    with pytest.raises(ValueError):
        markdown.render("x", "pdf")


def _stack(levels):
    """(owner, parent, path) by a stack."""
    out, chain = [], []
    for pos, level in enumerate(levels):
        parent = None
        if level is not None:
            while chain and chain[-1][0] >= level:
                chain.pop()
            parent = chain[-1][1] if chain else None
            chain.append((level, pos))
        out.append((chain[-1][1] if chain else None, parent, [p for _, p in chain]))
    return out


def test_packing_matches_a_stack(spark):
    rng = random.Random(3)
    docs = {f"d{i}": [rng.choice([None, None, 1, 2, 3, 4, 6]) for _ in range(rng.randint(0, 25))] for i in range(60)}
    rows = [(d, p, "Para" if lv is None else "Header", lv, "x") for d, levels in docs.items() for p, lv in enumerate(levels)]
    got = {(r.doc_id, r.pos): (r.owner, r.parent, list(r.path)) for r in sections.pack(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {(d, p): x for d, levels in docs.items() for p, x in enumerate(_stack(levels))}


def test_contents_table(spark):
    rows = ["目 录", "目录", "A 1", "B　2", "text", "C 3", "目录", "目录", "D 4"]
    df = spark.createDataFrame([("d", i, "Para", None, c) for i, c in enumerate(rows)], BLOCK)
    assert [r.pos for r in sections.drop_contents(df).orderBy("pos").collect()] == [0, 4, 5]


@pytest.mark.parametrize(("item", "taken"), [("1. Intro", True), ("1. Ends。", False), ("2. Later", False), ("1. a\n2. b", False), ("1) Other", True), ("1. x:", False)])
def test_heading_list(spark, item, taken):
    df = spark.createDataFrame([("d", 0, "Para", None, "p"), ("d", 1, "OrderedList", None, item), ("d", 2, "OrderedList", None, "1. Second"), ("d", 3, "Header", 2, "## H")], BLOCK)
    heads = [r.pos for r in sections.promote_heading(df).filter("t = 'Header'").orderBy("pos").collect()]
    assert heads == ([1, 3] if taken else [2, 3])


def test_slides(spark):
    rows = [("ok", "<!-- Slide number: 1 -->\r\nA\r\n<!-- Slide number: 2 -->\r\nB"), ("lead", "x\n<!-- Slide number: 1 -->\nA"), ("empty", "<!-- Slide number: 1 -->\n\n<!-- Slide number: 2 -->\nB"), ("no", "text"), ("null", None)]
    got = {(r.doc_id, r.slide): (r.title, r.status) for r in sections.split_slides(spark.createDataFrame(rows, "doc_id string, raw_markdown string")).collect()}
    assert got[("ok", 0)] == ("<!-- Slide number: 1 -->", "REORGNIZED") and got[("ok", 1)][1] == "REORGNIZED"
    assert got[("lead", -1)][1] == "ERROR" and got[("empty", 0)][1] == "ERROR"
    assert {d for d, _ in got} == {"ok", "lead", "empty"}


def _h(level, name="h"):
    return {"t": "Header", "c": [level, ["", [], []], [{"t": "Str", "c": name}]]}


def _p(x="p"):
    return {"t": "Para", "c": [{"t": "Str", "c": x}]}


def test_pack_document():
    out, levels = tree.pack_list([_h(1), _p(), _h(2), _p(), _h(1), _p()], top=True)
    assert levels == [1, 2, 1] and len(out) == 2 and len(out[0]["subnodes"]) == 1
    assert len(out[0]["c"][1]["c"]) == 1


def test_reorganise_scopes():
    root = {"blocks": [_p("目录"), _p("A 1"), _h(1), {"t": "BulletList", "c": [[_h(2), _p()]]}], "meta": {"x": [_h(3), _p()]}}
    out, levels = tree.reorganise(root)
    assert sorted(levels) == [1, 3] and [b["t"] for b in out["blocks"]] == ["Section"]
    assert out["blocks"][0]["c"][1]["c"][0]["c"][0][0]["t"] == "Header"  # lists in lists stay
    assert out["meta"]["x"][0]["t"] == "Section"


def test_slide_tree():
    deck = tree.reorganise_slides("<!-- Slide number: 1 -->\n# A\n<!-- Slide number: 2 -->\nB", lambda b: [markdown.node(t, lv, c) for _, t, lv, c in markdown.scan(b)])
    assert [s["c"][0]["c"][2][0]["c"] for s in deck["blocks"]] == ["<!-- Slide number: 1 -->", "<!-- Slide number: 2 -->"]
    assert deck["blocks"][0]["c"][1]["c"][0]["t"] == "Header"
    for bad in ("x\n<!-- Slide number: 1 -->\nA", "<!-- Slide number: 1 -->\n"):
        with pytest.raises(ValueError):
            tree.reorganise_slides(bad, lambda b: [])


def test_map_tree():
    seen, left = [], []
    tree.map_tree({"a": [{"b": 1}, [2, {"c": 3}]], "d": {"e": 4}}, lambda x: seen.append(x) or x, left.append)
    assert [x for x in seen if isinstance(x, list)] == [[2, {"c": 3}]]
    assert sum(isinstance(x, dict) for x in left) == 4 and sum(isinstance(x, list) for x in left) == 1
    assert json.loads(tree.walk('[{"a":1},{"b":[{}]}]', lambda x: x | {"m": 1})) == [{"a": 1, "m": 1}, {"b": [{"m": 1}], "m": 1}]


def _s(level, name="s"):
    return {"t": "Section", "c": [_h(level, name), {"t": "Content", "c": []}]}


def test_sections_that_are_there_already_are_packed():
    own, rest = tree.pack_section(_s(1, "top"), [_p("x"), _s(2), _p("y"), _s(1, "next"), _p("z")])
    assert [b["c"][0]["c"] for b in own["c"][1]["c"]] == ["x"] and len(own["subnodes"]) == 1
    assert own["subnodes"][0]["c"][1]["c"][0]["c"][0]["c"] == "y"
    assert rest[0]["c"][0]["c"][2][0]["c"] == "next" and len(rest) == 2
    with pytest.raises(ValueError):
        tree.pack_section(_p(), [])
    out, levels = tree.reorganise({"blocks": [_p(), _s(1), _h(2), _p("in"), _s(1)]})
    assert levels == [2] and [b["t"] for b in out["blocks"]] == ["Para", "Section", "Section"]
    assert out["blocks"][1]["subnodes"][0]["c"][1]["c"][0]["c"][0]["c"] == "in"


def test_scalars_under_keys_are_kept():
    got = tree.map_tree({"n": 1, "m": {"o": None}, "l": [3, ["x"]]}, lambda x: "never" if not isinstance(x, (dict, list)) else x)
    assert got == {"n": 1, "m": {"o": None}, "l": [3, ["x"]]}


def test_action_comes_before_the_parts_and_levels_in_order():
    root = {"blocks": [_h(1), {"t": "Quote", "c": [_h(2)]}, _h(3)]}
    seen = []
    _, levels = tree.reorganise(root, lambda x: seen.append(x.get("t") if isinstance(x, dict) else "list") or x)
    assert levels == [1, 2, 3] and seen[0] is None and seen.index("Quote") < len(seen) - 1
    replaced, _ = tree.reorganise({"a": {"drop": [1]}}, lambda x: {"kept": []} if isinstance(x, dict) and "drop" in x else x)
    assert replaced == {"a": {"kept": []}}


def test_any_depth_and_broken_headers(spark):
    deep = '{"blocks":[' + '{"t":"Quote","c":[' * 4000 + '{"t":"Null"}' + "]}" * 4000 + "]}"
    broken = '{"blocks":[{"t":"Header","c":null},{"t":"Header"},{"t":"Section"}]}'
    df = spark.createDataFrame([(1, deep), (2, broken), (3, "{"), (4, None), (5, '{"blocks":[{"t":"Para","c":[]}]}')], "k int, x string")
    got = {r.k: (r.a, r.b) for r in df.select("k", tree.reorganise_column("x").alias("a"), tree.map_column("x", lambda x: x).alias("b")).collect()}
    assert got[1][0].count("Quote") == 4000 and got[1][1].replace(" ", "") == deep
    assert got[2][0] is None and got[3] == (None, None) and got[4] == (None, None)
    assert json.loads(got[5][0]) == {"blocks": [{"t": "Para", "c": []}]}


def test_lines_text_and_zip():
    assert tree.lines('{\n "a": " x ",\n "b": [1,\n  true]\n}') == [(2, "a", "x"), (3, "b", None), (3, "b/0", "1"), (4, "b/1", "true")]
    assert tree.block_text({"t": "Para", "c": [{"t": "Str", "c": "a"}, {"t": "SoftBreak"}, {"t": "Emph", "c": [{"t": "Str", "c": "b"}]}]}) == "a b"
    assert len(list(tree.zip_trees({"a": [1, 2]}, {"b": [3, 4]}))) == 4


def test_text_columns(spark):
    df = spark.createDataFrame([(" a　\n b ", "/x/./y/../z.tar.md", ""), (None, "n.md", "v")], "t string, p string, e string")
    r = df.select(text.collapse("t").alias("c"), text.stem("p").alias("s"), text.parent("p").alias("d"), text.normal_path("p").alias("n"), text.filled("e", F.lit("def")).alias("f")).collect()
    assert tuple(r[0]) == ("a b", "z.tar", "/x/./y/..", "/x/z.tar.md", "def") and tuple(r[1]) == (None, "n", ".", "n.md", "v")
    parts = df.select(text.kept_separators(F.lit("a<1>b<2>c"), r"<\d>").alias("k")).first().k
    assert [(x.mark, x.piece) for x in parts] == [(None, "a"), ("<1>", "b"), ("<2>", "c")]
    with pytest.raises(Exception, match="Unsupported language"):
        spark.range(1).select(text.prompt(F.lit("x"), F.lit("jp"))).collect()
    assert spark.range(1).select(text.error_text(F.lit("m"), F.lit("n")).alias("e")).first().e == "m\nNode: n\nOn line: unknown"
    assert "\n" not in spark.range(1).select(text.unbroken_base64(F.lit(b"x" * 200)).alias("b")).first().b


def test_zip_mapped_runs_once(spark, sf):
    """One pass of Python for the map and the pairs, with the counts that the two columns give one after the other, and SQL's where these failed."""
    import duckdb

    from docloom.plans.catalogue import ORACLE, QUERIES

    plan = QUERIES["positional_zip"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan

    def measured(x):
        return x | {"n": len(x)} if isinstance(x, dict) else x

    def dropped(x):
        if isinstance(x, dict):
            x.pop("c", None)
        return x

    deep = '{"a":' + '[{"t":"Quote","c":' * 3000 + "null" + "}]" * 3000 + "}"
    texts = ['{"blocks":[{"t":"Para","c":["x",1,null]},[[]]]}', '{"n":{"a":1}}', '{"a":{"c":[1,2]},"b":[{"c":1,"d":2}]}', "7", "[]", None, "", "{", '{"a":NaN}', deep]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "`the key` long, x string")
    for transform in (measured, dropped):
        got = {r[0]: (r.pairs, r.alike) for r in tree.zip_mapped(df, transform, "the key", "x").collect()}
        both = df.select("the key", tree.zip_column("x", tree.map_column("x", transform)).alias("z")).filter("z is not null")
        assert got == {r[0]: (r.z.pairs, r.z.alike) for r in both.collect()} and set(got) == {0, 1, 2, 3, 4, 9}
    odd = ['{"a":[1e999]}', '{"a":"\\ud83d"}', '{"\\uDE00":1}', '{"a":["\\uD83D\\uDE00","\\\\ud83d"]}', '{"a":1}', "{"]  # the mapped text was refused, or ended the job
    con = duckdb.connect()
    con.execute("CREATE TABLE dom_documents (doc_id VARCHAR, ast_json VARCHAR)")
    con.executemany("INSERT INTO dom_documents VALUES (?, ?)", [(str(k), x) for k, x in enumerate(odd)])
    want = sorted(con.sql(ORACLE["positional_zip"]).fetchall())
    assert sorted(map(tuple, tree.zip_mapped(spark.createDataFrame([(str(k), x) for k, x in enumerate(odd)], "doc_id string, ast_json string"), measured).collect())) == want and len(want) == 3
