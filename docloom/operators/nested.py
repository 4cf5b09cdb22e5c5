"""Deeply nested JSON records turned into flat tables with parent-child links.

One depth-first pass per record emits tagged rows: the table tag, the primary
key, the parent key and a payload. The tagged stream is written once,
partitioned by tag, and each tag gets its schema when it is read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.jsontext import Invalid, loads
from docloom.runtime import latest

#: Node types that carry only running text.
TEXT_TYPES = ("Str", "Space", "SoftBreak", "LineBreak")

#: Tables by tag, with the schema of their payload.
TABLES = {
    "document": "version string, title string, summary string, n_keys int",
    "node": "key string, ord int, depth int, text string, scalar string",
    "inline": "key string, ord int, depth int, text string, scalar string",
    "field": "key string, value string",
}

ROW = "doc_id string, tag string, node_path string, parent_path string, t string, payload string"
_ARROW = pa.schema([(c, pa.string()) for c in ("doc_id", "tag", "node_path", "parent_path", "t", "payload")])

Emit = Callable[[str, str, str, "str | None", "str | None"], None]


def visit(root: object, emit: Emit, tags: frozenset[str], payload: bool) -> None:
    """Walk one parsed record depth first, in document order, without recursion."""
    nodes, inline, fields = "node" in tags, "inline" in tags, "field" in tags
    if "document" in tags:
        emit("document", "", "", None, _document(root) if payload else None)
    stack: list[tuple] = [(root, "", "", "", -1, 0)]
    while stack:
        value, path, parent, key, at, depth = stack.pop()
        if type(value) is dict:
            t = value.get("t")
            if type(t) is str:
                if t in TEXT_TYPES:
                    if inline:
                        emit("inline", path, parent, t, _node(value, key, at, depth) if payload else None)
                elif nodes:
                    emit("node", path, parent, t, _node(value, key, at, depth) if payload else None)
                if fields:
                    for k, v in value.items():
                        if k not in ("t", "c") and not isinstance(v, (dict, list)):
                            emit("field", f"{path}/{k}" if path else k, path, t, json.dumps({"key": k, "value": _scalar(v)}, ensure_ascii=False) if payload else None)
                parent = path
            entries = [(v, f"{path}/{k}" if path else k, parent, k, -1, depth + 1) for k, v in value.items() if type(v) is dict or type(v) is list]
        else:
            entries = []
            head = f"{path}/" if path else ""
            for i, v in enumerate(value):
                kind = type(v)
                if kind is dict:
                    if not inline and not fields and _plain(v):
                        continue
                    entries.append((v, f"{head}{i}", parent, key, i, depth + 1))
                elif kind is list:
                    entries.append((v, f"{head}{i}", parent, key, i, depth + 1))
        entries.reverse()
        stack += entries


def _plain(v: dict) -> bool:
    """Whether the object is a text leaf that holds nothing to descend into."""
    t, c = v.get("t"), v.get("c")
    return type(t) is str and t in TEXT_TYPES and type(c) is not dict and type(c) is not list and len(v) == 1 + ("c" in v)


def _scalar(v: object) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v)


def _node(value: dict, key: str, at: int, depth: int) -> str:
    c = value.get("c")
    text = None
    if isinstance(c, str):
        text = c
    elif isinstance(c, list):
        parts = [x["c"] if x["t"] == "Str" else " " for x in c if isinstance(x, dict) and x.get("t") in TEXT_TYPES and (x["t"] != "Str" or isinstance(x.get("c"), str))]
        text = "".join(parts) or None
    scalar = None if c is None or isinstance(c, (dict, list, str)) else json.dumps(c)
    return json.dumps({"key": key, "ord": at, "depth": depth, "text": text, "scalar": scalar}, ensure_ascii=False)


def _document(root: object) -> str:
    top = root if isinstance(root, dict) else {}
    version = top.get("pandoc-api-version")
    out = {"version": ".".join(map(str, version)) if isinstance(version, list) else None, "title": _scalar(top.get("title")) if not isinstance(top.get("title"), (dict, list)) else None}
    out |= {"summary": top["summary"] if isinstance(top.get("summary"), str) else None, "n_keys": len(top)}
    return json.dumps(out, ensure_ascii=False)


def _emitter(tags: frozenset[str], payload: bool, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _ARROW]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], schema=_ARROW)
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    root = loads(text.as_py())
                except Invalid:
                    continue
                if not isinstance(root, (dict, list)):
                    continue
                ids, kinds, paths, parents, ts, loads_ = out
                before = len(paths)

                def emit(tag: str, path: str, parent: str, t: str | None, body: str | None) -> None:
                    kinds.append(tag)
                    paths.append(path)
                    parents.append(parent)
                    ts.append(t)
                    loads_.append(body)

                visit(root, emit, tags, payload)
                ids += [doc] * (len(paths) - before)
                if len(paths) >= rows:
                    yield flush()
        if out[0]:
            yield flush()

    return run


def flatten(df: DataFrame, key: str = "doc_id", content: str = "ast_json", order: str | None = "ingested_at", tags: Iterable[str] = tuple(TABLES), payload: bool = True) -> DataFrame:
    """The tagged rows of every readable record: ``ROW``.

    ``node_path`` is the primary key within the record (keys and array
    positions from the root, joined by ``/``; the root itself is the empty
    path), ``parent_path`` the path of the nearest enclosing object with a
    string ``t``, or the empty string. Tag ``node`` holds typed objects,
    ``inline`` those of ``TEXT_TYPES``, ``field`` their scalar extras, and
    ``document`` one row per record.

    A record delivered more than once counts once, as delivered last. Null,
    blank and invalid JSON, and JSON whose root is a scalar, gives no rows, a
    null key gives rows with a null ``doc_id``, a repeated key within one object
    has its last value, an empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    kept = [c for c in dict.fromkeys([key, content, order]) if c and c in df.columns]
    once = latest(df.select(*[F.col(f"`{c}`") for c in kept]), [key], order if order in kept else None).filter(F.col(f"`{content}`").rlike(r"^\s*[\[{]"))
    wanted = frozenset(tags)
    if wanted - set(TABLES):
        raise ValueError(f"unknown tags: {sorted(wanted - set(TABLES))}")
    return once.select(F.col(f"`{key}`").cast("string"), F.col(f"`{content}`")).mapInArrow(_emitter(wanted, payload, 20_000), ROW)


def write_tables(tagged: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the tagged rows in one pass, one folder per table."""
    tagged.write.mode(mode).partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One of the tables written by ``write_tables``, under its own schema."""
    return typed(spark.read.parquet(path), tag)


def typed(tagged: DataFrame, tag: str) -> DataFrame:
    """The rows of one tag with the payload's fields as columns."""
    own = tagged.filter(F.col("tag") == tag).select("doc_id", "node_path", "parent_path", "t", F.from_json("payload", TABLES[tag]).alias("p"))
    return own.select("doc_id", "node_path", "parent_path", "t", "p.*")
