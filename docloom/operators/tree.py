"""Functions over JSON trees: mapping, walking, packing and text of fragments.

They work on one parsed tree; ``map_column`` and ``reorganise_column`` apply
them to a column of JSON texts, a batch at a time. For queries over all nodes
use the flat tables of ``docloom.operators.nested``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.jsontext import Invalid, dumps, loads
from docloom.operators.sections import SENTENCE_ENDS, SLIDE, TOC_TITLE

Transform = Callable[[Any], Any]
_SPACES = ("Space", "SoftBreak", "LineBreak")
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def rebuild(root: Any, enter: Callable[[Any], Any], leave: Callable[[Any], None] | None = None, key_list: Callable[[list, str, dict], list | None] | None = None, element: Callable[[Any, str, list], Any] | None = None, packed: Callable[[list], list] | None = None) -> Any:
    """Build a tree anew, of any depth, without recursion.

    ``enter`` gives what stands for the root, an object, or a list inside a
    list, before its parts are visited; ``leave`` sees the same when they are
    done. A list directly under a key is not visited itself: ``key_list``
    chooses its elements (or None: as they are, without what follows),
    ``element`` places each finished one (with the key and what stands before
    it) and ``packed`` gives the finished list. Scalars are kept.
    """
    done: list = []
    stack: list[list] = []  # [made, parts, key of a key list, visited, place in the parent, what it is made of]

    def place(value: Any, at: Any) -> None:
        if not stack:
            done.append(value)
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][at] = value
        else:
            made, _, key = stack[-1][:3]
            made.append(element(value, key, made) if element and key is not None else value)

    def begin(x: Any, at: Any, visited: bool) -> None:
        x = enter(x) if visited else x
        if isinstance(x, dict):
            stack.append([{}, iter(list(x.items())), None, visited, at, x])
        elif isinstance(x, list):
            own = key_list(x, at, stack[-1][5]) if key_list and not visited else None if visited else x
            stack.append([[], iter([(None, y) for y in (x if own is None else own)]), None if own is None else at, visited, at, x])
        else:
            if visited and leave and not stack:
                leave(x)
            place(x, at)

    begin(root, None, True)
    while stack:
        made, parts, key, visited, at, _ = stack[-1]
        step = next(parts, None)
        if step is not None:
            k, child = step
            if isinstance(child, dict) or (isinstance(child, list) and isinstance(made, list)):
                begin(child, k, True)
            elif isinstance(child, list):
                begin(child, k, False)
            else:
                place(child, k)
            continue
        stack.pop()
        if key is not None and packed:
            made = packed(made)
        if visited and leave:
            leave(made)
        place(made, at)
    return done[0]


def map_tree(root: Any, transform: Transform, on_exit: Transform | None = None) -> Any:
    """Apply ``transform`` before descending, and ``on_exit`` after, to the root, to objects and to lists inside lists.

    A list directly under a key is not passed on itself, only its elements are.
    Scalars are kept, under a key as in a list.
    """
    return rebuild(root, transform, on_exit)


def walk(raw_json: str, action: Transform | None = None) -> str:
    """JSON in, every object and list visited, JSON out; ``action`` reaches every object."""
    act = action or (lambda x: x)
    return dumps(map_tree(loads(raw_json), lambda x: act(x) if isinstance(x, dict) else x))


def lines(raw_json: str) -> list[tuple[int, str, str | None]]:
    """(line, path, scalar as text) of every key and element, in document order; strings are stripped."""
    out: list[tuple[int, str, str | None]] = []
    scan = re.compile(r'"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*|true|false|null|[\[\]{}:,]|\n')
    line, stack, key, after_key = 1, [], None, False
    loads(raw_json)
    for m in scan.finditer(raw_json):
        x = m.group()
        if x == "\n":
            line += 1
        elif x in "{[":
            if stack:
                _step(stack, key)
                out.append((line, "/".join(str(s[1]) for s in stack), None))
            stack.append([x, -1 if x == "[" else None])
            key, after_key = None, False
        elif x in "}]":
            stack.pop()
            after_key = False
        elif x == ":":
            after_key = True
        elif x == ",":
            after_key = False
        elif stack and stack[-1][0] == "{" and not after_key:
            key = json.loads(x)
        else:
            if stack:
                _step(stack, key)
            value = json.loads(x)
            out.append((line, "/".join(str(s[1]) for s in stack), value.strip() if isinstance(value, str) else x))
            after_key = False
    return out


def _step(stack: list[list], key: str | None) -> None:
    stack[-1][1] = key if stack[-1][0] == "{" else stack[-1][1] + 1


def zip_trees(a: Any, b: Any) -> Iterator[tuple[Any, Any]]:
    """Pairs of the nodes at equal places of two trees, by order of keys and elements."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        yield x, y
        if isinstance(x, dict) and isinstance(y, dict):
            stack += reversed(list(zip(x.values(), y.values())))
        elif isinstance(x, list) and isinstance(y, list):
            stack += reversed(list(zip(x, y)))


def node_text(node: Any) -> str:
    """The text of a fragment: words as they are, breaks as blanks, the rest by its content."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            t = x.get("t")
            if t == "Str":
                out.append(x.get("c") or "")
            elif t in _SPACES:
                out.append(" ")
            else:
                stack.append(x.get("c"))
    return "".join(out)


def block_text(node: Any) -> str:
    return " ".join(node_text(node).split())


def section(level: int, title: str | None = None, header: dict | None = None) -> dict:
    """An empty section, with the given header or one made of a title."""
    head = header or {"t": "Header", "c": [level, ["", [], []], [{"t": "Str", "c": title or ""}]]}
    return {"t": "Section", "c": [head, {"t": "Content", "c": []}], "subnodes": []}


def _heading_item(x: Any) -> str | None:
    c = x.get("c") if isinstance(x, dict) and x.get("t") == "OrderedList" else None
    if not isinstance(c, list) or len(c) != 2 or c[0][0] != 1 or len(c[1]) != 1 or len(c[1][0]) != 1 or c[1][0][0].get("t") != "Plain":
        return None
    text = block_text(c[1][0][0])
    return text if text and text[-1] not in SENTENCE_ENDS else None


def _without_contents(items: list) -> list:
    out, open_run = [], False
    for x in items:
        text = block_text(x) if isinstance(x, dict) and x.get("t") == "Para" else None
        if text == TOC_TITLE:
            open_run = True
        elif open_run and text is not None and re.search(r"^.+\s+\d+$", text):
            continue
        else:
            open_run = False
            out.append(x)
    return out


def _level(x: dict) -> int:
    return int(x["c"][0]["c"][0])


def _as_section(x: Any, top: bool, before: list) -> Any:
    """A header as an empty section; so is the first heading item of the top list, if no section stands before it."""
    if isinstance(x, dict):
        if x.get("t") == "Header":
            return section(0, header=x)
        if top and not any(_is_section(y) for y in before) and (text := _heading_item(x)):
            return section(1, text)
    return x


def _is_section(x: Any) -> bool:
    return isinstance(x, dict) and x.get("t") == "Section"


def nest(items: list) -> list:
    """Siblings with each section holding what follows it up to the next section of its level or above.

    Sections that are there already count like those made of headers: they keep
    what they hold, and what follows is added.
    """
    out, chain = [], []
    for x in items:
        if _is_section(x):
            level = _level(x)
            x.setdefault("subnodes", [])
            while chain and chain[-1][0] >= level:
                chain.pop()
            (chain[-1][1]["subnodes"] if chain else out).append(x)
            chain.append((level, x))
        elif chain:
            content = chain[-1][1]["c"][1]
            if content.get("t") != "Content":
                raise Invalid("a section without content")
            content["c"].append(x)
        else:
            out.append(x)
    return out


def pack_section(own: dict, items: list) -> tuple[dict, list]:
    """(the section with the items that belong to it, the rest): up to the first section of its level or above."""
    if not _is_section(own):
        raise Invalid("no section")
    stop = next((i for i, x in enumerate(items) if _is_section(x) and _level(x) <= _level(own)), len(items))
    return nest([own, *items[:stop]])[0], items[stop:]


def pack_list(items: list, top: bool = False) -> tuple[list, list[int]]:
    """(items nested into sections, levels of the sections made of headers, in order) of one list of siblings."""
    made, levels = [], []
    for x in _without_contents(items) if top else items:
        y = _as_section(x, top, made)
        if y is not x:
            levels.append(_level(y))
        made.append(y)
    return nest(made), levels


def reorganise(root: Any, action: Transform | None = None) -> tuple[Any, list[int]]:
    """(tree whose lists under object keys are packed into sections, header levels in the order of the visit).

    ``action`` gives what stands for a node before its parts are visited. A
    section that is there already keeps its header and content apart, so what
    is packed stays as it is.
    """
    levels: list[int] = []

    def element(x: Any, key: str, before: list) -> Any:
        y = _as_section(x, key == "blocks", before)
        if y is not x:
            levels.append(_level(y))
        return y

    def chosen(v: list, key: str, owner: dict) -> list | None:
        return None if key == "c" and _is_section(owner) else _without_contents(v) if key == "blocks" else v

    out = rebuild(root, action or (lambda x: x), None, chosen, element, nest)
    return out, levels


def walk_sections(raw_json: str) -> str:
    """JSON in, lists packed into sections, JSON out."""
    return dumps(reorganise(loads(raw_json))[0])


def reorganise_slides(markdown: str, blocks: Callable[[str], list], base: dict | None = None) -> dict:
    """The AST of a slide deck: one flat level-1 section per slide, titled by its whole comment; other keys as in ``base``."""
    pieces = re.split(rf"({SLIDE})", markdown)
    if pieces[0].strip():
        raise ValueError("text before the first slide")
    out = []
    for mark, body in zip(pieces[1::2], pieces[2::2]):
        if not body.strip():
            raise ValueError("empty slide")
        mark = mark.strip()
        one = section(1, header={"t": "Header", "c": [1, [mark, [], []], [{"t": "Str", "c": mark}]]})
        one["c"][1]["c"] = blocks(body.strip())
        out.append(one)
    return (base or {}) | {"blocks": out}


#: What a row of broken content raises; any other error is the operator's own and ends the job.
BROKEN = (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError)


def _column(function: Callable[[str], str | None], text: Column | str) -> Column:
    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for x in texts:
                try:
                    out.append(None if x is None else function(x))
                except BROKEN:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return apply(text)


def map_column(text: Column | str, transform: Transform) -> Column:
    """``map_tree`` over a column of JSON; null for null and invalid JSON, and for trees that are no documents."""
    return _column(lambda x: dumps(map_tree(loads(x), transform)), text)


def reorganise_column(text: Column | str) -> Column:
    """``reorganise`` over a column of JSON; null for null and invalid JSON, and for trees that are no documents."""
    return _column(walk_sections, text)


def text_column(text: Column | str) -> Column:
    """The collapsed text of a JSON fragment or document."""

    def words(x: str) -> str:
        root = loads(x)
        return block_text(root.get("blocks") if isinstance(root, dict) and "blocks" in root else root)

    return _column(words, text)


def _counted(a: Any, b: Any) -> tuple[int, int]:
    """(pairs, alike): how many nodes stand at equal places of two trees, and how many of those are of one kind."""
    pairs = alike = 0
    for x, y in zip_trees(a, b):
        pairs += 1
        alike += type(x) is type(y)
    return pairs, alike


def zip_column(a: Column | str, b: Column | str) -> Column:
    """(pairs, alike): the nodes at equal places of two trees, and those of one kind; null where either is no JSON."""

    @F.pandas_udf("struct<pairs:long,alike:long>")
    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for xs, ys in batches:
            out: list[tuple[int | None, int | None]] = []
            for x, y in zip(xs, ys):
                try:
                    out.append(_counted(loads(x), loads(y)))
                except BROKEN:
                    out.append((None, None))
            yield pd.DataFrame(out, columns=["pairs", "alike"], dtype="Int64")

    z = both(a, b)
    return F.when(z["pairs"].isNotNull(), z)


def zip_mapped(df: DataFrame, transform: Transform, key: str = "doc_id", text: str = "ast_json") -> DataFrame:
    """key, pairs, alike of each readable tree beside what ``map_tree`` makes of it, as ``zip_column`` counts them.

    A map over batches, one tree at a time: only the counts leave Python, and
    the optimizer can't repeat it for a filter on its result.
    """
    rows = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    kind = dict(rows.dtypes)["__key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pairs, alike = [], [], []
            for i, x in enumerate(batch.column(1)):
                try:
                    x = x.as_py()
                    root = loads(x)
                    if _SURROGATE.search(x):
                        dumps(root).encode()  # a lone surrogate is no text, so this is no JSON
                    n, same = _counted(root, map_tree(loads(x), transform))  # parsed twice, since a transform may change what it gets
                except BROKEN:
                    continue
                at.append(i)
                pairs.append(n)
                alike.append(same)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(pairs, pa.int64()), pa.array(alike, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "pairs", "alike"])

    return rows.mapInArrow(run, f"`{key}` {kind}, pairs long, alike long")
