"""Markdown to blocks, to a Pandoc-style AST, and to HTML or LaTeX.

The subset: ATX headers, paragraphs, fenced code, block quotes, bullet and
ordered lists, pipe tables, images of their own, HTML comments and blocks;
inlines are words, emphasis, strong, code, links, images and notes. Scanning
is one pass over a document's lines, without a shuffle.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BLOCK = "array<struct<pos:int,t:string,level:int,c:string>>"

_HEADER = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_BULLET = re.compile(r"[ \t]*[-*+][ \t]+\S?")
_ORDERED = re.compile(r"[ \t]*\d+[.)][ \t]+\S?")
_IMAGE = re.compile(r"[ \t]*!\[[^\]]*\]\([^)]*\)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")


def _kind(line: str) -> str:
    if _FENCE.match(line):
        return "CodeBlock"
    if _HEADER.match(line):
        return "Header"
    head = line.lstrip(" \t")
    if head.startswith("<!--") or re.match(r"</?[A-Za-z][^>]*>", head):
        return "RawBlock"
    if head.startswith(">"):
        return "BlockQuote"
    if head.startswith("|"):
        return "Table"
    if _RULE.match(line):
        return "HorizontalRule"
    if _BULLET.match(line):
        return "BulletList"
    if _ORDERED.match(line):
        return "OrderedList"
    if _IMAGE.match(line):
        return "Image"
    return "Para"


def scan(text: str | None) -> list[tuple[int, str, int | None, str]]:
    """The top-level blocks of a text: (pos, type, header level, Markdown with LF ends)."""
    out: list[tuple[int, str, int | None, str]] = []
    if not text:
        return out
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    i, n = 0, len(lines)

    def add(kind: str, own: list[str], level: int | None = None) -> None:
        out.append((len(out), kind, level, "\n".join(own).strip("\n").rstrip()))

    while i < n:
        line = lines[i]
        if not line.strip(" \t　"):
            i += 1
            continue
        kind = _kind(line)
        j = i + 1
        if kind == "CodeBlock":
            fence = _FENCE.match(line).group(1)
            while j < n and not re.match(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", lines[j]):
                j += 1
            j = min(n, j + 1)
            add(kind, lines[i:j])
        elif kind == "Header":
            add(kind, [line], len(_HEADER.match(line).group(1)))
        elif kind in ("HorizontalRule", "Image"):
            add(kind, [line])
        elif kind == "RawBlock":
            if "<!--" in line:
                while j < n and "-->" not in "\n".join(lines[i:j]):
                    j += 1
            else:
                while j < n and lines[j].strip():
                    j += 1
            add(kind, lines[i:j])
        elif kind in ("BlockQuote", "Table"):
            while j < n and _kind(lines[j]) == kind and lines[j].strip():
                j += 1
            add(kind, lines[i:j])
        elif kind in ("BulletList", "OrderedList"):
            while j < n and lines[j].strip() and (_kind(lines[j]) == kind or lines[j][:1] in " \t" or _kind(lines[j]) == "Para"):
                j += 1
            add(kind, lines[i:j])
        else:
            while j < n and lines[j].strip(" \t　") and _kind(lines[j]) == "Para":
                j += 1
            add("Para", lines[i:j])
        i = j
    return out


def blocks_column(text: Column | str) -> Column:
    """The blocks of a Markdown column; an empty array for null, empty and blank texts."""

    @F.pandas_udf(BLOCK)
    def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([scan(x) for x in texts], dtype=object)

    return blocks(text)


def blocks(df: DataFrame, key: str = "doc_id", text: str = "raw_markdown") -> DataFrame:
    """One row per block: key, pos, t, level, c. Documents without text give no rows."""
    return df.select(F.col(key), F.explode(blocks_column(F.col(text))).alias("b")).select(key, "b.pos", "b.t", "b.level", "b.c")


# -- AST -------------------------------------------------------------------------------------------

_INLINE = re.compile(r"(`[^`]+`)|(!?)\[([^\]]*)\]\(([^)\s]*)(?:\s+\"([^\"]*)\")?\)|\*\*(.+?)\*\*|\*([^*\s][^*]*?)\*|\^\[([^\]]*)\]|(\s+)|([^\s`!\[*^]+|.)", re.S)


def inlines(text: str) -> list[dict]:
    """Inline nodes of a text."""
    out: list[dict] = []
    for m in _INLINE.finditer(text):
        code, bang, label, url, title, strong, emph, note, space, word = m.groups()
        if code:
            out.append({"t": "Code", "c": [["", [], []], code[1:-1]]})
        elif url is not None:
            out.append({"t": "Image" if bang else "Link", "c": [["", [], []], inlines(label), [url, title or ""]]})
        elif strong:
            out.append({"t": "Strong", "c": inlines(strong)})
        elif emph:
            out.append({"t": "Emph", "c": inlines(emph)})
        elif note is not None:
            out.append({"t": "Note", "c": [{"t": "Para", "c": inlines(note)}]})
        elif space:
            out.append({"t": "SoftBreak" if "\n" in space else "Space"})
        elif out and out[-1]["t"] == "Str":
            out[-1]["c"] += word
        else:
            out.append({"t": "Str", "c": word})
    return out


def _items(text: str, mark: re.Pattern) -> list[list[dict]]:
    items: list[list[str]] = []
    for line in text.split("\n"):
        if mark.match(line) or not items:
            items.append([re.sub(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", "", line)])
        else:
            items[-1].append(line.strip())
    return [[{"t": "Plain", "c": inlines("\n".join(x))}] for x in items]


def _slug(text: str) -> str:
    return re.sub(r"[^\w.-]+", "-", re.sub(r"^[^^\W\d_]+", "", text.strip().lower())).strip("-")


def node(kind: str, level: int | None, text: str) -> dict:
    """The AST node of one block."""
    if kind == "Header":
        title = _HEADER.match(text).group(2) or ""
        return {"t": "Header", "c": [level, [_slug(title), [], []], inlines(title)]}
    if kind == "CodeBlock":
        first, _, rest = text.partition("\n")
        body = re.sub(r"\n? {0,3}(`{3,}|~{3,})[ \t]*$", "", rest)
        lang = first.strip().lstrip("`~").strip()
        return {"t": "CodeBlock", "c": [["", [lang] if lang else [], []], body]}
    if kind == "BlockQuote":
        inner = "\n".join(re.sub(r"^ {0,3}>+[ \t]?", "", x) for x in text.split("\n"))
        return {"t": "BlockQuote", "c": [{"t": "Para", "c": inlines(inner)}]}
    if kind == "BulletList":
        return {"t": "BulletList", "c": _items(text, _BULLET)}
    if kind == "OrderedList":
        start = int(re.match(r"[ \t]*(\d+)", text).group(1))
        return {"t": "OrderedList", "c": [[start, {"t": "Decimal"}, {"t": "Period"}], _items(text, _ORDERED)]}
    if kind == "Table":
        rows = [[inlines(cell.strip()) for cell in re.split(r"(?<!\\)\|", x.strip().strip("|"))] for x in text.split("\n")]
        ruled = len(rows) > 1 and re.fullmatch(r"[ \t|:-]+", text.split("\n")[1])
        body = rows[2:] if ruled else rows
        row = lambda cells: [["", [], []], [[["", [], []], {"t": "AlignDefault"}, 1, 1, [{"t": "Plain", "c": x}]] for x in cells]]
        spec = [[{"t": "AlignDefault"}, {"t": "ColWidthDefault"}] for _ in rows[0]]
        return {"t": "Table", "c": [["", [], []], [None, []], spec, [["", [], []], [row(rows[0])] if ruled else []], [[["", [], []], 0, [], [row(x) for x in body]]], [["", [], []], []]]}
    if kind == "RawBlock":
        return {"t": "RawBlock", "c": ["html", text]}
    if kind == "HorizontalRule":
        return {"t": "HorizontalRule"}
    return {"t": "Para", "c": inlines(text)}


VERSION = [1, 23, 1]


def to_ast(text: str | None) -> str | None:
    """The AST of a text as JSON; null for null and empty texts."""
    if not text:
        return None
    return json.dumps({"pandoc-api-version": VERSION, "meta": {}, "blocks": [node(t, level, c) for _, t, level, c in scan(text)]}, ensure_ascii=False)


# -- rendering -------------------------------------------------------------------------------------


def _tex(text: str) -> str:
    table = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {ch: f"\\{ch}" for ch in "#$%&_{}"}
    return "".join(table.get(ch, ch) for ch in text)


def _render(nodes: list, tex: bool) -> str:
    return "".join(_one(x, tex) for x in nodes if isinstance(x, dict))


def _one(x: dict, tex: bool) -> str:
    t, c = x["t"], x.get("c")
    esc: Callable[[str], str] = _tex if tex else html.escape
    pick = lambda a, b: b if tex else a
    if t == "Str":
        return esc(c)
    if t in ("Space", "SoftBreak"):
        return " " if t == "Space" else "\n"
    if t in ("Para", "Plain"):
        body = _render(c, tex)
        return body if t == "Plain" else pick(f"<p>{body}</p>\n", f"{body}\n\n")
    if t == "Header":
        body = _render(c[2], tex)
        return pick(f'<h{c[0]} id="{html.escape(c[1][0])}">{body}</h{c[0]}>\n', f"\\{'sub' * min(2, c[0] - 1)}section{{{body}}}\n")
    if t in ("Strong", "Emph"):
        tag, command = ("strong", "textbf") if t == "Strong" else ("em", "emph")
        return pick(f"<{tag}>{_render(c, tex)}</{tag}>", f"\\{command}{{{_render(c, tex)}}}")
    if t == "Code":
        return pick(f"<code>{esc(c[1])}</code>", f"\\texttt{{{esc(c[1])}}}")
    if t == "CodeBlock":
        return pick(f"<pre><code>{esc(c[1])}</code></pre>\n", f"\\begin{{verbatim}}\n{c[1]}\n\\end{{verbatim}}\n")
    if t == "Link":
        return pick(f'<a href="{html.escape(c[2][0])}">{_render(c[1], tex)}</a>', f"\\href{{{_tex(c[2][0])}}}{{{_render(c[1], tex)}}}")
    if t == "Image":
        return pick(f'<img src="{html.escape(c[2][0])}" alt="{html.escape(_render(c[1], False))}" />', f"\\includegraphics{{{c[2][0]}}}")
    if t == "Note":
        return pick(f"<span>{_render(c, tex)}</span>", f"\\footnote{{{_render(c, tex).strip()}}}")
    if t == "BlockQuote":
        return pick(f"<blockquote>\n{_render(c, tex)}</blockquote>\n", f"\\begin{{quote}}\n{_render(c, tex)}\\end{{quote}}\n")
    if t in ("BulletList", "OrderedList"):
        items = c if t == "BulletList" else c[1]
        tag, name = ("ul", "itemize") if t == "BulletList" else ("ol", "enumerate")
        body = "".join(pick(f"<li>{_render(i, tex)}</li>\n", f"\\item {_render(i, tex)}\n") for i in items)
        start = f' start="{c[0][0]}"' if t == "OrderedList" and c[0][0] != 1 else ""
        return pick(f"<{tag}{start}>\n{body}</{tag}>\n", f"\\begin{{{name}}}\n{body}\\end{{{name}}}\n")
    if t == "Table":
        head = [(True, r) for r in c[3][1]]
        rows = head + [(False, r) for b in c[4] for r in b[3]]
        if tex:
            lines = [" & ".join(_render(cell[4], True) for cell in r[1]) + r" \\" for _, r in rows]
            return f"\\begin{{tabular}}{{{'l' * len(c[2])}}}\n" + "\n".join(lines) + "\n\\end{tabular}\n"
        cells = lambda first, r: "".join(f"<{'th' if first else 'td'}>{_render(x[4], False)}</{'th' if first else 'td'}>" for x in r[1])
        return "<table>\n" + "".join(f"<tr>{cells(first, r)}</tr>\n" for first, r in rows) + "</table>\n"
    if t == "RawBlock":
        return pick(c[1] + "\n", "") if c[0] == "html" else ""
    if t == "HorizontalRule":
        return pick("<hr />\n", "\\hrule\n")
    return _render(c, tex) if isinstance(c, list) else ""


def render(text: str | None, target: str) -> str | None:
    """A Markdown text as ``html`` or ``latex``; null for null and empty texts."""
    if not text:
        return None
    if target not in ("html", "latex"):
        raise ValueError(f"Unsupported target: {target}")
    return _render([node(t, level, c) for _, t, level, c in scan(text)], target == "latex")


def text_column(function: Callable[[str | None], str | None], text: Column | str) -> Column:
    """A string function of one text as a vectorised column."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([function(x) for x in texts], dtype=object)

    return apply(text)


def ast_column(text: Column | str) -> Column:
    return text_column(to_ast, text)


def render_column(text: Column | str, target: str) -> Column:
    return text_column(lambda x: render(x, target), text)
