"""Bounded summaries at every level of a document.

With a prefix as the summariser, the fold over a tree equals one ordered
aggregate over its leaves, so sections of any depth cost one shuffle. Other
summarisers go through the node fold of one document at a time.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.jsontext import Invalid, loads
from docloom.functions.text import filled, strip
from docloom.operators.models import ImageSummarizer, Prefix, Summarizer, image_path, image_prompt

#: Lengths from which a leaf and a final text are summarised.
LEAF_MIN, FINAL_MIN = 100, 300
#: Node types without a summary.
SILENT = ("Cite", "AlignDefault", "ColWidth")


def leaf(text: Column | str, size: int = FINAL_MIN) -> Column:
    """Short texts stripped, longer ones their prefix of ``size`` characters; an empty summary falls back to the text."""
    x = strip(text)
    return F.when(F.length(x) < size, x).otherwise(filled(F.rtrim(F.left(x, F.lit(size))), x))


def section_summaries(packed: DataFrame, key: str = "doc_id", size: int = FINAL_MIN) -> DataFrame:
    """The summary of every section: its own and its descendants' blocks in order, the first ``size`` characters.

    Each block counts for all headers on its path. No more than ``size``
    characters of a block can matter, so no more are shuffled.
    """
    text = F.left(F.trim(F.regexp_replace("c", r"\s+", " ")), F.lit(size))
    each = packed.filter(F.size("path") > 0).select(key, "pos", text.alias("x"), F.explode("path").alias("section")).filter("x <> ''")
    joined = each.groupBy(key, "section").agg(F.expr("listagg(x, ' ') within group (order by pos)").alias("x"))
    return joined.select(key, "section", F.rtrim(F.left("x", F.lit(size))).alias("summary"))


def document_summaries(documents: DataFrame, sections: DataFrame, key: str = "doc_id", size: int = FINAL_MIN) -> DataFrame:
    """Title and top-level summaries in order, as one leaf; empty where a document has no sections."""
    joined = sections.groupBy(key).agg(F.expr("listagg(summary, ' ') within group (order by section)").alias("x"))
    out = documents.select(key, "title").join(joined, key, "left")
    return out.select(key, F.when(F.col("x").isNull(), F.lit("")).otherwise(leaf(F.concat_ws(" ", "title", "x"), size)).alias("summary"))


class Fold:
    """The bottom-up fold over one tree, for any summariser.

    ``compat`` keeps an older form: the minimum length alone decides, texts are
    not stripped, and empty parts are kept when lists are joined.
    """

    def __init__(self, model: Summarizer, leaf_min: int = LEAF_MIN, min_len: int | None = FINAL_MIN, image: Callable[[dict], str] | None = None, compat: bool = False) -> None:
        self.model, self.image, self.compat = model, image, compat
        self.threshold = leaf_min if min_len is None else min_len

    def leaf(self, text: str) -> str:
        text = text if self.compat else text.strip()
        if len(text) < self.threshold:
            return text
        return self.model.summarize(text) or text

    def coerce(self, x: Any) -> str:
        if x is None:
            return ""
        if isinstance(x, (str, bool, int, float)):
            return self.leaf(str(x))
        if isinstance(x, dict):
            return x.get("s") or ""
        if isinstance(x, list):
            return self.list(x)
        raise ValueError(f"Unsupported value: {type(x).__name__}")

    def list(self, items: list) -> str:
        parts = [self.coerce(x) for x in items]
        return self.leaf(" ".join(parts if self.compat else [p for p in parts if p]))

    def node(self, x: dict) -> dict:
        """The object with ``s`` on it and on every object below; scalars in its lists become texts."""
        if "t" not in x:
            raise ValueError("Missing key: t")
        if x["t"] in SILENT:
            return x | {"s": ""}
        if x["t"] == "Image" and self.image is not None:
            return x | {"s": self.image(x)}
        out, parts = {}, []
        for k, v in x.items():
            if k in ("t", "s") or v is None or v == "" or v == []:
                out[k] = v
                continue
            if isinstance(v, list):
                v = [self._element(y) for y in v]
                parts.append(self.list(v))
            elif isinstance(v, dict):
                v = self.node(v) if "t" in v else v
                parts.append(v.get("s") or "")
            else:
                parts.append(self.leaf(str(v)))
            out[k] = v
        out["s"] = self.leaf(" ".join(p for p in parts if p))
        return out

    def _element(self, y: Any) -> Any:
        if isinstance(y, dict):
            return self.node(y)
        if isinstance(y, list):
            return [self._element(z) for z in y]
        return None if y is None else self.leaf(str(y))

    def document(self, root: dict, title: str | None = None, file_path: str | None = None) -> dict:
        blocks = [self.node(b) for b in root.get("blocks") or []]
        found = [b["s"] for b in blocks if b.get("s") is not None]
        summary = self.leaf(" ".join([title or "", *found])) if found else ""
        return root | {"blocks": blocks, "title": title, "file_path": file_path, "summary": summary}


def describe(model: ImageSummarizer, node: dict, file_path: str | None) -> str:
    """What the model says of an image node's file, whose path is taken from the folder of the document."""
    path = image_path(posixpath.dirname(file_path or ""), node)
    return model.describe(image_prompt(path), path)


def semantics(one: Fold, ast: str | None, title: str | None, path: str | None) -> tuple[str | None, str, str | None]:
    """(semantics_json, status, exception) of one AST; null is ``PENDING``, a broken one ``ERROR``."""
    try:
        root = loads(ast) if ast is not None else None
        done = None if root is None else json.dumps(one.document(root, title, path), ensure_ascii=False)
        return done, "COMPLETED" if done else "PENDING", None
    except (Invalid, ValueError, AttributeError, RecursionError) as e:
        return None, "ERROR", f"{type(e).__name__}: {e}"


def semantics_column(ast: Column | str, title: Column | str, path: Column | str, factory: Callable[[], Summarizer] = Prefix, min_len: int | None = FINAL_MIN, images: Callable[[], ImageSummarizer] | None = None) -> Column:
    """(semantics_json, status, exception) of each AST; null ASTs are ``PENDING``, broken ones ``ERROR``.

    With ``images``, each image node's summary is what the describer says of
    its file, beside the document's; without, it is folded like other nodes.
    """

    @F.pandas_udf("struct<semantics_json:string,status:string,exception:string>")
    def fold(asts: pd.Series, titles: pd.Series, paths: pd.Series) -> pd.DataFrame:
        one, out = Fold(factory(), min_len=min_len), []
        describer = images() if images is not None else None
        for x, t, p in zip(asts, titles, paths):
            one.image = None if describer is None else lambda node: describe(describer, node, p)  # noqa: B023
            out.append(semantics(one, x, t, p))
        return pd.DataFrame(out, columns=["semantics_json", "status", "exception"])

    return fold(ast, title, path)
