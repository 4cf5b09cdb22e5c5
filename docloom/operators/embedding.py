"""Content ids and vectors of documents and their nodes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.jsontext import Invalid, dumps, loads
from docloom.operators.models import Embedder, HashedWords, Prefix, Summarizer, embed_with_retry
from docloom.operators.summaries import Fold, semantics

#: Node types that are embedded.
EMBEDDABLE = ("Section", "Image", "Table")


def canonical(x: Any) -> str:
    """JSON with sorted keys, non-ASCII kept and ``;`` between key and value: the text that ids are made of."""
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ";"))


def content_id(prefix: str, x: Any) -> str:
    return hashlib.sha256((prefix + canonical(x)).encode()).hexdigest()


class TreeEmbedder:
    """Ids and vectors of one document, in post-order after the root.

    Every embedded node's id joins a history that goes into the ids of the
    nodes after it, so ids depend on what was embedded before them.
    """

    def __init__(self, embedder: Embedder, types: tuple[str, ...] = EMBEDDABLE, action: Callable[[dict], Any] | None = None) -> None:
        self.embedder, self.types, self.action = embedder, types, action
        self.records: list[tuple[str, dict, list[float], str]] = []
        self.history: list[str] = []

    def _record(self, x: dict, name: str, text: str | None) -> None:
        x["i"] = name
        if not text:
            return
        x["m"] = {"embed_model": self.embedder.model}
        vector = embed_with_retry(self.embedder, text)
        if vector is not None:
            self.records.append((name, x["m"], vector, text))

    def node(self, x: dict) -> None:
        if x.get("t") not in self.types:
            raise AssertionError(f"Unexpected type: {x.get('t')}")
        name = content_id(str(self.history), x)
        self.history.append(name)
        self._record(x, name, x.get("s"))

    def walk(self, x: Any) -> None:
        if self.action is not None and isinstance(x, dict):
            self.action(x)
        for y in list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else ():
            if isinstance(y, (dict, list)):
                self.walk(y)
        if isinstance(x, dict) and x.get("t") in self.types:
            self.node(x)

    def document(self, root: dict, file_path: str | None) -> dict:
        self._record(root, content_id(str(file_path), root), root.get("s") or root.get("summary"))
        for k, y in list(root.items()):
            if k not in ("i", "m") and isinstance(y, (dict, list)):
                self.walk(y)
        return root


RECORDS = "struct<embed_json:string,records:array<struct<id:string,metadata:map<string,string>,embedding:array<float>,document:string>>,status:string,exception:string>"


def embedded(model: Embedder, semantics: str | None, path: str | None) -> tuple[dict | None, list[tuple[str, dict, list[float], str]], str, str | None]:
    """(tree with its ids, records, status, exception) of one document; null semantics are ``PENDING``."""
    if semantics is None:
        return None, [], "PENDING", None
    try:
        one = TreeEmbedder(model)
        return one.document(loads(semantics), path), one.records, "COMPLETED", None
    except (Invalid, ValueError, AttributeError, RecursionError) as e:
        return None, [], "ERROR", f"{type(e).__name__}: {e}"


def embed_column(semantics: Column | str, path: Column | str, factory: Callable[[], Embedder] = HashedWords) -> Column:
    """(embed_json, records, status, exception) of each document; null semantics are ``PENDING``."""

    @F.pandas_udf(RECORDS)
    def embed(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        model, out = factory(), []
        for x, p in zip(texts, paths):
            root, records, status, exception = embedded(model, x, p)
            out.append((None if root is None else dumps(root), [{"id": i, "metadata": m, "embedding": v, "document": t} for i, m, v, t in records], status, exception))
        return pd.DataFrame(out, columns=["embed_json", "records", "status", "exception"])

    return embed(semantics, path)


#: Records that are handed on together.
TOGETHER = 1000


def folded_records(df: DataFrame, key: str = "doc_id", ast: str = "ast_json", title: str = "title", path: str = "file_path", summarizer: Callable[[], Summarizer] = Prefix, embedder: Callable[[], Embedder] = HashedWords) -> DataFrame:
    """key, at, id, metadata, embedding, document: the records of each AST after the summary fold, numbered in order.

    The records of ``semantics_column`` and ``embed_column`` one after the
    other, in one pass: summaries and embedded trees are held for one document
    at a time. A map over batches, since the optimizer repeats a column of
    Python for the filter that it adds below an explode. ASTs that are null or
    broken have no records.
    """
    rows = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{ast}`").alias("__ast"), F.col(f"`{title}`").alias("__title"), F.col(f"`{path}`").alias("__path"))
    kind = dict(rows.dtypes)["__key"]
    types = (pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.float32()), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, model = Fold(summarizer()), embedder()
        for batch in batches:
            keys, own, out = batch.column(0), [], []

            def flush() -> pa.RecordBatch:
                columns = [pa.array(x, t) for x, t in zip(zip(*out), types)]  # noqa: B023
                done = pa.RecordBatch.from_arrays([keys.take(pa.array(own, pa.int64())), *columns], names=[key, "at", "id", "metadata", "embedding", "document"])  # noqa: B023
                own.clear()  # noqa: B023
                out.clear()  # noqa: B023
                return done

            for i, (x, t, p) in enumerate(zip(batch.column(1), batch.column(2), batch.column(3))):
                t, p = t.as_py(), p.as_py()
                _, records, _, _ = embedded(model, semantics(fold, x.as_py(), t, p)[0], p)
                own += [i] * len(records)
                out += [(n, name, list(m.items()), v, text) for n, (name, m, v, text) in enumerate(records)]
                if len(out) >= TOGETHER:
                    yield flush()
            if out:
                yield flush()

    return rows.mapInArrow(run, f"`{key}` {kind}, at int, id string, metadata map<string,string>, embedding array<float>, document string")


def stable_id(*parts: Column | str) -> Column:
    """An id that depends on its own parts alone: null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256)


def hash_chain(items: Column) -> Column:
    """The hash over a list in which each item's hash holds those before it."""
    return F.aggregate(items, F.lit(""), lambda acc, x: F.sha2(F.concat(acc, x), 256))


def normalised(vector: Column | str) -> Column:
    """Null for a null or empty vector, else its numbers as doubles, null elements dropped."""
    v = F.col(vector) if isinstance(vector, str) else vector
    kept = F.transform(F.filter(v, lambda x: x.isNotNull()), lambda x: x.cast("double"))
    return F.when(F.size(kept) > 0, kept)


def add_vectors(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not stored yet; repeated keys once."""
    return new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
