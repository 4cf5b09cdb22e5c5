"""Text helpers with one meaning of white space: Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages that prompts exist in.
PROMPTS = {
    "en": ("Please provide a summary of the following string. The summary should be concise and informative: ", ". "),
    "zh": ("请提供以下字符串的摘要。摘要应简明扼要且信息丰富: ", ". "),
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def newlines(x: Column | str) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(_col(x), r"\r\n?", "\n")


def strip(x: Column | str) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def collapse(x: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(_col(x), r"(?U)\s+", " "))


def filled(x: Column | str, default: Column | str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(_col(x), F.lit("")), _col(default))


def stem(path: Column | str) -> Column:
    """The file's name without its last suffix."""
    name = F.regexp_extract(_col(path), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def parent(path: Column | str) -> Column:
    """The folder of a path; ``.`` for a bare name."""
    return F.when(_col(path).contains("/"), F.regexp_replace(_col(path), r"/[^/]*$", "")).otherwise(F.lit("."))


def normal_path(path: Column | str) -> Column:
    """A path without ``.`` and ``..`` parts, where they can be resolved."""
    parts = F.filter(F.split(_col(path), "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    joined = F.array_join(kept, "/")
    return F.when(_col(path).startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def spoken(x: Column, kind: str) -> Column:
    """A scalar as text; truth values as ``True`` and ``False``."""
    return F.initcap(x.cast("string")) if kind == "boolean" else x.cast("string")


def unbroken_base64(x: Column | str) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(_col(x)), r"\r?\n", "")


def data_uri(content: Column | str, path: Column | str) -> Column:
    """Image bytes as a data URI, typed by the file's suffix."""
    suffix = F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(suffix == "jpg", "jpeg").otherwise(suffix)
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), unbroken_base64(content))


def error_text(message: Column | str, node: Column | str | None = None, line: Column | str | None = None) -> Column:
    """Message, node and line, each on its own line; an absent line is ``unknown``."""
    parts = [_col(message)]
    if node is not None:
        parts.append(F.when(_col(node).isNotNull(), F.concat(F.lit("Node: "), _col(node))))
    parts.append(F.concat(F.lit("On line: "), F.coalesce(_col(line).cast("string") if line is not None else F.lit(None).cast("string"), F.lit("unknown"))))
    return F.concat_ws("\n", *parts)


def prompt(content: Column | str, lang: Column | str, collapse_all: bool = False) -> Column:
    """The summary prompt in the language of the text; an unknown language is an error.

    White space is collapsed for ``zh``, or for every language with ``collapse_all``.
    """
    text, lang = _col(content), _col(lang)
    out = F.raise_error(F.concat(F.lit("Unsupported language: "), F.coalesce(lang, F.lit("null"))))
    for name, (before, after) in PROMPTS.items():
        body = collapse(text) if collapse_all or name == "zh" else text
        out = F.when(lang == name, F.concat(F.lit(before), body, F.lit(after))).otherwise(out)
    return out


def kept_separators(text: Column | str, pattern: str) -> Column:
    """A split that keeps its separators: (separator before, piece), the first with a null separator."""
    pieces = F.split(_col(text), pattern)
    marks = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(_col(text), F.lit(f"({pattern})"), F.lit(1)))
    return F.zip_with(marks, pieces, lambda m, p: F.struct(m.alias("mark"), p.alias("piece")))
