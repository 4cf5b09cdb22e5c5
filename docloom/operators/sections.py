"""Sections from flat blocks: contents tables, heading lists, nesting and slides.

Everything is a window over the blocks of one document in order; no document
is walked recursively and none is collected. Levels are 1 to 6, so the chain of
a block's ancestors follows from six running maxima in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import collapse
from docloom.runtime import latest

#: The title of a contents table, and what one of its entries looks like.
TOC_TITLE = "目录"
TOC_ENTRY = r"(?Ud)^.+\s+\d+$"
#: Ends of an ordered-list item that make it a sentence, not a heading.
SENTENCE_ENDS = "。！？；:"
#: Fixed value: the comment that opens a slide.
SLIDE = r"<!--\s*Slide number:\s*\d+\s*-->"

LEVELS = range(1, 7)


def distinct_blocks(df: DataFrame) -> DataFrame:
    """Blocks delivered more than once count once, as delivered last.

    The one shuffle is by document, which serves the windows that follow too.
    """
    own = df.select("doc_id", "pos", "t", "level", "c", "ingested_at").repartition("doc_id")
    return latest(own, ["doc_id", "pos"], "ingested_at").drop("ingested_at")


def _before(key: str) -> object:
    return Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def drop_contents(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Without contents tables: each title and the unbroken run of entries after it.

    The rule of a sequential scan in closed form: an entry goes if, before it,
    the last title comes after the last block that is neither.
    """
    para = F.col("t") == "Para"
    title = F.coalesce(para & (collapse("c") == TOC_TITLE), F.lit(False))
    entry = F.coalesce(para & collapse("c").rlike(TOC_ENTRY), F.lit(False))
    w = _before(key)
    marked = blocks.withColumns({"__title": title, "__entry": entry & ~title})
    marked = marked.withColumns({"__lt": F.max(F.when(F.col("__title"), F.col("pos"))).over(w), "__lb": F.max(F.when(~F.col("__title") & ~F.col("__entry"), F.col("pos"))).over(w)})
    gone = F.col("__title") | (F.col("__entry") & F.coalesce(F.col("__lt") > F.coalesce("__lb", F.lit(-1)), F.lit(False)))
    return marked.filter(~gone).drop("__title", "__entry", "__lt", "__lb")


def is_heading_item(c: Column) -> Column:
    """Whether an ordered list has one item, numbered 1, that reads like a heading."""
    body = F.regexp_extract(c, r"(?s)^\s*1[.)]\s+(.*)$", 1)
    return (body != "") & ~body.contains("\n") & ~body.rlike(f"[{SENTENCE_ENDS}]\\s*$")


def promote_heading(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first heading-like ordered list before any header becomes a level-1 header."""
    whole = Window.partitionBy(key)
    able = (F.col("t") == "OrderedList") & is_heading_item(F.col("c"))
    marked = blocks.withColumns({"__first": F.min(F.when(able, F.col("pos"))).over(whole), "__header": F.min(F.when(F.col("t") == "Header", F.col("pos"))).over(whole)})
    chosen = (F.col("pos") == F.col("__first")) & (F.col("__header").isNull() | (F.col("pos") < F.col("__header")))
    chosen = F.coalesce(chosen, F.lit(False))
    return marked.withColumns({"level": F.when(chosen, 1).otherwise(F.col("level")), "t": F.when(chosen, "Header").otherwise(F.col("t")), "c": F.when(chosen, F.regexp_extract("c", r"(?s)^\s*1[.)]\s+(.*)$", 1)).otherwise(F.col("c"))}).drop("__first", "__header")


def pack(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each block with ``owner`` (position of its section's header), ``path`` (headers from the top to the owner) and, for headers, ``parent``.

    A section takes what follows until the next header; a deeper header nests,
    one of the same or a smaller level closes. Blocks before the first header
    have a null owner and an empty path.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"__m{k}": F.max(F.when(F.col("level") == k, F.col("pos"))).over(w) for k in LEVELS}
    marked = blocks.withColumns(last)
    chain = F.array()
    newest: Column = F.lit(None).cast("int")
    parts = []
    for k in LEVELS:
        m = F.col(f"__m{k}")
        parts.append(F.when(m.isNotNull() & (newest.isNull() | (m > newest)), m))
        newest = F.greatest(newest, m)
    chain = F.filter(F.array(*parts), lambda x: x.isNotNull())
    out = marked.withColumn("path", chain).drop(*last)
    return out.withColumns({"owner": F.when(F.size("path") > 0, F.element_at("path", -1)), "parent": F.when((F.col("level").isNotNull()) & (F.size("path") > 1), F.element_at("path", -2))})


def title_of(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"^\s{0,3}#{1,6}\s*", ""))


def section_table(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per section: key, pos, level, parent, depth, title, n_blocks, n_children and content (its own blocks, joined by a blank)."""
    heads = packed.filter("level is not null").select(key, F.col("pos").alias("section"), "level", "parent", F.size("path").alias("depth"), title_of(F.col("c")).alias("title"))
    own = packed.filter("level is null and owner is not null").groupBy(key, F.col("owner").alias("section")).agg(F.count("*").alias("n_blocks"), F.expr("listagg(c, ' ') within group (order by pos)").alias("content"))
    children = heads.filter("parent is not null").groupBy(key, F.col("parent").alias("section")).agg(F.count("*").alias("n_children"))
    out = heads.join(own, [key, "section"], "left").join(children, [key, "section"], "left")
    return out.fillna(0, ["n_blocks", "n_children"])


def is_deck(text: Column) -> Column:
    """Whether a text is a slide deck, whatever the case of its markers."""
    return F.coalesce(text.rlike(rf"(?im)^{SLIDE}[ \t]*\r?$"), F.lit(False))


def split_slides(df: DataFrame, key: str = "doc_id", text: str = "raw_markdown") -> DataFrame:
    """One row per slide of every deck: key, slide (from 0), title (the whole comment), body, status, exception.

    Text before the first marker, a marker in another case and an empty slide
    do not stop the job: they come out with status ``ERROR``.
    """
    body = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    decks = df.filter(is_deck(F.col(text))).select(key, body.alias("__b"))
    marks = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all("__b", F.lit(f"({SLIDE})"), F.lit(1)))
    each = decks.select(key, F.posexplode(F.arrays_zip(marks.alias("mark"), F.split("__b", SLIDE).alias("piece"))).alias("at", "s"))
    piece = F.trim(F.regexp_replace("s.piece", r"^\s+|\s+$", ""))
    each = each.select(key, "at", F.col("s.mark").alias("mark"), piece.alias("body")).filter((F.col("at") > 0) | (F.col("body") != ""))
    wrong = F.when(F.col("mark").isNull(), "text before the first slide").when(F.col("body") == "", "empty slide")
    return each.select(key, (F.col("at") - 1).alias("slide"), F.coalesce(F.trim("mark"), F.lit("")).alias("title"), "body", F.when(wrong.isNull(), "REORGNIZED").otherwise("ERROR").alias("status"), wrong.alias("exception"))


def levels_of(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The header levels of each document in order, joined by commas."""
    return blocks.filter("level is not null").groupBy(key).agg(F.expr("listagg(cast(level as string), ',') within group (order by pos)").alias("levels"))
