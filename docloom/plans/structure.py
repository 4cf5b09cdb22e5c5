"""Queries on blocks, sections, slides and trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import markdown, nested, sections, tree
from docloom.runtime import latest, table

_B = "b AS (SELECT DISTINCT doc_id, pos, t, level, c FROM dom_blocks)"
#: White space as the engine has it, for SQL dialects that know only ASCII's.
_WS = "[ \\t\\n\\x0B\\f\\r\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents as delivered last, with only the columns that are asked for, so that only these are read."""
    return latest(table(spark, sf_dir, "dom_documents").select("doc_id", *columns, "ingested_at"), ["doc_id"], "ingested_at")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.distinct_blocks(table(spark, sf_dir, "dom_blocks"))


def blocks_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown to top-level blocks."""
    return markdown.blocks(_documents(spark, sf_dir, "raw_markdown").select("doc_id", "raw_markdown"))


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and characters by type and product."""
    b = latest(table(spark, sf_dir, "dom_blocks").select("block_id", "t", "c", "product_key", "ingested_at"), ["block_id"], "ingested_at")
    return b.groupBy("t", "product_key").agg(F.count("*").alias("n"), F.sum(F.length("c")).cast("long").alias("chars"))


def whitespace_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each text before and after its white space is collapsed."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length("text").cast("long").alias("n_before"), F.length(text.collapse("text")).cast("long").alias("n_after"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header levels of each document in order."""
    return sections.levels_of(_blocks(spark, sf_dir))


def toc_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks left when contents tables are dropped."""
    return sections.drop_contents(_blocks(spark, sf_dir)).select("doc_id", "pos", "t")


def ordered_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lists that become a heading."""
    before = _blocks(spark, sf_dir)
    return sections.promote_heading(before).filter("t = 'Header' and level = 1").join(before.filter("t = 'OrderedList'").select("doc_id", "pos"), ["doc_id", "pos"], "left_semi").select("doc_id", "pos", F.col("c").alias("title"))


def section_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner of each block and parent of each header."""
    return sections.pack(_blocks(spark, sf_dir)).select("doc_id", "pos", "owner", "parent")


def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and path of each section."""
    packed = sections.pack(_blocks(spark, sf_dir)).filter("level is not null")
    return packed.select("doc_id", "pos", F.size("path").alias("depth"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def section_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and hash of each section's own content."""
    s = sections.section_table(sections.pack(_blocks(spark, sf_dir)))
    return s.select("doc_id", "section", F.col("n_blocks").cast("long").alias("n_blocks"), F.sha2("content", 256).alias("content_hash"))


def section_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and number of subsections of each section."""
    s = sections.section_table(sections.pack(_blocks(spark, sf_dir)))
    return s.select("doc_id", "section", "title", F.col("n_children").cast("long").alias("n_children"))


def preamble_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks before the first header."""
    return sections.pack(_blocks(spark, sf_dir)).filter("owner is null").select("doc_id", "pos", "t")


def slide_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of each deck."""
    s = sections.split_slides(_documents(spark, sf_dir, "raw_markdown"))
    return s.select("doc_id", F.col("slide").cast("long").alias("slide"), "title", F.length("body").cast("long").alias("n_chars"), "status")


def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of the events' properties, without a parser in Python."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", F.explode("m").alias("key", "value"))


def json_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and greatest depth of each readable AST."""
    p = nested.flatten(table(spark, sf_dir, "dom_documents"), tags=["node", "inline"], payload=False)
    return p.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.max(F.size(F.split("node_path", "/"))).cast("long").alias("depth"))


def node_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parents and children with how often they meet."""
    n = nested.flatten(table(spark, sf_dir, "dom_documents"), tags=["node"], payload=False)
    up = n.select("doc_id", F.col("node_path").alias("parent_path"), F.col("t").alias("parent_t"))
    return n.join(up, ["doc_id", "parent_path"], "left").groupBy("parent_t", "t").agg(F.count("*").alias("n"))


def ast_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collapsed text of every readable AST."""
    d = latest(table(spark, sf_dir, "dom_documents").select("doc_id", "ast_json", "ingested_at"), ["doc_id"], "ingested_at")
    return d.select("doc_id", tree.text_column("ast_json").alias("text")).filter("text is not null")


def ast_reorganised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable AST with its lists packed into sections."""
    d = latest(table(spark, sf_dir, "dom_documents").select("doc_id", "ast_json", "ingested_at"), ["doc_id"], "ingested_at")
    return d.select("doc_id", tree.reorganise_column("ast_json").alias("ast_json")).filter("ast_json is not null")


def _measured(x: object) -> object:
    """An object with the number of its keys beside them; other nodes as they are."""
    return x | {"n": len(x)} if isinstance(x, dict) else x


def map_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable AST mapped so that each object counts its keys; the sum over the document."""
    d = latest(table(spark, sf_dir, "dom_documents").select("doc_id", "ast_json", "ingested_at"), ["doc_id"], "ingested_at")
    mapped = d.select("doc_id", tree.map_column("ast_json", _measured).alias("x")).filter("x is not null")
    counts = F.regexp_extract_all("x", F.lit(r'"n": (\d+)\}'), F.lit(1))
    return mapped.select("doc_id", F.size(counts).cast("long").alias("objects"), F.aggregate(counts, F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long")).alias("keys"))


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each readable AST beside itself with the keys counted: pairs of nodes at equal places, and those of equal type."""
    d = latest(table(spark, sf_dir, "dom_documents").select("doc_id", "ast_json", "ingested_at"), ["doc_id"], "ingested_at")
    return tree.zip_mapped(d, _measured)


def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image links of each document, resolved against its folder."""
    d = _documents(spark, sf_dir, "root_path", "raw_markdown").filter("raw_markdown is not null")
    links = F.regexp_extract_all("raw_markdown", F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))
    each = d.select("doc_id", "root_path", F.posexplode(links).alias("at", "link")).withColumn("at", F.col("at").cast("long"))
    valid = F.col("link").rlike(r"^[^\s]+\.(jpg|jpeg|png|gif|bmp|webp)")
    return each.select("doc_id", "at", "link", valid.alias("valid"), F.when(~F.col("link").startswith("data:"), text.normal_path(F.concat("root_path", F.lit("/"), "link"))).alias("path"))


def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "raw_markdown").select("doc_id", markdown.render_column(F.col("raw_markdown"), "html").alias("html"))


def render_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "raw_markdown").select("doc_id", markdown.render_column(F.col("raw_markdown"), "latex").alias("latex"))


def md_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "raw_markdown").select("doc_id", markdown.ast_column(F.col("raw_markdown")).alias("ast_json"))


_AST = "d AS (SELECT doc_id, any_value(ast_json) AS a FROM dom_documents WHERE json_valid(ast_json) GROUP BY doc_id)"
_NODES = f"""{_AST},
j AS (SELECT d.doc_id, x.id, x.parent, x.key, CASE WHEN x.type = 'OBJECT' AND json_type(x.value, '$.t') = 'VARCHAR' THEN x.value ->> '$.t' END AS t
      FROM d, json_tree(d.a) x WHERE x.type IN ('OBJECT', 'ARRAY')),
r AS (SELECT doc_id, id, '' AS node_path, '' AS parent_path, t FROM j WHERE parent IS NULL
      UNION ALL
      SELECT j.doc_id, j.id, CASE WHEN r.node_path = '' THEN j.key ELSE r.node_path || '/' || j.key END, CASE WHEN r.t IS NULL THEN r.parent_path ELSE r.node_path END, j.t
      FROM r JOIN j ON j.doc_id = r.doc_id AND j.parent = r.id)"""

QUERIES = {f.__name__: f for f in (blocks_scan, block_kinds, whitespace_collapse, heading_levels, toc_drop, ordered_heading, section_pack, section_tree, section_content, section_children, preamble_blocks, slide_split, json_walk, json_tree_depth, node_parents, ast_text, ast_reorganised, map_transform, positional_zip, image_links, render_html, render_latex, md_parse)}

_MARKS = f"""
{_B},
m AS (SELECT *, {', '.join(f'max(CASE WHEN level = {k} THEN pos END) OVER w AS m{k}' for k in range(1, 7))}
      FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, max(CASE WHEN level IS NOT NULL THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS owner FROM m),
h AS (SELECT *, nullif(greatest({', '.join(f'CASE WHEN level > {k} THEN coalesce(m{k}, -1) ELSE -1 END' for k in range(1, 7))}), -1) AS parent FROM o)"""

_DOCS = "d AS (SELECT doc_id, any_value(raw_markdown) AS x, any_value(root_path) AS root_path FROM dom_documents GROUP BY doc_id)"

ORACLE = {
    "blocks_scan": f"WITH {_B} SELECT * FROM b",
    "block_kinds": "SELECT t, product_key, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS chars FROM (SELECT DISTINCT block_id, t, c, product_key FROM dom_blocks) GROUP BY ALL",
    "whitespace_collapse": f"SELECT doc_id, length(text) AS n_before, length({_collapse('text')}) AS n_after FROM documents",
    "heading_levels": f"WITH {_B} SELECT doc_id, string_agg(CAST(level AS VARCHAR), ',' ORDER BY pos) AS levels FROM b WHERE level IS NOT NULL GROUP BY doc_id",
    "toc_drop": f"""
WITH {_B},
k AS (SELECT *, t = 'Para' AND {_collapse('c')} = '目录' AS title, t = 'Para' AND regexp_matches({_collapse('c')}, '^.+ \\p{{Nd}}+$') AS entry FROM b),
w AS (SELECT *, max(CASE WHEN title THEN pos END) OVER p AS lt, max(CASE WHEN NOT title AND NOT entry THEN pos END) OVER p AS lb
      FROM k WINDOW p AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, pos, t FROM w WHERE NOT (title OR (entry AND coalesce(lt > coalesce(lb, -1), false)))""",
    "ordered_heading": f"""
WITH {_B},
k AS (SELECT *, CASE WHEN t = 'OrderedList' AND regexp_matches(c, '^1[.)] +[^\\n]*[^\\n。！？；:\\s]\\s*$') THEN pos END AS able FROM b),
m AS (SELECT *, min(able) OVER (PARTITION BY doc_id) AS f, min(CASE WHEN t = 'Header' THEN pos END) OVER (PARTITION BY doc_id) AS h FROM k)
SELECT doc_id, pos, regexp_extract(c, '^1[.)]\\s+((?s:.*))$', 1) AS title FROM m WHERE pos = f AND (h IS NULL OR pos < h)""",
    "section_pack": f"WITH {_MARKS} SELECT doc_id, pos, owner, parent FROM h",
    "section_tree": f"""
WITH RECURSIVE {_MARKS.strip()},
r AS (SELECT doc_id, pos, 1 AS depth, CAST(pos AS VARCHAR) AS path FROM h WHERE level IS NOT NULL AND parent IS NULL
      UNION ALL SELECT h.doc_id, h.pos, r.depth + 1, r.path || '/' || h.pos FROM h JOIN r ON h.doc_id = r.doc_id AND h.parent = r.pos WHERE h.level IS NOT NULL)
SELECT * FROM r""",
    "section_content": f"""
WITH {_MARKS},
c AS (SELECT doc_id, owner AS section, count(*) AS n, string_agg(c, ' ' ORDER BY pos) AS x FROM h WHERE level IS NULL AND owner IS NOT NULL GROUP BY ALL)
SELECT h.doc_id, h.pos AS section, coalesce(n, 0) AS n_blocks, sha256(x) AS content_hash FROM h LEFT JOIN c ON c.doc_id = h.doc_id AND c.section = h.pos WHERE level IS NOT NULL""",
    "section_children": f"""
WITH {_MARKS},
c AS (SELECT doc_id, parent, count(*) AS n FROM h WHERE level IS NOT NULL AND parent IS NOT NULL GROUP BY ALL)
SELECT h.doc_id, h.pos AS section, {_collapse("regexp_replace(h.c, '^#+ *', '')")} AS title, coalesce(n, 0) AS n_children FROM h LEFT JOIN c ON c.doc_id = h.doc_id AND c.parent = h.pos WHERE level IS NOT NULL""",
    "preamble_blocks": f"WITH {_MARKS} SELECT doc_id, pos, t FROM h WHERE owner IS NULL",
    "slide_split": f"""
WITH {_DOCS},
k AS (SELECT doc_id, regexp_replace(x, '\\r\\n?', chr(10), 'g') AS x FROM d WHERE regexp_matches(x, '(?im)^<!--\\s*Slide number:\\s*\\d+\\s*-->[ \\t]*\\r?$')),
s AS (SELECT doc_id, string_split_regex(x, '<!--\\s*Slide number:\\s*\\d+\\s*-->') AS p, [NULL] || regexp_extract_all(x, '<!--\\s*Slide number:\\s*\\d+\\s*-->') AS m FROM k),
e AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS i, p, m FROM s),
f AS (SELECT doc_id, i, m[i] AS mark, trim(regexp_replace(p[i], '^\\s+|\\s+$', '', 'g')) AS body FROM e)
SELECT doc_id, i - 2 AS slide, coalesce(trim(mark), '') AS title, length(body) AS n_chars,
  CASE WHEN mark IS NULL OR body = '' THEN 'ERROR' ELSE 'REORGNIZED' END AS status
FROM f WHERE i > 1 OR body <> ''""",
    "json_walk": "SELECT e.event_id, j.key, j.value ->> '$' AS value FROM events e, json_each(e.props) j",
    "map_transform": f"""
WITH {_AST}
SELECT doc_id, count(*) FILTER (x.type = 'OBJECT') AS objects, CAST(sum(CASE WHEN x.type = 'OBJECT' THEN len(json_keys(x.value)) ELSE 0 END) AS BIGINT) AS keys
FROM d, json_tree(d.a) x GROUP BY doc_id""",
    "positional_zip": f"WITH {_AST} SELECT doc_id, count(*) AS pairs, count(*) AS alike FROM d, json_tree(d.a) x GROUP BY doc_id",
    "json_tree_depth": f"WITH RECURSIVE {_NODES} SELECT doc_id, count(*) AS n_nodes, CAST(max(len(string_split(node_path, '/'))) AS BIGINT) AS depth FROM r WHERE t IS NOT NULL GROUP BY doc_id",
    "node_parents": f"""
WITH RECURSIVE {_NODES},
n AS (SELECT * FROM r WHERE t IS NOT NULL AND t NOT IN ('Str', 'Space', 'SoftBreak', 'LineBreak'))
SELECT up.t AS parent_t, n.t, count(*) AS n FROM n LEFT JOIN n up ON up.doc_id = n.doc_id AND up.node_path = n.parent_path GROUP BY ALL""",
    "image_links": f"""
WITH {_DOCS},
l AS (SELECT doc_id, root_path, regexp_extract_all(x, '!\\[[^\\]]*\\]\\(([^)\\s]+)', 1) AS a FROM d WHERE x IS NOT NULL),
e AS (SELECT doc_id, root_path, a, unnest(generate_series(1, len(a))) AS i FROM l)
SELECT doc_id, i - 1 AS at, a[i] AS link, regexp_matches(a[i], '^[^\\s]+\\.(jpg|jpeg|png|gif|bmp|webp)') AS valid, CASE WHEN a[i] NOT LIKE 'data:%' THEN root_path || '/' || a[i] END AS path FROM e""",
}
