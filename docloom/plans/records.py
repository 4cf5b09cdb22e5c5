"""Queries on nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import nested
from docloom.runtime import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed object of every readable AST, with its place and its parent."""
    tagged = nested.flatten(table(spark, sf_dir, "dom_documents"), tags=["node"], payload=False)
    return tagged.select("doc_id", "node_path", "parent_path", "t")


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tagged rows of every readable AST, as ``write_tables`` writes them."""
    return nested.flatten(table(spark, sf_dir, "dom_documents"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each flat table by type."""
    return nested.flatten(table(spark, sf_dir, "dom_documents"), payload=False).groupBy("tag", "t").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p5_found, p5_tables, p5_counts)}
ORACLE: dict[str, str] = {
    "p5_found": """
WITH RECURSIVE d AS (SELECT doc_id, any_value(ast_json) AS a FROM dom_documents WHERE json_valid(ast_json) GROUP BY doc_id),
j AS (SELECT d.doc_id, x.id, x.parent, x.key, CASE WHEN x.type = 'OBJECT' AND json_type(x.value, '$.t') = 'VARCHAR' THEN x.value ->> '$.t' END AS t
      FROM d, json_tree(d.a) x WHERE x.type IN ('OBJECT', 'ARRAY')),
r AS (SELECT doc_id, id, '' AS node_path, '' AS parent_path, t FROM j WHERE parent IS NULL
      UNION ALL
      SELECT j.doc_id, j.id, CASE WHEN r.node_path = '' THEN j.key ELSE r.node_path || '/' || j.key END, CASE WHEN r.t IS NULL THEN r.parent_path ELSE r.node_path END, j.t
      FROM r JOIN j ON j.doc_id = r.doc_id AND j.parent = r.id)
SELECT doc_id, node_path, parent_path, t FROM r WHERE t IS NOT NULL AND t NOT IN ('Str', 'Space', 'SoftBreak', 'LineBreak')""",
}
