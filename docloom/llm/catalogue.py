"""Queries of this package, with the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import encoding_repair, near_duplicates, packing, pair_quality, splitting, tokens, vector_search
from docloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _pieces(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    limits = table(spark, sf_dir, "split_limits")
    docs = table(spark, sf_dir, "dom_documents").select(F.lit("raw_markdown").alias("item_field"), F.col("doc_id").alias("item_id"), F.col("raw_markdown").alias("text"), "ingested_at")
    blocks = table(spark, sf_dir, "dom_blocks").select(F.lit("c").alias("item_field"), F.col("block_id").cast("string").alias("item_id"), F.col("c").alias("text"), "ingested_at", "t")
    items = splitting.with_limits(docs, limits, "raw_markdown").unionByName(splitting.with_limits(blocks, limits, "c", F.col("t")).drop("t"))
    return splitting.split_oversized(items, ["item_field", "item_id"], order="ingested_at", with_text=with_text)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, False).filter("piece_no = 0").select("item_field", "item_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir, True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_defects(spark, sf_dir).select("pair_id", "defect")


def p2_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_quality.flag_pairs(table(spark, sf_dir, "qa_pairs"))


def _similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.similar_texts(table(spark, sf_dir, "dom_documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.all_pairs(*_similar(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(*_similar(spark, sf_dir))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "vectors"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.similar_pairs(p4_neighbours(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p7_bins(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_restored(spark, sf_dir).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.restore(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_defects, p3_found, p3_groups, p4_found, p4_neighbours, p6_ids, p7_bins, p7_fill, p8_found, p8_restored)}

ORACLE: dict[str, str] = {
    "p1_found": """
WITH items AS (
  SELECT DISTINCT 'raw_markdown' AS item_field, doc_id AS item_id, '*' AS t, length(raw_markdown) AS n FROM dom_documents
  UNION
  SELECT DISTINCT 'c', CAST(block_id AS VARCHAR), t, length(c) FROM dom_blocks)
SELECT DISTINCT i.item_field, i.item_id
FROM items i
LEFT JOIN split_limits own ON own.item_field = i.item_field AND own.t = i.t
LEFT JOIN split_limits rest ON rest.item_field = i.item_field AND rest.t = '*'
WHERE i.n > coalesce(own.max_chars, rest.max_chars)""",
    "p3_found": """
WITH d AS (
  SELECT doc_id, regexp_replace(any_value(raw_markdown), '[ \\t\\r\\n　]', '', 'g') AS x
  FROM dom_documents WHERE raw_markdown IS NOT NULL GROUP BY doc_id),
s AS (SELECT DISTINCT doc_id, substr(x, i, 16) AS g FROM (SELECT doc_id, x, unnest(range(1, length(x) - 14)) AS i FROM d WHERE length(x) >= 16)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_a, doc_b FROM p JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b
WHERE c >= 0.6 * (x.n + y.n - c)""",
    "p3_groups": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_replace(any_value(raw_markdown), '[ \\t\\r\\n　]', '', 'g') AS x
  FROM dom_documents WHERE raw_markdown IS NOT NULL GROUP BY doc_id HAVING length(regexp_replace(any_value(raw_markdown), '[ \\t\\r\\n　]', '', 'g')) >= 16),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS class_id, x FROM d),
s AS (SELECT DISTINCT doc_id, substr(x, i, 16) AS g FROM (SELECT doc_id, x, unnest(range(1, length(x) - 14)) AS i FROM c WHERE doc_id = class_id)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.6 * (x.n + y.n - c)),
r AS (SELECT DISTINCT class_id AS a, class_id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a, min(b) AS group_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, group_id, class_id, coalesce(k.n, 0) AS n_links FROM c JOIN g ON g.a = class_id LEFT JOIN k ON k.a = class_id""",
    "p4_found": """
WITH v AS (
  SELECT vec_id, CAST(any_value(embedding) AS DOUBLE[]) AS e FROM vectors
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
p AS (SELECT a.vec_id AS q, b.vec_id AS w, list_cosine_similarity(a.e, b.e) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, w) AS k FROM p)
SELECT DISTINCT least(q, w) AS vec_a, greatest(q, w) AS vec_b FROM r WHERE k <= 4 AND cosine >= 0.9""",
}
