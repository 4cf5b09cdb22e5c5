"""Queries on summaries, ids, vectors, artifacts and pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import embedding, models, retrieval, sections, summaries
from docloom.plans import pipeline
from docloom.plans.structure import _MARKS, _WS, _blocks, _collapse, _documents
from docloom.runtime import latest, table
from docloom.sources.files import parse_pairs


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "artifacts"), ["doc_id", "kind"], "ingested_at")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vectors").select("vec_id", "collection", "id", F.col("metadata")["source"].alias("source"), "embedding", "document")
    return latest(v, ["vec_id"])


def leaf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf rule on every text."""
    return table(spark, sf_dir, "documents").select("doc_id", summaries.leaf("text").alias("summary"))


def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded summary of every section."""
    return summaries.section_summaries(sections.pack(_blocks(spark, sf_dir)))


def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded summary of every document, from its top-level sections."""
    packed = sections.pack(_blocks(spark, sf_dir))
    top = packed.filter("level is not null and parent is null").select("doc_id", F.col("pos").alias("section"))
    s = summaries.section_summaries(packed).join(top, ["doc_id", "section"], "left_semi")
    return summaries.document_summaries(_documents(spark, sf_dir, "title"), s)


def metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title (or folder) and path of every document."""
    return _documents(spark, sf_dir, "title", "root_path", "file_path").select("doc_id", text.filled("title", "root_path").alias("title"), "file_path")


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary prompt of every text in a language that has one."""
    d = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "zh") & F.col("text").isNotNull())
    return d.select("doc_id", F.sha2(text.prompt("text", "lang"), 256).alias("prompt_hash"))


def summary_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by the default plug-in."""
    return table(spark, sf_dir, "documents").select("doc_id", models.summary_column(F.col("text"), F.col("lang")).alias("r")).select("doc_id", "r.summary", "r.exception")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable id of every block."""
    b = latest(table(spark, sf_dir, "dom_blocks").select("block_id", "doc_id", "pos", "t", "c", "ingested_at"), ["block_id"], "ingested_at")
    return b.select("block_id", embedding.stable_id("doc_id", F.col("pos").cast("string"), "t", "c").alias("node_hash"))


def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the hash over its headers in order."""
    heads = _blocks(spark, sf_dir).filter("level is not null").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("items"))
    return heads.select("doc_id", embedding.hash_chain(F.col("items")).alias("chain"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each text that occurs more than once its least id and its number of copies."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).filter("n > 1")


def embedding_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and rounded sum of every usable vector."""
    v = _vectors(spark, sf_dir).select("vec_id", embedding.normalised("embedding").alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total")).withColumn("size", F.when(F.col("total").isNotNull(), F.col("size")))


def embedding_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each pair's question vector, or of its answer's where that is missing."""
    v = _vectors(spark, sf_dir).select("collection", F.regexp_extract("id", r"(\d+)$", 1).alias("ord"), "source", F.size(embedding.normalised("embedding")).alias("n"), F.col("id").contains("_q").alias("q"))
    return v.groupBy("collection", "ord").agg(F.coalesce(F.max(F.when(F.col("q") & (F.col("n") > 0), F.col("n"))), F.max(F.when(~F.col("q") & (F.col("n") > 0), F.col("n")))).cast("long").alias("size"))


def _hits(spark: SparkSession, sf_dir: str, collection: str | None = None) -> DataFrame:
    """Queries are all vectors whose id is divisible by 20; they search all rows, of one collection or of all."""
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "collection")
    base = v if collection is None else v.filter(F.col("collection") == collection)
    return retrieval.nearest(v.filter("id % 20 = 0"), base)


def knn_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest vectors of every query vector, itself included."""
    return _hits(spark, sf_dir).select("query", "near", F.col("rank").cast("long").alias("rank"), F.round("distance", 5).alias("distance"))


def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the four nearest those that are questions."""
    q = _vectors(spark, sf_dir).filter("source = 'question'").select(F.col("vec_id").alias("near"))
    return _hits(spark, sf_dir).join(q, "near", "left_semi").select("query", "near")


def knn_union_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the four nearest of either collection."""
    both = _hits(spark, sf_dir, "service").unionByName(_hits(spark, sf_dir, "technology"))
    return both.groupBy("query").agg(F.min(F.struct("distance", "near")).alias("b")).select("query", F.col("b.near").alias("near"))


def qa_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer found for every query vector: top four per collection, questions only, the closest, its answer."""
    v = table(spark, sf_dir, "vectors").select("vec_id", "collection", "id", F.create_map(F.lit("source"), F.col("metadata")["source"]).alias("metadata"), "document")
    both = _hits(spark, sf_dir, "service").unionByName(_hits(spark, sf_dir, "technology"))
    found = retrieval.best_answers(both.select("query", "near", "distance"), latest(v, ["vec_id"]))
    return found.select("query", "question_id", "answer_id", "answer")


def qa_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two rows of every pair in a vector store."""
    p = latest(table(spark, sf_dir, "qa_pairs").select("pair_id", "collection", "ord", "question", "answer", "ingested_at"), ["pair_id"], "ingested_at")
    return retrieval.pair_rows(p)


def qa_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs read from texts that are lists of questions and answers."""
    return parse_pairs(table(spark, sf_dir, "documents"), "text", "doc_id")


def collections_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections with their number of distinct vectors."""
    return _vectors(spark, sf_dir).groupBy("collection").agg(F.count("*").alias("n"))


def vector_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of pairs whose vectors are not stored yet."""
    return embedding.add_vectors(_vectors(spark, sf_dir), qa_ids(spark, sf_dir), ["collection", "id"]).select("collection", "id")


def pending_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.pending(_documents(spark, sf_dir), _artifacts(spark, sf_dir)).select("doc_id")


def ready_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.ready(_documents(spark, sf_dir), _artifacts(spark, sf_dir)).select("doc_id")


def artifact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts after one is added for every document that lacks its AST."""
    have = _artifacts(spark, sf_dir).select("doc_id", "kind", "artifact_path")
    missing = pipeline.pending(_documents(spark, sf_dir, "file_path"), have, "ast").select("doc_id", F.lit("ast").alias("kind"), pipeline.artifact_path("file_path", "ast").alias("artifact_path"))
    return have.unionByName(missing)


def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by recorded status and the one their artifacts imply."""
    docs = _documents(spark, sf_dir, "status", "exception")
    implied = pipeline.status_of(docs, _artifacts(spark, sf_dir))
    return docs.select("doc_id", F.upper("status").alias("status")).join(implied, "doc_id").groupBy("status", "implied").agg(F.count("*").alias("n"))


def artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the artifacts of every document lie."""
    d = _documents(spark, sf_dir, "file_path")
    return d.select("doc_id", *[pipeline.artifact_path("file_path", k).alias(f"{k}_path") for k in pipeline.SUFFIXES])


def type_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block types of each document joined with those that are embedded."""
    s = _blocks(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("t").alias("ts"))
    both = F.array_sort(F.array_union("ts", F.array(*[F.lit(x) for x in embedding.EMBEDDABLE])))
    return s.select("doc_id", F.array_join(both, ",").alias("types"), F.array_contains("ts", "Table").alias("has_table"))


def word_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most frequent words of all texts, a top-2 report."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(2)


def embed_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every embedded node of every AST after the default summary fold."""
    d = latest(table(spark, sf_dir, "dom_documents").select("doc_id", "title", "file_path", "ast_json", "ingested_at"), ["doc_id"], "ingested_at")
    return embedding.folded_records(d).select("doc_id", "at", "id", F.size("embedding").alias("size"))


QUERIES = {f.__name__: f for f in (leaf_summary, section_summary, document_summary, metadata_projection, prompt_build, summary_plugin, content_hash, hash_chain, duplicate_ids, embedding_normalize, embedding_retry, knn_top4, knn_postfilter, knn_union_argmin, qa_lookup, qa_ids, qa_parse, collections_list, vector_insert, pending_docs, ready_docs, artifact_upsert, status_report, artifact_paths, type_sets, word_top2, embed_compat)}

_V = "v AS (SELECT vec_id, any_value(collection) AS collection, any_value(id) AS id, any_value(metadata['source']) AS source, any_value(embedding) AS embedding, any_value(document) AS document FROM vectors GROUP BY vec_id)"
_U = "u AS (SELECT vec_id, collection, CAST(embedding AS DOUBLE[]) AS e FROM v WHERE len(embedding) = 64)"
_DIST = "round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9)"


def _top(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS near, {_DIST} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank FROM u a JOIN u b ON true WHERE a.vec_id % 20 = 0 AND {where}) WHERE rank <= 4)"


_BOTH = f"{_V}, {_U}, {_top('s', 'b.collection = ' + chr(39) + 'service' + chr(39))}, {_top('k', 'b.collection = ' + chr(39) + 'technology' + chr(39))}, n AS (SELECT * FROM s UNION ALL SELECT * FROM k)"
_D = "d AS (SELECT doc_id, any_value(title) AS title, any_value(file_path) AS file_path, any_value(root_path) AS root_path, any_value(status) AS status, any_value(exception) AS exception FROM dom_documents GROUP BY doc_id)"
_A = "a AS (SELECT doc_id, kind, any_value(artifact_path) AS artifact_path FROM artifacts GROUP BY ALL)"
_P = "p AS (SELECT DISTINCT pair_id, collection, ord, question, answer FROM qa_pairs)"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_LEAF = lambda x: f"CASE WHEN length({_STRIP(x)}) < 300 THEN {_STRIP(x)} ELSE coalesce(nullif(rtrim(left({_STRIP(x)}, 300), ' '), ''), {_STRIP(x)}) END"
_PATHS = "regexp_replace(file_path, '/[^/]*$', '') || '/' || regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') || "
_SUMMED = f"""
WITH RECURSIVE {_MARKS.strip()},
up AS (SELECT doc_id, pos, owner AS section, left(trim(regexp_replace(c, '\\s+', ' ', 'g'), ' '), 300) AS x FROM h WHERE owner IS NOT NULL
       UNION ALL SELECT up.doc_id, up.pos, h.parent, up.x FROM up JOIN h ON h.doc_id = up.doc_id AND h.pos = up.section WHERE h.parent IS NOT NULL),
j AS (SELECT doc_id, section, rtrim(left(string_agg(x, ' ' ORDER BY pos), 300), ' ') AS summary FROM up WHERE x <> '' GROUP BY ALL)"""

ORACLE = {
    "leaf_summary": f"SELECT doc_id, {_LEAF('text')} AS summary FROM documents",
    "section_summary": f"{_SUMMED} SELECT * FROM j",
    "document_summary": f"""{_SUMMED},
{_D}, g AS (SELECT j.doc_id, string_agg(summary, ' ' ORDER BY section) AS x FROM j JOIN h ON h.doc_id = j.doc_id AND h.pos = j.section WHERE h.level IS NOT NULL AND h.parent IS NULL GROUP BY j.doc_id)
SELECT d.doc_id, CASE WHEN x IS NULL THEN '' ELSE {_LEAF("concat_ws(' ', title, x)")} END AS summary FROM d LEFT JOIN g USING (doc_id)""",
    "metadata_projection": f"WITH {_D} SELECT doc_id, coalesce(nullif(title, ''), root_path) AS title, file_path FROM d",
    "prompt_build": f"""
SELECT doc_id, sha256(CASE lang WHEN 'en' THEN 'Please provide a summary of the following string. The summary should be concise and informative: ' || text || '. '
  ELSE '请提供以下字符串的摘要。摘要应简明扼要且信息丰富: ' || {_collapse('text')} || '. ' END) AS prompt_hash
FROM documents WHERE lang IN ('en', 'zh') AND text IS NOT NULL""",
    "content_hash": "SELECT block_id, sha256(doc_id || '|' || pos || '|' || t || '|' || coalesce(c, '')) AS node_hash FROM (SELECT DISTINCT block_id, doc_id, pos, t, c FROM dom_blocks)",
    "hash_chain": """
WITH RECURSIVE b AS (SELECT DISTINCT doc_id, pos, c FROM dom_blocks WHERE level IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM b),
r AS (SELECT doc_id, k, n, sha256(c) AS chain FROM i WHERE k = 1 UNION ALL SELECT i.doc_id, i.k, i.n, sha256(r.chain || i.c) FROM r JOIN i ON i.doc_id = r.doc_id AND i.k = r.k + 1)
SELECT doc_id, chain FROM r WHERE k = n""",
    "duplicate_ids": "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "embedding_normalize": f"WITH {_V} SELECT vec_id, CASE WHEN len(embedding) > 0 THEN len(embedding) END AS size, round(CASE WHEN len(embedding) > 0 THEN list_sum(CAST(embedding AS DOUBLE[])) END, 4) AS total FROM v",
    "embedding_retry": f"WITH {_V}, x AS (SELECT collection, regexp_extract(id, '(\\d+)$', 1) AS ord, id LIKE '%\\_q%' ESCAPE '\\' AS q, nullif(len(embedding), 0) AS n FROM v) SELECT collection, ord, coalesce(max(CASE WHEN q THEN n END), max(CASE WHEN NOT q THEN n END)) AS size FROM x GROUP BY ALL",
    "knn_top4": f"WITH {_V}, {_U}, {_top('t')} SELECT query, near, rank, round(distance, 5) AS distance FROM t",
    "knn_postfilter": f"WITH {_V}, {_U}, {_top('t')} SELECT query, near FROM t JOIN v ON v.vec_id = t.near WHERE v.source = 'question'",
    "knn_union_argmin": f"WITH {_BOTH} SELECT query, near FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, near) AS r FROM n) WHERE r = 1",
    "qa_lookup": f"""
WITH {_BOTH},
q AS (SELECT n.query, n.distance, v.collection, v.id, row_number() OVER (PARTITION BY n.query ORDER BY n.distance, n.near) AS r FROM n JOIN v ON v.vec_id = n.near WHERE v.source = 'question'),
w AS (SELECT query, collection, id AS question_id, regexp_replace(id, '_q(\\d+)$', '_a\\1') AS answer_id FROM q WHERE r = 1)
SELECT w.query, w.question_id, w.answer_id, v.document AS answer FROM w LEFT JOIN v ON v.collection = w.collection AND v.id = w.answer_id""",
    "qa_ids": f"WITH {_P} SELECT collection, collection || '_q' || ord AS id, 'question' AS source, question AS document FROM p UNION ALL SELECT collection, collection || '_a' || ord, 'answer', answer FROM p",
    "collections_list": f"WITH {_V} SELECT collection, count(*) AS n FROM v GROUP BY 1",
    "vector_insert": f"WITH {_V}, {_P}, i AS (SELECT collection, collection || '_q' || ord AS id FROM p UNION SELECT collection, collection || '_a' || ord FROM p) SELECT i.collection, i.id FROM i ANTI JOIN v ON v.collection = i.collection AND v.id = i.id",
    "pending_docs": f"WITH {_D} SELECT doc_id FROM d ANTI JOIN (SELECT doc_id FROM artifacts WHERE kind = 'semantics') a USING (doc_id)",
    "ready_docs": f"WITH {_D} SELECT doc_id FROM d SEMI JOIN (SELECT doc_id FROM artifacts WHERE kind = 'semantics') a USING (doc_id)",
    "artifact_upsert": f"WITH {_D}, {_A} SELECT doc_id, kind, artifact_path FROM a UNION ALL SELECT doc_id, 'ast', {_PATHS} '_ast.json' FROM d ANTI JOIN (SELECT doc_id FROM a WHERE kind = 'ast') x USING (doc_id)",
    "status_report": f"""
WITH {_D}, k AS (SELECT doc_id, bool_or(kind = 'ast') AS ast, bool_or(kind = 'semantics') AS semantics, bool_or(kind = 'embed') AS embed FROM artifacts GROUP BY 1)
SELECT upper(status) AS status, CASE WHEN exception IS NOT NULL THEN 'ERROR' WHEN embed THEN 'COMPLETED' WHEN semantics THEN 'SEMANTICIZED' WHEN ast THEN 'REORGNIZED' ELSE 'PENDING' END AS implied, count(*) AS n
FROM d LEFT JOIN k USING (doc_id) GROUP BY ALL""",
    "artifact_paths": f"WITH {_D} SELECT doc_id, {_PATHS} '_ast.json' AS ast_path, {_PATHS} '_semantics.json' AS semantics_path, {_PATHS} '_embed.json' AS embed_path FROM d",
    "type_sets": "SELECT doc_id, array_to_string(list_sort(list_distinct(list(t) || ['Section', 'Image', 'Table'])), ',') AS types, list_contains(list(t), 'Table') AS has_table FROM dom_blocks GROUP BY doc_id",
    "word_top2": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2",
}
