"""Readers: Markdown trees, question-answer texts, CSV of pairs and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import data_uri, newlines, parent, stem, strip


def _empty_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Paths of the files without content, which the file readers pass over."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    paths = []
    while found.hasNext():
        one = found.next()
        if one.getLen() == 0 and one.getPath().getName().endswith(suffix):
            paths.append((one.getPath().toString(),))
    return spark.createDataFrame(paths, "path string")


def read_markdown(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """Every matching file below ``root``: doc_id (hash of the path), file_path, root_path, title, raw_markdown.

    Line ends become LF. An empty file has a null ``raw_markdown``, and so no
    further state.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    files = files.select("path", "content").unionByName(_empty_files(spark, root, pattern.lstrip("*")).withColumn("content", F.lit(b"")))
    text = newlines(F.decode("content", "utf-8"))
    path = F.regexp_replace("path", r"^file:/*", "/")
    return files.select(F.sha2(path, 256).alias("doc_id"), path.alias("file_path"), parent(path).alias("root_path"), stem(path).alias("title"), F.when(F.length(text) > 0, text).alias("raw_markdown"))


def read_json_documents(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Whole JSON files: file_path and ast_json."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", r"^file:/*", "/").alias("file_path"), F.decode("content", "utf-8").alias("ast_json"))


def parse_pairs(df: DataFrame, text: str = "text", key: str = "collection") -> DataFrame:
    """Question-answer texts (a line ``Q``, the question's line, the answer's lines) as key, ord, question, answer.

    What stands before the first ``Q`` is dropped; a block without an answer
    has an empty one. Null texts give no rows.
    """
    body = F.concat(F.lit("\n"), newlines(F.col(text)))
    blocks = F.slice(F.split(body, r"\n[ \t]*(?:Q|问)[ \t]*(?=\n)"), 2, 2**30)
    each = df.filter(F.col(text).isNotNull()).select(F.col(key), F.posexplode(blocks).alias("ord", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: strip(x) != "")
    return each.filter(F.size(lines) > 0).select(key, "ord", strip(lines[0]).alias("question"), strip(F.array_join(F.slice(lines, 2, 2**30), "\n")).alias("answer"))


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    """Pairs as CSV with the header ``Question,Answer``."""
    pairs.select(F.col("question").alias("Question"), F.col("answer").alias("Answer")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_pairs_csv(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Pairs written by ``write_pairs_csv``, numbered in file order within the collection."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("Question string, Answer string").csv(path)
    return rows.select(F.lit(collection).alias("collection"), F.monotonically_increasing_id().alias("ord"), F.col("Question").alias("question"), F.col("Answer").alias("answer"))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Images below ``root``: file_path and data_uri."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,gif,bmp,webp}").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    return files.select(path.alias("file_path"), data_uri("content", path).alias("data_uri"))
