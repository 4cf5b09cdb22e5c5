"""New Markdown files, picked up as they arrive, through the same stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.text import newlines, parent, stem
from docloom.plans import pipeline

_FILES = "path string, modificationTime timestamp, length long, content binary"


def markdown_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the Markdown files below ``root``, each once."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    text = newlines(F.decode("content", "utf-8"))
    return files.select(F.sha2(path, 256).alias("doc_id"), path.alias("file_path"), parent(path).alias("root_path"), stem(path).alias("title"), F.when(F.length(text) > 0, text).alias("raw_markdown"))


def process_stream(documents: DataFrame, artifacts: str, checkpoint: str) -> StreamingQuery:
    """Run the pending stages for every batch; a batch that is repeated after a failure does only what is left."""

    def one(batch: DataFrame, _: int) -> None:
        pipeline.run_pending(batch, artifacts)

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
