"""Compiling documents as they arrive in a folder."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import parser_for

if TYPE_CHECKING:
    from ..plans.engine import Engine


def ingest(engine: Engine, folder: str, checkpoint: str, extension: str = "md", **trigger) -> StreamingQuery:
    """Each batch of new text files becomes one compile; a batch that is run again finds its documents unchanged and skips them.

    ``trigger`` is that of the writer (``availableNow=True`` by default: what is there, then stop).
    """
    found = engine.spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").text(folder)
    files = found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def compiled(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            docs = batch.select(F.xxhash64("path").alias("doc_id"), "path", "text", F.encode("text", "UTF-8").alias("content"))
            engine.compile(raw_nodes=parser_for(extension)(docs).select("doc_id", "seq", "level", "title", "content"))

    return files.writeStream.foreachBatch(compiled).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
