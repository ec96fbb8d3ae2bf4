"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import cut, folders, release, shared_dir, tables

__all__ = ["WHITE", "WORD", "batches", "components", "cut", "folders", "parts", "release", "shared_dir", "stay", "tables", "tidy"]

#: ASCII white space, as in the class [\x20\x09-\x0D].
WHITE = r"[\x20\x09-\x0D]"
#: A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]++"

def batches(spark: SparkSession, rows: int = 500, size: int = 1 << 23) -> None:
    """Bounds the rows and bytes of an Arrow batch, since texts can be long; a longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def tidy(f):
    """``f`` over record batches, and afterwards what it freed goes back to the system: workers wait for later tasks."""

    def run(record_batches):
        yield from f(record_batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def parts(spark: SparkSession) -> int:
    """Partitions to deal keys out to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def stay(df: DataFrame, name: str) -> DataFrame:
    """``df`` as (part, idx, row): part and idx name a row, whose columns are fields of row; written once and bucketed by part.

    Rows stay where they were read: a join on (part, idx) shuffles only the other side, so whole texts
    are stored once and never dealt out.
    """
    spark = df.sparkSession
    # a table dealt by part alone also serves joins on (part, idx)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    key = f"foliant_{name}_{uuid.uuid4().hex}"
    rows = df.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("idx"), F.struct(*[df[c] for c in df.columns]).alias("row"))
    rows.write.bucketBy(max(1, min(4096, parts(spark))), "part").option("path", f"{shared_dir(spark)}/foliant/{key}").saveAsTable(key)
    tables.append(key)
    folders.append(f"{shared_dir(spark)}/foliant/{key}")
    return spark.table(key)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of an edge table (a long, b long) as (node, root), root the least node.

    Alternating large-star and small-star rounds over written tables; only counts and a checksum
    reach the driver. Nodes without an edge to another node do not appear.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for k in range(max_rounds):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"star{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
