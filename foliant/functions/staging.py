"""Tables written once and read again: a short lineage that outlives lost executors, and no work done twice."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
#: Folders and tables written in this process, for ``release``.
folders: list[str] = []
tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset and the master is local, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        path = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dir.append("file://" + path)
    return _own_dir[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Drops the tables and deletes the folders that operators have written in this process; call it once their results are no longer read."""
    while tables:
        spark.sql(f"DROP TABLE IF EXISTS {tables.pop()}")
    jvm = spark.sparkContext._jvm
    while folders:
        path = jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
