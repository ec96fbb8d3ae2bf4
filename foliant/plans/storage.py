"""A workspace of Parquet tables that are replaced in part and at once.

A table is dealt to buckets by a hash of its key. A write puts the buckets that change into a new folder
and then lets a new manifest take the old one's place by a rename; readers see the table before or after,
never between, and a crash leaves the old one. The manifest holds the format's version, the schema, and
each bucket's folder, rows and checksum (a sum of row hashes, whatever the rows' order).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = 1
_MANIFEST = "_manifest.json"


class CorruptTableError(ValueError):
    pass


class TableStore:
    #: How a manifest of an older format becomes one of a newer: (from, to) -> function of the manifest.
    migrations: dict[tuple[int, int], Callable[[dict], dict]] = {}

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, codec: str = "snappy"):
        self.spark, self.folder, self.buckets, self.codec = spark, folder.rstrip("/"), buckets, codec

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, name: str) -> dict | None:
        fs, path = self._fs(), self._path(name, _MANIFEST)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self._migrated(name, json.loads(text))

    def _migrated(self, name: str, m: dict) -> dict:
        """A manifest brought to this format by the fewest migrations that lead there."""
        ways = [[m["format"]]]
        for way in ways:
            if way[-1] == FORMAT:
                for step in zip(way, way[1:], strict=False):
                    m = self.migrations[step](m) | {"format": step[1]}
                return m
            ways += [[*way, b] for a, b in self.migrations if a == way[-1] and b not in way]
        raise CorruptTableError(f"{name} has format {m['format']}, not {FORMAT}")

    @contextmanager
    def lock(self, patience: float = 10.0, stale: float = 600.0) -> Iterator[None]:
        """Only one writer at a time: a file that one can create; one left behind for ``stale`` seconds counts for nothing."""
        fs, path, until = self._fs(), self._path("_lock"), time.time() + patience
        while not self._create(fs, path):
            if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > stale:
                fs.delete(path, False)
            elif time.time() > until:
                raise TimeoutError(f"{self.folder} is locked")
            else:
                time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(path, False)

    @staticmethod
    def _create(fs, path) -> bool:
        if fs.exists(path):
            return False
        try:
            fs.create(path, False).close()
        except Exception:  # another came first
            return False
        return True

    def _put_manifest(self, name: str, m: dict) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        new, old = self._path(name, f"_new-{uuid.uuid4().hex}"), self._path(name, _MANIFEST)
        out = self._fs().create(new)
        try:
            out.write(json.dumps(m).encode())
        finally:
            out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, old, options)

    # tables

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name, _MANIFEST))

    def names(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path()) if fs.exists(self._path(s.getPath().getName(), _MANIFEST)))

    def __len__(self) -> int:
        return len(self.names())

    def read(self, name: str) -> DataFrame:
        m = self._manifest(name)
        if m is None:
            raise KeyError(name)
        return self._read(name, m, list(m["buckets"]))

    def _read(self, name: str, m: dict, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.folder}/{name}/{m['buckets'][b]['folder']}" for b in buckets if b in m["buckets"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _sums(self, df: DataFrame) -> list:
        each = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in df.columns if c != "_bucket"])
        return df.groupBy("_bucket").agg(F.count("*").alias("rows"), F.sum(each.cast("decimal(38,0)")).cast("string").alias("checksum")).collect()  # a row per bucket

    def write(self, name: str, df: DataFrame, key: str = "doc_id") -> None:
        """``df`` as the whole table."""
        self._replace(name, df, key, None)

    def upsert(self, name: str, rows: DataFrame, keys: DataFrame, key: str = "doc_id") -> None:
        """The table with ``rows`` in place of those whose key is in ``keys``; only the buckets of these keys are written."""
        m = self._manifest(name)
        if m is None:
            return self._replace(name, rows, key, None)
        changed = [str(r[0]) for r in keys.select(self._bucket(key)).distinct().collect()]  # at most as many as buckets
        if changed:
            old = self._read(name, m, changed).join(keys.select(key).distinct(), key, "left_anti")
            self._replace(name, old.unionByName(rows.select(old.columns)), key, changed)

    def _replace(self, name: str, df: DataFrame, key: str, changed: list[str] | None) -> None:
        m = self._manifest(name) if changed is not None else None
        folder = f"v-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}/{folder}"
        df.withColumn("_bucket", self._bucket(key)).repartition("_bucket").write.option("compression", self.codec).partitionBy("_bucket").parquet(path)
        written = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(path)
        sums = {str(r["_bucket"]): {"folder": f"{folder}/_bucket={r['_bucket']}", "rows": r["rows"], "checksum": r["checksum"]} for r in self._sums(written)}
        kept = {b: v for b, v in (m["buckets"] if m else {}).items() if b not in (changed or [])}
        before = self._manifest(name)
        self._put_manifest(name, {"format": FORMAT, "key": key, "schema": df.schema.jsonValue(), "buckets": kept | sums})
        used = {v["folder"].split("/")[0] for v in (kept | sums).values()} | {folder} | {v["folder"].split("/")[0] for v in (before["buckets"] if before else {}).values()}
        fs = self._fs()
        for s in fs.listStatus(self._path(name)):  # folders that neither this nor the manifest before it names
            if s.isDirectory() and s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)

    def remove(self, name: str, keys: DataFrame, key: str = "doc_id") -> None:
        self.upsert(name, self.read(name).limit(0), keys, key)

    def delete(self, name: str) -> bool:
        return self._fs().delete(self._path(name), True)

    def clear(self) -> None:
        for name in self.names():
            self.delete(name)

    def rows(self, name: str) -> int:
        m = self._manifest(name)
        return sum(b["rows"] for b in m["buckets"].values()) if m else 0

    def size(self) -> int:
        """Bytes of the workspace, with folders that no manifest names any more."""
        fs = self._fs()
        return fs.getContentSummary(self._path()).getLength() if fs.exists(self._path()) else 0

    def verify(self, name: str) -> None:
        """Raises if the rows are not those that were written."""
        m = self._manifest(name)
        for b, v in m["buckets"].items():
            got = self._sums(self._read(name, m, [b]).withColumn("_bucket", F.lit(int(b))))
            if [(r["rows"], r["checksum"]) for r in got] != [(v["rows"], v["checksum"])]:
                raise CorruptTableError(f"{name}: bucket {b} has changed")
