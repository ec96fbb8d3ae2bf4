"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Senders (input partitions) keep their rows in a table bucketed by sender. Each sends its distinct
fingerprints, sorted and Golomb-Rice coded, to the owners of ranges of fingerprints; owners answer
with one bit per fingerprint, set if any other row has it. Only rows with a set bit, the suspects,
are shuffled, and only once per sender and text: grouping by the bytes themselves verifies them.

Defined results: a null text counts as empty and empty texts equal each other; of rows that agree
in text, length and doc_id exactly one stays; a null doc_id stays only if no equal-length row has
one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, folders, parts, shared_dir, tables

#: Fingerprints that one owner gets, about.
OWNED = 1 << 20
WHITE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as Golomb-Rice codes of their gaps: count, parameter, unary quotients, binary remainders."""
    n = len(values)
    if n == 0:
        return np.array([0, 0], "<u8").tobytes()
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(values[-1] // np.uint64(n)).bit_length() - 1)
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.array([n, k], "<u8").tobytes() + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    n, k = (int(x) for x in np.frombuffer(code, "<u8", 2))
    if n == 0:
        return np.zeros(0, np.uint64)
    rest_bytes = (n * k + 7) // 8
    body = np.frombuffer(code, np.uint8, offset=16)
    ends = np.flatnonzero(np.unpackbits(body[: len(body) - rest_bytes]) == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(body[len(body) - rest_bytes :], count=n * k).reshape(n, k) if k else np.zeros((n, 0), np.uint8)
    low = (rest.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((q.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def _senders(record_batches):
    part, at = TaskContext.get().partitionId(), 0
    for f in record_batches:
        texts = ["" if t is None else t for t in f.column("text").to_pylist()]
        norms = [t.encode("utf-8").translate(None, WHITE_BYTES) for t in texts]
        n = len(texts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64)), f.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                pa.array(np.array([xxhash.xxh64_intdigest(b) for b in norms], np.uint64).view(np.int64)), pa.array([hashlib.sha256(b).hexdigest() for b in norms], pa.string()), pa.array(norms, pa.binary()),
            ],
            ["part", "idx", "doc_id", "n_cp", "fp", "sha", "norm"],
        )
        at += n


def _owner_bounds(owners: int) -> np.ndarray:
    return np.array([(i << 64) // owners for i in range(1, owners)], np.uint64)


def _send(owners: int):
    def send(f: pd.DataFrame) -> pd.DataFrame:
        fps, counts = np.unique(f["fp"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        cuts = np.searchsorted(fps, _owner_bounds(owners))
        out = []
        for owner, (a, c) in enumerate(zip([0, *cuts], [*cuts, len(fps)], strict=True)):
            if c > a:
                out.append((int(f["part"].iloc[0]), owner, golomb_encode(fps[a:c]), np.packbits(counts[a:c] > 1).tobytes()))
        return pd.DataFrame(out, columns=["part", "owner", "codes", "local"])

    return send


def _answer(f: pd.DataFrame) -> pd.DataFrame:
    """An owner sees each fingerprint at most once per sender; one of two senders, or doubled in one, is a suspect."""
    lists = [golomb_decode(c) for c in f["codes"]]
    local = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(x)).astype(bool) for b, x in zip(f["local"], lists, strict=True)]
    fps, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = fps[counts > 1]
    marks = [np.packbits(own | np.isin(x, twice, assume_unique=True)).tobytes() for own, x in zip(local, lists, strict=True)]
    return pd.DataFrame({"part": f["part"], "owner": f["owner"], "marks": marks})


def _rows_marked(owners: int):
    def rows_marked(f: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Turns the owners' bits on sorted fingerprints into one bit per row of the sender."""
        if not len(f):
            return pd.DataFrame({"part": [], "bits": []})
        fps = f["fp"].to_numpy(np.int64).view(np.uint64)
        own = np.unique(fps)
        cuts = [0, *np.searchsorted(own, _owner_bounds(owners)), len(own)]
        hit = np.zeros(len(own), bool)
        for owner, marks in zip(answers["owner"], answers["marks"], strict=True):
            a, c = cuts[owner], cuts[owner + 1]
            hit[a:c] = np.unpackbits(np.frombuffer(marks, np.uint8), count=c - a)
        bits = np.zeros(int(f["idx"].max()) + 1, bool)
        bits[f["idx"].to_numpy()] = hit[np.searchsorted(own, fps)]
        return pd.DataFrame({"part": f["part"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    return rows_marked


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_senders, "part int, idx long, doc_id long, n_cp long, fp long, sha string, norm binary")
    n, key = max(1, min(4096, parts(spark))), uuid.uuid4().hex
    rows.write.bucketBy(n, "part").option("path", f"{shared_dir(spark)}/foliant/{key}-senders").saveAsTable(f"foliant_senders_{key}")
    tables.append(f"foliant_senders_{key}")
    folders.append(f"{shared_dir(spark)}/foliant/{key}-senders")
    table = spark.table(f"foliant_senders_{key}")

    owners = max(n, -(-table.count() // OWNED))
    sent = table.select("part", "fp").groupBy("part").applyInPandas(_send(owners), "part int, owner int, codes binary, local binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "part int, owner int, marks binary")
    bits = table.select("part", "idx", "fp").groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_rows_marked(owners), "part int, bits binary")
    byte = F.conv(F.hex(F.expr("substring(bits, int(idx div 8) + 1, 1)")), 16, 10).cast("int")
    suspects = table.join(bits.hint("shuffle_hash"), "part").where(byte.bitwiseAND(F.expr("shiftleft(1, int(7 - idx % 8))")) != 0)
    best = F.min(F.struct((-F.col("n_cp")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "part", "idx"))
    groups = suspects.groupBy("sha", "norm").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1").drop("norm")
    found = table.select("part", "idx", "doc_id", "sha").join(groups, "sha", "left")
    first = F.col("best").isNull() | ((F.col("best.part") == F.col("part")) & (F.col("best.idx") == F.col("idx")))
    return found.select(
        "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), first.alias("kept"), F.col("sha").alias("text_sha256"),
    )
