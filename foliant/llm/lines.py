"""Line dedup by a deletion-neighbourhood join within one edit.

A line counts once trimmed of ASCII white space, if it then has at least ``min_chars`` code points;
shorter ones always stay. Lines are ordered by (doc_id, number); a line goes if an earlier one equals
it or lies within one insertion, deletion or substitution, whether or not that one stays itself.

Equal lines meet by a 128-bit cryptographic digest, and each distinct line gets a number. Of the distinct lines only those that share a half with another
(an edit leaves the first or the second half whole, whatever the lengths) can have a near one; these
suspects emit all variants within the bound as hashed keys: the line itself, each deletion, and each
deletion with its place. Two lines meet under a deletion with its place exactly if one substitution
parts them, and a line meets another's deletion exactly if one insertion does. Keys that only one line
has are told by their neighbours in key order; keys that a sample shows to be very common are known to be
shared, and their rows are dealt out by line. Per key only the earliest line of each kind is kept, by
partial minima, never pairs; the text of each line and its earliest mate is then
compared by edit distance.

Defined results: a null text stays null, with 0 lines; a document whose lines all go has an empty
text; rows that repeat a doc_id are ordered as read; null ids come last; an empty table gives an
empty result; extra columns pass through ``dedup_lines`` untouched, but n_lines and n_removed are its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, stay, tidy

WHITE_CHARS = " \t\n\x0b\f\r"
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64)]
#: One in so many lines or texts tells which keys are hot.
SAMPLED = 32


def _powers_to(n: int) -> np.ndarray:
    while len(_powers[0]) < n:
        p = _powers[0]
        _powers[0] = np.concatenate([p, p * np.uint64(pow(_BASE, len(p), 1 << 64))])
    return _powers[0][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def half_keys(line: str) -> list[int]:
    """Keys of which two lines within one edit share one: a half's hash and the shorter line's length."""
    n, out = len(line), []
    for shorter in (n, n - 1):
        m = shorter // 2
        for side, half in enumerate((line[:m], line[n - m :])):
            out.append(xxhash.xxh64_intdigest(half.encode("utf-8"), 2 * shorter + side) - (1 << 63))
    return out


def variant_keys(line: str) -> tuple[np.ndarray, np.ndarray]:
    """(kinds, keys): 0 the line itself, 1 its deletions, 2 its deletions with their place."""
    c = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(c)
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * _powers_to(n), dtype=np.uint64)])
    less = pre[:n] + (pre[n] - pre[1:]) * np.uint64(_BASE_INVERSE)
    own = mixed(pre[n:] ^ mixed(np.array([n], np.uint64)))
    less = mixed(less ^ mixed(np.array([n - 1], np.uint64)))
    placed = mixed(less * np.uint64(3) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE))
    once = np.unique(less)
    kinds = np.repeat(np.array([0, 1, 2], np.int8), [1, len(once), n])
    return kinds, np.concatenate([own, once, placed]).view(np.int64)


def _lines(min_chars: int):
    def lines(record_batches):
        for f in record_batches:
            row, no, h1, h2, keys = [], [], [], [], []
            for i, text in enumerate(f.column("text").to_pylist()):
                for k, line in enumerate((text or "").split("\n")):
                    line = line.strip(WHITE_CHARS)
                    if len(line) >= min_chars:
                        h = hashlib.blake2b(line.encode("utf-8"), digest_size=16).digest()
                        row.append(i)
                        no.append(k)
                        h1.append(int.from_bytes(h[:8], "little", signed=True))
                        h2.append(int.from_bytes(h[8:], "little", signed=True))
                        keys.append(half_keys(line))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(f.column(c).take(at) for c in ("part", "idx", "doc_id")), pa.array(no, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["part", "idx", "doc_id", "no", "h1", "h2", "keys"],
            )

    return lines


def _variants(record_batches):
    def batch(parts):
        ids, kinds, keys = zip(*parts, strict=True)
        line = np.repeat(np.array(ids, np.int64), [len(k) for k in kinds])
        return pa.RecordBatch.from_arrays([pa.array(line), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys))], ["line", "kind", "key"])

    for f in record_batches:
        parts, size = [], 0
        for text, marked in zip(f.column("text").to_pylist(), f.column("marked").to_pylist(), strict=True):
            lines = text.split("\n")
            for m in marked:
                parts.append((m["line"], *variant_keys(lines[m["no"]].strip(WHITE_CHARS))))
                size += len(parts[-1][1])
                if size > 500_000:
                    yield batch(parts)
                    parts, size = [], 0
        if parts:
            yield batch(parts)


def hot_keys(sample: DataFrame, share: float = 1e-4, least: int = 50) -> DataFrame:
    """Keys that hold the given share of a sample's rows (line, key), and ``least`` rows: at most 1 / ``share`` of them."""
    total = sample.count()
    return cut(sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, share * total)).select("key"), "hot")


def _shared(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows (line, key, …) whose key another row has too: one shuffle and a sorted pass that keeps no group.

    Rows of the keys in ``hot`` are shared for certain; they are dealt out by line, so that no key is gathered.
    """
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("line"), F.lit(4096))).otherwise(0).cast("short")
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "key", "left").withColumn("_salt", salt)  # a bounded table
    w = Window.partitionBy("key", "_salt").orderBy("line")
    near = marked.withColumn("_b", F.lag("line").over(w)).withColumn("_a", F.lead("line").over(w))
    return near.where("_a is not null or _b is not null or _hot").select(rows.columns)


def removed_lines(table: DataFrame, min_chars: int = 10) -> DataFrame:
    """(part, idx, removed array<int>) of the rows of a table made by ``stay`` that lose lines."""
    lines = cut(
        table.select("part", "idx", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text")).where("text is not null").mapInArrow(
            tidy(_lines(min_chars)), "part int, idx long, doc_id long, no int, h1 long, h2 long, keys array<long>"
        ), "lines",
    )
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("no").alias("n"), F.col("part").alias("p"), F.col("idx").alias("i"))
    distinct = lines.groupBy("h1", "h2").agg(F.min(order).alias("at"), F.count("*").alias("times"), F.min("keys").alias("keys"))
    distinct = cut(distinct.withColumn("line", F.monotonically_increasing_id()), "distinct")
    some = F.pmod(F.xxhash64("h1"), F.lit(SAMPLED)) == 0  # where a sample is enough: it only tells which keys are hot
    halves = distinct.select("line", F.explode("keys").alias("key"))
    suspects = _shared(halves, hot_keys(distinct.where(some).select("line", F.explode("keys").alias("key")))).select("line").distinct()
    marked = distinct.select("line", "at").join(suspects, "line", "left_semi").groupBy(F.col("at.p").alias("part"), F.col("at.i").alias("idx")).agg(F.collect_list(F.struct(F.col("at.n").alias("no"), "line")).alias("marked"))
    texts = cut(table.select("part", "idx", F.col("row.text").cast("string").alias("text")).join(marked, ["part", "idx"]).select("text", "marked"), "marked")
    # (line, text) of the suspects, for the edit distance
    own = texts.select(F.split("text", "\n").alias("l"), F.explode("marked").alias("m")).select(F.col("m.line").alias("line"), F.trim(F.element_at("l", F.col("m.no") + 1), F.lit(WHITE_CHARS)).alias("said"))
    variants = lambda t: t.mapInArrow(tidy(_variants), "line long, kind byte, key long")
    hot = hot_keys(variants(texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)).select("line", "key"))
    met = cut(_shared(variants(texts), hot).join(distinct.select("line", "at"), "line").withColumn("who", F.struct("at", "line")), "met")
    first = met.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, F.col("who"))).alias(f"w{k}") for k in (0, 1, 2)])
    mate = F.when(F.col("kind") == 0, F.col("w1")).when(F.col("kind") == 1, F.col("w0")).otherwise(F.col("w2"))
    pairs = met.join(first, "key").withColumn("mate", mate).where("mate.at < at").select("line", F.col("mate.line").alias("mate")).distinct()
    near = pairs.join(own, "line").join(own.select(F.col("line").alias("mate"), F.col("said").alias("other")), "mate")
    near = near.where(F.levenshtein("said", "other", 1).between(0, 1)).select("line").distinct().withColumn("near", F.lit(True))
    gone = distinct.join(near, "line", "left").where("times > 1 or near").select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near"))
    lost = lines.join(gone, ["h1", "h2"]).where(F.col("near") | ~((F.col("at.p") == F.col("part")) & (F.col("at.i") == F.col("idx")) & (F.col("at.n") == F.col("no"))))
    return lost.groupBy("part", "idx").agg(F.array_sort(F.collect_list("no")).alias("removed"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with duplicate lines taken out of its texts, and columns n_lines and n_removed."""
    spark = docs.sparkSession
    batches(spark)
    table = stay(docs, "lines")
    lost = cut(removed_lines(table, min_chars), "lost")
    whole = table.join(lost, ["part", "idx"], "left")
    line = F.split(F.col("row.text").cast("string"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(line) - 1), F.col("removed"))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(line, i + 1)), "\n"))
    counts = [F.when(F.col("row.text").isNull(), 0).otherwise(F.size(line)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed")]
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return whole.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in own], *counts)


LINES_SQL = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, n, trim(lines[n + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS n FROM raw)),
c AS (SELECT *, row_number() OVER (ORDER BY doc_id, n) AS o FROM l WHERE length(s) >= 10),
d AS (SELECT s, min(o) AS o FROM c GROUP BY s),
v AS (SELECT s, o, i, hash(substr(s, 1, i - 1) || substr(s, i + 1)) AS v FROM (SELECT s, o, unnest(range(1, length(s) + 1)) AS i FROM d)),
p AS (SELECT o, min(o) OVER (PARTITION BY v, i) AS b FROM v
  UNION ALL SELECT v.o, d.o FROM v JOIN (SELECT hash(s) AS v, o FROM d) d ON v.v = d.v
  UNION ALL SELECT d.o, v.o FROM v JOIN (SELECT hash(s) AS v, o FROM d) d ON v.v = d.v),
near AS (SELECT DISTINCT o FROM p WHERE b < o),
k AS (SELECT c.doc_id, c.n FROM c JOIN d USING (s) WHERE c.o <> d.o OR d.o IN (SELECT o FROM near)),
g AS (SELECT doc_id, list(n) AS gone FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT list_contains(gone, i)], chr(10)) END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM raw LEFT JOIN g USING (doc_id)
"""
