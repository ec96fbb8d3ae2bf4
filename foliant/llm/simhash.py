"""Near duplicates by SimHash and covering locality-sensitive hashing.

Covering masks (radius r): every one of the 64 bits gets a vector of r + 1 random bits. Table v, one
for each nonzero v of r + 1 bits, keeps the bits whose vector has an odd inner product with v. For
any r bits some nonzero v is orthogonal to all their vectors, so two fingerprints that differ in at
most r bits agree on all kept bits of that table: 2^(r+1) - 1 tables lose no pair within the radius.

Only distinct fingerprints enter the tables. A bucket gives a spanning forest of its links, never
all pairs; a bucket of more than ``block`` fingerprints is joined exactly through the variants that
differ in r/2 bits or fewer (two fingerprints share one exactly when they are within r), in linear
space.

Defined results: a null text counts as empty; texts without words have fingerprint zero and link to
each other; rows that repeat a doc_id each get a row; a component of null ids only has id null.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, components, cut, parts, stay, tidy

#: Bits counted at once.
_CHUNK = 1 << 18


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash over shingles of ``words`` words of the text with A-Z lower-cased."""
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return 0
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    n = max(1, len(w) - words + 1)
    last = ends.tolist()[min(words, len(w)) - 1 :]
    return majority(np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n], last, strict=True)], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(radius: int, seed: int = 1) -> np.ndarray:
    """The 2^(radius+1) - 1 masks of a covering family over 64 bits."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), 64)
    masks = []
    for v in range(1, 1 << (radius + 1)):
        odd = [bin(int(x) & v).count("1") & 1 for x in vectors]
        masks.append(sum(1 << i for i, bit in enumerate(odd) if bit))
    return np.array(masks, np.uint64)


def _prints(words: int):
    def prints(record_batches):
        for f in record_batches:
            fps = np.array([fingerprint(t, words) for t in f.column("text").to_pylist()], np.uint64)
            keep = [c for c in f.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(f.column(c) for c in keep), pa.array(fps.view(np.int64))], [*keep, "fp"])

    return prints


def _tables(radius: int):
    def tables(frames):
        masks = covering_masks(radius)
        for f in frames:
            fps = f["fp"].to_numpy(np.int64).view(np.uint64)
            keys = (fps[:, None] & masks).view(np.int64)
            table = np.broadcast_to(np.arange(len(masks), dtype=np.int32), keys.shape)
            yield pd.DataFrame({"tab": table.ravel(), "key": keys.ravel(), "fp": np.repeat(f["fp"].to_numpy(), len(masks))})

    return tables


def _forest(fps: np.ndarray, radius: int, root: np.ndarray) -> None:
    """Joins in ``root`` (indices) all of ``fps`` within ``radius``, a block of rows at a time."""

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, (1 << 20) // len(fps))
    for at in range(0, len(fps), step):
        near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, :]) <= radius
        for i in range(len(near)):
            mates = np.flatnonzero(near[i])
            mates = mates[mates > at + i]
            mates = mates[root[mates] != root[at + i]]
            for j in mates:
                a, b = find(at + i), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)


def _buckets(radius: int, block: int):
    def close(tab, key, group, out):
        fps = np.concatenate(group)
        if len(fps) < 2:
            return
        if len(fps) == 2:
            if bin(int(fps[0] ^ fps[1])).count("1") <= radius:
                out.append((0, 0, int(fps[:1].view(np.int64)[0]), int(fps[1:].view(np.int64)[0])))
            return
        root = np.arange(len(fps))
        _forest(fps, radius, root)
        signed = fps.view(np.int64)
        out.extend((0, 0, int(signed[i]), int(signed[root[i]])) for i in np.flatnonzero(root != np.arange(len(fps))))

    def buckets(frames):
        """Rows come sorted by bucket. Output rows (tab, key, a, b): links, or (a = b) members of large buckets."""
        now, group, size = None, [], 0
        for f in frames:
            out: list[tuple] = []
            tabs, keys, fps = f["tab"].to_numpy(), f["key"].to_numpy(np.int64), f["fp"].to_numpy(np.int64).view(np.uint64)
            edges = np.flatnonzero((tabs[1:] != tabs[:-1]) | (keys[1:] != keys[:-1])) + 1
            for a, b in itertools.pairwise([0, *edges.tolist(), len(f)]):
                if (this := (tabs[a], keys[a])) != now:
                    if now and size <= block:
                        close(*now, group, out)
                    now, group, size = this, [], 0
                group.append(fps[a:b])
                size += b - a
                if size > block:
                    tab, key = now
                    out.extend((int(tab), int(key), int(x), int(x)) for g in group for x in g.view(np.int64))
                    group = []
            if out:
                yield pd.DataFrame(out, columns=["tab", "key", "a", "b"]).astype({"tab": "int32"})
        if now and size <= block:
            out = []
            close(*now, group, out)
            if out:
                yield pd.DataFrame(out, columns=["tab", "key", "a", "b"]).astype({"tab": "int32"})

    return buckets


def _variants(radius: int):
    def variants(frames):
        """Each member of a large bucket with all variants in at most radius / 2 of the bits its mask leaves open."""
        masks = covering_masks(radius)
        for f in frames:
            for tab, fp in zip(f["tab"], f["a"].to_numpy(np.int64).view(np.uint64), strict=True):
                open_bits = [np.uint64(1 << i) for i in range(64) if not int(masks[tab]) >> i & 1]
                flips = [np.uint64(0)]
                for k in range(1, radius // 2 + 1):
                    flips += [np.bitwise_or.reduce(c) for c in itertools.combinations(open_bits, k)]
                near = (fp ^ np.array(flips, np.uint64)).view(np.int64)
                yield pd.DataFrame({"tab": np.full(len(near), tab, np.int32), "near": near, "fp": np.full(len(near), fp, np.uint64).view(np.int64)})

    return variants


def fingerprint_links(prints: DataFrame, radius: int = 4, block: int = 16384) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly those within ``radius`` bits."""
    if radius % 2:
        raise ValueError("an even radius is needed for exact links in large buckets")
    spark = prints.sparkSession
    distinct = prints.select("fp").distinct()
    rows = distinct.mapInPandas(tidy(_tables(radius)), "tab int, key long, fp long")
    rows = rows.repartition(parts(spark), "tab", "key").sortWithinPartitions("tab", "key", "fp")
    batches(spark, 20000)  # rows of three numbers
    found = cut(rows.mapInPandas(tidy(_buckets(radius, block)), "tab int, key long, a long, b long"), "buckets")
    batches(spark)
    large = found.where("a = b").mapInPandas(_variants(radius), "tab int, near long, fp long")
    # two members that share a variant and the kept bits of a table are within the radius
    star = large.groupBy("tab", "near").agg(F.min("fp").alias("b"))
    by_variant = large.join(star, ["tab", "near"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return found.where("a <> b").select("a", "b").unionByName(by_variant)


def _classes(prints: DataFrame, radius: int, block: int) -> DataFrame:
    """(fp, root) of all distinct fingerprints; the root is any one of the component's."""
    roots = components(fingerprint_links(prints, radius, block))
    distinct = prints.select("fp").distinct()
    return cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "classes")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4, block: int = 16384) -> DataFrame:
    """``docs`` with only the row of the least doc_id (null last, then as read) of each component."""
    batches(docs.sparkSession)
    table = stay(docs, "near")
    rows = table.select("part", "idx", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    prints = cut(rows.mapInArrow(tidy(_prints(words)), "part int, idx long, doc_id long, fp long"), "prints")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "part", "idx")
    best = prints.groupBy("fp").agg(F.min(order).alias("best")).join(_classes(prints, radius, block), "fp").groupBy("root").agg(F.min("best").alias("best"))
    return table.join(best.select("best.part", "best.idx"), ["part", "idx"], "left_semi").select("row.*")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, block: int = 16384) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    batches(docs.sparkSession)
    prints = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_prints(words)), "doc_id long, fp long"), "prints")
    classes = _classes(prints, radius, block)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
