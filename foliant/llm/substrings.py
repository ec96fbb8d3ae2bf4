"""Repeated substrings by longest-previous-factor arrays over sparse suffixes.

Every string of ``length`` bytes holds an anchor: the rightmost of its k-grams with the least hash.
Equal strings hold the same anchor at the same place, so only anchors that occur twice need a look,
and only the bytes around them (at most ``length`` on either side) travel, grouped by anchor.

Within a group the suffixes that start at an anchor are sorted, with the lengths of the common
prefixes of neighbours, byte by byte. From these the order and the common prefixes of the suffixes
that start one byte earlier are induced, down to the first that can hold the anchor. For each start
the previous and the next smaller position in suffix order (those of earlier members) give each
suffix's longest previous factor. A string is a repeat where that reaches ``length``; the earliest of
equal strings, which has none, is the one that such a suffix's smaller position points at.

A group of more than ``block`` anchors is split: the span of its starts is halved, members fall apart
by the bytes that all strings of a half share, and members whose bytes agree throughout a half are
merged into their earliest one, until no group is larger. At a single start the shared bytes are the
string, so every group ends. No group is gathered into one task beyond ``block`` members.

Texts equal as wholes are one text with a count. A stretch that repeats itself with a short period is
resolved within its text. Long texts are hashed in segments, so the working memory has a bound.

Defined results: a null text is empty; texts under ``length`` bytes lose nothing; rows that repeat a
doc_id each get a row; with ``keep_first`` the earliest by doc_id (null last), then as read, stays;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, parts, stay, tidy
from .lines import mixed

GRAM = 96
_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)
_SLOT = np.uint64((1 << 22) - 1)
#: Bytes hashed at once; longer texts go in segments that overlap by a string.
SEGMENT = 1 << 21
_MEMBERS = 8192
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    p = _tables.get(base, np.ones(1, np.uint64))
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    _tables[base] = p
    return p[:n]


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all strings of ``length`` bytes of ``data``."""
    if len(data) <= SEGMENT:
        return _segment_anchors(data, length)
    step = SEGMENT - length + 1  # each string lies in a segment
    each = [(k, *_segment_anchors(data[k : k + SEGMENT], length)) for k in range(0, len(data) - length + 1, step)]
    at, first = np.unique(np.concatenate([k + a for k, a, _ in each]), return_index=True)
    return at, np.concatenate([h for _, _, h in each])[first]


def _segment_anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    n, w = len(data) - GRAM + 1, length - GRAM + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * _powers(_B, len(c)), dtype=np.uint64)])
    h = mixed((pre[GRAM:] - pre[:-GRAM]) * _powers(_B_INVERSE, n))
    # sliding minimum of (hash, later position first) over w grams, from block-wise running minima
    key = (h & ~_SLOT) | (_SLOT - np.arange(n, dtype=np.uint64))
    blocks = -(-n // w)
    padded = np.full(blocks * w, ~np.uint64(0), np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    at = np.unique((_SLOT - (least & _SLOT)).astype(np.int64))
    return at, h[at].view(np.int64)


def periodic(data: bytes, at: np.ndarray, h: np.ndarray, length: int, keep_first: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Stretches of ``data`` that repeat themselves, as intervals to remove, and which anchors are still needed."""
    need, out = np.ones(len(at), bool), []
    if len(at) < 2:
        return out, need
    same = h[1:] == h[:-1]
    if not same.any():
        return out, need
    gaps, i, b = np.diff(at), 0, np.frombuffer(data, np.uint8)
    while i < len(same):
        if not same[i]:
            i += 1
            continue
        j, p = i, int(gaps[i])
        while j + 1 < len(same) and same[j + 1] and gaps[j + 1] == p:
            j += 1
        start, end = int(at[i]), int(at[j + 1]) + GRAM
        if end - start >= length + p and (b[start + p : end] == b[start : end - p]).all():
            out.append((start + p * keep_first, end))
            need[(at >= start + p + length) & (at <= end - length - 1)] = False
        i = j + 1
    return out, need


def _prepare(length: int, keep_first: bool):
    def prepare(record_batches):
        for f in record_batches:
            sha, size, pos, hashes, own = [], [], [], [], []
            for t in f.column("text").to_pylist():
                data = (t or "").encode("utf-8")
                at, h = anchors(data, length)
                spans, need = periodic(data, at, h, length, keep_first)
                sha.append(hashlib.sha256(data).hexdigest())
                size.append(len(data))
                pos.append(at[need].tolist())
                hashes.append(h[need].tolist())
                own.append([{"start": a, "end": b} for a, b in spans])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(f.column(c) for c in ("part", "idx", "doc_id")), pa.array(sha, pa.string()), pa.array(size, pa.int64()), pa.array(pos, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64())), pa.array(own, span)],
                ["part", "idx", "doc_id", "sha", "n_bytes", "pos", "h", "own"],
            )

    return prepare


def _halves(length: int):
    """Members of hot groups once per half of their starts: key of the bytes that all its strings share, digest of all its bytes."""
    back = length - GRAM

    def halves(record_batches):
        names = ["key", "part", "idx", "d", "pos", "lo", "hi", "first", "last", "digest"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for f in record_batches:
            rows: list[tuple] = []
            for t, part, idx, d, marked in zip(*(f.column(c).to_pylist() for c in ("text", "part", "idx", "d", "marked")), strict=True):
                data = t.encode("utf-8")
                for m in marked:
                    base, mid = m["pos"] - back, (m["lo"] + m["hi"]) // 2
                    for lo, hi in ((m["lo"], mid), (mid + 1, m["hi"])):
                        # the starts of this text that lie in the half
                        a, b = max(lo, -base), min(hi, len(data) - length - base)
                        if a <= b:
                            core, whole = data[base + hi : base + lo + length], data[max(0, base + lo) : base + hi + length]
                            key = xxhash.xxh64_intdigest(core, lo) - (1 << 63)
                            rows.append((key, part, idx, d, m["pos"], lo, hi, a, b, hashlib.blake2b(whole, digest_size=16, key=b"%d:%d" % (a - lo, b - lo)).digest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    return halves


def _contexts(length: int):
    """The bytes that the strings of each marked member can cover; ``left`` of them come before the last start."""
    back = length - GRAM

    def contexts(record_batches):
        names = ["h", "part", "idx", "d", "pos", "lo", "hi", "left", "ctx"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for f in record_batches:
            rows: list[tuple] = []
            size = 0
            for t, part, idx, d, marked in zip(*(f.column(c).to_pylist() for c in ("text", "part", "idx", "d", "marked")), strict=True):
                data = t.encode("utf-8")
                for m in marked:
                    last = m["pos"] - back + m["hi"]
                    a = max(0, last - (m["hi"] - m["lo"]))
                    ctx = data[a : last + length]
                    rows.append((m["h"], part, idx, d, m["pos"], m["lo"], m["hi"], last - a, ctx))
                    size += len(ctx)
                    if size > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    return contexts


def smaller_position(place: np.ndarray, lcp: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order: the nearest one before it with a smaller place (below 0: none), and their common prefix.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i. Found by steps of falling powers of two over
    running minima, for all suffixes at once, as far as 2 ** levels - 1 suffixes away.
    """
    least, low = [place], [lcp]
    for k in range(levels - 1):
        s = 1 << k
        for t in (least, low):
            wide = t[-1].copy()
            wide[s:] = np.minimum(wide[s:], t[k][:-s])
            t.append(wide)
    at, common = np.arange(len(place)) - 1, lcp.copy()
    for k in range(levels - 1, -1, -1):
        here = np.maximum(at, 0)
        skip = (at >= 0) & (least[k][here] > place)
        common = np.where(skip, np.minimum(common, low[k][here]), common)
        at = np.where(skip, at - (1 << k), at)
    return at, np.where(at >= 0, common, 0)


def longest_previous(place: np.ndarray, lcp: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors of suffixes in order, and for each the suffix of smaller place that has it."""
    before, common = smaller_position(place, lcp, levels)
    back = np.append(lcp[1:], 0)[::-1]
    after, other = smaller_position(place[::-1], np.concatenate([[0], back[1:]]) if len(back) else back, levels)
    after, other = len(place) - 1 - after[::-1], other[::-1]
    return np.maximum(common, other), np.where(common >= other, before, after)


def repeated_starts(group: np.ndarray, ctx: list[bytes], left: np.ndarray, width: int, place: np.ndarray, length: int, keep_first: bool) -> np.ndarray:
    """Marks [member, k]: whether the string that starts ``k`` bytes after a member's first start is to go.

    ``group`` numbers the members' groups, ``left`` is where in ``ctx`` the last of the ``width + 1`` starts
    lies, ``place`` ranks members by position.
    """
    n = len(ctx)
    grid = np.zeros((n, width + length), np.uint8)
    for i, (c, a) in enumerate(zip(ctx, left.tolist(), strict=True)):
        grid[i, width - a : width - a + len(c)] = np.frombuffer(c, np.uint8)
    begin = width - left
    rest = np.fromiter(map(len, ctx), np.int64, n) - left
    suffixes = [c[a:] for c, a in zip(ctx, left.tolist(), strict=True)]
    g = group.astype(np.int64)
    by = np.array(sorted(range(n), key=lambda i: (g[i], suffixes[i])), np.int64)
    lcp = np.zeros(n, np.int64)
    for i in range(1, n, 1024):  # common prefixes of neighbours at the last start, from the bytes
        b, a = by[i : i + 1024], by[i - 1 : i - 1 + min(1024, n - i)]
        differ = grid[a, width:] != grid[b, width:]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        lcp[i : i + 1024] = np.where(g[a] == g[b], np.minimum(same, np.minimum(rest[a], rest[b])), 0)
    cols = np.ascontiguousarray(grid[:, :width].T)
    marks = np.zeros((width + 1, n), bool)
    rank = np.empty(n, np.int64)
    for o in range(width, -1, -1):
        if o < width:
            rank[by] = np.arange(n)
            symbol = np.where(o >= begin, cols[o].astype(np.int64) + 1, 0)
            order = np.argsort((g * 257 + symbol) * n + rank)
            # neighbours with the same byte share one more than all that lay between them did
            one, two = rank[order[:-1]] + 1, rank[order[1:]]
            ok = (symbol[order[1:]] > 0) & (symbol[order[1:]] == symbol[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
            one, two = one[ok], two[ok]
            k = np.frexp(two - one + 1)[1] - 1
            low = [lcp]
            for j in range(int(k.max()) if len(k) else 0):
                wide = low[j].copy()
                wide[: -(1 << j)] = np.minimum(wide[: -(1 << j)], low[j][1 << j :])
                low.append(wide)
            table = np.stack(low)
            lcp = np.zeros(n, np.int64)
            lcp[1:][ok] = 1 + np.minimum(table[k, one], table[k, two - (1 << k) + 1])
            by = order
        near = lcp >= length
        if near.any():  # only suffixes that share a string with a neighbour have a factor of its length
            held = np.flatnonzero(near | np.append(near[1:], False))
            longest = int(np.diff(np.flatnonzero(np.concatenate([[True], ~near, [True]]))).max())
            factor, source = longest_previous(place[by[held]], lcp[held], longest.bit_length())
            go = factor >= length
            if not keep_first:
                go[source[go]] = True
            marks[o, by[held]] = go
    return marks.T


def _runs(length: int, keep_first: bool):
    back = length - GRAM

    def close(rows: list[tuple]):
        out = []
        for (lo, hi), some in itertools.groupby(sorted(rows, key=lambda r: (r[5], r[6])), key=lambda r: (r[5], r[6])):
            h, part, idx, d, pos, _, _, left, ctx = (list(c) for c in zip(*some, strict=True))
            number = {x: k for k, x in enumerate(dict.fromkeys(h))}
            place = np.empty(len(h), np.int64)
            place[np.lexsort((pos, idx, part, d))] = np.arange(len(h))
            marks = repeated_starts(np.array([number[x] for x in h]), ctx, np.array(left), hi - lo, place, length, keep_first)
            edge = np.zeros((len(h), 1), bool)
            member, k = np.nonzero(np.diff(np.hstack([edge, marks, edge]).astype(np.int8), axis=1))
            a, b = k[::2], k[1::2] - 1
            i = member[::2]
            base = np.array(pos)[i] - back + lo
            out.append(pd.DataFrame({"part": np.array(part, np.int32)[i], "idx": np.array(idx)[i], "start": base + a, "end": base + b + length}))
        return pd.concat(out)

    def runs(frames):
        """Rows come sorted by group; groups are taken together until enough members have gathered."""
        rows: list[tuple] = []
        for f in frames:
            for h, some in itertools.groupby(f[["h", "part", "idx", "d", "pos", "lo", "hi", "left", "ctx"]].itertuples(index=False, name=None), key=lambda r: r[0]):
                if len(rows) >= _MEMBERS and rows[-1][0] != h:
                    yield close(rows)
                    rows = []
                rows.extend(some)
        if rows:
            yield close(rows)

    return runs


def _cut_out(record_batches):
    for f in record_batches:
        removed, spans, sha = [], [], []
        for t, own in zip(f.column("text").to_pylist(), f.column("spans").to_pylist(), strict=True):
            data, kept, at, n, k = t.encode("utf-8"), hashlib.sha256(), 0, 0, 0
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in own):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                kept.update(data[at:a])
                n, k, at = n + b - a, k + 1, b
            kept.update(data[at:])
            removed.append(n)
            spans.append(k)
            sha.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([f.column("part"), f.column("idx"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["part", "idx", "removed", "runs", "kept"])


def _around(table: DataFrame, members: DataFrame, *fields: str) -> DataFrame:
    """The texts of members with an array of their members."""
    marked = members.groupBy("part", "idx", "d").agg(F.collect_list(F.struct(*fields)).alias("marked"))
    return table.select("part", "idx", "text").join(marked, ["part", "idx"])


def repeated_spans(docs: DataFrame, length: int = 400, keep_first: bool = False, block: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, facts, spans): the stored rows, per row its hash and whether it goes as a copy, and byte spans to remove of the others."""
    if length < GRAM + 1:
        raise ValueError(f"length must exceed {GRAM}")
    spark = docs.sparkSession
    batches(spark)
    table = stay(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "texts").select("part", "idx", "row.*")
    schema = "part int, idx long, doc_id long, sha string, n_bytes long, pos array<long>, h array<long>, own array<struct<start:long,end:long>>"
    facts = cut(table.mapInArrow(tidy(_prepare(length, keep_first)), schema), "anchors")
    d = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    same = facts.groupBy("sha").agg(F.min(F.struct(d.alias("d"), "part", "idx")).alias("first"), F.count("*").alias("copies"))
    facts = facts.join(same, "sha")
    is_first = (F.col("first.part") == F.col("part")) & (F.col("first.idx") == F.col("idx"))
    facts = cut(facts.withColumn("is_first", is_first).withColumn("d", d).drop("first"), "facts")

    each = facts.where("is_first and size(h) > 0").select("part", "idx", "d", F.explode(F.arrays_zip("pos", "h")).alias("a"))
    each = each.select("part", "idx", "d", F.col("a.pos").alias("pos"), F.col("a.h").alias("h"))
    # counted by partial sums; a hot anchor can be split in the join
    times = cut(each.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "times")
    again = cut(each.join(times, "h").withColumns({"lo": F.lit(0), "hi": F.lit(length - GRAM)}), "again")
    own = facts.where("is_first and size(own) > 0").select("part", "idx", F.explode("own").alias("o")).select("part", "idx", "o.start", "o.end")
    spans, columns = [own], ["part", "idx", "d", "pos", "lo", "hi", "h"]
    small = [again.where(F.col("times") <= block).select(columns)]
    hot = again.where(F.col("times") > block)
    while not hot.isEmpty():  # at most as often as the span of starts can be halved
        schema = "key long, part int, idx long, d long, pos long, lo int, hi int, first int, last int, digest binary"
        halves = cut(_around(table, hot, "pos", "lo", "hi").mapInArrow(tidy(_halves(length)), schema), "halves")
        least = F.min(F.struct("d", "part", "idx", "pos", "lo", "hi")).alias("least")
        merged = cut(halves.groupBy("key", "digest").agg(least, F.count("*").alias("alike")), "merged")
        # all strings of members that agree throughout are repeats; their earliest speaks for them from here on
        alike = halves.join(merged.where("alike > 1"), ["key", "digest"])
        if keep_first:
            alike = alike.where(F.struct("d", "part", "idx", "pos", "lo", "hi") != F.col("least"))
        base = F.col("pos") - (length - GRAM)
        spans.append(alike.select("part", "idx", (base + F.col("first")).alias("start"), (base + F.col("last") + length).alias("end")))
        sizes = merged.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
        left = cut(merged.join(sizes, "key").select("least.*", F.col("key").alias("h"), "times"), "left")
        small.append(left.where(F.col("times") <= block).select(columns))
        hot = left.where(F.col("times") > block)
    members = functools.reduce(DataFrame.unionByName, small)
    context = _around(table, members, "h", "pos", "lo", "hi").mapInArrow(
        tidy(_contexts(length)), "h long, part int, idx long, d long, pos long, lo int, hi int, left int, ctx binary"
    )
    dealt = context.repartition(parts(spark), "h").sortWithinPartitions("h")
    spans.append(dealt.mapInPandas(tidy(_runs(length, keep_first)), "part int, idx long, start long, end long"))
    return table, facts, functools.reduce(DataFrame.unionByName, spans)


def remove_repeats(docs: DataFrame, length: int = 400, keep_first: bool = False, block: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    table, facts, spans = repeated_spans(docs, length, keep_first, block)
    whole = (F.col("n_bytes") >= length) & (F.col("copies") > 1) & (~F.col("is_first") if keep_first else F.lit(True))
    by_row = spans.groupBy("part", "idx").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    part_way = table.select("part", "idx", "text").join(by_row, ["part", "idx"]).mapInArrow(tidy(_cut_out), "part int, idx long, removed long, runs long, kept string")
    # a copy of a text whose first row is judged part way shares its fate only if it doesn't go as a whole
    done = facts.join(part_way, ["part", "idx"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    pick = lambda all_, some, none: F.when(whole, all_).when(F.col("removed").isNotNull(), some).otherwise(none)
    return done.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("runs"), F.lit(0)).cast("long").alias("n_spans"), pick(F.lit(nothing), F.col("kept"), F.col("sha")).alias("kept_sha256"),
    )
