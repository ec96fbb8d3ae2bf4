"""Packing documents into token sequences by linear grouping, few-size configurations and best fit.

The plan depends only on how many pieces have each length (at most ``capacity`` counts, whatever the
corpus), so it is made on the driver:

1. linear grouping: pieces of at least ``small`` tokens, longest first, form groups of equal numbers
   of pieces, and each counts as long as its group's longest (there are at most ``capacity - small + 1``
   lengths, so rounding binds only where more pieces than a group holds differ in length: with the
   default of 4096 groups seldom, and fewer groups trade room for a smaller plan);
2. configurations of these few sizes: the longest size left is filled up by the best sum of the sizes
   still available, and used as often as the counts allow;
3. actual documents take the places of their group's size, which leaves the true room;
4. small pieces go, longest first, where the least room is left that holds them (best fit).

The plan is kept as runs "pieces of this length with ranks lo..hi go to sequences first, first + 1, ...,
so many to each" and joined with the pieces by length and block of ranks, so that neither a common
length nor a long run is gathered into one task; the runs are broadcast only if the planner finds their
written table small. Ranks within a length come from salted counts.

Ids are those of the ``tokenizers`` file as it is loaded: a text that holds the content of an added
token gets that token's id there.

Defined results: a null text is empty, and has one piece of the closing id alone; rows that repeat a
doc_id are packed each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, tidy

#: Runs that make byte-pair merging slow in tiktoken; texts with one go to tokenizers, which merges by a heap.
_LONG_RUN = re.compile(r"\S{4096}|\s{4096}")
#: Ranks of a length that one key of the join with the runs covers.
STRETCH = 65536
_workers: dict[tuple[str, str], Encoder] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a byte-level ``tokenizers`` file as uint32 arrays.

    The file's vocabulary, whose ids are its merge ranks, is given to tiktoken, which finds the same
    ids several times as fast. Texts with an added token or a very long run go to the file's tokenizer.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        self.added = [t["content"] for t in vocabulary["added_tokens"]]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary["model"]["vocab"].items() if t not in self.added}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added) or _LONG_RUN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process."""
    if (path, pattern) not in _workers:
        _workers[path, pattern] = Encoder(path, pattern)
    return _workers[path, pattern]


def _pieces(path: str, pattern: str, closing: int, capacity: int):
    tail = np.array([closing], "<u4")

    def pieces(record_batches):
        enc = encoder(path, pattern)
        for f in record_batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(f.column("text").to_pylist()):
                ids = np.concatenate([enc.encode(t or ""), tail]).astype("<u4")
                n = len(ids)
                a, c = 0, n if n <= capacity else (n % capacity or capacity)
                k = 0
                while a < n:
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(c - a)
                    crc.append(zlib.crc32(ids[a:c]))
                    a, c, k = c, c + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [f.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


class _Bins:
    """A run of ``n`` sequences filled alike: slots (length, rank of the first, offset, pieces in each) and the room left."""

    __slots__ = ("n", "room", "slots")

    def __init__(self, n: int, slots: list[tuple[int, int, int, int]], room: int):
        self.n, self.slots, self.room = n, slots, room

    def split(self, n: int) -> _Bins:
        """Takes the first ``n`` sequences off as a run of their own."""
        head = _Bins(n, list(self.slots), self.room)
        self.slots = [(length, lo + n * each, at, each) for length, lo, at, each in self.slots]
        self.n -= n
        return head

    def put(self, length: int, lo: int, capacity: int, each: int = 1) -> None:
        self.slots.append((length, lo, capacity - self.room, each))
        self.room -= length * each


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Groups of equal numbers of pieces, longest first: (rounded size, runs [length, count])."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append((length, []))
                room = each
            use = min(n, room)
            out[-1][1].append([length, use])
            n, room = n - use, room - use
    return out


def best_sum(room: int, sizes: list[int], left: dict[int, int]) -> dict[int, int]:
    """How many of each size (longest first) to use for the largest sum within ``room``; prefers long ones."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for s in sizes:
        most, k = min(left[s], room // s) if s <= room else 0, 1
        while most:
            use = min(k, most)
            steps.append((s, use, reach))
            reach |= (reach << (s * use)) & mask
            most, k = most - use, 2 * k
        if reach >> room & 1:
            break
    goal, chosen = reach.bit_length() - 1, {}
    for s, use, before in reversed(steps):
        if not before >> goal & 1:
            chosen[s] = chosen.get(s, 0) + use
            goal -= s * use
    return chosen


def plan(counts: dict[int, int], capacity: int = 1024, small: int = 64, groups: int = 4096) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, lo, hi, first sequence, offset, pieces in each) for the given numbers of pieces by length, and the number of sequences.

    The piece of rank r has place r - lo in its run: sequence first + place // each, offset + place % each * length.
    """
    large = linear_groups({k: n for k, n in counts.items() if n and small <= k <= capacity}, groups)
    queue: dict[int, list[list[int]]] = {}
    for size, runs in large:
        queue.setdefault(size, []).extend(runs)
    left = {s: sum(n for _, n in q) for s, q in queue.items()}
    rank = dict.fromkeys(counts, 0)
    bins: list[_Bins] = []
    while left:
        sizes = sorted(left, reverse=True)
        chosen = {sizes[0]: 1}
        left[sizes[0]] -= 1
        for s, n in best_sum(capacity - sizes[0], sizes, left).items():
            chosen[s] = chosen.get(s, 0) + n
        left[sizes[0]] += 1
        times = min(left[s] // n for s, n in chosen.items())
        made = [_Bins(times, [], capacity)]
        for s in sorted(chosen, reverse=True):
            left[s] -= times * chosen[s]
            if not left[s]:
                del left[s]
            for _ in range(chosen[s]):  # actual pieces for one place in each of these sequences
                due, done = list(made), []
                while due:
                    b = due.pop(0)
                    run = queue[s][0]
                    if run[1] < b.n:
                        due.insert(0, b)
                        b = b.split(run[1])
                    b.put(run[0], rank[run[0]], capacity)
                    rank[run[0]] += b.n
                    run[1] -= b.n
                    if not run[1]:
                        queue[s].pop(0)
                    done.append(b)
                made = done
        bins += made
    by_room: dict[int, list[_Bins]] = {}
    for b in bins:
        by_room.setdefault(b.room, []).append(b)
    for length in sorted((k for k in counts if 0 < k < small), reverse=True):
        n = counts[length]
        while n:
            room = min((r for r, b in by_room.items() if r >= length and b), default=capacity)
            b = by_room[room].pop() if by_room.get(room) else _Bins(-(-n // (capacity // length)), [], capacity)
            each = room // length
            if b.n * each > n:  # fewer pieces than these sequences hold
                take = max(1, n // each)
                if b.n > take:
                    head = b.split(take)
                    by_room.setdefault(room, []).append(b)
                    b = head
                each = min(each, n // take)
            b.put(length, rank[length], capacity, each)
            rank[length] += b.n * each
            n -= each * b.n
            by_room.setdefault(b.room, []).append(b)
    out, first = [], 0
    for b in (b for r in sorted(by_room) for b in by_room[r]):
        out += [(length, lo, lo + b.n * each, first, at, each) for length, lo, at, each in b.slots]
        first += b.n
    return out, first


def pack(docs: DataFrame, tokenizer: str, pattern: str, closing: int = 2, capacity: int = 1024, small: int = 64, groups: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level ``tokenizers`` file that every executor can read, ``pattern`` its splitting pattern.
    """
    spark = docs.sparkSession
    batches(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(_pieces(tokenizer, pattern, closing, capacity)), schema), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity, small, groups)
    # a length is dealt to as many salts as keep each at about STRETCH pieces; the table has at most `capacity` rows
    salts = spark.createDataFrame([(k, -(-n // STRETCH)) for k, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    by_salt = cut(salted.groupBy("length", "salt").count(), "lengths")
    base = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = by_salt.select("length", "salt", base.alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own"))
    ranked = ranked.withColumn("stretch", F.floor(F.col("rank") / STRETCH))
    table = cut(spark.createDataFrame(runs, "length long, lo long, hi long, first long, at long, each long"), "runs")
    table = table.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("lo") / STRETCH), F.floor((F.col("hi") - 1) / STRETCH))))
    placed = ranked.join(table, ["length", "stretch"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    place = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(place / F.col("each"))).alias("sequence_id"),
        (F.col("at") + place % F.col("each") * F.col("length")).alias("offset"),
    )
