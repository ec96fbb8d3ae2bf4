"""Near duplicates by SimHash with covering masks, and exact similarity of word-shingle sets.

A document is the set of its shingles of ``words`` words (A-Z lower-cased; one shingle if it has fewer
words). Two documents are near duplicates at a Jaccard similarity of ``least`` or more, and a group is
a connected component of that relation.

Candidates: sets whose 64-bit SimHash fingerprints differ in ``radius`` bits or fewer, by the covering
masks of ``simhash``, none of which is lost. Within 4 bits fall pairs at a similarity of 0.8, 0.9 and 0.95
with a probability of about 0.03, 0.19 and 0.50 only, and masks for the radius that 0.8 needs would be many
thousands. So that no pair beyond the radius is lost, sets that share a band of MinHash are candidates too:
32 band keys of 5 minima each. A pair at similarity s shares none with a probability of (1 - s^5)^32: 3.0e-6
at 0.8, 7e-13 at 0.9. Documents that are linked either way, directly or through others, form a candidate
group, and each group's texts meet once: there all pairs are compared by their exact similarity, but for
pairs already connected. The document whose shingles are the commonest goes first, so a group around one
original is done after one step.

A candidate group of more than ``block`` sets is dealt to blocks: each finds its own components, then the
components' firsts are compared, which connects most of a group of alike documents. What is not in a
group's largest component by then is compared, a block at a time, with every block of the group, and the
links between components found so are followed to the end. Every task holds two blocks at most.

Defined results: a null text counts as empty; texts without words are one group. Equal sets are told
by 64-bit hashes and enter once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, components, cut, parts, stay, tidy
from .simhash import fingerprint_links, majority

BANDS, ROWS = 32, 5
_TIMES, _PLUS = np.random.default_rng(1).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_TIMES = 2 * _TIMES + np.uint64(1)
#: Shingles whose minima are taken at once.
_CHUNK = 1024


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    last = ends.tolist()[min(words, len(w)) - 1 :]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, last)], np.uint64))  # noqa: B905


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys of a set, one for each band; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (hashes[i : i + _CHUNK] * _TIMES + _PLUS).min(axis=1))
    return [xxhash.xxh64_intdigest(m.tobytes(), band) - (1 << 63) for band, m in enumerate(least.reshape(BANDS, ROWS))]


def similar_roots(sets: list[np.ndarray], least: float = 0.8) -> list[int]:
    """For each of the sets the least index of its component under a similarity of ``least`` or more."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = np.array([len(s) for s in sets], np.int64)
    _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    # members by shingle
    post = np.repeat(np.arange(len(sets)), sizes)[np.argsort(at, kind="stable")]
    first = np.cumsum(df) - df
    common = np.array([df[at[b - n : b]].mean() if n else 0 for b, n in zip(ends, sizes, strict=True)])
    left = len(sets) - 1
    for i in np.argsort(-common, kind="stable").tolist():
        if not left:
            break
        mine = at[ends[i] - sizes[i] : ends[i]]
        n = df[mine]
        both = np.bincount(post[np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        for j in np.flatnonzero(both >= least * (sizes[i] + sizes - both) - 1e-9).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                left -= 1
    return [find(i) for i in range(len(sets))]


def _prints(words: int):
    def prints(record_batches):
        for f in record_batches:
            sets, fps, keys = [], [], []
            for text in f.column("text").to_pylist():
                s = shingle_set(text, words)
                sets.append(xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63))
                fps.append(majority(s))
                keys.append(band_keys(s))
            keep = ["part", "idx", "doc_id"]
            columns = [pa.array(sets, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(f.column(c) for c in keep), *columns], [*keep, "set", "fp", "keys"])

    return prints


def _compared(words: int, least: float):
    def compared(record_batches):
        """Rows (group, set, text) come sorted by group. Output rows (set, root) of the sets that have another root."""
        now, ids, sets = None, [], []

        def close():
            roots = similar_roots(sets, least) if len(sets) > 1 else [0]
            moved = [(ids[i], ids[r]) for i, r in enumerate(roots) if i != r]
            return pa.RecordBatch.from_arrays([pa.array([m[k] for m in moved], pa.int64()) for k in (0, 1)], ["set", "root"])

        for f in record_batches:
            for group, name, text in zip(*(f.column(c).to_pylist() for c in ("group", "set", "text")), strict=True):
                if group != now:
                    if sets:
                        yield close()
                    now, ids, sets = group, [], []
                ids.append(name)
                sets.append(shingle_set(text, words))
        if sets:
            yield close()

    return compared


def _by_task(frames, names: tuple[str, ...]):
    """Rows that come sorted by ``task``, as one list per task."""
    now, rows = None, []
    for f in frames:
        for task, *row in zip(*(f.column(c).to_pylist() for c in ("task", *names)), strict=True):
            if task != now and rows:
                yield rows
                rows = []
            now = task
            rows.append(row)
    if rows:
        yield rows


def _stored(words: int):
    def stored(record_batches):
        for f in record_batches:
            sets = [shingle_set(t, words).tobytes() for t in f.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([f.column("group"), f.column("n"), f.column("set"), pa.array(sets, pa.binary())], ["group", "n", "set", "s"])

    return stored


def _within(least: float):
    def within(record_batches):
        for rows in _by_task(record_batches, ("set", "s")):
            ids, sets = [r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows]
            roots = similar_roots(sets, least) if len(sets) > 1 else [0]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[r] for r in roots], pa.int64())], ["set", "root"])

    return within


def _across(least: float):
    def across(record_batches):
        """Links (a, b) of the components of sets asked (side 1) with those of a block (side 0)."""
        for rows in _by_task(record_batches, ("side", "root", "s")):
            block = [(r[1], np.frombuffer(r[2], np.uint64)) for r in rows if r[0] == 0]
            if not block:
                continue
            sizes = np.array([len(x) for _, x in block], np.int64)
            values, at = np.unique(np.concatenate([x for _, x in block]), return_inverse=True)
            post = np.repeat(np.arange(len(block)), sizes)[np.argsort(at, kind="stable")]
            df = np.bincount(at, minlength=len(values))
            first = np.cumsum(df) - df
            found = set()
            for _, root, raw in (r for r in rows if r[0] == 1):
                own = np.frombuffer(raw, np.uint64)
                mine = np.searchsorted(values, own)
                mine = mine[(mine < len(values)) & (values[np.minimum(mine, len(values) - 1)] == own)]
                n = df[mine]
                both = np.bincount(post[np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(block))
                near = np.flatnonzero(both >= least * (len(own) + sizes - both) - 1e-9)
                found |= {(root, block[j][0]) for j in near.tolist() if block[j][0] != root}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in sorted(found)], pa.int64()) for k in (0, 1)], ["a", "b"])

    return across


def _large_groups(members: DataFrame, least: float, block: int) -> DataFrame:
    """(set, root) of the sets (group, n, set, s) of groups that are too large for one task."""
    n_parts = parts(members.sparkSession)

    def dealt(df: DataFrame, *keys) -> DataFrame:
        return df.withColumn("task", F.xxhash64(*keys)).repartition(n_parts, "task").sortWithinPartitions("task")

    blocks = F.pmod(F.xxhash64("set", F.lit(3)), F.ceil(F.col("n") / block))
    one = cut(dealt(members, "group", blocks).mapInArrow(_within(least), "set long, root long"), "blocks")
    # the firsts of the blocks' components, dealt anew
    firsts = members.join(one.select(F.col("root").alias("set")).distinct(), "set", "left_semi")
    firsts = firsts.drop("n").join(firsts.groupBy("group").agg(F.count("*").alias("n")), "group")
    two = dealt(firsts, "group", F.pmod(F.xxhash64("set", F.lit(5)), F.ceil(F.col("n") / block))).mapInArrow(_within(least), "set long, root long")
    two = cut(two.select(F.col("set").alias("root"), F.col("root").alias("top")), "firsts")
    known = cut(members.join(one, "set").join(two, "root").select("group", "n", "set", "s", F.col("top").alias("root")), "known")
    counts = known.groupBy("group", "root").agg(F.count("*").alias("k"))
    main = counts.groupBy("group").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    asked = known.join(main, "group").where("root <> main").drop("main")
    asked = cut(asked.drop("n").join(asked.groupBy("group").agg(F.count("*").alias("m")), "group"), "asked")
    size = F.ceil(F.col("n") / block).cast("int")
    # each block meets each block of what is asked of its group
    asked_blocks = F.ceil(F.col("m") / block).cast("int")
    per_group = asked.select("group", "m").distinct()
    side0 = known.join(per_group, "group").withColumn("b", F.pmod(F.xxhash64("set", F.lit(3)), size)).withColumn("q", F.explode(F.sequence(F.lit(0), asked_blocks - 1)))
    side1 = asked.join(known.select("group", "n").distinct(), "group").withColumn("q", F.pmod(F.xxhash64("set", F.lit(7)), asked_blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), size - 1)))
    columns = ["group", "b", "q", "root", "s"]
    both = side0.select(*columns, F.lit(0).alias("side")).unionByName(side1.select(*columns, F.lit(1).alias("side")))
    links = cut(dealt(both, "group", "b", "q").mapInArrow(_across(least), "a long, b long").distinct(), "links")
    tops = components(links)
    return known.join(tops.toDF("root", "top"), "root", "left").select("set", F.coalesce("top", "root").alias("root"))


def _stars(record_batches):
    """Rows (key, set) of a sorted range as links (set, hub) to the first set of their key in the range; the range's first and last key come as ends (key, set) too."""
    key = hub = None
    for f in record_batches:
        if not f.num_rows:
            continue
        k, s = f.column("key").to_numpy(), f.column("set").to_numpy()
        starts = np.flatnonzero(np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]]))
        hubs = np.repeat(s[starts], np.diff(np.append(starts, len(k))))
        if len(hubs) < len(k):  # the first rows go on with the key before
            hubs = np.concatenate([np.full(len(k) - len(hubs), hub), hubs])
        link = s != hubs
        ends = [(k[0], s[0])] if key is None else []
        key, hub = int(k[-1]), int(hubs[-1])
        yield pa.RecordBatch.from_arrays([pa.array(s[link]), pa.array(hubs[link]), pa.nulls(int(link.sum()), pa.int64())], ["set", "hub", "key"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([int(ends[0][1])]), pa.nulls(1, pa.int64()), pa.array([int(ends[0][0])])], ["set", "hub", "key"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([hub]), pa.nulls(1, pa.int64()), pa.array([key])], ["set", "hub", "key"])


def _linked(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all sets of a key, by ranges of (key, set), so that no key is gathered."""
    spark = sets.sparkSession
    ranges = sets.select(F.explode("keys").alias("key"), "set").repartitionByRange(parts(spark), "key", "set").sortWithinPartitions("key", "set")
    batches(spark, 10_000)  # rows are keys
    stars = cut(ranges.mapInArrow(_stars, "set long, hub long, key long"), "stars")
    batches(spark)
    # a key that goes on in the next range: two rows of each range at most
    ends = stars.where("hub is null").select("key", "set")
    across = ends.join(ends.groupBy("key").agg(F.min("set").alias("b")), "key").select(F.col("set").alias("a"), "b")
    return stars.where("hub is not null").select(F.col("set").alias("a"), F.col("hub").alias("b")).unionByName(across).where("a <> b").distinct()


def _fingerprint_linked(sets: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect all sets with shingles whose fingerprints differ in ``radius`` bits or fewer."""
    some = sets.where("size(keys) > 0").select("set", "fp")
    hubs = cut(some.groupBy("fp").agg(F.min("set").alias("hub")), "hubs")
    same = some.join(hubs, "fp").where("set <> hub").select(F.col("set").alias("a"), F.col("hub").alias("b"))
    near = fingerprint_links(hubs, radius).toDF("fp_a", "fp_b").join(hubs.toDF("fp_a", "a"), "fp_a").join(hubs.toDF("fp_b", "b"), "fp_b")
    return same.unionByName(near.select("a", "b"))


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, block: int = 4096, radius: int = 4) -> DataFrame:
    """``docs`` with only the row of the least doc_id (null last, then as read) of each component."""
    spark = docs.sparkSession
    batches(spark)
    table = stay(docs, "near")
    rows = table.select("part", "idx", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    prints = cut(rows.mapInArrow(tidy(_prints(words)), "part int, idx long, doc_id long, set long, fp long, keys array<long>"), "prints")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "part", "idx")
    sets = cut(prints.groupBy("set").agg(F.min(order).alias("best"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "sets")
    met = components(_fingerprint_linked(sets, radius).unionByName(_linked(sets)))
    met = met.unionByName(met.select(F.col("root").alias("node"), "root").distinct())
    met = met.join(met.groupBy("root").agg(F.count("*").alias("n")), "root")
    wanted = cut(met.join(sets, met.node == sets.set).select("best.part", "best.idx", F.col("root").alias("group"), "set", "n"), "wanted")
    texts = rows.join(wanted.where(F.col("n") <= block), ["part", "idx"]).select("group", "set", "text")
    texts = texts.repartition(parts(spark), "group").sortWithinPartitions("group", "set")
    roots = cut(texts.mapInArrow(tidy(_compared(words, least)), "set long, root long"), "roots")
    if not wanted.where(F.col("n") > block).isEmpty():
        large = rows.join(wanted.where(F.col("n") > block), ["part", "idx"]).mapInArrow(tidy(_stored(words)), "group long, n long, set long, s binary")
        roots = roots.unionByName(_large_groups(cut(large, "large"), least, block))
    best = sets.select("set", "best").join(roots, "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("best").alias("best"))
    return table.join(best.select("best.part", "best.idx"), ["part", "idx"], "left_semi").select("row.*")
