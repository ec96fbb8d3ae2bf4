"""Change detection between two versions of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import cut
from ..functions.text import fingerprint


def node_fingerprints(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, title, content_fp, subtree_fp): the subtree's is a hash of its content's and its children's in order.

    Folded from the lowest depth up to the roots, a level at a time over written tables, so that only a
    node's children ever stand in one row.
    """
    if "parent_id" not in nodes.columns:  # the last node above, of those whose subtree reaches here
        up = nodes.select("doc_id", F.col("node_id").alias("_p"), F.col("last_desc").alias("_z"), F.col("depth").alias("_d"))
        of = nodes.join(up, "doc_id").where("_p < node_id and node_id <= _z and _d = depth - 1").select("doc_id", "node_id", F.col("_p").alias("parent_id"))
        nodes = nodes.join(of, ["doc_id", "node_id"], "left")
    own = nodes.select("doc_id", "node_id", "parent_id", "depth", "title", fingerprint(F.col("title"), F.col("content")).alias("content_fp"))
    own = cut(own, "own")
    out, below, deepest = None, None, own.agg(F.max("depth")).first()[0] or 0
    for k in range(deepest, -1, -1):
        level = own.where(F.col("depth") == k)
        if below is None:
            level = level.withColumn("subtree_fp", F.sha2("content_fp", 256))
        else:
            kids = below.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("node_id", "subtree_fp"))).alias("kids"))
            under = F.array_join(F.transform(F.coalesce("kids", F.array().cast("array<struct<node_id:int,subtree_fp:string>>")), lambda x: x["subtree_fp"]), ",")
            level = level.join(kids, ["doc_id", "node_id"], "left").withColumn("subtree_fp", F.sha2(F.concat_ws(",", "content_fp", F.nullif(under, F.lit(""))), 256)).drop("kids")
        below = level = cut(level, "level") if 0 < k < deepest else level
        done = level.select("doc_id", "node_id", "title", "content_fp", "subtree_fp")
        out = done if out is None else out.unionByName(done)
    return out


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, title, change) by title, the last node of a title counting: added, removed, modified or restructured."""
    last = lambda df, p: df.groupBy("doc_id", "title").agg(F.max(F.struct("node_id", "content_fp", "subtree_fp")).alias(p))
    both = last(old, "o").join(last(new, "n"), ["doc_id", "title"], "full")
    change = (
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed")
        .when(F.col("o.content_fp") != F.col("n.content_fp"), "modified").when(F.col("o.subtree_fp") != F.col("n.subtree_fp"), "restructured")
    )
    return both.select("doc_id", "title", change.alias("change")).where("change is not null")


def node_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, node_id, content_changed, subtree_changed, only_descendants) of the nodes that both versions have."""
    o = old.select("doc_id", "node_id", F.col("content_fp").alias("_c"), F.col("subtree_fp").alias("_s"))
    content, subtree = F.col("content_fp") != F.col("_c"), F.col("subtree_fp") != F.col("_s")
    return new.join(o, ["doc_id", "node_id"]).select("doc_id", "node_id", content.alias("content_changed"), subtree.alias("subtree_changed"), (subtree & ~content).alias("only_descendants"))


def needing_reprocess(old: DataFrame, new: DataFrame, version_changed: bool = False) -> DataFrame:
    """Nodes (doc_id, node_id) of ``new`` whose content or subtree differs, or that are new; all if the version has changed."""
    if version_changed:
        return new.select("doc_id", "node_id")
    o = old.select("doc_id", "node_id", F.col("content_fp").alias("c"), F.col("subtree_fp").alias("s"))
    return new.join(o, ["doc_id", "node_id"], "left").where("c is null or c <> content_fp or s <> subtree_fp").select("doc_id", "node_id")


def needs_recompile(stored: Column, current: Column) -> Column:
    """Whether a stored mark (hash, time or version) differs; unknown counts as changed."""
    return F.coalesce(stored != current, F.lit(True))


def needs_reprocessing(stored_fp: Column, stored_version: Column, current_fp: Column, version: int) -> Column:
    return F.coalesce((stored_version == 0) | (stored_version < version) | (stored_fp != current_fp), F.lit(True))


def resolve_action(stored_fp: Column, stored_logic: Column, stored_version: Column, current_fp: Column, current_logic: Column, version: int = 1) -> Column:
    """skip, full or incremental: unchanged content and version; else a changed logic; else changed content alone."""
    return (
        F.when(stored_fp.isNull(), "full").when(~needs_reprocessing(stored_fp, stored_version, current_fp, version), "skip")
        .when((F.coalesce(stored_logic, F.lit("")) != "") & (stored_logic != current_logic), "full").otherwise("incremental")
    )


def reuse_enrichment(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` (…, subtree_fp, summary) with empty summaries taken from the first old node of the same subtree."""
    first = old.where("coalesce(summary, '') <> ''").groupBy("doc_id", "subtree_fp").agg(F.min(F.struct("node_id", "summary")).alias("o"))
    out = new.join(first, ["doc_id", "subtree_fp"], "left")
    take = (F.coalesce("summary", F.lit("")) == "") & F.col("o").isNotNull()
    return out.withColumn("reused", take).withColumn("summary", F.when(take, F.col("o.summary")).otherwise(F.col("summary"))).drop("o")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def logic_fingerprint(options: dict) -> str:
    """A hash of the options that decide results."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(options, sort_keys=True).encode()).hexdigest()


def last_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class ChangeSet:
    """Changes (doc_id, title, change) and what they come to."""

    def __init__(self, changes: DataFrame):
        self.changes = changes

    def is_empty(self) -> bool:
        return self.changes.isEmpty()

    def counts(self) -> dict[str, int]:
        return {r.change: r["count"] for r in self.changes.groupBy("change").count().collect()}  # four kinds at most

    def total_changes(self) -> int:
        return sum(self.counts().values())

    def merge(self, other: ChangeSet) -> ChangeSet:
        """Both sets of changes; the other's word on a title replaces this one's."""
        return ChangeSet(upsert(self.changes, other.changes, ["doc_id", "title"]))

    def changed_titles(self) -> DataFrame:
        """What still exists of the changed nodes: those removed are not among them."""
        return self.changes.where("change <> 'removed'").select("doc_id", "title")


class ChangeDetector:
    """What is known of documents: a state (doc_id, content_fp, logic_fp, version, modified)."""

    COLUMNS = ("doc_id", "content_fp", "logic_fp", "version", "modified")

    def __init__(self, state: DataFrame):
        self.state = state.select(*self.COLUMNS)

    def record(self, seen: DataFrame) -> ChangeDetector:
        return ChangeDetector(upsert(self.state, seen.select(*self.COLUMNS), ["doc_id"]))

    def clear(self) -> ChangeDetector:
        return ChangeDetector(self.state.limit(0))

    def to_state(self) -> DataFrame:
        """The state to store; times of files do not outlast the process that saw them."""
        return self.state.drop("modified")

    @staticmethod
    def from_state(state: DataFrame) -> ChangeDetector:
        return ChangeDetector(state.withColumn("modified", F.lit(None).cast("timestamp")))

    def needing(self, seen: DataFrame) -> DataFrame:
        """Of ``seen`` the documents to compile again: unknown ones, newer files, and changed content, logic or version."""
        old = self.state.toDF("doc_id", "_c", "_l", "_v", "_m")
        j = seen.join(old, "doc_id", "left")
        newer = F.coalesce(F.col("modified") > F.col("_m"), F.lit(False))
        same = ~(needs_recompile(F.col("_c"), F.col("content_fp")) | needs_recompile(F.col("_l"), F.col("logic_fp")) | needs_recompile(F.col("_v"), F.col("version")))
        return j.where(newer | ~same).select(seen.columns)
