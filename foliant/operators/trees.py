"""Section trees as relations.

A tree is a table of nodes (doc_id, node_id, parent_id, last_desc, depth, structure, title, content,
is_leaf): node_id is the pre-order number from 1, and node_id..last_desc is the node's subtree, so
subtree tests are range conditions within a document and need no recursion. Trees are built by
windows over one document at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import cut
from ..functions.text import token_estimate

NODE_COLUMNS = ["doc_id", "node_id", "parent_id", "last_desc", "depth", "structure", "title", "content", "is_leaf"]
MAX_LEVEL = 6


def block_nodes(docs: DataFrame, size: int = 5) -> DataFrame:
    """Documents as three-level trees: the text, blocks of ``size`` lines, lines. Node numbers follow from positions."""
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    n = F.size("lines")
    blocks = F.ceil(n / size).cast("int")
    number = lambda b: (2 + b * (size + 1)).cast("int")
    root = F.struct(
        F.lit(1).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), (1 + n + blocks).cast("int").alias("last_desc"), F.lit(0).alias("depth"), F.lit("").alias("structure"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("content"), F.lit(False).alias("is_leaf"),
    )

    def block(b: Column) -> Column:
        return F.struct(
            number(b).alias("node_id"), F.lit(1).alias("parent_id"), F.least(number(b) + size, 1 + n + blocks).cast("int").alias("last_desc"), F.lit(1).alias("depth"),
            (b + 1).cast("string").alias("structure"), F.concat(F.lit("block "), (b + 1).cast("string")).alias("title"), F.lit("").alias("content"), F.lit(False).alias("is_leaf"),
        )

    def line(text: Column, i: Column) -> Column:
        b = F.floor(i / size).cast("int")
        own = (3 + i + b).cast("int")
        return F.struct(
            own.alias("node_id"), number(b).alias("parent_id"), own.alias("last_desc"), F.lit(2).alias("depth"), F.concat_ws(".", (b + 1).cast("string"), (i % size + 1).cast("string")).alias("structure"),
            F.concat(F.lit("line "), (i + 1).cast("string")).alias("title"), text.alias("content"), F.lit(True).alias("is_leaf"),
        )

    nodes = F.concat(F.array(root), F.transform(F.sequence(F.lit(0), blocks - 1), block), F.transform("lines", line))
    return lines.select("doc_id", F.explode(nodes).alias("n")).select("doc_id", "n.*")


def build_tree(raw: DataFrame, root_title: Column | None = None) -> DataFrame:
    """The tree of raw nodes (doc_id, seq, level 0..6, title, content), under a root per document.

    A node's parent is the nearest one before it of a smaller level (level 0: the root). Running last
    positions per level give parents, depths and structure numbers without recursion.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    levels = range(MAX_LEVEL + 1)
    rank = F.row_number().over(order)
    d = raw.withColumn("node_id", (rank + 1).cast("int")).withColumn("level", F.col("level").cast("int"))
    for k in levels:
        at = F.when(F.col("level") == k, F.col("node_id"))
        d = d.withColumn(f"p{k}", F.coalesce(F.last(at, ignorenulls=True).over(before), F.lit(0)) if k else F.lit(0)).withColumn(f"n{k}", F.first(at, ignorenulls=True).over(after))
    smaller = lambda name: F.array_max(F.array(F.lit(0), *[F.when(F.col("level") > k, F.col(f"{name}{k}")).otherwise(0) for k in levels]))
    d = d.withColumn("parent_id", F.greatest(smaller("p"), F.lit(1)))
    following = F.array_min(F.filter(F.array(*[F.when(F.col("level") >= k, F.col(f"n{k}")) for k in levels]), lambda x: x.isNotNull()))
    size = F.count("*").over(Window.partitionBy("doc_id"))
    d = d.withColumn("last_desc", F.coalesce(following - 1, size + 1).cast("int"))
    d = d.withColumn("ci", F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("seq")).cast("string"))
    for k in levels:
        d = d.withColumn(f"c{k}", F.last(F.when(F.col("level") == k, F.col("ci")), ignorenulls=True).over(before))
    # a level's last node is an ancestor if it came after the last nodes of all smaller levels
    up = []
    for k in range(1, MAX_LEVEL + 1):
        over = F.greatest(F.lit(0), *[F.col(f"p{j}") for j in range(k)]) if k > 1 else F.lit(0)
        up.append(F.when((F.col("level") > k) & (F.col(f"p{k}") > over), F.col(f"c{k}")))
    path = F.filter(F.array(*up), lambda x: x.isNotNull())
    leaf = F.col("last_desc") == F.col("node_id")
    tree = d.select("doc_id", "node_id", "parent_id", "last_desc", (F.size(path) + 1).alias("depth"), F.array_join(F.concat(path, F.array("ci")), ".").alias("structure"), "title", "content", leaf.alias("is_leaf"))
    title = root_title if root_title is not None else F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    roots = raw.groupBy("doc_id").agg(F.count("*").alias("n")).select(
        "doc_id", F.lit(1).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), (F.col("n") + 1).cast("int").alias("last_desc"), F.lit(0).alias("depth"), F.lit("").alias("structure"),
        title.alias("title"), F.lit("").alias("content"), F.lit(False).alias("is_leaf"),
    )
    return roots.unionByName(tree)


def children(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_id, node_id, position) of all edges."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    return nodes.where("parent_id is not null").select("doc_id", "parent_id", "node_id", F.row_number().over(w).alias("position"))


def siblings(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, sibling_id): those before, then those after, without the node itself."""
    c = nodes.where("parent_id is not null").select("doc_id", "parent_id", "node_id")
    return c.join(c.withColumnRenamed("node_id", "sibling_id"), ["doc_id", "parent_id"]).where("node_id <> sibling_id").select("doc_id", "node_id", "sibling_id")


def subtree_pairs(nodes: DataFrame) -> DataFrame:
    """(doc_id, ancestor_id, node_id), each node under itself too: by short ancestor chains, so no pair is made that isn't one."""
    own = nodes.select("doc_id", F.col("node_id").alias("ancestor_id"), "node_id")
    return own.unionByName(ancestors(nodes).select("doc_id", "ancestor_id", "node_id"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, ancestor_id, distance) from the parent up to the root, one join per level of depth."""
    edges = cut(nodes.select("doc_id", "node_id", "parent_id", "depth"), "edges")
    up = edges.select("doc_id", "node_id", F.col("parent_id").alias("ancestor_id")).where("ancestor_id is not null")
    edge = edges.select("doc_id", F.col("node_id").alias("ancestor_id"), F.col("parent_id").alias("next_id"))
    out, level = up.withColumn("distance", F.lit(1)), up
    deepest = edges.agg(F.max("depth")).first()[0] or 0
    for k in range(2, deepest + 1):
        level = level.join(edge, ["doc_id", "ancestor_id"]).where("next_id is not null").select("doc_id", "node_id", F.col("next_id").alias("ancestor_id"))
        out = out.unionByName(level.withColumn("distance", F.lit(k)))
    return out


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """Leaves below each node; a leaf counts itself. Running counts over the pre-order, no join of pairs."""
    return _subtree_sum(nodes, F.col("is_leaf").cast("long"), "leaf_count")


def subtree_tokens(nodes: DataFrame) -> DataFrame:
    """Own and total tokens of each node's subtree."""
    own = token_estimate(F.col("content"))
    return _subtree_sum(nodes.withColumn("own_tokens", own), F.col("own_tokens"), "total_tokens", keep=["own_tokens"])


def _subtree_sum(nodes: DataFrame, value: Column, name: str, keep: list[str] | None = None) -> DataFrame:
    """Sum of ``value`` over each subtree: the running sum at its last node less the one before its first."""
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = nodes.withColumn("_v", value).withColumn("_run", F.sum("_v").over(w))
    ends = run.select("doc_id", F.col("node_id").alias("last_desc"), F.col("_run").alias("_end"))
    return run.join(ends, ["doc_id", "last_desc"]).select("doc_id", "node_id", *(keep or []), (F.col("_end") - F.col("_run") + F.col("_v")).alias(name))


def validate(nodes: DataFrame, max_depth: int = 20) -> DataFrame:
    """One row of warnings: depth, untitled leaves, parents far lighter than their children, repeated leaves."""
    own = nodes.withColumn("t", token_estimate(F.col("content")))
    below = own.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.sum("t").alias("below"))
    light = own.join(below, ["doc_id", "node_id"]).where("below >= 100 and t < 0.8 * below").agg(F.count("*").alias("light_parents"))
    leaves = nodes.where("is_leaf and octet_length(content) >= 50").groupBy("doc_id", F.md5("content").alias("h")).agg(F.count("*").alias("n"))
    again = leaves.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("repeated_leaves"))
    base = nodes.agg(F.max("depth").alias("max_depth"), F.count_if(F.col("depth") > max_depth).alias("too_deep"), F.count_if(F.col("is_leaf") & (F.trim("title") == "")).alias("untitled_leaves"))
    return base.crossJoin(light).crossJoin(again)  # one row each


def page_ranges(nodes: DataFrame) -> DataFrame:
    """Page ranges (start_page, end_page) widened over each subtree; kept as they are where nothing below has pages."""
    p = subtree_pairs(nodes).join(nodes.select("doc_id", "node_id", "start_page", "end_page"), ["doc_id", "node_id"])
    below = p.where("node_id <> ancestor_id").groupBy("doc_id", F.col("ancestor_id").alias("node_id")).agg(F.min("start_page").alias("lo"), F.max("end_page").alias("hi"))
    out = nodes.drop("start_page", "end_page").join(nodes.select("doc_id", "node_id", "start_page", "end_page").join(below, ["doc_id", "node_id"], "left"), ["doc_id", "node_id"])
    return out.withColumn("start_page", F.coalesce("lo", "start_page")).withColumn("end_page", F.coalesce("hi", "end_page")).drop("lo", "hi")


def overlapping_pages(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """Nodes whose pages meet first..last."""
    return nodes.where((F.col("start_page") <= last) & (F.col("end_page") >= first))


def toc(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Flat table of contents in pre-order, the root left out; deeper parts are clipped."""
    t = nodes.where("parent_id is not null")
    return t if max_depth is None else t.where(F.col("depth") <= max_depth)


def toc_markdown(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The table of contents as one Markdown list per document."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), F.col("title"))
    t = toc(nodes, max_depth).select("doc_id", F.struct("node_id", line.alias("line")).alias("s"))
    return t.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("markdown"))


def structure_json(nodes: DataFrame) -> DataFrame:
    """Each node as a JSON object."""
    return nodes.select("doc_id", "node_id", F.to_json(F.struct("node_id", "parent_id", "depth", "structure", "title", "content")).alias("json"))


def node_stats(nodes: DataFrame) -> DataFrame:
    """Per node: lines, words, bytes, tokens, children, leaves below (0 for a leaf)."""
    from ..functions.text import words

    lines = F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n")))
    own = nodes.select("doc_id", "node_id", "is_leaf", "depth", lines.alias("n_lines"), F.size(words(F.col("content"))).alias("n_words"), F.octet_length("content").alias("n_bytes"), token_estimate(F.col("content")).alias("n_tokens"))
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"))
    full = own.join(kids, ["doc_id", "node_id"], "left").join(leaf_counts(nodes), ["doc_id", "node_id"])
    return full.select("doc_id", "node_id", "depth", "n_lines", "n_words", "n_bytes", "n_tokens", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("is_leaf"), 0).otherwise(F.col("leaf_count")).alias("n_leaves"))


def head(content: Column, title: Column, n: int) -> Column:
    """The first ``n`` lines under a heading that says how many there are."""
    lines = F.split(content, "\n")
    total = F.size(lines)
    shown = F.least(total, F.lit(n))
    rest = F.when(total > n, F.concat(F.lit("\n... ("), (total - n).cast("string"), F.lit(" more lines)"))).otherwise("")
    return F.concat(F.lit("[Preview: "), title, F.lit(" — showing "), shown.cast("string"), F.lit("/"), total.cast("string"), F.lit(" lines]\n"), F.array_join(F.slice(lines, 1, n), "\n"), rest)


def thin(nodes: DataFrame, threshold: int) -> DataFrame:
    """Merges subtrees of under ``threshold`` tokens into their tops: each original content once, blank lines between."""
    total = nodes.join(subtree_tokens(nodes).select("doc_id", "node_id", "total_tokens"), ["doc_id", "node_id"])
    # tops: small nodes without a small ancestor below the root; running maxima of the last number covered find them
    small = (F.col("total_tokens") < threshold) & F.col("parent_id").isNotNull() & ~F.col("is_leaf")
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    d = total.withColumn("_small", small).withColumn("_covered", F.coalesce(F.max(F.when(F.col("_small"), F.col("last_desc"))).over(w), F.lit(0)))
    d = d.withColumn("_top", F.col("_small") & (F.col("node_id") > F.col("_covered")))
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.last(F.when(F.col("_top"), F.struct("node_id", "last_desc")), ignorenulls=True).over(w)
    d = d.withColumn("_at", at).withColumn("top_id", F.when(F.col("node_id") <= F.col("_at.last_desc"), F.col("_at.node_id")).otherwise(F.col("node_id")))
    parts = d.where("content <> ''").groupBy("doc_id", F.col("top_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("node_id", "content"))).alias("c"))
    merged = parts.select("doc_id", "node_id", F.array_join(F.transform("c", lambda s: s["content"]), "\n\n").alias("merged"))
    kept = d.where("top_id = node_id").join(merged, ["doc_id", "node_id"], "left")
    return kept.select("doc_id", "node_id", "parent_id", "depth", "structure", "title", F.coalesce("merged", F.lit("")).alias("content"), (F.col("is_leaf") | F.col("_top")).alias("is_leaf"))


def largest_child(nodes: DataFrame) -> DataFrame:
    """For each parent the direct child of most total tokens, the last among equals."""
    t = nodes.where("parent_id is not null").join(subtree_tokens(nodes), ["doc_id", "node_id"])
    w = Window.partitionBy("doc_id", "parent_id").orderBy(F.desc("total_tokens"), F.desc("node_id"))
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "parent_id", F.col("node_id").alias("child_id"), "total_tokens")


def merge_small_leaves(nodes: DataFrame, threshold: int) -> DataFrame:
    """Pairs neighbouring sibling leaves that each have 0 < tokens < ``threshold``: the first takes the second's text.

    Within a run of such leaves the odd ones take the even ones; (node_id, donor_id, title, content).
    """
    w = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    t = nodes.where("parent_id is not null").withColumn("t", token_estimate(F.col("content")))
    ok = F.col("is_leaf") & (F.col("t") > 0) & (F.col("t") < threshold)
    t = t.withColumn("ok", ok).withColumn("run", F.sum((~F.col("ok")).cast("int")).over(w))
    t = t.where("ok").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "parent_id", "run").orderBy("node_id")))
    v = Window.partitionBy("doc_id", "parent_id", "run").orderBy("node_id")
    t = t.withColumn("donor_id", F.lead("node_id").over(v)).withColumn("donor_title", F.lead("title").over(v)).withColumn("donor_content", F.lead("content").over(v))
    t = t.where("k % 2 = 1 and donor_id is not null")
    text = F.concat("content", F.lit("\n\n## "), "donor_title", F.lit("\n"), "donor_content")
    return t.select("doc_id", "node_id", "donor_id", F.concat(F.lit("[MERGED: "), "donor_title", F.lit("]")).alias("donor_new_title"), text.alias("content"))


def mark_empty(nodes: DataFrame) -> DataFrame:
    """Inner nodes (not the root) with one child and blank content, renamed."""
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    found = nodes.where("parent_id is not null and not is_leaf and trim(content) = ''").join(kids.where("n = 1"), ["doc_id", "node_id"])
    return found.select("doc_id", "node_id", F.concat(F.lit("[EMPTY: "), "title", F.lit("]")).alias("new_title"))


def split_leaves(nodes: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """Children for leaves of over ``max_tokens``: cuts at headings, else paragraphs, that leave chunks of half the limit or more, else at the limit.

    An ordered fold over a leaf's lines, inside the JVM: (doc_id, node_id, part, title, content).
    """
    half, most = max_tokens * 2, max_tokens * 4  # bytes
    big = nodes.where("is_leaf").where(token_estimate(F.col("content")) > max_tokens)
    lines = F.split("content", "\n")

    def fold(starts) -> Column:
        """Greedy chunks of lines: a line that may start one does if the chunk at hand is at least half full, or over full."""
        init = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

        def step(acc, line):
            size = F.octet_length(acc["now"])
            cut = ((size >= half) & starts(line)) | (size + F.octet_length(line) > most) & (size > 0)
            return F.struct(
                F.when(cut, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
                F.when(cut | (size == 0), line).otherwise(F.concat(acc["now"], F.lit("\n"), line)).alias("now"),
            )

        return F.aggregate(lines, init, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))

    headed = F.exists(lines, lambda x: x.startswith("#"))
    chunks = F.when(headed, fold(lambda x: x.startswith("#"))).otherwise(fold(lambda x: F.trim(x) == ""))
    out = big.select("doc_id", "node_id", "title", F.posexplode(chunks).alias("k", "chunk")).withColumn("content", F.trim(F.regexp_replace("chunk", r"^\s+|\s+$", ""))).where("content <> ''")
    named = F.when(F.col("content").startswith("#"), F.trim(F.regexp_replace(F.substring_index("content", "\n", 1), "^#+", ""))).otherwise(F.concat("title", F.lit(" (part "), (F.col("k") + 1).cast("string"), F.lit(")")))
    return out.select("doc_id", "node_id", (F.col("k") + 1).alias("part"), named.alias("title"), "content")


def split_raw(raw: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """Raw nodes with the parts of too large leaves (``split_leaves``) in place of their text, a level deeper."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    r = raw.select("doc_id", "seq", "level", "title", "content", F.coalesce(F.lead("level").over(w) <= F.col("level"), F.lit(True)).alias("is_leaf"))
    parts = split_leaves(r.where(F.col("level") < MAX_LEVEL).select("doc_id", F.col("seq").alias("node_id"), "title", "content", "is_leaf"), max_tokens).withColumnRenamed("node_id", "seq")
    cut_up = parts.select("doc_id", "seq").distinct().withColumn("cut", F.lit(True))
    heads = r.join(cut_up, ["doc_id", "seq"], "left").select("doc_id", "seq", F.lit(0).alias("part"), "level", "title", F.when(F.col("cut"), "").otherwise(F.col("content")).alias("content"))
    below = parts.join(r.select("doc_id", "seq", "level"), ["doc_id", "seq"]).select("doc_id", "seq", "part", (F.col("level") + 1).cast("int").alias("level"), "title", "content")
    return heads.unionByName(below).withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "part"))).drop("part")


def optimised(nodes: DataFrame, threshold: int = 0) -> DataFrame:
    """``nodes`` with small sibling leaves merged (if ``threshold`` is positive) and empty inner nodes marked in their titles."""
    if threshold > 0:
        m = merge_small_leaves(nodes, threshold)
        changes = m.select("doc_id", "node_id", F.col("content").alias("_c"), F.lit(None).cast("string").alias("_t")).unionByName(m.select("doc_id", F.col("donor_id").alias("node_id"), F.lit("").alias("_c"), F.col("donor_new_title").alias("_t")))
        nodes = nodes.join(changes, ["doc_id", "node_id"], "left").withColumns({"title": F.coalesce("_t", "title"), "content": F.coalesce("_c", "content")}).drop("_c", "_t")
    marked = mark_empty(nodes)
    return nodes.join(marked, ["doc_id", "node_id"], "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title")


def limited(nodes: DataFrame, max_depth: int | None = None, max_children: int | None = None) -> DataFrame:
    """``nodes`` down to a depth, and of each parent only its first children, with what lies below those."""
    kept = nodes if max_depth is None else nodes.where(F.col("depth") <= max_depth)
    if max_children is None:
        return kept
    gone = children(nodes).where(F.col("position") > max_children).select("doc_id", F.col("node_id").alias("_a")).join(nodes.select("doc_id", F.col("node_id").alias("_a"), F.col("last_desc").alias("_z")), ["doc_id", "_a"])
    # subtrees nest, so a running maximum of their ends tells what lies in any of them
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = kept.join(gone.select("doc_id", F.col("_a").alias("node_id"), "_z"), ["doc_id", "node_id"], "left").withColumn("_end", F.coalesce(F.max("_z").over(w), F.lit(0)))
    return ends.where(F.col("node_id") > F.col("_end")).drop("_z", "_end")


def numbered(node_id: Column) -> Column:
    """Node numbers as text of four digits or more."""
    return F.when(node_id > 9999, node_id.cast("string")).otherwise(F.lpad(node_id.cast("string"), 4, "0"))


def toc_filtered(nodes: DataFrame, wanted: Column) -> DataFrame:
    """The subtrees of the nodes that ``wanted`` holds for, once each, in pre-order."""
    w = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.coalesce(F.max(F.when(wanted, F.col("last_desc"))).over(w), F.lit(0))
    return nodes.withColumn("_end", end).where(F.col("node_id") <= F.col("_end")).drop("_end")


def toc_from(nodes: DataFrame, node_id: int, max_depth: int | None = None) -> DataFrame:
    """The table of contents below a node, down to ``max_depth`` levels; what is cut off there shows as "..."."""
    top = nodes.where(F.col("node_id") == node_id).select("doc_id", F.col("node_id").alias("_a"), F.col("last_desc").alias("_z"), F.col("depth").alias("_d"))
    t = nodes.join(top, "doc_id").where("node_id between _a and _z").withColumn("below", F.col("depth") - F.col("_d")).drop("_a", "_z", "_d")
    if max_depth is None:
        return t
    shown = t.where(F.col("below") <= max_depth)
    clipped = (F.col("below") == max_depth) & ~F.col("is_leaf")
    return shown.withColumn("title", F.when(clipped, F.concat("title", F.lit(" ..."))).otherwise(F.col("title")))


def tree_counts(nodes: DataFrame) -> DataFrame:
    """(doc_id, n_nodes, n_leaves, n_sections, max_depth) of whole trees; sections are all nodes, the root too."""
    return nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count_if("is_leaf").alias("n_leaves"), F.count_if(~F.col("is_leaf")).alias("n_inner"), F.max("depth").alias("max_depth"))


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, path): the titles from the root down to each node, parted by " / "."""
    a = ancestors(nodes).join(nodes.select("doc_id", F.col("node_id").alias("ancestor_id"), F.col("title").alias("t")), ["doc_id", "ancestor_id"])
    up = a.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "t"))).alias("u"))
    own = nodes.select("doc_id", "node_id", "title").join(up, ["doc_id", "node_id"], "left")
    return own.select("doc_id", "node_id", F.concat_ws(" / ", F.transform("u", lambda x: x["t"]), "title").alias("path"))
