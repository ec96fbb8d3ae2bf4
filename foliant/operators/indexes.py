"""Derived indexes of trees: postings, section maps, routes, cards, overlaps and evidence scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import cut
from ..functions.text import composite, data_richness, density_of, is_index_term, jaccard, pieces, specificity_of, word_set, words
from .trees import leaf_counts


def postings(nodes: DataFrame, max_keywords: int | None = 5000, max_nodes: int = 20, only: Sequence[str] | None = None) -> DataFrame:
    """Weighted postings (doc_id, keyword, node_id, weight, depth), of all keywords or of those in ``only``.

    An occurrence adds 2 in a title, 1.5 in a summary, 1 in content; per document the keywords of most
    occurrences stay (all, if ``max_keywords`` is None), and per keyword the heaviest nodes, with weights
    relative to the heaviest.
    """
    fields = [("title", 2.0), ("content", 1.0)] + ([("summary", 1.5)] if "summary" in nodes.columns else [])
    texts = F.explode(F.array(*[F.struct(F.col(c).alias("text"), F.lit(w).alias("w")) for c, w in fields]))
    each = nodes.select("doc_id", "node_id", "depth", texts.alias("f")).select("doc_id", "node_id", "depth", F.explode(pieces(F.col("f.text"))).alias("keyword"), "f.w").where(is_index_term(F.col("keyword")))
    if only is None or max_keywords is None:
        return _kept(each if only is None else each.where(F.col("keyword").isin(list(only))), max_keywords, max_nodes)
    # a document of no more words than keywords stay loses none, so the asked ones are all that is needed of it
    held = each.groupBy("doc_id", "node_id", "depth", F.when(F.col("keyword").isin(list(only)), F.col("keyword")).alias("keyword"), "w").agg(F.count("*").alias("n"))
    held = cut(held, "asked")
    long = cut(held.groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") > max_keywords).select("doc_id"), "long")
    whole = postings(nodes.join(long, "doc_id", "left_semi"), max_keywords, max_nodes).where(F.col("keyword").isin(list(only)))
    asked = held.where("keyword is not null").join(long, "doc_id", "left_anti").select("doc_id", "node_id", "depth", "keyword", (F.col("w") * F.col("n")).alias("w"), "n")
    return whole.unionByName(_kept(asked, max_keywords, max_nodes))


def _kept(each: DataFrame, max_keywords: int | None, max_nodes: int) -> DataFrame:
    """Postings of occurrences (doc_id, node_id, depth, keyword, w), each counting once or ``n`` times."""
    n = F.sum("n") if "n" in each.columns else F.count("*")
    # one shuffle serves the sums, the ranks and the cuts; only the cut of keywords needs a document in one place
    dealt = each.repartition("doc_id", "keyword") if max_keywords is None else each.repartition("doc_id")
    per_node = dealt.groupBy("doc_id", "keyword", "node_id", "depth").agg(F.sum("w").alias("w"), n.alias("n"))
    by_kw = Window.partitionBy("doc_id", "keyword").orderBy(F.desc("w"), "node_id")
    p = per_node.withColumn("r", F.row_number().over(by_kw)).withColumn("most", F.first("w").over(by_kw))
    weighted = ["doc_id", "keyword", "node_id", (F.col("w") / F.col("most")).alias("weight"), "depth"]
    if max_keywords is None:
        return p.where(F.col("r") <= max_nodes).select(*weighted)
    p = p.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id", "keyword")))
    p = p.where(F.col("r") <= max_nodes).withColumn("kr", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("total"), "keyword")))
    return p.where(F.col("kr") <= max_keywords).select(*weighted)


def expand_synonyms(posting: DataFrame, synonyms: DataFrame, factor: float = 0.6, most: int = 5) -> DataFrame:
    """Postings for up to ``most`` synonyms (keyword, synonym, place) of each keyword, where the document has none of its own."""
    s = synonyms.where("octet_length(synonym) >= 2").withColumn("r", F.row_number().over(Window.partitionBy("keyword").orderBy("place"))).where(F.col("r") <= most)
    new = posting.join(s.select("keyword", F.lower("synonym").alias("synonym")), "keyword")
    new = new.groupBy("doc_id", F.col("synonym").alias("keyword"), "node_id", "depth").agg(F.max(F.col("weight") * factor).alias("weight"))
    new = new.join(posting.select("doc_id", "keyword").distinct(), ["doc_id", "keyword"], "left_anti")
    return posting.unionByName(new.select(*posting.columns))


def section_map(nodes: DataFrame) -> DataFrame:
    """(doc_id, name, node_id) of the top sections by lower-cased title and by structure number; the last of a name wins."""
    top = nodes.where("depth = 1")
    both = top.select("doc_id", F.lower("title").alias("name"), "node_id").unionByName(top.select("doc_id", F.col("structure").alias("name"), "node_id"))
    return both.groupBy("doc_id", "name").agg(F.max("node_id").alias("node_id"))


def summary_shortcut(nodes: DataFrame) -> DataFrame:
    """The root's summary, else its children's as lines "title: summary"."""
    root = nodes.where("parent_id is null").select("doc_id", F.nullif(F.trim("summary"), F.lit("")).alias("own"))
    line = F.struct("node_id", F.concat("title", F.lit(": "), "summary").alias("line"))
    kids = nodes.where("parent_id = 1 and trim(coalesce(summary, '')) <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    joined = F.array_join(F.transform("l", lambda s: s["line"]), "\n")
    return root.join(kids, "doc_id", "left").select("doc_id", F.coalesce("own", joined, F.lit("")).alias("summary"))


def hot_nodes(hits: DataFrame, threshold: int = 3) -> DataFrame:
    """Hits (node_id, score) counted and averaged; hot from ``threshold`` hits on."""
    return hits.groupBy("node_id").agg(F.count("*").alias("hit_count"), F.avg("score").alias("avg_score")).withColumn("is_hot", F.col("hit_count") >= threshold)


def concepts(posting: DataFrame, nodes: DataFrame, most: int = 15, of: int = 20) -> DataFrame:
    """Concepts without a language model: a document's heaviest keywords, and the titles of the sections that hold them."""
    best = posting.groupBy("doc_id", "keyword").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.desc("n"), "keyword")
    top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(most, of))
    held = top.join(posting.select("doc_id", "keyword", "node_id"), ["doc_id", "keyword"]).join(nodes.select("doc_id", "node_id", "title"), ["doc_id", "node_id"])
    return held.groupBy("doc_id", "rank", "keyword", "weight").agg(F.array_join(F.array_sort(F.collect_set("title")), "|").alias("sections"))


def nav_entries(nodes: DataFrame) -> DataFrame:
    """Inner nodes with an overview (summary, else title), leaves below and level."""
    overview = F.coalesce(F.nullif(F.col("summary"), F.lit("")), "title") if "summary" in nodes.columns else F.col("title")
    return nodes.where("not is_leaf").join(leaf_counts(nodes), ["doc_id", "node_id"]).select("doc_id", "node_id", overview.alias("overview"), "leaf_count", F.col("depth").alias("level"))


def child_routes(nodes: DataFrame) -> DataFrame:
    """Edges with the child's title, description (summary, else the content's start, else title) and leaves below."""
    told = [F.nullif(F.col("summary"), F.lit(""))] if "summary" in nodes.columns else []
    description = F.coalesce(*told, F.nullif(F.substring("content", 1, 100), F.lit("")), "title")
    return nodes.where("parent_id is not null").join(leaf_counts(nodes), ["doc_id", "node_id"]).select("doc_id", "parent_id", "node_id", "title", description.alias("description"), "leaf_count")


def doc_cards(nodes: DataFrame) -> DataFrame:
    """One row per document: title, overview, leaves, and the titles of its top sections in order."""
    root = nav_entries(nodes).where("level = 0").join(nodes.where("depth = 0").select("doc_id", "title"), "doc_id")
    top = nodes.where("depth = 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "title"))).alias("s"))
    sections = F.coalesce(F.array_join(F.transform("s", lambda s: s["title"]), "|"), F.lit(""))
    return root.join(top, "doc_id", "left").select("doc_id", "title", "overview", F.col("leaf_count").alias("total_leaves"), F.coalesce(F.size("s"), F.lit(0)).alias("n_sections"), sections.alias("sections"))


def intent_routes(nodes: DataFrame) -> DataFrame:
    """Where the questions of a node (array column hints) lead: its children by relevance.

    A child with hints and content scores 0.7 and 0.1 for each of up to three hints; content alone 0.5; else 0.3.
    """
    asking = nodes.where("size(hints) > 0").select("doc_id", F.col("node_id").alias("parent_id"))
    n, full = F.size("hints"), F.col("content") != ""
    relevance = F.when((n > 0) & full, 0.7 + F.least(n, F.lit(3)) * 0.1).when(full, 0.5).otherwise(0.3)
    reason = F.when(n > 0, F.concat(F.lit("Can answer: "), F.element_at("hints", 1))).otherwise(F.concat(F.lit("Section: "), "title"))
    t = nodes.join(asking, ["doc_id", "parent_id"]).select("doc_id", "parent_id", "node_id", relevance.alias("relevance"), reason.alias("reason"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy(F.desc("relevance"), "node_id")))


def concept_routes(nodes: DataFrame, per_concept: int = 10, most: int = 50) -> DataFrame:
    """Where each lower-cased tag (array column tags) leads: leaves 0.9, inner nodes 0.7; the concepts of most targets per document."""
    relevance = F.when(F.col("is_leaf"), 0.9).otherwise(0.7)
    t = nodes.select("doc_id", "node_id", relevance.alias("relevance"), F.explode(F.array_distinct(F.transform("tags", lambda x: F.lower(x)))).alias("concept"))
    t = t.withColumn("targets", F.count("*").over(Window.partitionBy("doc_id", "concept")))
    t = t.withColumn("cr", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("targets"), "concept"))).where(F.col("cr") <= most)
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "concept").orderBy(F.desc("relevance"), "node_id")))
    return t.where(F.col("rank") <= per_concept).select("doc_id", "concept", "node_id", "relevance", "rank")


def evidence_scores(nodes: DataFrame) -> DataFrame:
    """Density, richness, specificity and their composite of all nodes that have content."""
    # words are split once: a column that is used often isn't inlined
    d = nodes.where("content <> ''").select("doc_id", "node_id", "content", words(F.col("content")).alias("w"))
    d = d.select("doc_id", "node_id", density_of(F.col("w")).alias("density"), data_richness(F.col("content")).alias("data_richness"), specificity_of(F.col("w")).alias("specificity"))
    return d.withColumn("composite", composite(F.col("density"), F.col("data_richness"), F.col("specificity")))


def similar_sets(sets: DataFrame, key: list[str], scope: list[str], least: float) -> DataFrame:
    """Pairs (key_a < key_b) within a scope whose word sets (column ws) have a Jaccard similarity of ``least`` or more.

    Prefix filter: in any fixed order of words, two such sets share one of the first n - ceil(least n) + 1
    words of each. The order is by how few sets of the scope hold a word, so hot words are not joined on.
    """
    sets = cut(sets.where("size(ws) > 0").select(*scope, *key, "ws", F.size("ws").alias("n")), "sets")
    w = sets.select(*scope, *key, "n", F.explode("ws").alias("word"))
    df = w.groupBy(*scope, "word").agg(F.count("*").alias("df"))
    order = F.row_number().over(Window.partitionBy(*scope, *key).orderBy("df", "word"))
    ranked = w.join(df, [*scope, "word"]).withColumn("r", order)
    # words of one set alone make no pair; only ids travel with the words
    pre = cut(ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1) & (F.col("df") > 1)).select(*scope, "word", F.struct(*key).alias("k"), "n"), "prefixes")
    a, b = (pre.select(*scope, "word", F.col("k").alias(x), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    sizes = (F.col("n_a") >= F.col("n_b") * least - 1e-9) & (F.col("n_b") >= F.col("n_a") * least - 1e-9)
    pairs = a.join(b, [*scope, "word"]).where((F.col("a") < F.col("b")) & sizes).select(*scope, "a", "b").distinct()
    for x in ("a", "b"):
        pairs = pairs.join(sets.select(*scope, F.struct(*key).alias(x), F.col("ws").alias(f"ws_{x}")), [*scope, x])
    return pairs.withColumn("similarity", jaccard(F.col("ws_a"), F.col("ws_b"))).where(F.col("similarity") >= least).select(*scope, "a", "b", "similarity")


def overlaps(nodes: DataFrame, least: float = 0.8, min_bytes: int = 50) -> DataFrame:
    """Pairs of a document's leaves of ``min_bytes`` or more that repeat each other, and how."""
    leaves = nodes.where(F.col("is_leaf") & (F.octet_length("content") >= min_bytes))
    # a leaf's size goes with its number, so that pairs need no more joins
    sets = leaves.select("doc_id", "node_id", F.octet_length("content").alias("bytes"), word_set(F.col("content")).alias("ws"))
    p = similar_sets(sets, ["node_id", "bytes"], ["doc_id"], least)
    kind = overlap_type(F.col("similarity"), F.col("a.bytes"), F.col("b.bytes"))
    return p.select("doc_id", F.col("a.node_id").alias("node_a"), F.col("b.node_id").alias("node_b"), "similarity", kind.alias("overlap_type"))


def overlap_type(similarity, bytes_a, bytes_b):
    ratio = F.least(bytes_a, bytes_b) / F.greatest(bytes_a, bytes_b)
    return F.when(similarity >= 0.9, "duplicate").when(ratio < 0.5, "summary").otherwise("subset")


def overlaps_for(pairs: DataFrame) -> DataFrame:
    """Overlaps from either side: (doc_id, node_id, other_id, similarity, overlap_type)."""
    a = pairs.select("doc_id", F.col("node_a").alias("node_id"), F.col("node_b").alias("other_id"), "similarity", "overlap_type")
    return a.unionByName(pairs.select("doc_id", F.col("node_b").alias("node_id"), F.col("node_a").alias("other_id"), "similarity", "overlap_type"))
