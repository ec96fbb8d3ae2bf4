"""Search over trees and texts: BM25, patterns, keywords, similar nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import cut
from ..functions.text import search_terms, snippet

K1, B = 1.5, 0.75


def bm25(units: DataFrame, terms: Sequence[str], text: Column, key: list[str], scope: list[str] | None = None) -> DataFrame:
    """Scores (key, score, matched) of the units that hold any of ``terms``; N, df and the mean length per ``scope``.

    One pass over the units counts tokens and the query's terms in each; the counts are written once and serve the
    statistics and the scores.
    """
    scope = scope or []
    t = units.select(*scope, *key, search_terms(text).alias("t"))
    tf = [F.size(F.filter("t", F.lit(q).__eq__)).alias(f"f{i}") for i, q in enumerate(terms)]
    t = cut(t.select(*scope, *key, F.size("t").alias("len"), *tf), "counts").where("len > 0")
    stats = t.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    t = t.join(stats, scope) if scope else t.crossJoin(stats)  # the other side is one row
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        f, df = F.col(f"f{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))).otherwise(0.0)
        matched = matched + (f > 0).cast("int")
    return t.select(*scope, *key, score.alias("score"), matched.alias("matched")).where("matched > 0")


def top_k(scored: DataFrame, k: int, order: list, per: list[str] | None = None) -> DataFrame:
    """The first ``k`` rows in ``order``, overall or per group, with their rank."""
    if per:
        w = Window.partitionBy(*per).orderBy(*order)
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def search_documents(docs: DataFrame, terms: Sequence[str], k: int = 10) -> DataFrame:
    """Ranked documents with snippets; texts are only fetched for the hits."""
    hits = top_k(bm25(docs, terms, F.col("text"), ["doc_id"]), k or 10, [F.desc("score"), F.col("doc_id")])
    return hits.join(docs.select("doc_id", "text"), "doc_id").select("rank", "doc_id", "score", "matched", snippet(F.col("text"), terms).alias("snippet"))


def search_nodes(nodes: DataFrame, terms: Sequence[str], k: int = 10) -> DataFrame:
    """The best nodes of each document by title, summary and content."""
    fields = [c for c in ("title", "summary", "content") if c in nodes.columns]
    scored = bm25(nodes, terms, F.concat_ws(" ", *fields), ["node_id"], ["doc_id"])
    return top_k(scored, k or 10, [F.desc("score"), F.col("node_id")], ["doc_id"])


def grep(nodes: DataFrame, pattern: str, most: int = 30) -> DataFrame:
    """The first ``most`` matching lines of each document, with their places."""
    lines = nodes.where(F.rlike("content", F.lit(pattern))).select("doc_id", "node_id", F.posexplode(F.split("content", "\n")).alias("k", "line"))
    hits = lines.where(F.rlike("line", F.lit(pattern)))
    w = Window.partitionBy("doc_id").orderBy("node_id", "k")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("doc_id", "node_id", (F.col("k") + 1).alias("line_no"), "line")


def find(nodes: DataFrame, keyword: str) -> DataFrame:
    """Nodes that hold ``keyword`` in title or content, whatever its case."""
    k = keyword.lower()
    return nodes.where(F.lower("title").contains(k) | F.lower("content").contains(k)).select("doc_id", "node_id", "title")


def keyword_entries(posting: DataFrame, keyword: str) -> DataFrame:
    return posting.where(F.col("keyword") == keyword.lower()).select("doc_id", "node_id", "weight", "depth")


def similar_nodes(posting: DataFrame, doc_id: int, node_id: int, k: int = 10) -> DataFrame:
    """Nodes of the document that share keywords with one: the sum of their weights for those."""
    own = posting.where((F.col("doc_id") == doc_id) & (F.col("node_id") == node_id)).select("keyword")
    rest = posting.where((F.col("doc_id") == doc_id) & (F.col("node_id") != node_id))
    scored = rest.join(own, "keyword", "left_semi").groupBy("node_id").agg(F.sum("weight").alias("score"))
    return top_k(scored, k, [F.desc("score"), F.col("node_id")])


def resolve_target(nodes: DataFrame, doc_id: int, parent_id: int, target: str) -> DataFrame:
    """What a name means below a node: exact title, then any case, then part of it, then a number among the children, then deeper (four levels)."""
    t = target.strip().strip("\"'`“”‘’")
    kids = nodes.where((F.col("doc_id") == doc_id) & (F.col("parent_id") == parent_id))
    at = F.row_number().over(Window.orderBy("node_id"))
    low = F.lower("title")
    rank = F.when(F.col("title") == t, 1).when(low == t.lower(), 2).when(low.contains(t.lower()), 3).when(at == (int(t) if t.isdigit() else 0), 4)
    near = kids.select("node_id", "title", rank.alias("way"))
    base = nodes.where((F.col("doc_id") == doc_id) & (F.col("node_id") == parent_id)).select(F.col("depth").alias("_d"), F.col("node_id").alias("_a"), F.col("last_desc").alias("_z"))
    deep = nodes.where(F.col("doc_id") == doc_id).crossJoin(base).where("node_id > _a and node_id <= _z and depth between _d + 2 and _d + 4")  # base is one row
    way = F.when(F.col("title") == t, 5).when(low == t.lower(), 6).when(low.contains(t.lower()), 7)
    return near.unionByName(deep.select("node_id", "title", way.alias("way"))).where("way is not null").orderBy("way", "node_id").limit(1)
