"""The cross-document keyword graph and the routing of questions over documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import cut
from ..functions.text import is_index_term, pieces
from .search import bm25, top_k


def keyword_profiles(units: DataFrame, key: str, text: str, most: int = 50) -> DataFrame:
    """(doc, keyword, weight): each document's ``most`` heaviest keywords, relative to its heaviest."""
    t = units.select(F.col(key).cast("string").alias("doc"), F.explode(pieces(F.col(text))).alias("keyword")).where(is_index_term(F.col("keyword")))
    n = t.groupBy("doc", "keyword").agg(F.count("*").alias("n"))
    w = n.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy("doc")))
    return graph_nodes(w.select("doc", "keyword", "weight"), most)


def graph_nodes(weights: DataFrame, most: int = 50) -> DataFrame:
    """The ``most`` heaviest keywords (mean weight over nodes) of each document."""
    mean = weights.groupBy("doc", "keyword").agg(F.avg("weight").alias("weight"))
    r = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("weight"), "keyword"))
    return mean.withColumn("r", r).where(F.col("r") <= most).drop("r")


def graph_edges(profiles: DataFrame, least_shared: int = 2, least_jaccard: float = 0.1, full: int = 50) -> DataFrame:
    """(src, dst, shared, jaccard, weight) both ways between documents that share enough keywords.

    Prefix filter: documents with a Jaccard similarity of t share one of the n - ceil(t n) + 1 rarest
    keywords of each, so the hottest keywords need no join; the exact counts are taken for those pairs only.
    """
    profiles = cut(profiles, "profiles")
    df = profiles.groupBy("keyword").agg(F.count("*").alias("df"))
    sized = profiles.join(df, "keyword").withColumn("n", F.count("*").over(Window.partitionBy("doc")))
    rare = F.row_number().over(Window.partitionBy("doc").orderBy("df", "keyword"))
    pre = sized.withColumn("r", rare).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least_jaccard - 1e-9) + 1)
    pairs = pre.select("keyword", F.col("doc").alias("a")).join(pre.select("keyword", F.col("doc").alias("b")), "keyword").where("a < b").select("a", "b").distinct()
    sets = profiles.groupBy("doc").agg(F.array_sort(F.collect_set("keyword")).alias("k"))
    p = pairs.join(sets.toDF("a", "ka"), "a").join(sets.toDF("b", "kb"), "b")
    shared = F.size(F.array_intersect("ka", "kb"))
    p = p.withColumn("shared", shared).withColumn("jaccard", F.col("shared") / (F.size("ka") + F.size("kb") - F.col("shared")))
    p = p.where((F.col("shared") >= least_shared) & (F.col("jaccard") >= least_jaccard))
    p = p.withColumn("weight", F.least(F.lit(1.0), 0.6 * F.col("jaccard") + 0.4 * F.least(F.col("shared") / full, F.lit(1.0))))
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return p.select(ends.alias("e"), "shared", "jaccard", "weight").select("e.*", "shared", "jaccard", "weight")


def trim_edges(edges: DataFrame, most: int = 20) -> DataFrame:
    """Each document's ``most`` heaviest edges."""
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return edges.withColumn("rank", r).where(F.col("rank") <= most)


def fuse_routes(scored: DataFrame, terms: Sequence[str], edges: DataFrame, profiles: DataFrame, k: int = 15) -> DataFrame:
    """Documents for a question from their scores (doc, score): half of it BM25, three tenths keyword overlap, two tenths what the best hits' neighbours lend."""
    scored = cut(scored, "scored")
    best = scored.agg(F.max("score").alias("best"))
    scored = scored.crossJoin(best).select("doc", (F.col("score") / F.col("best")).alias("bm25"))  # best is one row
    asked = F.array(*[F.lit(t) for t in terms])
    sets = profiles.groupBy("doc").agg(F.collect_set("keyword").alias("k"))
    common = F.size(F.array_intersect("k", asked))
    overlap = sets.select("doc", (common / (F.size("k") + len(terms) - common)).alias("overlap"))
    seeds = top_k(scored, 5, [F.desc("bm25"), F.col("doc")]).select(F.col("doc").alias("src"), F.col("bm25").alias("seed"))
    lent = edges.join(F.broadcast(seeds), "src").groupBy(F.col("dst").alias("doc")).agg(F.max(F.col("weight") * F.col("seed")).alias("boost"))  # five seeds
    f = scored.join(overlap, "doc", "full").join(lent, "doc", "left").na.fill(0.0, ["bm25", "overlap", "boost"])
    f = f.withColumn("score", 0.5 * F.col("bm25") + 0.3 * F.col("overlap") + 0.2 * F.col("boost")).where("score > 0")
    return top_k(f, k, [F.desc("score"), F.col("doc")])


def route(units: DataFrame, key: str, text: str, terms: Sequence[str], edges: DataFrame, profiles: DataFrame, k: int = 15) -> DataFrame:
    """``fuse_routes`` over the BM25 scores of documents."""
    scored = bm25(units.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text")), terms, F.col("text"), ["doc"])
    return fuse_routes(scored.select("doc", "score"), terms, edges, profiles, k)
