"""Candidates and evidence: fusion, the confidence gate, deduplication, the route cache and call metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, jaccard, word_set


def fuse(sources: list[DataFrame], key: list[str], most: int = 24, per: list[str] | None = None) -> DataFrame:
    """Candidates (key, score, why) of several sources as one list: hits counted, the best score and its reason kept."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    best = F.max(F.struct("score", (-F.col("place")).alias("p"), "why")) if "place" in every.columns else F.max(F.struct("score", F.lit(0).alias("p"), "why"))
    f = every.groupBy(*key).agg(F.count("*").alias("hits"), best.alias("b")).select(*key, "hits", F.col("b.score").alias("score"), F.col("b.why").alias("why"))
    w = Window.partitionBy(*per).orderBy(F.desc("score"), *key) if per else Window.orderBy(F.desc("score"), *key)
    if not per:
        f = f.orderBy(F.desc("score"), *key).limit(most)
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def search_scores(ranked: DataFrame) -> Column:
    return 0.9 - (F.col("rank") - 1) * 0.03


def confidence_gate(cands: DataFrame, n_keywords: int, intent: str, per: list[str]) -> DataFrame:
    """The top candidate of each group that is a sure answer to a simple question."""
    w = Window.partitionBy(*per).orderBy(F.desc("score"), "node_id")
    c = cands.withColumn("next", F.lead("score").over(w)).withColumn("r", F.row_number().over(w)).where("r = 1")
    simple = F.lit(n_keywords <= 4 or intent in ("factual", "procedural"))
    sure = (F.col("hits") >= 2) | F.col("next").isNull() | (F.col("score") >= 0.8) | (F.col("score") - F.col("next") >= 0.2)
    return c.where((F.col("score") >= 0.5) & simple & sure).drop("r", "next")


def read_also(cands: DataFrame, per: list[str], within: float = 0.1) -> DataFrame:
    """The top candidate and the second if it is close."""
    w = Window.partitionBy(*per).orderBy(F.desc("score"), "node_id")
    c = cands.withColumn("r", F.row_number().over(w)).withColumn("best", F.max("score").over(Window.partitionBy(*per)))
    return c.where((F.col("r") == 1) | ((F.col("r") == 2) & (F.col("best") - F.col("score") <= within))).drop("r", "best")


def toc_candidates(nodes: DataFrame, most: int = 24) -> DataFrame:
    """Without indexes: the top sections in order, a hundredth less each."""
    w = Window.partitionBy("doc_id").orderBy("node_id")
    t = nodes.where("depth = 1").withColumn("i", F.row_number().over(w) - 1).where(F.col("i") < most)
    return t.select("doc_id", "node_id", clamp(F.col("title")).alias("title"), (1 - F.col("i") * 0.01).alias("score"), F.lit("toc").alias("why"))


def expand_children(cands: DataFrame, nodes: DataFrame) -> DataFrame:
    """Children of candidates that aren't candidates yet, a hundredth less by place."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    kids = nodes.where("parent_id is not null").select("doc_id", "parent_id", "node_id", F.row_number().over(w).alias("i"))
    c = cands.select("doc_id", F.col("node_id").alias("parent_id"), "score")
    new = kids.join(c, ["doc_id", "parent_id"]).join(cands.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
    return new.groupBy("doc_id", "node_id").agg(F.max(F.col("score") - 0.01 * F.col("i")).alias("score"))


MIN_CHARS = 50
NEAR = 0.8


def first_of_source(evidence: DataFrame, per: list[str] | None = None) -> DataFrame:
    """Evidence (seq, source_path, content, doc_name, …) of some length, the first of each source."""
    long = evidence.where(F.length(F.trim("content")) >= MIN_CHARS)
    w = Window.partitionBy(*(per or []), F.coalesce(F.nullif(F.col("doc_name"), F.lit("")), F.lit("_unknown")), "source_path").orderBy("seq")
    return long.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dedup_evidence(evidence: DataFrame, per: str) -> DataFrame:
    """``first_of_source``, less what nearly repeats an earlier piece that stays, in order, per question (column ``per``).

    Whether a piece stays depends on the earlier ones that do, so each question's bounded list of evidence is folded in order.
    """
    e = first_of_source(evidence, [per]).withColumn("_ws", word_set(F.col("content")))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        keep = []
        for ws in (set(w) for w in f.sort_values("seq")["_ws"]):
            keep.append(all(len(ws & k) < NEAR * len(ws | k) for k in kept))
            if keep[-1]:
                kept.append(ws)
        return f.sort_values("seq")[keep].drop(columns="_ws")

    return e.groupBy(per).applyInPandas(fold, evidence.schema)


def format_answer(evidence: DataFrame, per: str, navigational: bool = False) -> DataFrame:
    """One text per question: places for navigational ones, else the pieces under their titles."""
    if navigational:
        line = F.concat(F.lit("- **"), "node_title", F.lit("** in "), F.coalesce("doc_name", F.lit("unknown")), F.lit(" at "), "source_path")
    else:
        line = F.concat(F.lit("["), "node_title", F.when(F.coalesce("doc_name", F.lit("")) != "", F.concat(F.lit(" — "), "doc_name")).otherwise(""), F.lit("]\n"), "content")
    parts = evidence.groupBy(per).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda s: s["line"]), "\n" if navigational else "\n\n")
    return parts.select(per, (F.concat(F.lit("Found at:\n"), text, F.lit("\n")) if navigational else text).alias("answer"))


def cache_lookup(cache: DataFrame, asked: DataFrame, least_confidence: float = 0.7, least_jaccard: float = 0.8) -> DataFrame:
    """For each question (ask_id, doc_id, intent, keywords) the node ids of the best cached route that is close enough."""
    c = cache.where(F.col("confidence") >= least_confidence).withColumnRenamed("keywords", "known")
    j = asked.join(c, ["doc_id", "intent"]).withColumn("j", jaccard(F.array_distinct("keywords"), F.array_distinct("known")))
    w = Window.partitionBy("ask_id").orderBy(F.desc("j"), F.desc("confidence"), F.desc("hits"))
    return j.where((F.col("j") >= least_jaccard) & (F.size("keywords") > 0)).withColumn("r", F.row_number().over(w)).where("r = 1 and size(node_ids) > 0").select("ask_id", "doc_id", "node_ids", "confidence")


def cache_record(cache: DataFrame, routes: DataFrame, most: int = 200) -> DataFrame:
    """The cache with new routes: the same document, intent and keywords count hits and keep the surer nodes; the least hit go beyond ``most``."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(routes.withColumn("hits", F.lit(1)).withColumn("_new", F.lit(1))).where("size(node_ids) > 0 and size(keywords) > 0")
    both = both.withColumn("keywords", F.array_sort(F.array_distinct("keywords")))
    m = both.groupBy("doc_id", "intent", "keywords").agg(F.max(F.struct("confidence", "_new", "node_ids")).alias("b"), F.sum("hits").cast("int").alias("hits"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "intent", "keywords")
    m = m.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return m.select("doc_id", "intent", "keywords", F.col("b.node_ids").alias("node_ids"), F.col("b.confidence").alias("confidence"), "hits")


def llm_metrics(calls: DataFrame, price_in: float = 0.00015, price_out: float = 0.0006) -> DataFrame:
    """Calls (tokens_in, tokens_out, ms, ok) summed, with their cost per thousand tokens."""
    return calls.agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.avg("ms").alias("avg_ms"), (F.sum("tokens_in") / 1000 * price_in + F.sum("tokens_out") / 1000 * price_out).alias("cost"),
    )


def retrieval_metrics(runs: DataFrame) -> DataFrame:
    """Runs (iterations, path_length, score, cached) summed: high from 0.5, low under 0.3."""
    return runs.agg(
        F.count("*").alias("queries"), F.avg("iterations").alias("avg_iterations"), F.avg("path_length").alias("avg_path_length"), F.avg("score").alias("avg_score"),
        F.count_if(F.col("score") >= 0.5).alias("high"), F.count_if(F.col("score") < 0.3).alias("low"), F.avg(F.col("cached").cast("double")).alias("hit_rate"),
    )


def ask_metrics(outputs: DataFrame) -> DataFrame:
    """Outputs of several documents as one: sums, and whether any was checked."""
    return outputs.groupBy("ask_id").agg(F.sum("llm_calls").alias("llm_calls"), F.sum("nodes_visited").alias("nodes_visited"), F.sum("evidence").alias("evidence"), F.bool_or("checked").alias("checked"))
