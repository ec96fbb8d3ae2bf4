"""Summaries, questions and tags of nodes: by a model where there is one, else by rules."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_nav_response, token_estimate

SHORT = 50


def should_generate(strategy: str, least_tokens: int = 100):
    """Which nodes a strategy summarises: full (all), selective (leaves and longer nodes), lazy and none (no node beforehand)."""
    t = token_estimate(F.col("content"))
    return {"full": F.lit(True), "selective": F.col("is_leaf") | (t >= least_tokens), "lazy": F.lit(False), "none": F.lit(False)}[strategy]


def enhance(nodes: DataFrame, posting: DataFrame, strategy: str = "full", max_tags: int = 5) -> DataFrame:
    """``nodes`` with summary, hints and tags, without a model.

    Short contents are their own summary, longer ones give their first sentences up to 200 characters,
    inner nodes the titles of their children; tags are a node's heaviest keywords.
    """
    start = F.substring("content", 1, 200)
    cut = F.regexp_extract(start, r"(?s)^(.*[.!?])\s", 1)
    own = F.when(token_estimate(F.col("content")) <= SHORT, F.col("content")).otherwise(F.coalesce(F.nullif(cut, F.lit("")), start))
    kids = nodes.where("parent_id is not null").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("node_id", "title"))).alias("k"))
    w = Window.partitionBy("doc_id", "node_id").orderBy(F.desc("weight"), "keyword")
    top = posting.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_tags)
    tags = top.groupBy("doc_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "keyword"))), lambda x: x["keyword"]).alias("tags"))
    titles = F.array_join(F.transform("k", lambda x: x["title"]), "; ")
    summary = F.when(should_generate(strategy), F.coalesce(F.nullif(own, F.lit("")), titles, F.lit(""))).otherwise("")
    none = F.array().cast("array<string>")
    return nodes.join(kids, ["doc_id", "node_id"], "left").join(tags, ["doc_id", "node_id"], "left").select(*[nodes[c] for c in nodes.columns], summary.alias("summary"), none.alias("hints"), F.coalesce("tags", none).alias("tags"))


def enhance_by_model(nodes: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """``nodes`` with what a model says of each: ``complete`` runs on the executors and answers OVERVIEW, QUESTIONS and TAGS lines."""

    def ask(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "node_id": f["node_id"], "answer": [complete(f"{t}\n{c}") for t, c in zip(f["title"], f["content"], strict=True)]})

    said = nodes.select("doc_id", "node_id", "title", "content").mapInPandas(ask, "doc_id long, node_id int, answer string")
    said = said.select("doc_id", "node_id", parse_nav_response(F.col("answer")).alias("a"))
    return nodes.join(said, ["doc_id", "node_id"], "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("a.overview", F.lit("")).alias("summary"), F.col("a.questions").alias("hints"), F.col("a.tags").alias("tags"))


def verify(nodes: DataFrame, concepts: DataFrame | None = None) -> list[str]:
    """What a compile should be warned of; raises if there are no nodes."""
    r = nodes.agg(F.count("*").alias("n"), F.count_if((F.col("depth") == 0) & (F.coalesce("summary", F.lit("")) == "") if "summary" in nodes.columns else F.lit(False)).alias("bare")).first()
    if not r.n:
        raise ValueError("no nodes were compiled")
    out = [f"{r.bare} documents without a summary"] if r.bare else []
    return out + (["no concepts"] if concepts is not None and concepts.isEmpty() else [])
