"""In-text references, their targets, and the chains they form."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_spans

# How references are written, in order of precedence at one place. Digits are ASCII digits.
PATTERNS = [
    ("section", r"(?i)(?:see\s+)?(?:section|sec\.?)\s+([0-9.]+)"),
    ("section", r"(?i)(?:see\s+)?(?:chapter|ch\.?)\s+([0-9]+)"),
    ("appendix", r"(?i)(?:see\s+)?(?:appendix|app\.?)\s+([A-Z]|[a-z])"),
    ("table", r"(?i)(?:see\s+)?(?:table|tbl\.?)\s+([0-9.]+)"),
    ("figure", r"(?i)(?:see\s+)?(?:figure|fig\.?)\s+([0-9.]+)"),
    ("page", r"(?i)(?:see\s+)?(?:page|p\.?)\s+([0-9]+)"),
    ("equation", r"(?i)(?:see\s+)?(?:equation|eq\.?)\s+([0-9.]+)"),
]
HINT = r"(?i)section|sec\.?\s|chapter|ch\.?\s|appendix|app\.?\s|table|tbl|figure|fig|page|p\.?\s|equation|eq"


def extract(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, position, ref_type, ref_text, target_id), one per place; positions count characters from 0."""
    def matches(order: int, kind: str, pattern: str):
        def row(m):
            return F.struct(m["start"].alias("position"), F.lit(order).alias("o"), F.lit(kind).alias("ref_type"), m["s"].alias("ref_text"), F.rtrim(F.regexp_extract(m["s"], pattern, 1), F.lit(".")).alias("target_id"))

        return F.transform(match_spans(F.col("content"), pattern), row)

    found = [matches(order, kind, pattern) for order, (kind, pattern) in enumerate(PATTERNS)]
    likely = nodes.where(F.rlike("content", F.lit(HINT)))  # cheap, before the patterns
    each = likely.select("doc_id", "node_id", F.explode(F.concat(*found)).alias("r")).select("doc_id", "node_id", "r.*")
    w = Window.partitionBy("doc_id", "node_id", "position").orderBy("o")
    return each.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "o")


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with target_node and confidence (0.8, or 0 where nothing is found).

    Sections match a structure number, else the first below it; appendices a title's start; tables and
    figures a title's part; pages the deepest node on them. The first in pre-order wins.
    """
    n = nodes.select("doc_id", F.col("node_id").alias("t"), "structure", "title", "depth", *[c for c in ("start_page", "end_page") if c in nodes.columns])
    keys = ["doc_id", "node_id", "position"]
    # sections: a node answers for its own number and for every number above it, so they meet by equality
    digits = F.split("structure", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(digits)), lambda k: F.array_join(F.slice(digits, 1, k), "."))
    sections = n.where("structure <> ''").select("doc_id", "t", F.size(digits).alias("depth"), F.explode(above).alias("target_id"))
    sections = sections.groupBy("doc_id", "target_id").agg(F.min(F.struct((F.size(F.split("target_id", r"\.")) != F.col("depth")).cast("int").alias("o"), "t")).alias("b"))
    hits = [refs.where("ref_type = 'section'").select(*keys, "target_id").join(sections, ["doc_id", "target_id"]).select(*keys, "b")]
    # appendices, tables and figures: titles that name the kind give the few words that can be meant
    title = F.lower("title")
    for kind, pattern in (("appendix", "^appendix (.)"), ("table", r"table ([0-9.]+)"), ("figure", r"figure ([0-9.]+)")):
        said = n.where(title.contains(kind)).select("doc_id", "t", F.explode(F.regexp_extract_all(title, F.lit(pattern), F.lit(1))).alias("said"))
        # a reference names the beginning of what the title says
        starts = said.select("doc_id", "t", F.explode(F.transform(F.sequence(F.lit(1), F.length("said")), lambda k: F.substring(F.col("said"), F.lit(1), k))).alias("target_id"))
        starts = starts.groupBy("doc_id", "target_id").agg(F.min("t").alias("t"))
        named = refs.where(F.col("ref_type") == kind).select(*keys, F.lower("target_id").alias("target_id"))
        hits.append(named.join(starts, ["doc_id", "target_id"]).select(*keys, F.struct(F.lit(0).alias("o"), "t").alias("b")))
    if "start_page" in nodes.columns:
        # nodes per page they lie on: the deepest answers
        pages = n.where("start_page is not null and end_page >= start_page").select("doc_id", "t", "depth", F.explode(F.sequence("start_page", "end_page")).alias("page"))
        pages = pages.groupBy("doc_id", "page").agg(F.min(F.struct((-F.col("depth")).alias("o"), "t")).alias("b"))
        asked = refs.where("ref_type = 'page'").select(*keys, F.col("target_id").try_cast("int").alias("page"))
        hits.append(asked.join(pages, ["doc_id", "page"]).select(*keys, F.col("b")))
    best = functools.reduce(DataFrame.unionByName, [h.select(*keys, F.col("b.t").alias("b")) for h in hits])
    out = refs.join(best, keys, "left")
    return out.select(*refs.columns, F.col("b").alias("target_node"), F.when(F.col("b").isNull(), 0.0).otherwise(0.8).alias("confidence"))


def chains(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, premise, conclusion, chain_type, summary): what a node refers to supports it, or elaborates on it if deeper."""
    n = nodes.select("doc_id", "node_id", "depth", "title")
    r = resolved.where("target_node is not null and target_node <> node_id")
    r = r.join(n.toDF("doc_id", "node_id", "d1", "t1"), ["doc_id", "node_id"]).join(n.toDF("doc_id", "target_node", "d2", "t2"), ["doc_id", "target_node"])
    kind = F.when(F.col("ref_type") == "footnote", "elaboration").when((F.col("ref_type") == "section") & (F.col("d2") > F.col("d1")), "elaboration").otherwise("supporting")
    return r.select("doc_id", F.col("target_node").alias("premise"), F.col("node_id").alias("conclusion"), kind.alias("chain_type"), F.concat("t1", F.lit(" → "), "t2").alias("summary"))


def chains_for(chain: DataFrame) -> DataFrame:
    """Chains by each node they touch."""
    return chain.select("doc_id", F.col("premise").alias("node_id"), "premise", "conclusion", "chain_type").unionByName(chain.select("doc_id", F.col("conclusion").alias("node_id"), "premise", "conclusion", "chain_type"))
