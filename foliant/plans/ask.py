"""Answering a question over a workspace: analysis, choice of documents, candidates, reading, synthesis.

Candidates of all chosen documents are found in one plan; only bounded lists (``MOST`` candidates of up to
``max_docs`` documents) reach the driver, where the model, or the rules that stand in for it, decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.staging import cut
from ..functions.text import clamp, clamp_preview, query_search_terms, routing_hint
from ..operators import evidence, graph, search
from .llm import Model, QueryAnalysis, analyse, extract_json, parse_dispatch

MOST = 24


@dataclass
class Answer:
    query: str
    intent: str
    confidence: float
    answer: str
    evidence: DataFrame
    docs: list[int] = field(default_factory=list)
    metrics: dict[str, int] = field(default_factory=dict)


@dataclass
class Tables:
    """The tables of the documents in scope."""

    nodes: DataFrame
    postings: DataFrame
    scores: DataFrame
    intents: DataFrame | None = None
    concepts: DataFrame | None = None
    cards: DataFrame | None = None
    cache: DataFrame | None = None

    def of(self, docs: DataFrame) -> Tables:
        return Tables(*[None if t is None else t.join(docs, "doc_id", "left_semi") for t in (self.nodes, self.postings, self.scores, self.intents, self.concepts, self.cards, self.cache)])


def cross_find(postings: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """The three heaviest nodes of each document for each of the first five keywords: (doc_id, keyword, node_id, weight, rank)."""
    held = postings.where(F.col("keyword").isin(list(keywords[:5])))
    return search.top_k(held, 3, [F.desc("weight"), F.col("node_id")], ["doc_id", "keyword"])


def gather(t: Tables, terms: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """Candidates of each document from search, intent and concept routes, keyword entries and evidence scores, fused."""
    found = search.search_nodes(t.nodes, terms, 12)
    parts = [found.select("doc_id", "node_id", evidence.search_scores(found).alias("score"), F.lit("search").alias("why"), F.lit(0).alias("place"))]
    asked = list(keywords[:5])
    if t.intents is not None:
        # a route counts for a question that shares a word with what the node answers
        meant = F.exists(F.array(*[F.lit(k) for k in asked]), lambda k: F.lower("reason").contains(k)) if asked else F.lit(False)
        best = t.intents.where(meant).groupBy("doc_id", "node_id").agg(F.max("relevance").alias("relevance"))
        best = search.top_k(best, 3, [F.desc("relevance"), F.col("node_id")], ["doc_id"])
        parts.append(best.select("doc_id", "node_id", F.col("relevance").alias("score"), F.lit("intent").alias("why"), F.lit(1).alias("place")))
    if t.concepts is not None and asked:
        c = t.concepts.withColumn("keyword", F.explode(F.array(*[F.lit(k) for k in asked]))).where(F.col("concept").contains(F.col("keyword")))
        c = search.top_k(c.groupBy("doc_id", "keyword", "node_id").agg(F.max("relevance").alias("relevance")), 3, [F.desc("relevance"), F.col("node_id")], ["doc_id", "keyword"])
        parts.append(c.select("doc_id", "node_id", F.col("relevance").alias("score"), F.concat(F.lit("concept:"), "keyword").alias("why"), F.lit(2).alias("place")))
    held = cross_find(t.postings, asked)
    parts.append(held.select("doc_id", "node_id", F.col("weight").alias("score"), F.concat(F.lit("kw:"), "keyword").alias("why"), F.lit(3).alias("place")))
    good = search.top_k(t.scores, 12, [F.desc("composite"), F.col("node_id")], ["doc_id"])
    parts.append(good.select("doc_id", "node_id", F.col("composite").alias("score"), F.lit("score").alias("why"), F.lit(4).alias("place")))
    return evidence.fuse(parts, ["doc_id", "node_id"], MOST, ["doc_id"])


class Asker:
    def __init__(self, tables: Tables, model: Model | None = None, edges: Callable[[], DataFrame] | None = None, max_docs: int = 10, k: int = 8, beam: int = 3, on_event: Callable[[str, Any], None] | None = None):
        self.tables, self.model, self.edges, self.max_docs, self.k, self.beam = tables, model, edges, max_docs, k, beam
        self.on_event = on_event or (lambda name, what: None)
        self.calls = 0

    def _said(self, prompt: str) -> str | None:
        """The model's answer; None without a model or when it fails, so that rules decide."""
        if self.model is None:
            return None
        self.calls += 1
        try:
            return self.model.complete(prompt)
        except Exception as e:
            self.on_event("model_failed", str(e))
            return None

    # which documents

    def dispatch(self, a: QueryAnalysis, t: Tables, leave: Sequence[int] = ()) -> list[int] | None:
        """Documents to read, best first; None if the model says that no reading is needed."""
        hits = cross_find(t.postings, a.keywords).where(~F.col("doc_id").isin(list(leave))) if leave else cross_find(t.postings, a.keywords)
        scored = hits.groupBy("doc_id").agg(F.sum("weight").alias("score"))
        texts = search.bm25(t.nodes, query_search_terms(a.original), F.concat_ws(" ", "title", "content"), ["node_id"], ["doc_id"]).groupBy("doc_id").agg(F.max("score").alias("score"))
        texts = texts.where(~F.col("doc_id").isin(list(leave))) if leave else texts
        both = scored.unionByName(texts).groupBy("doc_id").agg(F.sum("score").alias("score"))
        if self.edges is not None:
            seeds = search.top_k(both, 5, [F.desc("score"), F.col("doc_id")]).select(F.col("doc_id").cast("string").alias("src"), F.col("score").alias("seed"))
            lent = self.edges().join(seeds, "src").groupBy(F.col("dst").cast("long").alias("doc_id")).agg((0.2 * F.max(F.col("weight") * F.col("seed"))).alias("lent"))
            both = both.join(lent, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("lent", F.lit(0.0))).alias("score"))
        ranked = [r.doc_id for r in both.orderBy(F.desc("score"), "doc_id").limit(self.max_docs).collect()]
        if len(ranked) > 1 and self.model is not None and t.cards is not None:
            cards = {r.doc_id: r for r in t.cards.where(F.col("doc_id").isin(ranked)).collect()}
            listed = "\n".join(f"{i}. {cards[d].title}: {cards[d].sections}" for i, d in enumerate(ranked, 1) if d in cards)
            said = self._said(f"Which of these documents must be read to answer, as lines '- doc: n' with reason: and task:? ALREADY_ANSWERED if none.\n{listed}\nQuestion: {a.original}")
            plan = parse_dispatch(said, len(ranked)) if said is not None else []
            if plan is None:
                return None
            ranked = [ranked[p["doc"] - 1] for p in plan] or ranked
        return ranked

    # which nodes

    def candidates(self, a: QueryAnalysis, docs: Sequence[int]) -> tuple[DataFrame, DataFrame]:
        """(candidates, nodes) of the documents: cached routes, else all indexes, else the top sections; children of inner nodes too."""
        spark = self.tables.nodes.sparkSession
        scope = cut(spark.createDataFrame([(int(d),) for d in docs], "doc_id long"), "scope")
        t = self.tables.of(scope)
        known = None
        if t.cache is not None and a.keywords:
            asked = scope.select(F.col("doc_id").alias("ask_id"), "doc_id", F.lit(a.intent).alias("intent"), F.array(*[F.lit(k) for k in a.keywords]).alias("keywords"))
            known = evidence.cache_lookup(t.cache, asked)
            known = cut(known.select("doc_id", F.explode("node_ids").alias("node_id"), F.lit(2).cast("long").alias("hits"), F.col("confidence").alias("score"), F.lit("cached").alias("why")), "known")
        c = cut(gather(t, query_search_terms(a.original), a.keywords).drop("rank"), "candidates")
        if known is not None:
            c = c.join(known.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(known)
        toc = evidence.toc_candidates(t.nodes.join(c.select("doc_id").distinct(), "doc_id", "left_anti"), MOST)
        c = c.unionByName(toc.select("doc_id", "node_id", F.lit(1).cast("long").alias("hits"), "score", "why"))
        inner = c.join(t.nodes.where("content = ''").select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")
        more = evidence.expand_children(inner, t.nodes).join(c.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
        c = c.unionByName(more.select("doc_id", "node_id", F.lit(1).cast("long").alias("hits"), "score", F.lit("child").alias("why")))
        return cut(c, "candidates"), t.nodes

    def read(self, a: QueryAnalysis, docs: Sequence[int]) -> list[Row]:
        """The rows (doc_id, node_id, title, content, score) to use as evidence."""
        c, nodes = self.candidates(a, docs)
        full = c.join(nodes.select("doc_id", "node_id", "title", "content", *[x for x in ("summary", "hints") if x in nodes.columns]), ["doc_id", "node_id"]).where("content <> ''")
        full = cut(full, "readable")
        sure = cut(evidence.confidence_gate(full, len(a.keywords), a.intent, ["doc_id"]).select("doc_id"), "sure")
        fast = evidence.read_also(full.join(sure, "doc_id", "left_semi"), ["doc_id"])
        rows = fast.collect()  # two of each document at most
        slow = full.join(sure, "doc_id", "left_anti")
        w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "node_id")
        hint = routing_hint(F.col("hints"), F.col("summary")) if {"hints", "summary"} <= set(full.columns) else F.lit("")
        listed = slow.withColumn("r", F.row_number().over(w)).where(F.col("r") <= MOST).withColumn("label", F.concat(clamp(F.col("title")), hint)).withColumn("preview", clamp_preview(F.col("content")))
        by_doc: dict[int, list[Row]] = {}
        for r in listed.orderBy("doc_id", "r").collect():
            by_doc.setdefault(r.doc_id, []).append(r)
        for some in by_doc.values():
            rows += self.pick(a, some)
        return sorted(rows, key=lambda r: (-r.score, r.doc_id, r.node_id))

    def pick(self, a: QueryAnalysis, some: list[Row]) -> list[Row]:
        """Nodes that the model picks, in beams until one verifies; without a model the first three."""
        said = self._said("Which of these sections answer the question? Numbers only, best first.\n" + "\n".join(f"{i}. {r.label} — {r.preview}" for i, r in enumerate(some, 1)) + f"\nQuestion: {a.original}")
        if said is None:
            return some[:3]
        order = [int(x) - 1 for x in dict.fromkeys(re.findall(r"\d+", said)) if 1 <= int(x) <= len(some)] or list(range(len(some)))
        for k in range(0, len(order), self.beam):
            beam = [some[i] for i in order[k : k + self.beam]]
            if self.verified(a, beam):
                return beam
        return [some[i] for i in order[: self.beam]]

    def verified(self, a: QueryAnalysis, rows: list[Row]) -> bool:
        """Whether the model finds an answer in the texts; a failing model accepts them."""
        said = self._said("Do these texts answer the question? yes or no.\n" + "\n\n".join(r.content for r in rows) + f"\nQuestion: {a.original}")
        return said is None or not said.strip().lower().startswith("no")

    # the answer

    def found(self, rows: list[Row]) -> DataFrame:
        spark = self.tables.nodes.sparkSession
        schema = "ask int, seq int, source_path string, node_title string, content string, doc_name string, score double"
        return evidence.dedup_evidence(spark.createDataFrame([(1, i, f"{r.doc_id}/{r.node_id}", r.title, r.content, str(r.doc_id), float(r.score)) for i, r in enumerate(rows, 1)], schema), "ask")

    def synthesis(self, a: QueryAnalysis, kept: DataFrame, first: list[Row]) -> tuple[str, float]:
        """The answer's text and confidence: places for navigational questions, the model's words, or the evidence itself."""
        text = lambda nav: (evidence.format_answer(kept, "ask", nav).collect() or [Row(answer="")])[0].answer
        if not first:
            return "", 0.0
        if a.intent == "navigational":
            return text(True), 0.7
        said = self._said("Answer from these texts alone, as JSON {answer, confidence}.\n" + "\n\n".join(f"[{r.node_title}]\n{r.content}" for r in first[:8]) + f"\nQuestion: {a.original}")
        if self.model is None:
            return text(False), float(min(1.0, max(r.score for r in first)))
        try:
            got = extract_json(said)
            return str(got["answer"]), float(min(1.0, max(0.0, float(got.get("confidence", 0.5)))))
        except Exception:
            return text(False), 0.4

    def gaps(self, a: QueryAnalysis, answer: str) -> str | None:
        """What the model still misses, as another question."""
        said = self._said(f"What is missing in this answer? One question, or NONE.\nQuestion: {a.original}\nAnswer: {answer}")
        return None if said is None or not said.strip() or said.strip().upper().startswith("NONE") else said.strip()

    def ask(self, query: str, scoped: bool = False) -> Answer:
        a = analyse(query, self.model)
        self.on_event("analysed", a)
        docs = self.dispatch(a, self.tables)
        self.on_event("dispatched", docs)
        rows = self.read(a, docs) if docs else []
        kept = self.found(rows[: self.k])
        first = kept.orderBy("seq").collect()
        answer, confidence = self.synthesis(a, kept, first)
        # one more round over other documents, where the whole workspace is asked
        again = self.gaps(a, answer) if docs and not scoped else None
        if again or (docs is not None and not first and not scoped):
            b = analyse(again or query, self.model)
            others = self.dispatch(b, self.tables, docs) or []
            if others:
                rows += self.read(b, others)
                rows.sort(key=lambda r: (-r.score, r.doc_id, r.node_id))
                docs, kept = [*docs, *others], self.found(rows[: self.k])
                first = kept.orderBy("seq").collect()
                answer, confidence = self.synthesis(a, kept, first)
        self.on_event("answered", answer)
        return Answer(query, a.intent, confidence, answer, kept, list(docs or []), {"llm_calls": self.calls, "nodes_visited": len(rows), "evidence": len(first)})


def routes_taken(a: Answer, keywords: Sequence[str]) -> list[tuple]:
    """Rows for the route cache: of each document the nodes that became evidence."""
    by: dict[int, list[int]] = {}
    for r in a.evidence.select("source_path").collect():
        doc, node = r.source_path.split("/")
        by.setdefault(int(doc), []).append(int(node))
    return [(d, a.intent, list(keywords), nodes, a.confidence) for d, nodes in sorted(by.items())]


def document_graph(postings: DataFrame) -> DataFrame:
    """Trimmed edges between documents by the keywords of their postings."""
    profiles = graph.graph_nodes(postings.select(F.col("doc_id").cast("string").alias("doc"), "keyword", "weight"))
    return graph.trim_edges(graph.graph_edges(profiles))

