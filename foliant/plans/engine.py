"""The engine: compiles documents into trees and indexes in a workspace of tables, and answers questions over them."""

from __future__ import annotations

import queue
import threading
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.staging import cut
from ..functions.text import fingerprint
from ..operators import enhance, evidence, indexes, references, trees
from ..operators.incremental import logic_fingerprint, node_fingerprints
from ..sources.readers import source
from .ask import Answer, Asker, Tables, document_graph, routes_taken
from .llm import Model, analyse
from .navigator import Navigator
from .pipeline import Pipeline
from .storage import TableStore

VERSION = 2
TABLES = (
    "nodes", "postings", "sections", "nav_entries", "child_routes", "doc_cards", "summaries", "intent_routes", "concept_routes", "evidence_scores", "overlaps", "references", "chains", "concepts", "fingerprints", "catalog",
)
CACHE = "doc_id long, intent string, keywords array<string>, node_ids array<int>, confidence double, hits int"


class FoliantError(Exception):
    """What the engine raises; ``retryable`` says whether another try can help."""

    retryable = False


class DocumentNotFoundError(FoliantError, KeyError):
    pass


class CompileError(FoliantError):
    retryable = True


def compile_pipeline(config: Config | None = None, overlaps: bool = True, synonyms: DataFrame | None = None, complete: Callable[[str], str] | None = None) -> Pipeline:
    """The passes from raw nodes (context key raw) to all indexes."""
    config = config or Config()

    def put(key, make):
        return lambda c: c.__setitem__(key, make(c))

    def written(key, make):  # what many passes read is made once
        return lambda c: c.__setitem__(key, cut(make(c), key))

    def posted(c):
        p = indexes.postings(c["nodes"], config.max_keyword_entries, config.max_topic_entries)
        return p if synonyms is None else indexes.expand_synonyms(p, synonyms)

    def enhanced(c):
        return enhance.enhance_by_model(c["nodes"], complete) if complete else enhance.enhance(c["nodes"], indexes.postings(c["nodes"], config.max_keyword_entries, config.max_topic_entries), config.summaries)

    p = Pipeline()
    p.stage("split", written("raw", lambda c: trees.split_raw(c["raw"], config.max_tokens_per_node)), priority=5)
    p.stage("build", written("nodes", lambda c: trees.optimised(trees.build_tree(c["raw"]), config.merge_below)), ("split",), 10)
    p.stage("validate", put("warnings", lambda c: trees.validate(c["nodes"])), ("build",), 20, optional=True)
    p.stage("enhance", written("nodes", enhanced), ("build",), 30)
    p.stage("references", written("references", lambda c: references.resolve(references.extract(c["nodes"]), c["nodes"])), ("enhance",), 40)
    if overlaps:
        p.stage("overlap", put("overlaps", lambda c: indexes.overlaps(c["nodes"], config.overlap_threshold)), ("enhance",), 45, optional=True)
    p.stage("postings", written("postings", posted), ("enhance",), 50)
    p.stage("sections", put("sections", lambda c: indexes.section_map(c["nodes"])), ("enhance",), 50)
    p.stage("nav_entries", put("nav_entries", lambda c: indexes.nav_entries(c["nodes"])), ("enhance",), 50)
    p.stage("child_routes", put("child_routes", lambda c: indexes.child_routes(c["nodes"])), ("enhance",), 50)
    p.stage("doc_cards", put("doc_cards", lambda c: indexes.doc_cards(c["nodes"])), ("enhance",), 55)
    p.stage("summaries", put("summaries", lambda c: indexes.summary_shortcut(c["nodes"])), ("enhance",), 55, optional=True)
    p.stage("intent_routes", put("intent_routes", lambda c: indexes.intent_routes(c["nodes"])), ("enhance",), 55, optional=True)
    p.stage("concept_routes", put("concept_routes", lambda c: indexes.concept_routes(c["nodes"])), ("enhance",), 55, optional=True)
    p.stage("evidence", put("evidence_scores", lambda c: indexes.evidence_scores(c["nodes"])), ("enhance",), 55, optional=True)
    p.stage("chains", put("chains", lambda c: references.chains(c["references"], c["nodes"])), ("references",), 60, optional=True)
    p.stage("concepts", put("concepts", lambda c: indexes.concepts(c["postings"], c["nodes"])), ("postings",), 60, optional=True)
    p.stage("fingerprints", put("fingerprints", lambda c: node_fingerprints(c["nodes"])), ("enhance",), 90)
    return p


class Engine:
    """A workspace folder of Parquet tables, one per index, keyed by document."""

    def __init__(self, spark: SparkSession, workspace: str, model: Model | None = None, config: Config | None = None, on_event: Callable[[str, Any], None] | None = None):
        self.spark, self.workspace, self.model, self.config = spark, workspace.rstrip("/"), model, config or Config()
        self.store = TableStore(spark, self.workspace)
        self.pipeline: Pipeline | None = None
        self.on_event = on_event or (lambda name, what: None)
        self._open: OrderedDict[int, Navigator] = OrderedDict()
        self.opened = self.reopened = 0
        self.asked: list[dict[str, int]] = []

    @classmethod
    def from_env(cls, spark: SparkSession, **overrides: Any) -> Engine:
        config = Config.load(**overrides)
        return cls(spark, config.workspace, config=config)

    @classmethod
    def from_config_file(cls, spark: SparkSession, path: str, **overrides: Any) -> Engine:
        config = Config.load(path, **overrides)
        return cls(spark, config.workspace, config=config)

    def table(self, name: str) -> DataFrame:
        if not self.store.exists(name):
            raise DocumentNotFoundError(name)
        return self.store.read(name)

    def logic(self) -> str:
        """A hash of what decides results; a document compiled by another is compiled again."""
        c = self.config
        return logic_fingerprint({"tables": TABLES, "version": VERSION, "options": [c.max_keyword_entries, c.max_topic_entries, c.overlap_threshold, c.max_tokens_per_node, c.merge_below, c.summaries], "model": type(self.model).__name__})

    def compile(self, mode: str = "default", synonyms: DataFrame | None = None, complete: Callable[[str], str] | None = None, **inputs: Any) -> dict[str, int]:
        """Compiles one kind of input; unchanged documents are skipped unless ``mode`` is "force". ``complete`` summarises on the executors."""
        raw = cut(source(self.spark, **inputs).select("doc_id", "seq", "level", "title", "content"), "raw")
        part = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws("\n", F.col("level").cast("string"), "title", "content").alias("t"))))
        now = raw.groupBy("doc_id").agg(fingerprint(F.array_join(F.transform(part, lambda x: x["t"]), "\n")).alias("content_fp"), F.count("*").alias("node_count"))
        where = inputs.get("path") or inputs.get("directory") or ""
        now = now.withColumns({"logic_fp": F.lit(self.logic()), "version": F.lit(VERSION), "source_path": F.lit(str(where))})
        if any(inputs.get(k) for k in ("path", "paths", "directory")):
            from ..sources.readers import EXTENSIONS, files

            given = [inputs["path"]] if inputs.get("path") else [inputs["directory"]] if inputs.get("directory") else list(inputs["paths"])
            at = files(self.spark, given, inputs.get("recursive", True), inputs.get("extensions", EXTENSIONS)).select("doc_id", F.col("path").alias("_at"))
            now = now.join(at, "doc_id", "left").withColumn("source_path", F.coalesce("_at", "source_path")).drop("_at")
        now = cut(now, "now")
        todo, total, keys = now, now.count(), ["doc_id", "content_fp", "logic_fp", "version"]
        if self.store.exists("catalog") and mode != "force":
            todo = cut(now.join(self.table("catalog").select(keys), keys, "left_anti"), "todo")
        n = todo.count()
        if n:
            context = {"raw": raw.join(todo.select("doc_id"), "doc_id", "left_semi")}
            self.pipeline = compile_pipeline(self.config, synonyms=synonyms, complete=complete)
            self.pipeline.on_event = lambda name, how: self.on_event(f"pass_{how}", name)
            try:
                self.pipeline.run(context)
            except ValueError:
                raise
            except Exception as e:
                raise CompileError(str(e)) from e
            context["catalog"] = todo
            with self.store.lock():
                for name in TABLES:
                    if name in context:  # rows of recompiled documents give way, also where they have none now
                        self.store.upsert(name, context[name], todo.select("doc_id"))
            self._changed()
        self.on_event("compiled", n)
        return {"compiled": n, "skipped": total - n}

    def compile_pre_parsed(self, raw: DataFrame, mode: str = "default") -> dict[str, int]:
        return self.compile(mode, raw_nodes=raw)

    def compile_batch(self, sources: Sequence[dict[str, Any]], mode: str = "default") -> dict[str, int]:
        """Several inputs, one after another: each is a distributed job of its own."""
        total = {"compiled": 0, "skipped": 0}
        for s in sources:
            for k, n in self.compile(mode, **s).items():
                total[k] += n
        return total

    def verify(self) -> list[str]:
        """Checks the stored tables' sums, and says what a compile should be warned of."""
        for name in self.store.names():
            self.store.verify(name)
        return enhance.verify(self.table("nodes"), self.table("concepts"))

    def _changed(self) -> None:
        self._open.clear()
        if self.store.exists("graph"):
            self.store.delete("graph")

    def list_documents(self) -> DataFrame:
        return self.table("doc_cards")

    def list_document_ids(self) -> list[int]:
        return [r.doc_id for r in self.table("catalog").select("doc_id").orderBy("doc_id").toLocalIterator()]

    def exists(self, doc_id: int) -> bool:
        return self.store.exists("catalog") and not self.table("catalog").where(F.col("doc_id") == doc_id).isEmpty()

    def find_by_source_path(self, path: str) -> int | None:
        row = self.table("catalog").where(F.col("source_path") == path).select("doc_id").first() if self.store.exists("catalog") else None
        return row.doc_id if row else None

    def remove(self, doc_id: int) -> bool:
        found = self.exists(doc_id)
        gone = self.spark.createDataFrame([(doc_id,)], "doc_id long")
        for name in (*TABLES, "route_cache") if found else ():
            if self.store.exists(name):
                self.store.remove(name, gone)
        if found:
            self._changed()
        return found

    forget = remove

    def clear(self) -> None:
        self.store.clear()
        self._open.clear()

    def load_document(self, doc_id: int) -> Navigator:
        """A new session; the last ``open_documents`` are kept as they were left."""
        self.opened += 1
        if doc_id in self._open:
            self.reopened += 1
            self._open.move_to_end(doc_id)
            return self._open[doc_id]
        if not self.exists(doc_id):
            raise DocumentNotFoundError(doc_id)
        self._open[doc_id] = Navigator({name: self.table(name) for name in TABLES if self.store.exists(name)}, doc_id)
        while len(self._open) > self.config.open_documents:
            self._open.popitem(last=False)
        return self._open[doc_id]

    def get_graph(self) -> DataFrame:
        """The document graph; kept until documents change."""
        if not self.store.exists("graph"):
            self.store.write("graph", document_graph(self.table("postings")), "src")
        return self.table("graph")

    def ask(self, query: str, doc_ids: Sequence[int] | None = None, k: int = 8, remember: bool = True) -> Answer:
        """An answer from documents of the workspace, or of ``doc_ids`` alone; sure routes are remembered."""
        optional = lambda name: self.table(name) if self.store.exists(name) else None
        t = Tables(self.table("nodes"), self.table("postings"), self.table("evidence_scores"), optional("intent_routes"), optional("concept_routes"), optional("doc_cards"), optional("route_cache"))
        if doc_ids is not None:
            scope = self.spark.createDataFrame([(int(d),) for d in doc_ids], "doc_id long")
            t = t.of(scope)
            if t.nodes.isEmpty():
                raise DocumentNotFoundError(list(doc_ids))
        got = Asker(t, self.model, self.get_graph if doc_ids is None else None, k=k, on_event=self.on_event).ask(query, doc_ids is not None)
        self.asked.append(got.metrics)
        keywords = analyse(query).keywords
        if remember and got.confidence >= 0.7 and keywords:
            new = self.spark.createDataFrame(routes_taken(got, keywords), "doc_id long, intent string, keywords array<string>, node_ids array<int>, confidence double")
            old = (self.table("route_cache") if self.store.exists("route_cache") else self.spark.createDataFrame([], CACHE)).join(new.select("doc_id"), "doc_id", "left_semi")
            self.store.upsert("route_cache", evidence.cache_record(old, new), new.select("doc_id"))
        return got

    def query_stream(self, query: str, doc_ids: Sequence[int] | None = None) -> Iterator[tuple[str, Any]]:
        """The events of answering a question as they come; the last is ("answer", the answer) or ("failed", the error)."""
        events: queue.Queue = queue.Queue()

        def run() -> None:
            before = self.on_event
            self.on_event = lambda name, what: (before(name, what), events.put((name, what)))
            try:
                events.put(("answer", self.ask(query, doc_ids)))
            except Exception as e:
                events.put(("failed", e))
            finally:
                self.on_event = before

        threading.Thread(target=run, daemon=True).start()
        while True:
            event = events.get()
            yield event
            if event[0] in ("answer", "failed"):
                return

    def metrics_report(self) -> dict[str, Any]:
        """Seconds of the last compile's passes, and what asking has cost."""
        passes = dict(self.pipeline.seconds) if self.pipeline else {}
        return {"passes": passes, "compile_seconds": sum(passes.values()), "open_hit_rate": self.reopened / self.opened if self.opened else 0.0, "questions": len(self.asked), **{k: sum(m[k] for m in self.asked) for k in ("llm_calls", "nodes_visited", "evidence")}}
