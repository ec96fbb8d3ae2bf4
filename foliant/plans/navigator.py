"""A reading session over one compiled document: where the reader stands, what was seen and collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import references, search, trees


class Navigator:
    """The cursor lives on the driver; the tables stay DataFrames, narrowed to the document."""

    def __init__(self, tables: dict[str, DataFrame], doc_id: int):
        self.doc_id = doc_id
        self.tables = {k: t.where(F.col("doc_id") == doc_id) for k, t in tables.items()}
        self.nodes = self.tables["nodes"]
        self.trail, self.history, self.visited, self.evidence = [1], [], {1}, {}
        self._summaries: dict[int, str] = {}

    @property
    def cursor(self) -> int:
        return self.trail[-1]

    def _node(self, node_id: int) -> Row | None:
        return self.nodes.where(F.col("node_id") == node_id).first()

    def ls(self) -> list[Row]:
        routes = self.tables["child_routes"].where(F.col("parent_id") == self.cursor)
        return routes.orderBy("node_id").collect()

    def _move(self, trail: list[int]) -> None:
        self.history.append(list(self.trail))
        self.trail = trail
        self.visited.add(self.cursor)

    def cd(self, target: str) -> bool:
        row = search.resolve_target(self.nodes, self.doc_id, self.cursor, target).first()
        return row is not None and self.cd_id(row.node_id)

    def cd_by_title(self, title: str) -> bool:
        """To the first node of the document with a title, whatever its case."""
        row = self.nodes.where(F.lower("title") == title.strip().lower()).orderBy("node_id").first()
        return row is not None and self.cd_id(row.node_id)

    def cd_id(self, node_id: int) -> bool:
        if self._node(node_id) is None:
            return False
        up = [r.ancestor_id for r in trees.ancestors(self.nodes).where(F.col("node_id") == node_id).orderBy(F.desc("distance")).collect()]
        self._move([*up, node_id])
        return True

    def cd_up(self) -> bool:
        if len(self.trail) == 1:
            return False
        self._move(self.trail[:-1])
        return True

    def cd_root(self) -> None:
        self.trail = [1]

    def back(self) -> bool:
        if not self.history:
            return False
        self.trail = self.history.pop()
        return True

    def pwd(self) -> str:
        titles = {r.node_id: r.title for r in self.nodes.where(F.col("node_id").isin(self.trail)).select("node_id", "title").collect()}
        return " / ".join(titles[n] for n in self.trail)

    def cat(self, node_id: int | None = None) -> str:
        n = node_id or self.cursor
        row = self._node(n)
        if row is None:
            return ""
        if row.content and n not in self.evidence:
            self.evidence[n] = {"source_path": f"{self.pwd()} / {row.title}" if n != self.cursor else self.pwd(), "node_title": row.title, "content": row.content}
        return row.content

    def collect_evidence(self, node_id: int | None = None) -> list[dict]:
        """What was collected so far, with a node's text added to it."""
        self.cat(node_id)
        return list(self.evidence.values())

    def info(self) -> dict[str, int]:
        c = trees.tree_counts(self.nodes).first()
        return {"doc_id": self.doc_id, "sections": c.n_nodes, "leaves": c.n_leaves, "max_depth": c.max_depth}

    def node_title(self, node_id: int) -> str | None:
        row = self._node(node_id)
        return row.title if row else None

    def grep_node(self, pattern: str, node_id: int | None = None) -> list[Row]:
        return search.grep(self.nodes.where(F.col("node_id") == (node_id or self.cursor)), pattern).orderBy("line_no").collect()

    def toc_filtered(self, wanted) -> list[Row]:
        return trees.toc(trees.toc_filtered(self.nodes, wanted)).orderBy("node_id").select("node_id", "depth", "title").collect()

    def toc_from(self, node_id: int | None = None, max_depth: int | None = None) -> list[Row]:
        return trees.toc_from(self.nodes, node_id or self.cursor, max_depth).orderBy("node_id").select("node_id", "depth", "title").collect()

    def head(self, n: int = 10, node_id: int | None = None) -> str:
        row = self.nodes.where(F.col("node_id") == (node_id or self.cursor)).select(trees.head(F.col("content"), F.col("title"), n).alias("h")).first()
        return row.h if row else ""

    def wc(self, node_id: int | None = None) -> Row:
        return trees.node_stats(self.nodes).where(F.col("node_id") == (node_id or self.cursor)).first()

    def toc(self, max_depth: int | None = None) -> list[Row]:
        return trees.toc(self.nodes, max_depth).orderBy("node_id").select("node_id", "depth", "title").collect()

    def siblings(self) -> list[int]:
        return [r.sibling_id for r in trees.siblings(self.nodes).where(F.col("node_id") == self.cursor).orderBy("sibling_id").collect()]

    def search(self, query: str, k: int = 10) -> list[Row]:
        from ..functions.text import query_search_terms

        return search.search_nodes(self.nodes, query_search_terms(query), k).orderBy("rank").collect()

    def grep(self, pattern: str) -> list[Row]:
        here = self._node(self.cursor)
        return search.grep(self.nodes.where(F.col("node_id").between(here.node_id, here.last_desc)), pattern).orderBy("node_id", "line_no").collect()

    def find(self, keyword: str) -> list[Row]:
        return search.find(self.nodes, keyword).orderBy("node_id").collect()

    def similar(self, node_id: int | None = None, k: int = 10) -> list[Row]:
        return search.similar_nodes(self.tables["postings"], self.doc_id, node_id or self.cursor, k).orderBy("rank").collect()

    def find_section(self, name: str) -> int | None:
        row = self.tables["sections"].where(F.col("name") == name.lower()).first()
        return row.node_id if row else None

    def keyword_entries(self, keyword: str) -> list[Row]:
        return search.keyword_entries(self.tables["postings"], keyword).orderBy(F.desc("weight"), "node_id").collect()

    def topic_summary(self, keyword: str) -> str:
        """The titles of the nodes that hold a keyword, heaviest first, with their weights."""
        held = {r.node_id: r.weight for r in self.keyword_entries(keyword)}
        titles = {r.node_id: r.title for r in self.nodes.where(F.col("node_id").isin(list(held))).select("node_id", "title").collect()}
        return "\n".join(f"- {titles[n]} [{n}] ({w:.2f})" for n, w in held.items())

    def intent_routes(self, node_id: int | None = None) -> list[Row]:
        """Where the questions of a node lead."""
        return self.tables["intent_routes"].where(F.col("parent_id") == (node_id or self.cursor)).orderBy("rank").collect()

    def concept_routes(self, keyword: str) -> list[Row]:
        """Targets of all concepts that hold a keyword."""
        return self.tables["concept_routes"].where(F.col("concept").contains(keyword.lower())).orderBy("concept", "rank").collect()

    def node_routing(self, node_id: int | None = None) -> Row | None:
        """A node's own questions and tags."""
        return self.nodes.where(F.col("node_id") == (node_id or self.cursor)).select("node_id", "hints", "tags").first()

    def premises_from(self, node_id: int | None = None) -> list[int]:
        """Nodes that a node's statements rest on."""
        return sorted({r.premise for r in self.tables["chains"].where(F.col("conclusion") == (node_id or self.cursor)).collect()})

    def conclusions_from(self, node_id: int | None = None) -> list[int]:
        return sorted({r.conclusion for r in self.tables["chains"].where(F.col("premise") == (node_id or self.cursor)).collect()})

    def summary(self, node_id: int | None = None, complete=None) -> str:
        """A node's summary; where none was made beforehand, one made now (by ``complete``, else the text's start) and kept."""
        n = node_id or self.cursor
        if n not in self._summaries:
            row = self._node(n)
            made = (row.summary if row is not None and "summary" in row else "") or ""
            if row is not None and not made:
                made = complete(f"{row.title}\n{row.content}") if complete else (row.content or row.title)[:200]
            self._summaries[n] = made
        return self._summaries[n]

    def counts(self) -> dict[str, int]:
        """How much each index holds of the document."""
        return {name: t.count() for name, t in self.tables.items()}

    def has_overlap(self, node_id: int | None = None) -> bool:
        return bool(self.overlaps_for(node_id))

    def chains_for(self, node_id: int | None = None) -> list[Row]:
        return references.chains_for(self.tables["chains"]).where(F.col("node_id") == (node_id or self.cursor)).collect()

    def evidence_score(self, node_id: int | None = None) -> float:
        row = self.tables["evidence_scores"].where(F.col("node_id") == (node_id or self.cursor)).first()
        return row.composite if row else 0.0

    def doc_card(self) -> Row | None:
        return self.tables["doc_cards"].first()

    def concepts(self) -> list[Row]:
        return self.tables["concepts"].orderBy("rank").collect()

    def section_overview(self, name: str) -> str | None:
        """The overview of a top section by title or number."""
        n = self.find_section(name)
        row = self.tables["nav_entries"].where(F.col("node_id") == n).first() if n else None
        return row.overview if row else (self._node(n).title if n else None)

    def related_sections(self, keyword: str) -> list[int]:
        """Nodes that hold a keyword, heaviest first and once each."""
        return list(dict.fromkeys(r.node_id for r in self.keyword_entries(keyword)))

    def overlaps_for(self, node_id: int | None = None) -> list[Row]:
        from ..operators import indexes

        return indexes.overlaps_for(self.tables["overlaps"]).where(F.col("node_id") == (node_id or self.cursor)).orderBy("other_id").collect()
