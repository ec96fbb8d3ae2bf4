"""Results as text for a terminal."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Row


def table_text(rows: Iterable[Sequence], heads: Sequence[str], widest: int = 60) -> str:
    """Columns padded to their widest cell, long cells cut with an ellipsis."""
    cell = lambda v: (s if len(s := str("" if v is None else v).replace("\n", " ")) <= widest else s[: widest - 1] + "…")
    lines = [list(heads), *[[cell(v) for v in r] for r in rows]]
    widths = [max(len(x[i]) for x in lines) for i in range(len(heads))]
    out = ["  ".join(v.ljust(w) for v, w in zip(x, widths, strict=True)).rstrip() for x in lines]
    return "\n".join([out[0], "  ".join("-" * w for w in widths), *out[1:]])


def documents_text(cards: Iterable[Row]) -> str:
    return table_text([(r.doc_id, r.title, r.n_sections, r.total_leaves) for r in cards], ["id", "title", "sections", "leaves"])


def tree_text(rows: Iterable[Row]) -> str:
    """A flat table of contents as an indented list."""
    return "\n".join("  " * max(r.depth - 1, 0) + f"- {r.title} [{r.node_id}]" for r in rows)


def answer_text(answer, as_json: bool = False) -> str:
    """An answer with its confidence and sources."""
    sources = [r.source_path for r in answer.evidence.orderBy("seq").collect()]
    if as_json:
        return json.dumps({"query": answer.query, "answer": answer.answer, "confidence": answer.confidence, "sources": sources})
    return f"{answer.answer}\n\nconfidence {answer.confidence:.2f}; from {', '.join(sources) or 'nothing'}"
