"""Source code as raw nodes: a node per class and function, under those that hold it."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame

#: How declarations begin in languages that are read line by line; the first name is the title.
_DECLARED = re.compile(r"^(\s*)(?:pub(?:lic)?\s+|private\s+|protected\s+|static\s+|export\s+|async\s+|abstract\s+|final\s+)*(class|struct|enum|trait|impl|interface|fn|func|function|def|module|namespace)\s+([A-Za-z_][\w:<>.]*)")


def python_nodes(text: str) -> list[tuple[int, str, str]]:
    """(level, title, content): the module's own text, then classes and functions with what is theirs alone."""
    tree, lines, out = ast.parse(text), text.split("\n"), []
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "def", ast.AsyncFunctionDef: "async def"}

    def first(n) -> int:
        return min([n.lineno, *(d.lineno for d in n.decorator_list)])

    def walk(node, level: int, title: str, start: int, end: int) -> None:
        inner = [n for n in node.body if type(n) in kinds]
        taken = {k for n in inner for k in range(first(n), n.end_lineno + 1)}
        own = "\n".join(lines[k - 1] for k in range(start, end + 1) if k not in taken).strip("\n")
        out.append((level, title, own))
        for n in inner:
            walk(n, min(level + 1, 6), f"{kinds[type(n)]} {n.name}", first(n), n.end_lineno)

    walk(tree, 1, "module", 1, len(lines))
    return out


def outlined(text: str) -> list[tuple[int, str, str]]:
    """The same for other languages by lines that declare something; levels follow indentation."""
    out: list[list] = [[1, "module", []]]
    depths: list[int] = []
    for line in text.split("\n"):
        m = _DECLARED.match(line)
        if m:
            at = len(m[1].expandtabs(4))
            while depths and depths[-1] >= at:
                depths.pop()
            depths.append(at)
            out.append([min(1 + len(depths), 6), f"{m[2]} {m[3]}", []])
        out[-1][2].append(line)
    return [(level, title, "\n".join(lines).strip("\n")) for level, title, lines in out]


def code_nodes(files: DataFrame) -> DataFrame:
    """Raw nodes of files (doc_id, path, text); Python that does not parse is read by lines."""

    def read(frames):
        for f in frames:
            rows = []
            for doc_id, path, text in zip(f["doc_id"], f["path"], f["text"], strict=True):
                try:
                    nodes = python_nodes(text or "") if str(path).endswith(".py") else outlined(text or "")
                except (SyntaxError, ValueError):
                    nodes = outlined(text or "")
                rows += [(doc_id, k, level, title, content) for k, (level, title, content) in enumerate(nodes, 1) if content.strip() or title != "module"]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "level", "title", "content"])

    return files.select("doc_id", "path", "text").mapInPandas(read, "doc_id long, seq int, level int, title string, content string")
