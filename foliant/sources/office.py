"""DOCX and LaTeX as raw nodes."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_COMMANDS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_HEAD = re.compile(r"\\(" + "|".join(_COMMANDS) + r")\*?\s*(?:\[[^\]]*\])?\{")


def docx_nodes(content: bytes) -> list[tuple[int, str, str]]:
    """(level, title, content): paragraphs in a heading style open sections, rows of tables are lines; nothing for other files."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out: list[list] = []

    def said(e) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in e.iter())

    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            m = re.fullmatch(r"(?i)heading\s*([1-9])|title", style.get(f"{_W}val", "")) if style is not None else None
            if m and said(e).strip():
                out.append([min(int(m[1] or 1), 6), said(e).strip(), []])
                continue
            lines = [said(e)]
        elif e.tag == f"{_W}tbl":
            lines = [" | ".join(said(c).strip() for c in row.iter(f"{_W}tc")) for row in e.iter(f"{_W}tr")]
        else:
            continue
        if not out and any(x.strip() for x in lines):
            out.append([1, "Introduction", []])
        if out:
            out[-1][2] += lines
    return [(level, title, "\n".join(x).strip()) for level, title, x in out]


def _group(text: str, at: int) -> int:
    """Where the group that opened before ``at`` ends."""
    depth = 1
    while at < len(text) and depth:
        depth += (text[at] == "{") - (text[at] == "}") if text[at - 1] != "\\" else 0
        at += 1
    return at


def latex_nodes(text: str) -> list[tuple[int, str, str]]:
    """The same for LaTeX by its sectioning commands; the uppermost kind in use is level 1. Comments go."""
    text = re.sub(r"(?<!\\)%.*", "", text)
    m = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text, re.DOTALL)
    text = m[1] if m else text
    heads = list(_HEAD.finditer(text))
    least = min((_COMMANDS[h[1]] for h in heads), default=1)
    first = text[: heads[0].start()] if heads else text
    out = [(1, "Introduction", first.strip())] if first.strip() else []
    for h, after in zip(heads, [*heads[1:], None], strict=False):
        end = _group(text, h.end())
        out.append((min(_COMMANDS[h[1]] - least + 1, 6), " ".join(text[h.end() : end - 1].split()), text[end : after.start() if after else len(text)].strip()))
    return out


def _rows(files: DataFrame, column: str, nodes) -> DataFrame:
    def read(frames):
        for f in frames:
            rows = []
            for doc_id, x in zip(f["doc_id"], f[column], strict=True):
                rows += [(doc_id, k, *n) for k, n in enumerate(nodes(x), 1)] if x is not None else []
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "level", "title", "content"])

    return files.select("doc_id", column).mapInPandas(read, "doc_id long, seq int, level int, title string, content string")


def docx(files: DataFrame) -> DataFrame:
    """Raw nodes of files (doc_id, content)."""
    return _rows(files, "content", lambda x: docx_nodes(bytes(x)))


def latex(files: DataFrame) -> DataFrame:
    """Raw nodes of files (doc_id, text)."""
    return _rows(files, "text", latex_nodes)
