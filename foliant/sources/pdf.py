"""Text and metadata of PDF files, read from their own streams: plain and Flate-coded, in objects and object streams.

Fonts' own code tables are read where a font has one (ToUnicode); other text is taken as Latin-1. Encrypted
files and images of text give no pages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|/[^\s<>\[\]()/%{}]*|\d+\s+\d+\s+R\b|[+-]?(?:\d+\.?\d*|\.\d+)|\(|<[0-9A-Fa-f\s]*>|[^\s<>\[\]()/%]+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """A reference to an object by number."""


class Name(str):
    pass


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string that opens before ``at``, unescaped, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            if m := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                out.append(int(m[0], 8) & 255)
                at += len(m[0])
                continue
            at += 1
            if e == b"\r" and data[at : at + 1] == b"\n":
                at += 1
            elif e not in b"\r\n" or not e:
                out += _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes, at: int = 0) -> Iterator[object]:
    """Numbers, names, strings (bytes), references, operators (str) and brackets."""
    while m := _TOKEN.match(data, at):
        t, at = m[1], m.end()
        if t == b"(":
            s, at = _string(data, at)
            yield s
        elif t.startswith(b"<") and t != b"<<":
            h = re.sub(rb"\s", b"", t[1:-1])
            yield bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
        elif t.startswith(b"/"):
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1"))
        elif t.endswith(b"R") and t[:1].isdigit():
            yield Ref(t.split()[0])
        elif re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", t):
            yield float(t) if b"." in t else int(t)
        else:
            yield t.decode("latin-1")


def value(stream: Iterator[object]) -> object:
    """The next whole value: dictionaries and arrays with what they hold."""
    t = next(stream)
    if t == "<<" and not isinstance(t, Name):
        out: dict = {}
        while (k := value(stream)) != ">>":
            out[k] = value(stream)
        return out
    if t == "[" and not isinstance(t, Name):
        items = []
        while (x := value(stream)) != "]":
            items.append(x)
        return items
    return t


class Document:
    def __init__(self, data: bytes):
        self.objects: dict[int, tuple[object, bytes]] = {}
        if not data.startswith(b"%PDF") or b"/Encrypt" in data:
            return
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", data):  # the last of a number counts, as updates are appended
            self._add(int(m[1]), data, m.end())
        for v, body in list(self.objects.values()):
            if isinstance(v, dict) and v.get("Type") == "ObjStm":
                inner = self._plain(v, body)
                heads = [int(x) for x in inner[: self.get(v.get("First"), 0)].split()]
                for number, at in zip(heads[::2], heads[1::2], strict=False):
                    try:
                        self.objects.setdefault(number, (value(tokens(inner, self.get(v["First"], 0) + at)), b""))
                    except (StopIteration, ValueError, RecursionError):
                        continue
        self.trailer: dict = {}
        for m in re.finditer(rb"trailer", data):
            try:
                t = value(tokens(data, m.end()))
            except (StopIteration, ValueError, RecursionError):
                continue
            self.trailer |= t if isinstance(t, dict) else {}
        for v, _ in self.objects.values():
            if isinstance(v, dict) and v.get("Type") == "XRef":
                self.trailer = {k: x for k, x in v.items() if k in ("Root", "Info")} | self.trailer

    def _add(self, number: int, data: bytes, at: int) -> None:
        try:
            v = value(tokens(data, at))
        except (StopIteration, ValueError, RecursionError):
            return
        body, end = b"", data.find(b"endobj", at)
        if isinstance(v, dict) and "Length" in v:
            start = re.compile(rb"stream\r?\n").search(data, at, end if end > 0 else len(data))
            if start:
                n = v["Length"]
                stop = start.end() + n if isinstance(n, int) and not isinstance(n, Ref) else data.find(b"endstream", start.end())
                body = data[start.end() : stop]
        self.objects[number] = (v, body)

    def get(self, v: object, default: object = None) -> object:
        for _ in range(8):
            if not isinstance(v, Ref):
                return default if v is None else v
            v = self.objects.get(int(v), (None, b""))[0]
        return default

    def _plain(self, v: dict, body: bytes) -> bytes:
        kinds = self.get(v.get("Filter"), [])
        for kind in kinds if isinstance(kinds, list) else [kinds]:
            if kind != "FlateDecode":
                return b""
            d = zlib.decompressobj()
            try:
                body = d.decompress(body)
            except zlib.error:
                return b""
        return body

    def _content(self, v: object) -> bytes:
        refs = v if isinstance(v, list) else self.get(v) if isinstance(self.get(v), list) else [v]
        return b"\n".join(self._plain(*self.objects[int(r)]) for r in refs if isinstance(r, Ref) and int(r) in self.objects and isinstance(self.objects[int(r)][0], dict))

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """(page, its resources) in order, by the tree of pages."""
        root = self.get(getattr(self, "trailer", {}).get("Root")) or next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        seen: set[int] = set()

        def walk(ref: object, resources: object):
            v = self.get(ref)
            if not isinstance(v, dict) or id(v) in seen:
                return
            seen.add(id(v))
            own = self.get(v.get("Resources")) or resources
            if "Kids" in v:
                for k in self.get(v["Kids"], []):
                    yield from walk(k, own)
            else:
                yield v, own if isinstance(own, dict) else {}

        if isinstance(root, dict):
            yield from walk(root.get("Pages"), {})

    def _codes(self, resources: dict) -> dict[str, dict[bytes, str]]:
        """Code tables of the fonts that have one."""
        out = {}
        for name, ref in (self.get(resources.get("Font"), {}) or {}).items():
            font = self.get(ref)
            if isinstance(font, dict) and isinstance(font.get("ToUnicode"), Ref) and int(font["ToUnicode"]) in self.objects:
                out[name] = code_table(self._plain(*self.objects[int(font["ToUnicode"])]))
        return out

    def text(self, page: dict, resources: dict) -> str:
        codes, known, parts, stack = self._codes(resources), {}, [], []

        def said(s: bytes) -> str:
            if not known:
                return s.decode("latin-1")
            width = len(next(iter(known)))
            return "".join(known.get(s[i : i + width], "") for i in range(0, len(s), width))

        stream = tokens(self._content(page.get("Contents")))
        while True:
            try:
                t = value(stream)
            except (StopIteration, RecursionError, ValueError):
                break
            if not isinstance(t, str) or isinstance(t, Name):
                stack.append(t)
                continue
            if t == "Tf" and len(stack) > 1:
                known = codes.get(stack[-2], {}) if isinstance(stack[-2], str) else {}
            elif t in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
                parts.append(("\n" if t != "Tj" else "") + said(stack[-1]))
            elif t == "TJ" and stack and isinstance(stack[-1], list):
                parts.append("".join(said(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -200 else "" for x in stack[-1]))
            elif t in ("T*", "ET") or (t in ("Td", "TD") and stack and isinstance(stack[-1], (int, float)) and stack[-1]) or t == "Tm":
                parts.append("\n")
            stack = []
        return re.sub(r"\n{2,}", "\n", "".join(parts)).strip()

    def info(self) -> dict[str, str]:
        d = self.get(getattr(self, "trailer", {}).get("Info"), {})
        out = {}
        for k in ("Title", "Author", "Subject"):
            v = self.get(d.get(k)) if isinstance(d, dict) else None
            if isinstance(v, bytes):
                out[k.lower()] = v[2:].decode("utf-16-be", "replace") if v.startswith(b"\xfe\xff") else v.decode("latin-1")
        return out


def code_table(cmap: bytes) -> dict[bytes, str]:
    """What codes stand for, from the single entries and ranges of a font's table."""
    said = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        out |= {bytes.fromhex(a.decode()): said(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width, first = len(a) // 2, said(b)
            for i in range(min(int(z, 16) - int(a, 16) + 1, 65536)):
                out[(int(a, 16) + i).to_bytes(width, "big")] = first[:-1] + chr(ord(first[-1]) + i)
    return out


def pdf_pages(files: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(doc_id, number, text) of files (doc_id, content): pages from 1 that have text."""

    def read(frames):
        for f in frames:
            rows = []
            for doc_id, content in zip(f["doc_id"], f["content"], strict=True):
                d = Document(bytes(content or b""))
                for n, (page, resources) in enumerate(d.pages(), 1):
                    if max_pages is not None and n > max_pages:
                        break
                    text = d.text(page, resources)
                    if text:
                        rows.append((doc_id, n, text))
            yield pd.DataFrame(rows, columns=["doc_id", "number", "text"])

    return files.select("doc_id", "content").mapInPandas(read, "doc_id long, number int, text string")


def pdf_metadata(files: DataFrame) -> DataFrame:
    """(doc_id, title, author, subject, n_pages) of files (doc_id, content)."""

    def read(frames):
        for f in frames:
            rows = []
            for doc_id, content in zip(f["doc_id"], f["content"], strict=True):
                d = Document(bytes(content or b""))
                i = d.info()
                rows.append((doc_id, i.get("title"), i.get("author"), i.get("subject"), sum(1 for _ in d.pages())))
            yield pd.DataFrame(rows, columns=["doc_id", "title", "author", "subject", "n_pages"])

    return files.select("doc_id", "content").mapInPandas(read, "doc_id long, title string, author string, subject string, n_pages int")
