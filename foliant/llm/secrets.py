"""Secret scan: fixed patterns, and a token-efficiency test for what has no pattern.

A random string takes more tokens than words do: runs of 20 or more characters with a letter that give
at most ``max_ratio`` characters per token under a byte-pair vocabulary are reported as kind ``dense``,
unless they are known digests (hexadecimal of a digest's length) or UUIDs, or touch a span that a
pattern has found. Runs that have the form of an identifier (letters with a few digits after them,
joined by marks, or no digit at all) have to stay under the stricter ``named_ratio``, which words do not.

Defined results: a null text is empty and has no spans; rows that repeat a doc_id each get a row;
an empty table gives an empty result; extra columns are ignored. Spans count code points.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

# The patterns of the kinds, their least lengths, and how a text that has a match must look.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
# Candidates of the token-efficiency test, what is known to be harmless, and how identifiers look.
RUN = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
DIGEST = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NAMED = re.compile(r"([A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,8})([_/=+-]+([A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,8}))*[_/=+-]*")

_encodings: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file; one per worker process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern kinds, leftmost and not overlapping within a kind, by start and then kind."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def dense_spans(text: str, taken: list[tuple[int, int, str]], enc, max_ratio: float, named_ratio: float = 1.8) -> list[tuple[int, int, str]]:
    out = []
    for m in RUN.finditer(text):
        a, b, s = m.start(), m.end(), m.group()
        if not any(c.isalpha() for c in s) or DIGEST.fullmatch(s) or UUID.fullmatch(s) or any(x < b and a < y for x, y, _ in taken):
            continue
        named = not any(c.isdigit() for c in s) or NAMED.fullmatch(s)
        if len(s) <= (named_ratio if named else max_ratio) * len(enc.encode_ordinary(s)):
            out.append((a, b, "dense"))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(path: str, pattern: str, max_ratio: float, named_ratio: float):
    order = {k: i for i, k in enumerate((*KINDS, "dense"))}

    def scan(record_batches):
        enc = encoding(path, pattern)
        for f in record_batches:
            rows = []
            for t in f.column("text").to_pylist():
                base = base_spans(t or "")
                spans = sorted(base + dense_spans(t or "", base, enc, max_ratio, named_ratio), key=lambda s: (s[0], order[s[2]]))
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_dense"]
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names)

    return scan


def scan_secrets(docs: DataFrame, ranks: str, pattern: str, max_ratio: float = 2.2, named_ratio: float = 1.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_dense.

    ``ranks`` is the path of a tiktoken rank file that every executor can read, ``pattern`` its splitting pattern.
    """
    batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_dense long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(ranks, pattern, max_ratio, named_ratio), schema)
