"""Reading inputs: one of paths, directories, contents, bytes or raw nodes; validation; a registry of parsers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .code import code_nodes
from .markdown import frontmatter, markdown_nodes
from .office import docx, latex
from .pages import html_nodes, paged_nodes
from .pdf import pdf_pages

EXTENSIONS = ("md", "markdown", "pdf")
#: Kinds of files whose bytes are no text.
BINARY = ("pdf", "docx")
Parser = Callable[[DataFrame], DataFrame]
_parsers: dict[str, Parser] = {}


def register_parser(extension: str, parser: Parser) -> None:
    """A function from files (doc_id, path, text, content) to raw nodes; a later registration wins."""
    _parsers[extension.lower().lstrip(".")] = parser


def parser_for(extension: str) -> Parser:
    e = extension.lower().lstrip(".")
    if e not in _parsers:
        raise ValueError(f"no parser for .{e}")
    return _parsers[e]


register_parser("md", lambda files: markdown_nodes(frontmatter(files.withColumnRenamed("text", "markdown"))))
register_parser("markdown", lambda files: parser_for("md")(files))
register_parser("pdf", lambda files: paged_nodes(pdf_pages(files)))
register_parser("docx", docx)
register_parser("tex", latex)
for _ext in ("py", "js", "ts", "java", "go", "rs", "c", "cpp", "h"):
    register_parser(_ext, code_nodes)
register_parser("html", lambda files: html_nodes(files.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))))


def files(spark: SparkSession, paths: Sequence[str], recursive: bool = True, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(doc_id, path, ext, bytes, modified, content) of files and folders; the id is a hash of the path."""
    glob = "*.{" + ",".join(x for e in extensions for x in (e, e.upper())) + "}"
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    d = r.load(list(paths))
    return d.select(F.xxhash64("path").alias("doc_id"), "path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def validated(found: DataFrame, large: int = 100 * 1024 * 1024) -> DataFrame:
    """``found`` with a column problem: empty files and PDFs without their mark; and whether a file is large."""
    pdf = F.substring(F.col("content").cast("binary"), 1, 4) != F.lit(b"%PDF")
    problem = F.when(F.col("bytes") == 0, "empty").when((F.col("ext") == "pdf") & pdf, "not a PDF")
    return found.withColumn("problem", problem).withColumn("is_large", F.col("bytes") > large)


def source(spark: SparkSession, *, path: str | None = None, paths: Sequence[str] | None = None, directory: str | None = None, content: str | None = None, bytes_data: bytes | None = None, raw_nodes: DataFrame | Sequence[tuple] | None = None, format: str = "md", recursive: bool = True, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Raw nodes (doc_id, seq, level, title, content) of exactly one kind of input."""
    given = [x for x in (path, paths, directory, content, bytes_data, raw_nodes) if x is not None]
    if len(given) != 1:
        raise ValueError("exactly one of path, paths, directory, content, bytes_data and raw_nodes is needed")
    if raw_nodes is not None:
        if isinstance(raw_nodes, DataFrame):
            return raw_nodes
        rows = [(0, i + 1, int(r[2]) if len(r) > 2 and r[2] is not None else 1, r[0], r[1]) for i, r in enumerate(raw_nodes)]
        return spark.createDataFrame(rows, "doc_id long, seq int, level int, title string, content string")
    if content is not None or bytes_data is not None:
        held = content.encode() if content is not None else bytes_data
        text = content if content is not None else bytes_data.decode("utf-8", "replace")
        if not text.strip():
            raise ValueError("the content is empty")
        return _parsed(spark.createDataFrame([(0, f"content.{format}", text, bytearray(held))], "doc_id long, path string, text string, content binary"), format)
    found = validated(files(spark, [path] if path else [directory] if directory else list(paths), recursive, extensions)).where("problem is null")
    if clash := found.groupBy("doc_id").agg(F.min("path").alias("a"), F.max("path").alias("b")).where("a <> b").first():
        raise ValueError(f"{clash.a} and {clash.b} have the same id")
    text = found.select("doc_id", "path", "ext", F.when(~F.col("ext").isin(*BINARY), F.decode("content", "UTF-8")).alias("text"), "content")
    kinds = [r.ext for r in text.select("ext").distinct().collect()]
    out = None
    for ext in kinds:
        part = _parsed(text.where(F.col("ext") == ext).drop("ext"), ext)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError("no readable document")
    return out


def _parsed(found: DataFrame, ext: str) -> DataFrame:
    return parser_for(ext)(found).select("doc_id", "seq", "level", "title", "content")
