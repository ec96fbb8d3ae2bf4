"""Markdown and frontmatter to raw nodes, by windows over lines.

ATX headings, and lines underlined by = or -, open a section outside code fences; fenced blocks stay text (or are left out); text before
the first heading joins the first section, or is one section "Introduction" of level 0 if there is no
heading. Blocks keep their blank lines, so paragraphs and lists stay apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MarkdownConfig:
    min_level: int = 1
    max_level: int = 6
    keep_code: bool = True

    @staticmethod
    def gfm() -> MarkdownConfig:
        return MarkdownConfig()

    @staticmethod
    def commonmark() -> MarkdownConfig:
        """The same sections: what the flavours differ in (tables, strikethrough, task lists) stays text here."""
        return MarkdownConfig()

    @staticmethod
    def documentation(max_level: int = 3) -> MarkdownConfig:
        return MarkdownConfig(max_level=min(6, max(1, max_level)))

    @staticmethod
    def no_code_blocks() -> MarkdownConfig:
        return MarkdownConfig(keep_code=False)


FRONT = r"(?s)^(---|\+\+\+)[ \t]*\r?\n(.*?)\r?\n\1[ \t]*(?:\r?\n|$)"


def frontmatter(docs: DataFrame, column: str = "markdown") -> DataFrame:
    """``docs`` with front_title and front_description (unquoted), and the text without its frontmatter."""
    block = F.regexp_extract(column, FRONT, 2)

    def value(key: str):
        raw = F.trim(F.regexp_extract("_front", rf"(?m)^\s*{key}\s*[:=](.*)$", 1))
        return F.nullif(F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2"), F.lit(""))

    d = docs.withColumn("_front", block).withColumn("front_title", value("title")).withColumn("front_description", value("description"))
    return d.withColumn(column, F.regexp_replace(F.col(column), FRONT, "")).drop("_front")


def markdown_nodes(docs: DataFrame, config: MarkdownConfig = MarkdownConfig(), column: str = "markdown") -> DataFrame:
    """Raw nodes (doc_id, seq, level, title, content, line_start, line_end) of Markdown texts."""
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = docs.where(F.trim(F.coalesce(column, F.lit(""))) != "").select("doc_id", F.posexplode(F.split(F.regexp_replace(column, "\r\n", "\n"), "\n")).alias("k", "line"))
    fence = F.rlike("line", F.lit(r"^ {0,3}(```|~~~)"))
    d = lines.withColumn("fence", fence.cast("int")).withColumn("open", (F.sum("fence").over(w) - F.col("fence")) % 2 == 1)
    by_line = Window.partitionBy("doc_id").orderBy("k")
    plain = ~F.col("open") & (F.col("fence") == 0)
    under = F.regexp_extract(F.coalesce(F.lead("line").over(by_line), F.lit("")), r"^ {0,3}(=+|-+)[ \t]*$", 1)
    # one line of a paragraph with a line of = or - below it
    text_line = F.rlike("line", F.lit(r"^ {0,3}[^\s#>|=\-]")) & ~F.rlike("line", F.lit(r"^ {0,3}([-*+]|[0-9]+[.)])[ \t]"))
    setext = F.when(plain & (under != "") & text_line & (F.trim(F.coalesce(F.lag("line").over(by_line), F.lit(""))) == ""), F.when(under.startswith("="), 1).otherwise(2))
    atx = F.length(F.regexp_extract("line", r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1))
    d = d.withColumn("setext", F.when(setext.between(config.min_level, config.max_level), setext))
    level = F.coalesce("setext", atx)
    head = plain & level.between(config.min_level, config.max_level)
    d = d.withColumn("level", F.when(head, level)).withColumn("line", F.when(F.lag("setext").over(by_line).isNotNull(), "").otherwise(F.col("line")))
    d = d.withColumn("sec", F.sum(F.col("level").isNotNull().cast("int")).over(w))
    if not config.keep_code:
        d = d.where("not open and fence = 0")
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^ {0,3}#{1,6}[ \t]*", ""), r"[ \t]+#+[ \t]*$", ""), "`[^`]*`", ""))
    text = F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("k", "line"))))
    s = d.groupBy("doc_id", "sec").agg(F.max("level").alias("level"), F.max(F.when(F.col("level").isNotNull(), title)).alias("title"), text.alias("t"), F.min("k").alias("a"), F.max("k").alias("z"))
    s = s.withColumn("content", F.regexp_replace(F.array_join(F.transform("t", lambda x: x["line"]), "\n"), r"^\s+|\s+$", ""))
    v = Window.partitionBy("doc_id").orderBy("sec")
    lead = F.lag(F.when(F.col("sec") == 0, F.nullif(F.col("content"), F.lit("")))).over(v)
    s = s.withColumn("before", F.when(F.col("sec") == 1, lead)).withColumn("secs", F.max("sec").over(Window.partitionBy("doc_id")))
    s = s.where("sec > 0 or secs = 0")
    content = F.concat_ws("\n\n", "before", F.nullif(F.col("content"), F.lit("")))
    return s.select("doc_id", F.col("sec").cast("int").alias("seq"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("title", F.lit("Introduction")).alias("title"), content.alias("content"), (F.col("a") + 1).alias("line_start"), (F.col("z") + 1).alias("line_end"))
