"""Web pages, paged documents and their tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import cut
from ..functions.text import token_estimate


def strip_tags(html: Column) -> Column:
    """Text of HTML: scripts, styles and tags dropped, the common entities read, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_nodes(pages: DataFrame) -> DataFrame:
    """Raw nodes of pages (page_id, html): h1 to h6 open sections, paragraphs, items and cells are leaves one level below them."""
    parts = F.regexp_extract_all("html", F.lit(r"(?is)<(h[1-6]|p|li|td)\b[^>]*>.*?(?=<(?:h[1-6]|p|li|td|/p|/li|/td|/h[1-6]|/article|/body)\b|$)"), F.lit(0))
    d = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(parts).alias("k", "part")).withColumn("tag", F.lower(F.regexp_extract("part", r"^<([a-zA-Z0-9]+)", 1)))
    d = d.withColumn("text", strip_tags(F.col("part"))).where("text <> ''")
    own = F.when(F.col("tag").startswith("h"), F.substring("tag", 2, 1).cast("int"))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.coalesce(own, F.least(F.coalesce(F.last(own, ignorenulls=True).over(w), F.lit(0)) + 1, F.lit(6)))
    head = F.col("tag").startswith("h")
    return d.select("doc_id", F.col("k").alias("seq"), level.alias("level"), F.when(head, F.col("text")).otherwise(F.col("tag")).alias("title"), F.when(head, "").otherwise(F.col("text")).alias("content"))


def page_nodes(pages: DataFrame) -> DataFrame:
    """Paged text (doc_id, number, text) as one section per page that has text."""
    return pages.where(F.trim("text") != "").select("doc_id", F.col("number").alias("seq"), F.lit(1).alias("level"), F.concat(F.lit("Page "), F.col("number").cast("string")).alias("title"), F.col("text").alias("content"), F.col("number").alias("start_page"), F.col("number").alias("end_page"))


def page_range_text(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Text of the pages at positions first..last of each document, by blank lines."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("number"))
    p = pages.withColumn("at", at).where(F.col("at").between(first, last))
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


# What lines of a table of contents look like, and how much each look counts.
TOC_PATTERNS = [
    (0.9, r"(?i)^[\s]*(目\s*录|内\s*容\s*摘\s*要)[\s]*$"),
    (0.85, r"第[一二三四五六七八九十0-9]+[章节部篇].*?[\.\s…·]{2,}\s*[0-9]+"),
    (0.8, r"[0-9]+[\.0-9]+\s+.+?\s*[\.\s…·]{3,}\s*[0-9]+"),
    (0.9, r"(?i)^[\s]*(table\s+of\s+contents|contents|outline)[\s]*$"),
    (0.85, r"(?i)^[\s]*(chapter|section|part)\s+[0-9]+.*?[0-9]+\s*$"),
    (0.75, r"^[0-9]+\.[0-9]+(\.[0-9]+)?\s+.+?[\.\s…]{3,}\s*[0-9]+\s*$"),
    (0.7, r".+?[\.\s…·]{4,}\s*[0-9]{1,4}\s*$"),
    (0.5, r"^.{3,50}?\s{2,}[0-9]{1,4}\s*$"),
]


def toc_scores(pages: DataFrame, first_pages: int = 15) -> DataFrame:
    """(doc_id, number, score, hits) of the first pages: the weightiest pattern, in full from three hits on, seven tenths below."""
    lines = pages.where(F.col("number") <= first_pages).select("doc_id", "number", F.explode(F.split("text", "\n")).alias("line"))
    looks = F.array(*[F.when(F.rlike("line", F.lit(p)), F.lit(w)) for w, p in TOC_PATTERNS])
    d = lines.withColumn("w", F.filter(looks, lambda x: x.isNotNull()))
    g = d.groupBy("doc_id", "number").agg(F.max(F.array_max("w")).alias("best"), F.sum(F.size("w")).alias("hits"))
    score = F.when(F.col("hits") >= 3, F.col("best")).when(F.col("hits") >= 1, F.col("best") * 0.7).otherwise(0.0)
    return g.select("doc_id", "number", score.alias("score"), "hits")


def toc_detection(pages: DataFrame) -> DataFrame:
    """(doc_id, found, confidence, mode): pages over one half are contents; the mode without a usable one is no_toc."""
    s = toc_scores(pages)
    g = s.groupBy("doc_id").agg(F.count_if(F.col("score") > 0.5).alias("n"), F.coalesce(F.avg(F.when(F.col("score") > 0.5, F.col("score"))), F.lit(0.0)).alias("confidence"))
    return g.select("doc_id", (F.col("n") > 0).alias("found"), "confidence", F.when(F.col("confidence") >= 0.6, "toc_with_pages").when(F.col("n") > 0, "toc_without_pages").otherwise("no_toc").alias("mode"))


#: A line of a table of contents: an optional number, a title, leaders or space, a page.
ENTRY = r"^\s*((?:[0-9]+(?:\.[0-9]+)*\.?\s+|(?:[Cc]hapter|[Ss]ection|[Pp]art)\s+[0-9]+(?:\.[0-9]+)*[.:]?\s+)?)(.*?\S)(?:\s*[.…·]{2,}\s*|\s{2,}|\t)([0-9]{1,4})\s*$"


def toc_entries(pages: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Entries (doc_id, seq, level, title, toc_page, physical_page) in the text of the pages that look like contents.

    An entry's level is the depth of its number, 1 without one. No physical page is known yet.
    """
    scores = toc_scores(pages) if scores is None else scores
    found = pages.join(scores.where("score > 0.5").select("doc_id", "number"), ["doc_id", "number"])
    lines = found.select("doc_id", "number", F.posexplode(F.split("text", "\n")).alias("k", "line")).where(F.rlike("line", F.lit(ENTRY)))
    part = lambda i: F.regexp_extract("line", ENTRY, i)
    number = F.regexp_extract(part(1), r"([0-9]+(?:\.[0-9]+)*)", 1)
    level = F.when(number == "", 1).otherwise(F.least(F.size(F.split(number, r"\.")), F.lit(6)))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("number", "k"))
    return lines.select("doc_id", seq.alias("seq"), level.cast("int").alias("level"), part(2).alias("title"), part(3).cast("int").alias("toc_page"), F.lit(None).cast("int").alias("physical_page"))


def entries_by_model(text: str, complete, rounds: int = 3) -> list[dict]:
    """Entries (level, title, page) that a model reads out of the text of a table of contents; it is asked to go on until it says that all are there."""
    from ..plans.llm import extract_json

    out: list[dict] = []
    for _ in range(rounds):
        got = extract_json(complete(f"List the entries as JSON {{complete, entries: [{{level, title, page}}]}}. Already listed: {[e['title'] for e in out]}\n{text}"))
        known = {e["title"] for e in out}
        new = got.get("entries", []) if isinstance(got, dict) else got
        out += [{"level": int(e.get("level") or 1), "title": str(e["title"]), "page": e.get("page")} for e in new if e.get("title") and e["title"] not in known]
        if not isinstance(got, dict) or got.get("complete", True) or not new:
            break
    return out


def located(entries: DataFrame, pages: DataFrame, scores: DataFrame) -> DataFrame:
    """Entries with the first page that holds their title, pages of contents left out: anchors where no page is known."""
    text = pages.join(scores.where("score > 0.5").select("doc_id", "number"), ["doc_id", "number"], "left_anti")
    hits = entries.select("doc_id", "seq", "title").join(text, "doc_id").where(F.lower("text").contains(F.lower("title")))
    first = hits.groupBy("doc_id", "seq").agg(F.min("number").alias("at"))
    return entries.join(first, ["doc_id", "seq"], "left").withColumn("physical_page", F.coalesce("physical_page", "at")).drop("at")


def refined(entries: DataFrame, pages: DataFrame, most_pages: int = 30, most_tokens: int = 20000) -> DataFrame:
    """Entries with sub-entries for the page groups of the too large ones, a level deeper, numbered anew in order."""
    big = oversized_entries(entries, pages, most_pages, most_tokens)
    inner = pages.join(big.select("doc_id", F.col("seq").alias("of"), "physical_page", "last_page"), "doc_id").where("number between physical_page and last_page")
    # groups are made per document: give each entry's pages a document of its own
    own = inner.select(F.struct("doc_id", "of").alias("doc_id"), "number", "text")
    parts = page_groups(own, most_tokens).where("group > 0").select("doc_id.*", "group", "first_page", "last_page")
    parts = parts.join(entries.select("doc_id", F.col("seq").alias("of"), "level", "title"), ["doc_id", "of"])
    title = F.concat("title", F.lit(" (pages "), F.col("first_page").cast("string"), F.lit("–"), F.col("last_page").cast("string"), F.lit(")"))
    new = parts.select("doc_id", F.col("of").alias("seq"), F.col("group").alias("sub"), F.least(F.col("level") + 1, F.lit(6)).alias("level"), title.alias("title"), F.col("first_page").alias("physical_page"))
    both = entries.select("doc_id", "seq", F.lit(0).alias("sub"), "level", "title", "physical_page").unionByName(new)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "sub"))).drop("sub")


def paged_nodes(pages: DataFrame, least_accuracy: float = 0.6, refine: bool = True) -> DataFrame:
    """Raw nodes of paged text (doc_id, number, text), by the best mode that holds per document (column mode).

    toc_with_pages: printed page numbers, set right by the commonest offset to pages that hold the titles, and
    repaired nearby; toc_without_pages: the pages where the titles stand; no_toc: a node per page. A mode
    that puts fewer than ``least_accuracy`` of the titles on their pages gives way to the next.
    """
    pages = cut(pages, "pages")
    scores = cut(toc_scores(pages), "toc")
    printed = cut(toc_entries(pages, scores), "entries")
    anchors = cut(located(printed, pages, scores), "anchors")
    ways = {"toc_with_pages": repair_entries(assign_pages(printed, page_offset(anchors)).where("physical_page is not null"), pages), "toc_without_pages": anchors.where("physical_page is not null")}
    asked = printed.groupBy("doc_id").agg(F.count("*").alias("asked"))
    left, out = pages.select("doc_id").distinct(), None
    for mode, entries in ways.items():
        entries = cut(entries.join(left, "doc_id", "left_semi").select("doc_id", "seq", "level", "title", "physical_page"), mode)
        good = verify_entries(entries, pages).join(asked, "doc_id").where(F.col("correct") >= least_accuracy * F.col("asked")).select("doc_id")
        good = cut(good, "good")
        kept = entries.join(good, "doc_id", "left_semi")
        kept = refined(kept, pages) if refine else kept
        part = toc_nodes(kept, pages).select("doc_id", "seq", "level", "title", "content", "start_page", F.lit(mode).alias("mode"))
        out = part if out is None else out.unionByName(part)
        left = left.join(good, "doc_id", "left_anti")
    rest = page_nodes(pages.join(left, "doc_id", "left_semi")).select("doc_id", "seq", "level", "title", "content", "start_page", F.lit("no_toc").alias("mode"))
    return out.unionByName(rest)


def page_offset(entries: DataFrame) -> DataFrame:
    """(doc_id, page_offset, confidence): the commonest difference of physical and printed page, and the share that has it."""
    d = entries.where("toc_page is not null and physical_page is not null").groupBy("doc_id", (F.col("physical_page") - F.col("toc_page")).alias("page_offset")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "page_offset")
    d = d.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id"))).withColumn("r", F.row_number().over(w)).where("r = 1")
    return d.select("doc_id", "page_offset", (F.col("n") / F.col("total")).alias("confidence"))


def assign_pages(entries: DataFrame, offsets: DataFrame) -> DataFrame:
    """Entries with physical pages filled in by the offset."""
    return entries.join(offsets.select("doc_id", "page_offset"), "doc_id", "left").withColumn("physical_page", F.coalesce("physical_page", F.col("toc_page") + F.col("page_offset"))).drop("page_offset")


def verify_entries(entries: DataFrame, pages: DataFrame, sample: int | None = None) -> DataFrame:
    """(doc_id, correct, total, accuracy): entries whose title stands on their page, of all or of ``sample`` of a document's, chosen by hash."""
    if sample is not None:
        r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("seq", "title"), "seq"))
        entries = entries.withColumn("_r", r).where(F.col("_r") <= sample).drop("_r")
    e = entries.join(pages.select("doc_id", F.col("number").alias("physical_page"), "text"), ["doc_id", "physical_page"], "left")
    ok = F.coalesce(F.lower("text").contains(F.lower("title")), F.lit(False))
    return e.groupBy("doc_id").agg(F.count_if(ok).alias("correct"), F.count("*").alias("total"), F.avg(ok.cast("double")).alias("accuracy"))


def repair_entries(entries: DataFrame, pages: DataFrame, reach: int = 5) -> DataFrame:
    """Entries moved to the nearest page within ``reach`` that holds their title."""
    near = entries.join(pages.select("doc_id", "number", "text"), "doc_id").where((F.abs(F.col("number") - F.col("physical_page")) <= reach) & F.lower("text").contains(F.lower("title")))
    best = near.groupBy("doc_id", "title", "physical_page").agg(F.min(F.struct(F.abs(F.col("number") - F.col("physical_page")).alias("d"), "number")).alias("b"))
    return entries.join(best, ["doc_id", "title", "physical_page"], "left").withColumn("physical_page", F.coalesce("b.number", "physical_page")).drop("b")


def toc_nodes(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Raw nodes of entries (doc_id, seq, level, title, physical_page): the text after the title on its page, else the page."""
    e = entries.join(pages.select("doc_id", F.col("number").alias("physical_page"), "text"), ["doc_id", "physical_page"], "left")
    at = F.position(F.lower("title"), F.lower("text"))
    return e.select("doc_id", "seq", "level", "title", F.trim(F.when(at > 0, F.substring("text", at + F.length("title"), F.length("text"))).otherwise(F.coalesce("text", F.lit("")))).alias("content"), F.col("physical_page").alias("start_page"))


def page_groups(pages: DataFrame, most_tokens: int = 20000) -> DataFrame:
    """(doc_id, group, first_page, last_page): consecutive pages within the token bound, each group one page into the last.

    An ordered fold over each document's pages, inside the JVM.
    """
    p = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", token_estimate(F.col("text")).alias("t")))).alias("p"))
    init = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("tail"))

    def step(a, x):
        n = x["number"].cast("int")
        full = (a["first"] > 0) & (a["sum"] + x["t"] > most_tokens)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["last"].alias("last"))))).otherwise(a["done"]).alias("done"),
            F.when(full, a["last"]).when(a["first"] == 0, n).otherwise(a["first"]).alias("first"), n.alias("last"), F.when(full, a["tail"] + x["t"]).otherwise(a["sum"] + x["t"]).alias("sum"), x["t"].alias("tail"),
        )

    groups = F.aggregate("p", init, step, lambda a: F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["last"].alias("last")))))
    return p.select("doc_id", F.posexplode(groups).alias("group", "g")).select("doc_id", "group", F.col("g.first").alias("first_page"), F.col("g.last").alias("last_page"))


def oversized_entries(entries: DataFrame, pages: DataFrame, most_pages: int = 30, most_tokens: int = 20000) -> DataFrame:
    """Entries that span too many pages and tokens up to the next entry (column last_page)."""
    last_of_doc = pages.groupBy("doc_id").agg(F.max("number").alias("pages"))
    w = Window.partitionBy("doc_id").orderBy("physical_page", "seq")
    e = entries.withColumn("next", F.lead("physical_page").over(w)).join(last_of_doc, "doc_id").withColumn("last_page", F.coalesce(F.col("next") - 1, "pages"))
    e = e.where(F.col("last_page") - F.col("physical_page") + 1 > most_pages)
    p = pages.select("doc_id", "number", token_estimate(F.col("text")).alias("t"))
    s = e.join(p, "doc_id").where("number between physical_page and last_page").groupBy("doc_id", "seq", "title", "physical_page", "last_page").agg(F.sum("t").alias("tokens"))
    return s.where(F.col("tokens") > most_tokens)
