"""More queries over the benchmark tables: paged sources, shaping, asking, counters and routes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import QUERY_STOP
from ..operators import evidence, incremental, indexes, references, search, trees
from ..plans.ask import cross_find
from ..plans.llm import rule_analysis
from ..sources import markdown, pages, readers
from .catalog import (
    SQL, SQL_NODES, SQL_POSTINGS, SQL_SCOUT, TERMS, _asked, _entries, _list, _paged, _scout, _sql_entries, _sql_kinds, _sql_pages, _sql_toc, _sql_versions, _tree, _versions, SQL_TOKENS, SQL_TREE, docs, nodes, postings, query, sql_words, table,
)

# sources

#: Lines of documents as pages of a book.
SQL_LINES = "lp AS (SELECT doc_id, (i + 1)::INT AS number, l[i + 1] AS text FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"


def _line_pages(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "text"))
    return d.select("doc_id", (F.col("k") + 1).alias("number"), "text")


@query("""SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) = 0 THEN 'empty' WHEN doc_id % 3 = 0 AND left(text, 4) <> '%PDF' THEN 'not a PDF' END AS problem, strlen(coalesce(text, '')) > 5000 AS is_large FROM documents""")
def source_validation(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("md").alias("ext"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.encode("text", "UTF-8").alias("content"))
    return readers.validated(d, 5000).select("doc_id", "problem", "is_large")


@query(f"WITH {SQL_LINES} SELECT doc_id, number AS seq, 1 AS level, 'Page ' || number AS title, text AS content, number AS start_page, number AS end_page FROM lp WHERE trim(text) <> ''")
def page_sections(spark, sf_dir):
    return pages.page_nodes(_line_pages(spark, sf_dir))


@query(f"WITH {SQL_LINES} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY number) AS text FROM lp WHERE number BETWEEN 2 AND 4 GROUP BY doc_id")
def page_range_text(spark, sf_dir):
    return pages.page_range_text(_line_pages(spark, sf_dir), 2, 4)


@query(f"""WITH {_sql_toc}, x AS (SELECT p.doc_id, p.number, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM p JOIN s ON p.doc_id = s.doc_id AND p.number = s.number WHERE score > 0.5),
y AS (SELECT doc_id, number, k, regexp_extract(line, '{pages.ENTRY}', ['a', 'title', 'page']) AS r FROM x WHERE regexp_matches(line, '{pages.ENTRY}'))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY number, k))::INT AS seq, CASE WHEN regexp_extract(r.a, '[0-9.]*[0-9]') = '' THEN 1 ELSE len(string_split(regexp_extract(r.a, '[0-9.]*[0-9]'), '.')) END::INT AS level, r.title AS title, r.page::INT AS toc_page, NULL::INT AS physical_page FROM y""")
def toc_text_entries(spark, sf_dir):
    return pages.toc_entries(_paged(spark))


@query(f"""WITH {_sql_pages}, {_sql_entries}, g AS (SELECT doc_id, seq, level, title, toc_page, coalesce(physical_page, 1) + 2 AS physical_page FROM e),
n AS (SELECT g.doc_id, g.title, g.physical_page, arg_min(p.number, (abs(p.number - g.physical_page), p.number)) AS held FROM g JOIN p ON g.doc_id = p.doc_id AND abs(p.number - g.physical_page) <= 5 AND contains(lower(p.text), lower(g.title)) GROUP BY ALL)
SELECT doc_id, title, coalesce(held, physical_page) AS physical_page, seq, level, toc_page FROM g LEFT JOIN n USING (doc_id, title, physical_page)""")
def toc_repair(spark, sf_dir):
    return pages.repair_entries(_entries(spark).withColumn("physical_page", F.coalesce("physical_page", F.lit(1)) + 2), _paged(spark))


@query(f"""WITH {_sql_pages}, {_sql_entries}, x AS (SELECT doc_id, physical_page - toc_page AS page_offset, count(*) AS n FROM e WHERE physical_page IS NOT NULL GROUP BY ALL), o AS (SELECT doc_id, page_offset FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, page_offset) = 1)
SELECT doc_id, seq, level, title, toc_page, coalesce(physical_page, toc_page + page_offset) AS physical_page FROM e LEFT JOIN o USING (doc_id)""")
def toc_assign(spark, sf_dir):
    return pages.assign_pages(_entries(spark), pages.page_offset(_entries(spark)))


@query(f"""WITH {SQL_LINES}, t AS (SELECT doc_id, list([{{'done': []::STRUCT(a INT, z INT)[], 'a': number, 'z': number, 's': {SQL_TOKENS.format('text')}, 't': {SQL_TOKENS.format('text')}}}] ORDER BY number) AS l FROM lp GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce([x[1] FOR x IN l], lambda a, x: CASE WHEN a.s + x.t > 200 THEN {{'done': list_append(a.done, {{'a': a.a, 'z': a.z}}), 'a': a.z, 'z': x.z, 's': a.t + x.t, 't': x.t}} ELSE {{'done': a.done, 'a': a.a, 'z': x.z, 's': a.s + x.t, 't': x.t}} END) AS a FROM t),
g AS (SELECT doc_id, list_append(a.done, {{'a': a.a, 'z': a.z}}) AS g FROM f)
SELECT doc_id, (k - 1)::INT AS "group", g[k].a AS first_page, g[k].z AS last_page FROM (SELECT doc_id, g, unnest(range(1, len(g) + 1)) AS k FROM g)""")
def page_group_ranges(spark, sf_dir):
    return pages.page_groups(_line_pages(spark, sf_dir), 200)


@query(f"""WITH {SQL_LINES}, e AS (SELECT doc_id, (number - 1) // 7 + 1 AS seq, 'part ' || ((number - 1) // 7 + 1) AS title, min(number) AS physical_page FROM lp GROUP BY ALL),
w AS (SELECT e.*, coalesce(lead(physical_page) OVER (PARTITION BY doc_id ORDER BY physical_page, seq) - 1, (SELECT max(number) FROM lp WHERE lp.doc_id = e.doc_id)) AS last_page FROM e)
SELECT w.doc_id, seq, title, physical_page, last_page, sum({SQL_TOKENS.format('text')})::BIGINT AS tokens FROM w JOIN lp ON w.doc_id = lp.doc_id AND number BETWEEN physical_page AND last_page WHERE last_page - physical_page + 1 > 5 GROUP BY ALL HAVING tokens > 150""")
def oversized_parts(spark, sf_dir):
    p = _line_pages(spark, sf_dir)
    part = F.floor((F.col("number") - 1) / 7) + 1
    e = p.groupBy("doc_id", part.alias("seq")).agg(F.min("number").alias("physical_page")).withColumn("title", F.concat(F.lit("part "), F.col("seq").cast("string")))
    return pages.oversized_entries(e, p, 5, 150)


@query("SELECT doc_id, 0 AS seq, 0 AS level, 'Introduction' AS title, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM documents WHERE trim(coalesce(text, '')) <> ''")
def md_documents(spark, sf_dir):
    """All documents read as Markdown: they hold no headings, so each is one section."""
    return markdown.markdown_nodes(docs(spark, sf_dir).withColumnRenamed("text", "markdown")).select("doc_id", "seq", "level", "title", "content")


@query(f"""WITH {SQL_NODES}, refs AS (SELECT doc_id, node_id, content FROM nodes WHERE is_leaf), k AS ({_sql_kinds}) SELECT doc_id, node_id, ref_type, count(*) AS n FROM k GROUP BY ALL""")
def refs_documents(spark, sf_dir):
    """References in all lines of all documents, by kind."""
    return references.extract(nodes(spark, sf_dir).where("is_leaf")).groupBy("doc_id", "node_id", "ref_type").agg(F.count("*").alias("n"))


# trees


@query(f"WITH {SQL_NODES} SELECT doc_id, count(*) AS n_nodes, count(*) FILTER (is_leaf) AS n_leaves, count(*) FILTER (NOT is_leaf) AS n_inner, max(depth) AS max_depth FROM nodes GROUP BY doc_id")
def tree_counts(spark, sf_dir):
    return trees.tree_counts(nodes(spark, sf_dir))


@query(f"""WITH {SQL_NODES} SELECT n.doc_id, n.node_id, concat_ws(' / ', r.title, CASE WHEN n.depth = 2 THEN p.title END, CASE WHEN n.depth > 0 THEN n.title END) AS path
FROM nodes n JOIN nodes r ON n.doc_id = r.doc_id AND r.depth = 0 LEFT JOIN nodes p ON n.doc_id = p.doc_id AND n.parent_id = p.node_id""")
def tree_paths(spark, sf_dir):
    return trees.breadcrumbs(nodes(spark, sf_dir))


@query(f"WITH {SQL_NODES} SELECT b.doc_id, b.node_id, b.title FROM nodes a JOIN nodes b ON a.doc_id = b.doc_id AND b.node_id BETWEEN a.node_id AND a.last_desc WHERE a.depth = 1 AND a.structure IN ('2', '5')")
def toc_filtered(spark, sf_dir):
    return trees.toc_filtered(nodes(spark, sf_dir), (F.col("depth") == 1) & F.col("structure").isin("2", "5")).select("doc_id", "node_id", "title")


@query(f"WITH {SQL_NODES} SELECT doc_id, node_id, title || CASE WHEN depth = 1 THEN ' ...' ELSE '' END AS title, depth AS below FROM nodes WHERE depth <= 1")
def toc_clipped(spark, sf_dir):
    return trees.toc_from(nodes(spark, sf_dir), 1, 1).select("doc_id", "node_id", "title", "below")


@query(f"WITH {SQL_NODES} SELECT doc_id, node_id, CASE WHEN node_id > 9999 THEN node_id::VARCHAR ELSE lpad(node_id::VARCHAR, 4, '0') END AS number FROM nodes")
def node_numbers(spark, sf_dir):
    return nodes(spark, sf_dir).select("doc_id", "node_id", trees.numbered(F.col("node_id")).alias("number"))


@query(f"WITH {SQL_NODES} SELECT doc_id, node_id, depth FROM nodes WHERE depth < 2 AND (depth = 0 OR structure::INT <= 3) UNION ALL SELECT doc_id, node_id, depth FROM nodes WHERE depth = 2 AND string_split(structure, '.')[1]::INT <= 3 AND string_split(structure, '.')[2]::INT <= 3")
def tree_limited(spark, sf_dir):
    return trees.limited(nodes(spark, sf_dir), max_children=3).select("doc_id", "node_id", "depth")


@query(f"""WITH {SQL_NODES}, p AS (SELECT *, CASE WHEN is_leaf AND node_id % 3 = 0 THEN node_id END AS a FROM nodes)
SELECT x.doc_id, x.node_id, min(y.a) AS start_page, max(y.a) AS end_page FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.node_id BETWEEN x.node_id AND x.last_desc GROUP BY x.doc_id, x.node_id""")
def page_ranges(spark, sf_dir):
    """Pages of every third leaf, widened up the trees."""
    at = F.when(F.col("is_leaf") & (F.col("node_id") % 3 == 0), F.col("node_id"))
    return trees.page_ranges(nodes(spark, sf_dir).withColumns({"start_page": at, "end_page": at})).select("doc_id", "node_id", "start_page", "end_page")


@query(f"""WITH {SQL_NODES}, s AS (SELECT *, CASE WHEN depth = 0 AND doc_id % 2 = 0 THEN 'own ' || doc_id WHEN depth = 1 THEN 'sum ' || structure ELSE '' END AS summary FROM nodes)
SELECT r.doc_id, coalesce(nullif(r.summary, ''), (SELECT string_agg(k.title || ': ' || k.summary, chr(10) ORDER BY k.node_id) FROM s k WHERE k.doc_id = r.doc_id AND k.depth = 1), '') AS summary FROM s r WHERE r.depth = 0""")
def summary_shortcut(spark, sf_dir):
    s = F.when((F.col("depth") == 0) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("own "), F.col("doc_id").cast("string"))).when(F.col("depth") == 1, F.concat(F.lit("sum "), "structure")).otherwise("")
    return indexes.summary_shortcut(nodes(spark, sf_dir).withColumn("summary", s))


@query(f"""WITH {SQL_NODES}, k AS (SELECT doc_id, parent_id, node_id, title, content, {SQL_TOKENS.format('content')} AS t FROM nodes WHERE is_leaf), g AS (SELECT *, (t > 0 AND t < 20) AS ok, sum((NOT (t > 0 AND t < 20))::INT) OVER (PARTITION BY doc_id, parent_id ORDER BY node_id) AS run FROM k),
j AS (SELECT *, row_number() OVER w AS i, lead(node_id) OVER w AS d, lead(title) OVER w AS dt, lead(content) OVER w AS dc FROM g WHERE ok WINDOW w AS (PARTITION BY doc_id, parent_id, run ORDER BY node_id)),
m AS (SELECT * FROM j WHERE i % 2 = 1 AND d IS NOT NULL)
SELECT n.doc_id, n.node_id, CASE WHEN e.d IS NOT NULL THEN '[MERGED: ' || n.title || ']' ELSE n.title END AS title, CASE WHEN e.d IS NOT NULL THEN '' WHEN m.d IS NOT NULL THEN m.content || chr(10) || chr(10) || '## ' || m.dt || chr(10) || m.dc ELSE n.content END AS content
FROM nodes n LEFT JOIN m ON n.doc_id = m.doc_id AND n.node_id = m.node_id LEFT JOIN m e ON n.doc_id = e.doc_id AND n.node_id = e.d WHERE n.is_leaf""")
def optimised_leaves(spark, sf_dir):
    return trees.optimised(nodes(spark, sf_dir), 20).where("is_leaf").select("doc_id", "node_id", "title", "content")


@query(f"""WITH {SQL_NODES}, k AS (SELECT doc_id, parent_id, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL)
SELECT n.doc_id, n.node_id, CASE WHEN k.n = 1 THEN '[EMPTY: ' || title || ']' ELSE title END AS title FROM nodes n JOIN k ON n.doc_id = k.doc_id AND n.node_id = k.parent_id WHERE n.depth = 1""")
def optimised_sections(spark, sf_dir):
    return trees.optimised(nodes(spark, sf_dir)).where("depth = 1").select("doc_id", "node_id", "title")


@query(f"""SELECT doc_id, trim(coalesce(text, '')) <> '' AS has_content, length(coalesce(text, '')) AS char_count, len({sql_words("coalesce(text, '')")}) AS word_count FROM documents""")
def raw_counts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf_dir).select("doc_id", (F.trim(t) != "").alias("has_content"), F.length(t).cast("long").alias("char_count"), F.size(T.words(t)).cast("long").alias("word_count"))


# asking


@query(f"WITH {SQL_POSTINGS} SELECT doc_id, keyword, node_id, round(weight, 6) AS weight, row_number() OVER (PARTITION BY doc_id, keyword ORDER BY weight DESC, node_id)::INT AS rank FROM postings WHERE list_contains({_asked}, keyword) QUALIFY rank <= 3")
def cross_document_find(spark, sf_dir):
    return cross_find(postings(nodes(spark, sf_dir), only=TERMS), TERMS).select("doc_id", "keyword", "node_id", F.round("weight", 6).alias("weight"), "rank")


@query(rf"""WITH q AS (SELECT item_id, lower(text) AS q, len(list_distinct(k)) AS n, array_to_string(list_sort(list_distinct(k)), '|') AS keywords FROM
  (SELECT item_id, text, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 AND NOT list_contains({_list(QUERY_STOP)}, w)) AS k FROM benchmark))
SELECT item_id, keywords, CASE WHEN contains(q, 'where') THEN 'navigational' WHEN contains(q, 'compare') OR contains(q, 'versus') THEN 'comparative' WHEN contains(q, 'summar') OR contains(q, 'overview') THEN 'summary'
  WHEN contains(q, 'how to') OR contains(q, 'steps') THEN 'procedural' WHEN contains(q, 'why') OR contains(q, 'explain') THEN 'analytical' ELSE 'factual' END AS intent,
  CASE WHEN n <= 4 THEN 'simple' WHEN n <= 8 THEN 'moderate' ELSE 'complex' END AS complexity FROM q""")
def question_analysis(spark, sf_dir):
    """The items of the benchmark taken as questions and analysed by rules."""

    def read(frames):
        for f in frames:
            got = [rule_analysis(t or "") for t in f["text"]]
            yield pd.DataFrame({"item_id": f["item_id"], "keywords": ["|".join(sorted(a.keywords)) for a in got], "intent": [a.intent for a in got], "complexity": [a.complexity for a in got]})

    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(read, "item_id long, keywords string, intent string, complexity string")


@query(f"WITH {SQL_SCOUT}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, node_id) AS r, max(score) OVER (PARTITION BY doc_id) AS best FROM fused) SELECT doc_id, node_id, round(score, 6) AS score FROM r WHERE r = 1 OR (r = 2 AND best - score <= 0.1)")
def fast_path_reads(spark, sf_dir):
    return evidence.read_also(_scout(spark, sf_dir), ["doc_id"]).select("doc_id", "node_id", F.round("score", 6).alias("score"))


@query(f"WITH {SQL_NODES} SELECT doc_id, node_id, title, round(1 - (structure::INT - 1) * 0.01, 6)::DOUBLE AS score, 'toc' AS why FROM nodes WHERE depth = 1 AND structure::INT <= 24")
def toc_fallback(spark, sf_dir):
    return evidence.toc_candidates(nodes(spark, sf_dir)).withColumn("score", F.round(F.col("score").cast("double"), 6))


@query(f"WITH {SQL_NODES} SELECT doc_id, node_id, round(1 - (string_split(structure, '.')[1]::INT - 1) * 0.01 - 0.01 * string_split(structure, '.')[2]::INT, 6)::DOUBLE AS score FROM nodes WHERE depth = 2 AND string_split(structure, '.')[1]::INT <= 24")
def expanded_children(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return evidence.expand_children(evidence.toc_candidates(n), n).withColumn("score", F.round(F.col("score").cast("double"), 6))


@query(r"""WITH d AS (SELECT doc_id, replace(trim(coalesce(text, '')), chr(10), ' ') AS t, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS p FROM documents)
SELECT doc_id, CASE WHEN length(t) > 90 THEN substr(t, 1, 90) || '…' ELSE t END AS title, CASE WHEN length(p) > 120 THEN substr(p, 1, 120) || '…' ELSE p END AS preview FROM d""")
def clamped_texts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf_dir).select("doc_id", T.clamp(t).alias("title"), T.clamp_preview(t).alias("preview"))


# changes


@query("SELECT doc_id, doc_id % 7 = 0 OR doc_id % 5 = 0 AS stale FROM documents WHERE text IS NOT NULL")
def recompile_marks(spark, sf_dir):
    d = docs(spark, sf_dir).where("text is not null").withColumn("now", F.md5("text"))
    stored = F.when(F.col("doc_id") % 7 != 0, F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("now")))
    return d.select("doc_id", incremental.needs_recompile(stored, F.col("now")).alias("stale"))


@query(f"""WITH {_sql_versions}, x AS (SELECT CASE WHEN a.added THEN 'added' WHEN a.modified THEN 'modified' ELSE 'restructured' END AS change FROM ch a
WHERE a.added OR EXISTS (SELECT 1 FROM ch b WHERE b.doc_id = a.doc_id AND b.node_id BETWEEN a.node_id AND a.last_desc AND b.modified)) SELECT change, count(*) AS n FROM x GROUP BY change""")
def change_counts(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    c = incremental.ChangeSet(incremental.detect_changes(incremental.node_fingerprints(old), incremental.node_fingerprints(new)))
    return c.changes.groupBy("change").agg(F.count("*").alias("n"))


@query(f"""WITH {_sql_versions}, b AS (SELECT a.doc_id, a.node_id, a.modified AS c, EXISTS (SELECT 1 FROM ch b WHERE b.doc_id = a.doc_id AND b.node_id BETWEEN a.node_id AND a.last_desc AND b.modified) AS s FROM ch a WHERE NOT a.added)
SELECT doc_id, node_id, c AS content_changed, s AS subtree_changed, s AND NOT c AS only_descendants FROM b""")
def node_changes(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return incremental.node_changes(incremental.node_fingerprints(old), incremental.node_fingerprints(new))


@query("""SELECT doc_id FROM documents WHERE doc_id % 6 <> 1 OR doc_id % 10 = 7""")
def detector_needs(spark, sf_dir):
    """Documents to compile again: two thirds and more have no state, or one of other content."""
    d = docs(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_fp"), F.lit("l").alias("logic_fp"), F.lit(1).alias("version"), F.lit(None).cast("timestamp").alias("modified"))
    known = d.where("doc_id % 6 = 1").withColumn("content_fp", F.when(F.col("doc_id") % 10 == 7, "old").otherwise(F.col("content_fp")))
    return incremental.ChangeDetector(known).needing(d).select("doc_id")


@query("SELECT doc_id, to_base64(unhex(sha256(coalesce(text, '')))) AS fp64, sha256(coalesce(text, '')) AS hex FROM documents")
def fingerprint_forms(spark, sf_dir):
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs(spark, sf_dir).select("doc_id", F.base64(F.unhex(h)).alias("fp64"), h.alias("hex"))


# routes, chains and counters


@query(f"WITH {SQL_POSTINGS} SELECT doc_id, node_id, round(max(weight), 6) AS weight FROM postings WHERE list_contains({_asked}, keyword) GROUP BY ALL")
def related_sections(spark, sf_dir):
    p = postings(nodes(spark, sf_dir), only=TERMS)
    return p.groupBy("doc_id", "node_id").agg(F.round(F.max("weight"), 6).alias("weight"))


@query(f"""WITH {SQL_POSTINGS} SELECT doc_id, count(DISTINCT keyword) AS topics, count(*) AS entries, (SELECT count(*) FROM nodes n WHERE n.doc_id = p.doc_id AND NOT is_leaf) AS nav_entries, (SELECT count(*) FROM nodes n WHERE n.doc_id = p.doc_id AND parent_id IS NOT NULL) AS child_routes FROM postings p GROUP BY doc_id""")
def index_counts(spark, sf_dir):
    n = nodes(spark, sf_dir)
    p = postings(n).groupBy("doc_id").agg(F.count_distinct("keyword").alias("topics"), F.count("*").alias("entries"))
    k = n.groupBy("doc_id").agg(F.count_if(~F.col("is_leaf")).alias("nav_entries"), F.count("parent_id").alias("child_routes"))
    return p.join(k, "doc_id").select("doc_id", "topics", "entries", "nav_entries", "child_routes")


@query(f"WITH c AS ({SQL['chains']}) SELECT doc_id, node_id, count(*) FILTER (side = 'p') AS n_premises, count(*) FILTER (side = 'c') AS n_conclusions FROM (SELECT doc_id, conclusion AS node_id, 'p' AS side FROM c UNION ALL SELECT doc_id, premise, 'c' FROM c) GROUP BY ALL")
def chain_sides(spark, sf_dir):
    """How many premises and conclusions each node of a chain has."""
    t = _tree(spark)
    c = references.chains(references.resolve(references.extract(t), t), t)
    sides = c.select("doc_id", F.col("conclusion").alias("node_id"), F.lit("p").alias("side")).unionByName(c.select("doc_id", F.col("premise").alias("node_id"), F.lit("c").alias("side")))
    return sides.groupBy("doc_id", "node_id").agg(F.count_if(F.col("side") == "p").alias("n_premises"), F.count_if(F.col("side") == "c").alias("n_conclusions"))


@query(f"WITH r AS ({SQL['refs_resolve']}) SELECT ref_type, count(*) AS n, count(target_node) AS resolved FROM r GROUP BY ref_type")
def resolved_counts(spark, sf_dir):
    t = _tree(spark)
    r = references.resolve(references.extract(t), t)
    return r.groupBy("ref_type").agg(F.count("*").alias("n"), F.count("target_node").alias("resolved"))


@query(f"WITH {SQL_NODES}, l AS (SELECT doc_id, node_id, generate_subscripts(string_split(content, chr(10)), 1) AS k, unnest(string_split(content, chr(10))) AS line FROM nodes WHERE node_id = 3) SELECT doc_id, node_id, k::INT AS line_no, line FROM l WHERE regexp_matches(line, '[A-Z]')")
def grep_one_node(spark, sf_dir):
    """The first line of each document, if it matches."""
    return search.grep(nodes(spark, sf_dir).where("node_id = 3"), "[A-Z]")


@query(f"WITH {SQL_NODES}, t AS (SELECT doc_id, node_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) AS k FROM nodes WHERE depth = 1) SELECT doc_id, min(node_id) AS node_id, min(title) AS title FROM t WHERE title = 'block 2' GROUP BY doc_id")
def resolved_titles(spark, sf_dir):
    """A section by title in every document, whatever its case."""
    n = nodes(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("node_id")
    hit = n.where((F.col("depth") == 1) & (F.lower("title") == "block 2"))
    return hit.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "node_id", "title")
