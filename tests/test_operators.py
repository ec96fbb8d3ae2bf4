import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import evidence, graph, incremental, indexes, references, search, trees
from foliant.plans.llm import CachedModel, analyse, extract_json, parse_dispatch
from foliant.plans.pipeline import Pipeline
from foliant.sources import markdown, pages


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*cols).first()


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("hello world foo bar", "hello world foo bar", 1.0), ("alpha beta gamma", "delta epsilon zeta", 0.0), ("alpha beta gamma", "beta gamma delta", 0.5), ("", "", 1.0), ("content", "", 0.0), ("Hello World", "hello world", 1.0)],
)
def test_jaccard(spark, a, b, want):
    assert one(spark, T.jaccard(T.word_set(F.lit(a)), T.word_set(F.lit(b))).alias("j")).j == want


@pytest.mark.parametrize(("s", "x", "y", "want"), [(0.95, 100, 100, "duplicate"), (0.85, 100, 90, "subset"), (0.85, 100, 30, "summary")])
def test_overlap_type(spark, s, x, y, want):
    assert one(spark, indexes.overlap_type(F.lit(s), F.lit(x), F.lit(y)).alias("t")).t == want


def leaves(spark, texts):
    return spark.createDataFrame([(1, i + 2, 1, i + 2, 1, str(i + 1), f"t{i}", t, True) for i, t in enumerate(texts)], "doc_id int, node_id int, parent_id int, last_desc int, depth int, structure string, title string, content string, is_leaf boolean")


def test_overlaps(spark):
    long = "the same long sentence that is repeated in two places of the document"
    assert [r.overlap_type for r in indexes.overlaps(leaves(spark, [long, long])).collect()] == ["duplicate"]
    assert indexes.overlaps(leaves(spark, [long, "entirely different words make up this other sentence which shares nothing"])).count() == 0
    assert indexes.overlaps(leaves(spark, [long])).count() == 0
    assert indexes.overlaps(leaves(spark, ["short text", "short text"])).count() == 0


def test_evidence_scores(spark):
    def score(f, s):
        return one(spark, f(F.lit(s)).alias("x")).x

    assert score(T.density, "word word word") == pytest.approx(1 / 3)
    assert score(T.density, "alpha beta gamma delta") == 1 and score(T.density, "") == 0
    for s in ("Revenue was $4.2B in Q3 2024, up 12.5%", "| A | B | C |\n|---|---|---|\n| 1 | 2 | 3 |", "```rust\nfn main() {}\n```", "- item one\n- item two\n- item three"):
        assert score(T.data_richness, s) > 0
    assert score(T.data_richness, "just some plain text without any structured data") == 0 and score(T.data_richness, "") == 0
    assert score(T.specificity, "HashMap implementation details concurrency primitives") > 0.8
    assert score(T.specificity, "the is a an and or but in on at to for of with") < 0.3 and score(T.specificity, "") == 0
    assert one(spark, T.composite(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("c")).c == pytest.approx(1)


def test_keywords(spark):
    assert one(spark, T.index_terms(F.lit("Introduction to Machine Learning")).alias("k")).k == ["introduction", "machine", "learning"]
    assert one(spark, T.index_terms(F.lit("A B CD")).alias("k")).k == ["cd"]
    assert T.query_keywords("What is the total revenue in 2025, the revenue?") == ["total", "revenue", "2025"]


def test_postings_weights_and_caps(spark):
    p = indexes.postings(leaves(spark, [f"section {i} alpha beta gamma delta" for i in range(50)]), max_keywords=5)
    rows = p.collect()
    assert all(0 < r.weight <= 1 for r in rows) and len({r.keyword for r in rows}) <= 5
    assert max(sum(r.keyword == k for r in rows) for k in {r.keyword for r in rows}) <= 20


def test_build_tree(spark):
    raw = [(1, 1, 1, "Section 1", "c"), (1, 2, 2, "1.1", "c"), (1, 3, 2, "1.2", "c"), (1, 4, 1, "Section 2", "c"), (1, 5, 3, "2.1", "c"), (1, 6, 2, "2.2", "c"), (1, 7, 0, "zero", "c")]
    t = {r.title: r for r in trees.build_tree(spark.createDataFrame(raw, "doc_id int, seq int, level int, title string, content string")).collect()}
    assert [t[x].structure for x in ("Section 1", "1.1", "1.2", "Section 2", "2.1", "2.2", "zero")] == ["1", "1.1", "1.2", "2", "2.1", "2.2", "3"]
    assert (t["doc 1"].node_id, t["doc 1"].last_desc, t["doc 1"].depth) == (1, 8, 0)
    assert (t["Section 1"].last_desc, t["2.1"].depth, t["2.2"].parent_id, t["zero"].parent_id) == (4, 2, 5, 1)
    n = trees.build_tree(spark.createDataFrame(raw[:6], "doc_id int, seq int, level int, title string, content string"))
    counts = {r.node_id: r.leaf_count for r in trees.leaf_counts(n).collect()}
    assert counts[1] == 4 and counts[2] == 2 and counts[3] == 1


def test_merge_small_leaves_and_empty(spark):
    t = leaves(spark, ["a" * 200, "b" * 120, "c" * 800, "d" * 160])
    got = trees.merge_small_leaves(t, 100).collect()
    assert [(r.node_id, r.donor_id, r.donor_new_title) for r in got] == [(2, 3, "[MERGED: t1]")]
    n = spark.createDataFrame([(1, 1, None, 3, 0, "", "r", "", False), (1, 2, 1, 3, 1, "1", "s", "", False), (1, 3, 2, 3, 2, "1.1", "l", "x", True)], t.schema)
    assert [r.new_title for r in trees.mark_empty(n).collect()] == ["[EMPTY: s]"]


def test_split_leaves(spark):
    text = "\n".join(f"# Part {i}\n" + "word " * 300 for i in range(4))
    got = trees.split_leaves(leaves(spark, [text, "small"]), 500).orderBy("part").collect()
    assert {r.node_id for r in got} == {2} and [r.title for r in got] == [f"Part {i}" for i in range(4)]
    assert "".join(r.content.replace("\n", "").replace(" ", "") for r in got) == text.replace("\n", "").replace(" ", "")


def test_page_ranges(spark):
    n = spark.createDataFrame([(1, 1, None, 3, 0, None, None), (1, 2, 1, 3, 1, 9, 9), (1, 3, 2, 3, 2, 4, 6)], "doc_id int, node_id int, parent_id int, last_desc int, depth int, start_page int, end_page int")
    got = {r.node_id: (r.start_page, r.end_page) for r in trees.page_ranges(n).collect()}
    assert got[3] == (4, 6) and got[2] == (4, 6) and got[1] == (4, 9)


@pytest.mark.parametrize(("kind", "a", "b", "want"), [("section", 1, 2, "elaboration"), ("section", 2, 1, "supporting"), ("table", 1, 2, "supporting"), ("footnote", 2, 1, "elaboration")])
def test_chain_types(spark, kind, a, b, want):
    n = spark.createDataFrame([(1, 1, a, "x"), (1, 2, b, "y")], "doc_id int, node_id int, depth int, title string")
    r = spark.createDataFrame([(1, 1, kind, 2)], "doc_id int, node_id int, ref_type string, target_node int")
    assert references.chains(r, n).first().chain_type == want


def test_references(spark):
    texts = ["For details, see Section 2.1 and Section 3.2.1.", "See Appendix G for more.", "In Table 5.3 and Table 1.", "As shown in Figure 2.1 and fig. 3.", "See page 42.", "For details, see Section 2.1, Appendix G, and Table 5.3."]
    d = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id int, node_id int, content string")
    got = {}
    for r in references.extract(d).orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append((r.ref_type, r.target_id))
    assert got[0] == [("section", "2.1"), ("section", "3.2.1")] and got[1] == [("appendix", "G")] and got[2] == [("table", "5.3"), ("table", "1")]
    assert got[3] == [("figure", "2.1"), ("figure", "3")] and got[4] == [("page", "42")] and len(got[5]) == 3


def test_routes(spark):
    t = [(1, 1, None, 0, False, "Root", "", ["What was the revenue?"], ["revenue", "finance"]), (1, 2, 1, 1, True, "Revenue Q3", "Q3 revenue was $4.2B", [], ["revenue", "Q3"]), (1, 3, 1, 1, True, "Revenue Q4", "Q4 revenue was $5.1B", ["What was Q4 revenue?"], ["revenue", "Q4"])]
    n = spark.createDataFrame(t, "doc_id int, node_id int, parent_id int, depth int, is_leaf boolean, title string, content string, hints array<string>, tags array<string>")
    got = indexes.intent_routes(n).orderBy("rank").collect()
    assert [(r.node_id, round(r.relevance, 6)) for r in got] == [(3, 0.8), (2, 0.5)] and got[0].reason == "Can answer: What was Q4 revenue?"
    c = indexes.concept_routes(n).where("concept = 'revenue'").orderBy("rank").collect()
    assert [r.relevance for r in c] == [0.9, 0.9, 0.7]


def profiles(spark, sets):
    return spark.createDataFrame([(d, k, w) for d, s in sets.items() for k, w in s.items()], "doc string, keyword string, weight double")


def test_graph(spark):
    e = graph.graph_edges(profiles(spark, {"1": {"rust": 0.9, "async": 0.8, "tokio": 0.6}, "2": {"rust": 0.7, "async": 0.9, "futures": 0.5}})).collect()
    assert {(r.src, r.dst) for r in e} == {("1", "2"), ("2", "1")}
    assert all(r.shared == 2 and r.jaccard == 0.5 and r.weight == pytest.approx(0.316) for r in e)
    assert graph.graph_edges(profiles(spark, {"1": {"rust": 1.0, "ownership": 1.0}, "2": {"pasta": 1.0, "sauce": 1.0}})).count() == 0
    assert graph.graph_edges(profiles(spark, {"1": dict.fromkeys("abcde", 1.0), "2": dict.fromkeys("axyz", 1.0)}), least_jaccard=0.9).count() == 0
    many = graph.graph_edges(profiles(spark, {str(i): {"shared": 1.0, "common": 1.0} for i in range(4)}))
    assert graph.trim_edges(many, 2).groupBy("src").count().agg(F.max("count")).first()[0] == 2


def test_markdown_levels(spark):
    d = spark.createDataFrame([(1, "# H1\n## H2\n### H3\n#### H4"), (2, ""), (3, "Just some text\nwith no headings.")], "doc_id int, markdown string")
    got = markdown.markdown_nodes(d, markdown.MarkdownConfig.documentation(2)).collect()
    assert sorted(r.title for r in got if r.doc_id == 1) == ["H1", "H2"] and not [r for r in got if r.doc_id == 2]
    assert [(r.title, r.level) for r in got if r.doc_id == 3] == [("Introduction", 0)]


BASE = "the quarterly revenue grew strongly across all regions this fiscal year"


def test_evidence_dedup(spark):
    rows = [(1, 1, "a", "A", "short", "d"), (1, 2, "b", "B", BASE, "d"), (1, 3, "b", "B", "another text of the same source that is long enough to stay around", "d"), (1, 4, "c", "C", BASE + " indeed", "d"), (2, 5, "c", "C", BASE, None)]
    e = spark.createDataFrame(rows, "ask int, seq int, source_path string, node_title string, content string, doc_name string")
    kept = evidence.dedup_evidence(e, "ask")
    assert sorted(r.seq for r in kept.collect()) == [2, 5]
    told = {r.ask: r.answer for r in evidence.format_answer(kept, "ask").collect()}
    assert told[1] == f"[B — d]\n{BASE}" and told[2] == f"[C]\n{BASE}"
    assert "- **B** in d at b" in {r.ask: r.answer for r in evidence.format_answer(kept, "ask", True).collect()}[1]


@pytest.mark.parametrize(
    ("cands", "keywords", "intent", "want"),
    [([(0.9, 1)], 2, "x", 1), ([(0.7, 2), (0.69, 1)], 2, "x", 1), ([(0.85, 1), (0.6, 1)], 2, "x", 1), ([(0.55, 1), (0.54, 1)], 9, "x", None), ([(0.4, 5)], 1, "x", None), ([], 1, "x", None), ([(0.9, 1)], 9, "factual", 1)],
)
def test_confidence_gate(spark, cands, keywords, intent, want):
    d = spark.createDataFrame([(1, i + 1, s, h) for i, (s, h) in enumerate(cands)], "doc_id int, node_id int, score double, hits int")
    got = evidence.confidence_gate(d, keywords, intent, ["doc_id"]).collect()
    assert [r.node_id for r in got] == ([want] if want else [])


def test_clamps(spark):
    assert one(spark, T.clamp(F.lit("x" * 95)).alias("c")).c == "x" * 90 + "…" and one(spark, T.clamp(F.lit(" a\nb ")).alias("c")).c == "a b"
    assert one(spark, T.routing_hint(F.array(F.lit("q1"), F.lit("q2"), F.lit("q3")), F.lit("s")).alias("h")).h == "  ⟨answers: q1; q2⟩"


def test_hot_nodes(spark, tmp_path):
    hits = spark.createDataFrame([("c1", 0.9), ("c2", 0.7), ("c1", 0.8)], "node_id string, score double")
    assert {r.node_id: r.is_hot for r in indexes.hot_nodes(hits, 2).collect()} == {"c1": True, "c2": False}
    from foliant.streaming.hot import hot_nodes_stream

    hits.write.parquet(str(tmp_path / "hits"))
    s = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "hits"))
    q = hot_nodes_stream(s, 2).writeStream.outputMode("complete").format("memory").queryName("hot").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.node_id: r.hit_count for r in spark.table("hot").collect()} == {"c1": 2, "c2": 1}


def test_changes(spark):
    cols = "doc_id int, node_id int, last_desc int, depth int, title string, content string"
    old = incremental.node_fingerprints(spark.createDataFrame([(1, 1, 3, 0, "r", ""), (1, 2, 2, 1, "a", "x"), (1, 3, 3, 1, "gone", "y")], cols))
    new = incremental.node_fingerprints(spark.createDataFrame([(1, 1, 3, 0, "r", ""), (1, 2, 2, 1, "a", "z"), (1, 3, 3, 1, "new", "y")], cols))
    got = {r.title: r.change for r in incremental.detect_changes(old, new).collect()}
    assert got == {"r": "restructured", "a": "modified", "gone": "removed", "new": "added"}
    r = lambda fp, v: one(spark, incremental.needs_reprocessing(F.lit(fp), F.lit(v), F.lit("f"), 1).alias("x")).x
    assert not r("f", 1) and r("f", 0) and r("g", 1) and r(None, 1)


def test_toc_groups(spark):
    p = spark.createDataFrame([(1, i, "x" * 400) for i in range(1, 8)], "doc_id int, number int, text string")
    got = [(r.first_page, r.last_page) for r in pages.page_groups(p, 300).orderBy("group").collect()]
    assert got == [(1, 3), (3, 5), (5, 7)]


def test_model_seam():
    assert extract_json('x ```json\n{"a": 1}\n``` y') == {"a": 1} and extract_json('say {"b": {"c": 2}} end') == {"b": {"c": 2}}
    assert analyse("Where is the cost table?").intent == "navigational" and analyse("total revenue").intent == "factual"

    class Odd:
        n = 0

        def complete(self, prompt):
            self.n += 1
            if self.n == 1:
                raise RuntimeError
            return '{"intent": "nonsense", "keywords": ["k"]}'

    m = CachedModel(Odd())
    assert analyse("q", m).intent == "factual" and analyse("q", m).keywords == ["k"] and m.hits == 1
    assert parse_dispatch("ALREADY_ANSWERED", 3) is None
    assert parse_dispatch("- doc: 2\n  task: read\n- doc: 9\n", 3) == [{"doc": 2, "task": "read"}]


def test_pipeline_order_and_failures():
    seen = []
    p = Pipeline().stage("b", lambda c: seen.append("b"), ("a",)).stage("a", lambda c: seen.append("a")).stage("c", lambda c: 1 / 0, ("a",), 10, optional=True)
    p.run({})
    assert p.groups() == [["a"], ["c", "b"]] and seen == ["a", "b"] and "c" in p.skipped
    with pytest.raises(ValueError):
        Pipeline().stage("x", print, ("y",)).groups()
    with pytest.raises(ValueError):
        Pipeline().stage("x", print, ("y",)).stage("y", print, ("x",)).groups()


def test_snippet_and_search(spark):
    d = spark.createDataFrame([(1, "zebra " * 60 + "needle here " + "tail " * 60), (2, "nothing to see"), (3, "needle needle")], "doc_id int, text string")
    got = search.search_documents(d, ["needle"]).orderBy("rank").collect()
    assert {r.doc_id for r in got} == {1, 3} and got[0].doc_id == 3
    s = next(r.snippet for r in got if r.doc_id == 1)
    assert s.startswith("…") and s.endswith("…") and "needle" in s


def test_enhance_and_verify(spark):
    from foliant.operators import enhance

    t = leaves(spark, ["First sentence here. " + "more words follow " * 30, "short"])
    got = {r.node_id: r for r in enhance.enhance(t, indexes.postings(t)).collect()}
    assert got[2].summary == "First sentence here." and got[3].summary == "short" and got[2].tags
    by = {r.node_id: r for r in enhance.enhance_by_model(t, lambda p: "OVERVIEW: about x\nQUESTIONS: what?; why?\nTAGS: a, b").collect()}
    assert by[2].summary == "about x" and by[2].hints == ["what?", "why?"] and by[3].tags == ["a", "b"]
    assert enhance.verify(t) == []
    with pytest.raises(ValueError):
        enhance.verify(t.limit(0))


def test_config(monkeypatch, tmp_path):
    from foliant.config import Config

    (tmp_path / "c.json").write_text('{"graph_edges": 5, "route_results": 3}')
    monkeypatch.setenv("FOLIANT_ROUTE_RESULTS", "7")
    c = Config.load(str(tmp_path / "c.json"), graph_keywords=9)
    assert (c.graph_edges, c.route_results, c.graph_keywords) == (5, 7, 9)
    for bad in ({"nope": 1}, {"graph_edges": 0}, {"overlap_threshold": 2.0}):
        with pytest.raises(ValueError):
            Config.load(None, **bad)
