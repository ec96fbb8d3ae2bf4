import pytest

from foliant.plans.engine import DocumentNotFoundError, Engine
from foliant.sources import readers


def test_engine_from_files_to_answers(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# Finance\nThe total revenue in the last year was four billion, as Section 2 says.\n\n## Costs\nThe costs of the company were mostly salaries and rent for its offices.\n\n# Outlook\nGrowth is expected in all regions of the world next year.")
    (tmp_path / "in" / "sub" / "b.MD").write_text("# Engines\nA tokio runtime drives all asynchronous tasks of the service in production.")
    (tmp_path / "in" / "bad.pdf").write_bytes(b"no pdf")
    e = Engine(spark, str(tmp_path / "ws"))
    assert e.compile(directory=str(tmp_path / "in")) == {"compiled": 2, "skipped": 0}
    assert e.compile(directory=str(tmp_path / "in")) == {"compiled": 0, "skipped": 2}
    cards = {r.sections: r.doc_id for r in e.list_documents().collect()}
    doc = cards["Finance|Outlook"]
    a = e.ask("What was the total revenue?")
    assert "four billion" in a.answer and a.confidence > 0.5
    with pytest.raises(DocumentNotFoundError):
        e.ask("anything", [12345])
    n = e.load_document(doc)
    assert [r.title for r in n.ls()] == ["Finance", "Outlook"]
    assert n.cd("finance") and n.pwd().endswith(" / Finance") and "revenue" in n.cat() and len(n.evidence) == 1
    assert n.cd("Costs") and n.cd_up() and n.cd_up() and not n.cd_up() and n.back()
    assert n.cd_id(1) and [r.node_id for r in n.search("costs salaries")][0] == 3
    assert n.find_section("outlook") == 4 and [r.node_id for r in n.find("growth")] == [4] and n.siblings() == []
    assert [r.line for r in n.grep("sal.ries")] and n.evidence_score(3) > 0 and n.toc()[0].title == "Finance"
    assert n.keyword_entries("costs")[0].node_id == 3 and n.head(1, 4).startswith("[Preview: Outlook")
    assert len(n.chains_for(2)) == 1
    e.get_graph().collect()
    assert e.remove(doc) and not e.exists(doc) and not e.remove(doc)
    with pytest.raises(DocumentNotFoundError):
        e.load_document(doc)


def test_sources(spark):
    with pytest.raises(ValueError):
        readers.source(spark)
    with pytest.raises(ValueError):
        readers.source(spark, content="a", path="b")
    with pytest.raises(ValueError):
        readers.source(spark, content="  ")
    assert readers.source(spark, content="# A\nx").first().title == "A"
    assert readers.source(spark, bytes_data=b"# B\ny").first().title == "B"
    assert [r.level for r in readers.source(spark, raw_nodes=[("t", "c"), ("u", "d", 2)]).collect()] == [1, 2]
    readers.register_parser("txt", lambda f: f.selectExpr("doc_id", "1 AS seq", "1 AS level", "path AS title", "text AS content"))
    assert readers.source(spark, content="z", format="txt").first().content == "z"
