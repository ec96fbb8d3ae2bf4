"""Command line: python -m foliant.cli [--workspace W] init | add PATH… | list | info ID | tree ID | remove ID | ask QUESTION | query TERMS | stats | config [KEY [VALUE]]"""

from __future__ import annotations

import argparse
import dataclasses
import os

from .config import Config
from .plans.render import answer_text, documents_text, tree_text


def size_text(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def main(args: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="foliant")
    p.add_argument("--workspace", default=Config.load().workspace)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("add").add_argument("paths", nargs="+")
    sub.add_parser("list")
    sub.add_parser("stats")
    sub.add_parser("init")
    for name in ("tree", "remove", "info"):
        sub.add_parser(name).add_argument("doc_id", type=int)
    q = sub.add_parser("ask")
    q.add_argument("question")
    q.add_argument("--json", action="store_true")
    sub.add_parser("query").add_argument("terms")
    c = sub.add_parser("config")
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    p.add_argument("--settings", default=None, help="a JSON file of settings")
    a = p.parse_args(args)

    config = Config.load(a.settings) if a.settings and os.path.exists(a.settings) else Config.load()
    if a.command == "config":
        if a.value is not None:
            config = config.with_value(a.key, a.value)
            config.save(a.settings or "foliant.json")
        shown = [a.key] if a.key else [f.name for f in dataclasses.fields(Config)]
        print("\n".join(f"{k} = {config.get(k)}" for k in shown))
        return 0
    if a.command == "init":
        config.with_value("workspace", a.workspace).save(a.settings or "foliant.json")
        print(f"workspace {a.workspace}")
        return 0

    from pyspark.sql import SparkSession

    from .plans.engine import Engine

    e = Engine(spark or SparkSession.builder.getOrCreate(), a.workspace, config=config)
    if a.command == "add":
        print(e.compile(paths=a.paths))
    elif a.command == "list":
        print(documents_text(e.list_documents().orderBy("doc_id").toLocalIterator()))
    elif a.command == "tree":
        print(tree_text(e.load_document(a.doc_id).toc()))
    elif a.command == "info":
        print(e.load_document(a.doc_id).info())
    elif a.command == "query":
        from pyspark.sql import functions as F

        from .functions.text import query_search_terms
        from .operators.search import search_nodes

        hits = search_nodes(e.table("nodes"), query_search_terms(a.terms), 5).join(e.table("nodes").select("doc_id", "node_id", "title"), ["doc_id", "node_id"])
        for r in hits.orderBy(F.desc("score"), "doc_id", "node_id").limit(20).collect():
            print(f"{r.doc_id}\t{r.node_id}\t{r.score:.3f}\t{r.title}")
    elif a.command == "remove":
        print("removed" if e.remove(a.doc_id) else "not found")
    elif a.command == "ask":
        print(answer_text(e.ask(a.question), a.json))
    else:
        print({"documents": e.store.rows("catalog"), "nodes": e.store.rows("nodes"), "size": size_text(e.store.size())})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
