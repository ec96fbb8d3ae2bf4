"""The language-model seam: a small protocol, and rules that stand in for a model so that results repeat."""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Any, Protocol

from ..functions.text import query_keywords

INTENTS = ("factual", "analytical", "navigational", "comparative", "summary", "procedural")


@dataclass
class QueryAnalysis:
    original: str
    intent: str = "factual"
    complexity: str = "simple"
    strategy: str = "focused"
    keywords: list[str] = field(default_factory=list)
    rewritten: list[str] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)


class Model(Protocol):
    def complete(self, prompt: str) -> str: ...


class RuleModel:
    """No model: every call fails, so callers take their rules."""

    def complete(self, prompt: str) -> str:
        raise RuntimeError("no language model is configured")


class CachedModel:
    """Another model behind a cache of the last answers, with retries."""

    def __init__(self, model: Model, size: int = 1000, retries: int = 3):
        self.model, self.size, self.retries, self.hits, self.calls = model, size, retries, 0, 0
        self._answers: OrderedDict[str, str] = OrderedDict()

    def complete(self, prompt: str) -> str:
        key = hashlib.sha256(prompt.encode()).hexdigest()
        if key in self._answers:
            self.hits += 1
            self._answers.move_to_end(key)
            return self._answers[key]
        for left in range(self.retries, 0, -1):
            self.calls += 1
            try:
                answer = self.model.complete(prompt)
                break
            except Exception:
                if left == 1:
                    raise
        self._answers[key] = answer
        if len(self._answers) > self.size:
            self._answers.popitem(last=False)
        return answer


def extract_json(text: str) -> Any:
    """The JSON in a model's answer: a fenced block, else the first balanced braces, else the whole."""
    for block in re.findall(r"```(?:json)?\s*\n(.*?)```", text, re.DOTALL):
        try:
            return json.loads(block)
        except ValueError:
            continue
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return json.loads(text)


def rule_analysis(query: str) -> QueryAnalysis:
    q = query.lower()
    # the first of these words that occurs decides
    hints = [("where", "navigational"), ("compare", "comparative"), ("versus", "comparative"), ("summar", "summary"), ("overview", "summary"), ("how to", "procedural"), ("steps", "procedural"), ("why", "analytical"), ("explain", "analytical")]
    intent = next((name for word, name in hints if word in q), "factual")
    keywords = query_keywords(query)
    size = "simple" if len(keywords) <= 4 else "moderate" if len(keywords) <= 8 else "complex"
    return QueryAnalysis(query, intent, size, "focused" if size == "simple" else "broad", keywords, [], re.findall(r"\b[A-Z][A-Za-z0-9]+\b", query))


def analyse(query: str, model: Model | None = None) -> QueryAnalysis:
    """A question's analysis by the model, with unknown values at their defaults; by rules without one."""
    rules = rule_analysis(query)
    if model is None:
        return rules
    try:
        got = extract_json(model.complete(f"Analyse the question and answer as JSON with intent, complexity, strategy, keywords, rewritten, entities: {query}"))
    except Exception:
        return rules
    pick = lambda k, allowed, default: got.get(k) if got.get(k) in allowed else default
    return QueryAnalysis(
        query, pick("intent", INTENTS, "factual"), pick("complexity", ("simple", "moderate", "complex"), "simple"), pick("strategy", ("focused", "broad", "exhaustive"), "focused"),
        list(got.get("keywords") or rules.keywords), list(got.get("rewritten") or []), list(got.get("entities") or []),
    )


def parse_dispatch(text: str, n_docs: int) -> list[dict] | None:
    """The documents to read and what for, from blocks "- doc: n"; None if the model says it's answered already."""
    if "ALREADY_ANSWERED" in text:
        return None
    out = []
    for block in re.split(r"(?m)^\s*-\s*doc:\s*", text)[1:]:
        m = re.match(r"(\d+)", block)
        if m and 1 <= int(m[1]) <= n_docs:
            out.append({"doc": int(m[1])} | {k: v.strip() for k, v in re.findall(r"(?m)^\s*(reason|task):\s*(.*)$", block)})
    return out
