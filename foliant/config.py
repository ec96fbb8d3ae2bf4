"""Settings: defaults, a JSON file, the environment (FOLIANT_…) and overrides, in rising precedence."""

from __future__ import annotations

import dataclasses
import json
import os
from typing import Any


@dataclasses.dataclass(frozen=True)
class Config:
    workspace: str = "foliant-workspace"
    max_keyword_entries: int = 5000
    max_topic_entries: int = 20
    overlap_threshold: float = 0.8
    max_tokens_per_node: int = 4000
    merge_below: int = 0
    summaries: str = "full"
    open_documents: int = 100
    graph_keywords: int = 50
    graph_edges: int = 20
    route_results: int = 15

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            if isinstance(v, (int, float)) and (v < 0 or v == 0 and f.name != "merge_below"):
                raise ValueError(f"{f.name} must be positive")
        if self.summaries not in ("full", "selective", "lazy", "none"):
            raise ValueError("summaries must be full, selective, lazy or none")
        if self.overlap_threshold > 1:
            raise ValueError("overlap_threshold must be at most 1")

    @staticmethod
    def load(path: str | None = None, **overrides: Any) -> Config:
        values: dict[str, Any] = {}
        if path:
            with open(path, encoding="utf-8") as f:
                values |= json.load(f)
        kinds = {f.name: type(f.default) for f in dataclasses.fields(Config)}
        values |= {k: os.environ[f"FOLIANT_{k.upper()}"] for k in kinds if f"FOLIANT_{k.upper()}" in os.environ}
        values |= overrides
        if unknown := set(values) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Config(**{k: kinds[k](v) for k, v in values.items()})

    def get(self, key: str) -> Any:
        return getattr(self, key)

    def with_value(self, key: str, text: str) -> Config:
        """The settings with one changed, its text read as the setting's kind."""
        kinds = {f.name: type(f.default) for f in dataclasses.fields(Config)}
        if key not in kinds:
            raise ValueError(f"unknown settings: {key}")
        return dataclasses.replace(self, **{key: kinds[key](text)})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(dataclasses.asdict(self), f, indent=2)
