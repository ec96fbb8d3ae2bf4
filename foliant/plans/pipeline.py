"""Passes over trees in order of what they depend on, with a policy for failures."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Stage:
    name: str
    run: Callable[[dict[str, Any]], None]
    after: tuple[str, ...] = ()
    priority: int = 100
    optional: bool = False
    retries: int = 0
    pause: float = 0.0


@dataclass
class Pipeline:
    """Stages change a context of DataFrames; Catalyst plans what they declare when a result is asked for."""

    stages: dict[str, Stage] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)
    on_event: Callable[[str, str], None] | None = None

    def stage(self, name: str, run: Callable, after: tuple[str, ...] = (), priority: int = 100, optional: bool = False, retries: int = 0, pause: float = 0.0) -> Pipeline:
        """Adds a stage: a failing one is tried again ``retries`` times after growing pauses, then skipped if optional."""
        self.stages[name] = Stage(name, run, after, priority, optional, retries, pause)
        return self

    def has_stage(self, name: str) -> bool:
        return name in self.stages

    def stage_names(self) -> list[str]:
        return list(self.stages)

    def remove_stage(self, name: str) -> Pipeline:
        self.stages.pop(name, None)
        return self

    def groups(self) -> list[list[str]]:
        """Stages level by level; within a level by priority and name."""
        left, done, out = dict(self.stages), set(), []
        for s in left.values():
            if missing := [a for a in s.after if a not in self.stages]:
                raise ValueError(f"{s.name} needs {', '.join(missing)}")
        while left:
            ready = sorted((s for s in left.values() if set(s.after) <= done), key=lambda s: (s.priority, s.name))
            if not ready:
                raise ValueError(f"a cycle among {', '.join(sorted(left))}")
            out.append([s.name for s in ready])
            done |= {s.name for s in ready}
            left = {k: v for k, v in left.items() if k not in done}
        return out

    def order(self) -> list[str]:
        return [n for g in self.groups() for n in g]

    def run(self, context: dict[str, Any]) -> dict[str, Any]:
        for name in self.order():
            s, began = self.stages[name], time.time()
            for left in range(s.retries, -1, -1):
                try:
                    s.run(context)
                    break
                except Exception as e:
                    if left:
                        time.sleep(s.pause * 2 ** (s.retries - left))
                        continue
                    if not s.optional:
                        raise
                    self.skipped[name] = str(e)
            self.seconds[name] = time.time() - began
            if self.on_event:
                self.on_event(name, "skipped" if name in self.skipped else "done")
        return context
