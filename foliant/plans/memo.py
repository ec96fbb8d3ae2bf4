"""What stands between callers and a language model: a memo of answers, a throttle, a chain of models, a pool of two."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Sequence

from .llm import Model


class MemoStore:
    """Answers by key, the least lately used dropped beyond ``size``, and all after ``ttl`` seconds."""

    def __init__(self, size: int = 10_000, ttl: float = 7 * 86400, clock: Callable[[], float] = time.time):
        self.size, self.ttl, self.clock, self.hits, self.misses = size, ttl, clock, 0, 0
        self._held: OrderedDict[str, tuple[float, str, str]] = OrderedDict()

    @staticmethod
    def key(*parts: str) -> str:
        return hashlib.sha256("".join(f"{len(p.encode())}:{p}" for p in parts).encode()).hexdigest()

    def get(self, key: str) -> str | None:
        held = self._held.get(key)
        if held is None or self.clock() - held[0] > self.ttl:
            self._held.pop(key, None)
            self.misses += 1
            return None
        self._held.move_to_end(key)
        self.hits += 1
        return held[2]

    def put(self, key: str, value: str, label: str = "") -> None:
        self._held[key] = (self.clock(), label, value)
        self._held.move_to_end(key)
        while len(self._held) > self.size:
            self._held.popitem(last=False)

    def invalidate(self, label: str) -> int:
        """Drops what was stored under a label (a model, a document) and says how much."""
        gone = [k for k, v in self._held.items() if v[1] == label]
        for k in gone:
            del self._held[k]
        return len(gone)

    def prune(self) -> int:
        gone = [k for k, v in self._held.items() if self.clock() - v[0] > self.ttl]
        for k in gone:
            del self._held[k]
        return len(gone)

    def __len__(self) -> int:
        return len(self._held)

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump([[k, *v] for k, v in self._held.items()], f)

    def load(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            for k, t, label, value in json.load(f):
                self._held[k] = (t, label, value)
        self.prune()


class Throttle:
    """At most ``concurrent`` calls at a time and ``per_minute`` starts in any minute."""

    def __init__(self, concurrent: int = 10, per_minute: int = 500, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self._slots, self._lock, self._starts = threading.Semaphore(concurrent), threading.Lock(), deque()
        self.per_minute, self.clock, self.sleep = per_minute, clock, sleep

    def __enter__(self) -> Throttle:
        self._slots.acquire()
        while True:
            with self._lock:
                now = self.clock()
                while self._starts and now - self._starts[0] >= 60:
                    self._starts.popleft()
                if len(self._starts) < self.per_minute:
                    self._starts.append(now)
                    return self
                wait = 60 - (now - self._starts[0])
            self.sleep(wait)

    def __exit__(self, *_) -> None:
        self._slots.release()


class GuardedModel:
    """Models in order of preference behind a memo and a throttle: each is tried with growing pauses, then the next, within ``attempts`` in all."""

    def __init__(self, models: Sequence[Model], memo: MemoStore | None = None, throttle: Throttle | None = None, retries: int = 3, attempts: int = 20, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep, label: str = ""):
        self.models, self.memo, self.throttle = list(models), memo or MemoStore(), throttle or Throttle()
        self.retries, self.attempts, self.pause, self.sleep, self.label = retries, attempts, pause, sleep, label
        self.calls = self.failures = 0

    def complete(self, prompt: str) -> str:
        key = MemoStore.key(self.label, prompt)
        if (held := self.memo.get(key)) is not None:
            return held
        last: Exception = RuntimeError("no language model is configured")
        made = 0
        for model in self.models:
            for again in range(self.retries):
                if made == self.attempts:
                    raise last
                made += 1
                self.calls += 1
                try:
                    with self.throttle:
                        answer = model.complete(prompt)
                except Exception as e:
                    self.failures += 1
                    last = e
                    if again + 1 < self.retries:
                        self.sleep(self.pause * 2**again)
                    continue
                self.memo.put(key, answer, self.label)
                return answer
        raise last


class ModelPool:
    """One slot for compiling and one for asking, behind the same throttle and memo."""

    def __init__(self, compiling: Sequence[Model], asking: Sequence[Model] | None = None, **options):
        memo, throttle = options.pop("memo", None) or MemoStore(), options.pop("throttle", None) or Throttle()
        self.compiling = GuardedModel(compiling, memo, throttle, label="compiling", **options)
        self.asking = GuardedModel(asking or compiling, memo, throttle, label="asking", **options)
