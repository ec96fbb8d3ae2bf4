"""Stages' results kept as tables, so that a pipeline that stopped goes on where it was."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .storage import TableStore


class Checkpoints:
    """Tables named by the logic they come from and their stage; another logic's count for nothing."""

    def __init__(self, spark: SparkSession, folder: str, logic: str):
        self.store, self.logic = TableStore(spark, folder, buckets=8), logic

    def _name(self, stage: str) -> str:
        return f"{self.logic[:16]}-{stage}"

    def save(self, stage: str, df: DataFrame) -> DataFrame:
        self.store.write(self._name(stage), df, df.columns[0])
        return self.load(stage)

    def valid(self, stage: str) -> bool:
        return self.store.exists(self._name(stage))

    def load(self, stage: str) -> DataFrame:
        return self.store.read(self._name(stage))

    def stages(self) -> list[str]:
        own = self._name("")
        return [n.removeprefix(own) for n in self.store.names() if n.startswith(own)]

    def clear(self) -> None:
        for s in self.stages():
            self.store.delete(self._name(s))

    def around(self, key: str, make) -> Any:
        """A stage's function that loads what is kept of ``key`` and else makes and keeps it."""

        def run(context: dict[str, Any]) -> None:
            context[key] = self.load(key) if self.valid(key) else self.save(key, make(context))

        return run
