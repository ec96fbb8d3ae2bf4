"""Hot nodes over a stream of hits: counts and means kept up as hits arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indexes import hot_nodes


def hot_nodes_stream(hits: DataFrame, threshold: int = 3) -> DataFrame:
    """Hits (node_id, score) of a stream; write with output mode "update" or "complete"."""
    return hot_nodes(hits, threshold)


def windowed_hits(hits: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Hits (ts, node_id, score) per tumbling window, late rows waited for."""
    return hits.withWatermark("ts", late).groupBy(F.window("ts", every), "node_id").agg(F.count("*").alias("hit_count"), F.avg("score").alias("avg_score"))
