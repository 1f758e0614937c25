"""Edge expansion that spreads the neighbours of hub nodes over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itinera.plans.tables import TableStore

HUB_DEGREE = 1_000_000


class Adjacency:
    """Directed edges keyed by (src, lane).

    A node with more than ``hub_degree`` edges gets several lanes; its edges are
    spread over them by the other end, and a row that expands the node is copied
    once per lane. Every other node has lane 0 only, so nothing is copied for it.
    The number of hubs is at most edges / ``hub_degree``.
    """

    def __init__(self, edges: DataFrame, store: TableStore, hub_degree: int = HUB_DEGREE):
        degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")) \
            .filter(F.col("n") > hub_degree) \
            .select("src", F.ceil(F.col("n") / hub_degree).cast("int").alias("lanes"))
        hubs, seen = store.write(degrees, "hubs", n=F.count(F.lit(1)))
        self.hubs = hubs if seen["n"] else None
        if self.hubs is None:
            keyed = edges.withColumn("lane", F.lit(0))
        else:
            lane = F.pmod(F.xxhash64("dst"), F.coalesce("lanes", F.lit(1))).cast("int")
            keyed = edges.join(self.hubs, "src", "left").withColumn("lane", lane).drop("lanes")
        self.edges, _ = store.write(keyed, "edges")

    def expand(self, rows: DataFrame, node: str = "node") -> DataFrame:
        """``rows`` joined with the edges that leave their node (adds dst and edge columns)."""
        if self.hubs is None:
            rows = rows.withColumn("lane", F.lit(0))
        else:
            hubs = self.hubs.withColumnRenamed("src", node)
            rows = rows.join(hubs, node, "left").withColumn(
                "lane", F.explode(F.sequence(F.lit(0), F.coalesce("lanes", F.lit(1)) - 1))).drop("lanes")
        return rows.join(self.edges.withColumnRenamed("src", node), [node, "lane"]).drop("lane")
