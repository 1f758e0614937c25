import random

from pyspark.sql import functions as F

from itinera.operators import graph as GR
from itinera.plans.tables import TableStore


def test_equal_numbers_are_drawn_again(spark, monkeypatch):
    """With the first seed all nodes have one number."""
    seen = []
    number = GR._node_number
    monkeypatch.setattr(GR, "_node_number", lambda node, seed: seen.append(seed) or (node * 0 if not seed else number(node, seed)))
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "node bigint")
    edges = spark.createDataFrame([(2, 1), (3, 4), (4, 4), (None, 9)], "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in GR.connected_components(nodes, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9} and max(seen) == 1


def test_edges_shrink_with_each_round(spark, monkeypatch):
    """A chain and a star: a round writes far fewer edges than the one before, and few rows of labels in all."""
    written = []
    write = TableStore.write
    monkeypatch.setattr(TableStore, "write", lambda self, df, name, **counters: written.append(
        (name, (out := write(self, df, name, **counters))[0].count())) or out)
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(400)]
    star = [("hub", f"leaf{i}") for i in range(300)]
    random.Random(1).shuffle(chain)
    edges = spark.createDataFrame(chain + star, "src string, dst string")
    parts = GR.connected_components(edges.select(F.col("src").alias("node")), edges)
    assert {(r["component"], r["count"]) for r in parts.groupBy("component").count().collect()} == {("n000", 401), ("hub", 301)}
    sizes = [n for name, n in written if name.startswith("edges-")]
    assert sizes[0] == 700 and sizes[4] < 150 and sum(sizes) < 3 * 700
