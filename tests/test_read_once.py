"""Inputs that are dear to derive are derived once, however often a plan reads them."""

from pyspark.sql import functions as F

from itinera.operators import graph as GR
from itinera.operators.network import Network
from itinera.plans.resolution import resolve_orders


def counted(spark, column):
    """The column through a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return F.udf(same, "string").asNondeterministic()(column), calls


def line(spark):
    nodes = spark.createDataFrame([(u, f"Gare {u}") for u in "abc"], "uic string, station_name string")
    edges = spark.createDataFrame([("a", "b", 2.0, 2), ("b", "c", 3.0, 3)], "src string, dst string, cost double, minutes int") \
        .withColumns({"cost": F.col("cost").cast("decimal(18,3)"), "minutes": F.col("minutes").cast("bigint")})
    return Network(nodes, edges, spark.createDataFrame([], "uic string, main_uic string"))


def test_pairs_of_shortest_paths(spark):
    net = line(spark)
    pairs = spark.createDataFrame([("a", "c"), ("a", "b"), ("c", "a"), ("x", "a")], "origin_uic string, destination_uic string")
    origin, calls = counted(spark, F.col("origin_uic"))
    out = GR.shortest_paths(net.nodes, net.edges, pairs.withColumn("origin_uic", origin)).collect()
    assert {(r.origin_uic, r.destination_uic): (r.path, r.error) for r in out} == {
        ("a", "c"): (["a", "b", "c"], None), ("a", "b"): (["a", "b"], None), ("c", "a"): (None, "NoPathError"), ("x", "a"): (None, "InvalidStationError")}
    assert calls.value == 4


def test_orders_that_are_resolved(spark):
    net = line(spark)
    cities = spark.createDataFrame([("paris", "a", 1), ("lyon", "c", 2)], "city_norm string, uic string, seq bigint")
    orders = spark.createDataFrame([(1, "x", "Paris", "Lyon", True), (2, "y", "Lyon", "Paris", True), (3, "z", None, None, False)],
                                   "sentenceID bigint, sentence string, origin string, destination string, valid boolean")
    origin, calls = counted(spark, F.col("origin"))
    out = resolve_orders(orders.withColumn("origin", origin), cities, net, spark.createDataFrame([], "norm string"), "route").collect()
    assert {r.sentence_id: (r.path, r.error_type) for r in out} == {1: (["a", "b", "c"], None), 2: ([], "NoPathError"), 3: ([], None)}
    assert calls.value == 3
