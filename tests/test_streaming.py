from itinera.operators import graph as GR
from itinera.streaming.orders import batch_tables, first_seen, read_batches, resolve_batches, resolve_stream


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_resolve_stream(spark, gazetteer, tmp_path):
    spark.createDataFrame([(1, "Je vais de Paris à Lyon"), (2, "Bonjour"), (3, "De Nice à Paris")],
                          "sentenceID int, sentence string").write.parquet(str(tmp_path / "in"))
    nodes = spark.createDataFrame([("1",), ("2",)], "uic string")
    edges = spark.createDataFrame([("1", "2", 120)], "src string, dst string, minutes int").selectExpr(
        "src", "dst", "minutes", "cast(125 as decimal(18,3)) as cost")
    pairs = spark.createDataFrame([("1", "2")], "origin_uic string, destination_uic string")
    routes = GR.shortest_paths(nodes, edges, pairs)
    cities = spark.createDataFrame([("paris", "1", 0), ("lyon", "2", 1)], "city_norm string, uic string, seq bigint")
    source = spark.readStream.schema("sentenceID int, sentence string").parquet(str(tmp_path / "in"))
    out = {r["sentenceID"]: r for r in drain(resolve_stream(source, gazetteer, cities, routes), "k1").collect()}
    assert out[1]["path"] == ["1", "2"] and out[1]["total_time"] == 120 and out[1]["success"]
    assert not out[2]["valid"] and not out[3]["success"] and out[3]["origin"] == "Nice"


def test_resolve_batches_with_a_replay(spark, gazetteer, tmp_path):
    """A dictionary above the inline limit, two batches, and the last one handed over again."""
    for part in ([(1, "Je vais de Paris à Lyon"), (2, "Bonjour")], [(3, "De Nice à Paris"), (4, None)]):
        spark.createDataFrame(part, "sentenceID int, sentence string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    cities = spark.createDataFrame([("paris", "1", 0), ("lyon", "2", 1)], "city_norm string, uic string, seq bigint")
    routes = spark.createDataFrame([("1", "2", ["1", "2"], 120, None)],
                                   "origin_uic string, destination_uic string, path array<string>, minutes int, error string")
    source = spark.readStream.schema("sentenceID int, sentence string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink, seen = batch_tables(str(tmp_path / "out")), []

    def twice(rows, number):
        seen.append(number)
        sink(rows, number)
        sink(rows, number)

    for _ in range(2):  # the second start finds nothing new
        resolve_batches(source, gazetteer, cities, routes, twice, str(tmp_path / "progress"), inline_keys=1).awaitTermination()
    out = sorted((r["sentenceID"], r["origin"], r["destination"], r["total_time"]) for r in read_batches(source, str(tmp_path / "out")).collect())
    assert seen == [0, 1] and [r[0] for r in out] == [1, 2, 3, 4]
    assert out[0] == (1, "Paris", "Lyon", 120) and out[2] == (3, "Nice", "Paris", None)


def test_first_seen(spark, tmp_path):
    import datetime as dt
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    for i, part in enumerate([[("a", at(0)), ("a", at(1)), ("b", at(2))], [("a", at(3)), ("c", at(4))]]):
        spark.createDataFrame(part, "sentence string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("sentence string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = [r["sentence"] for r in drain(first_seen(source, ["sentence"], "ts"), "k2").collect()]
    assert sorted(got) == ["a", "b", "c"]
