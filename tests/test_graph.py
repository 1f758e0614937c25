import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from itinera.operators import graph as GR
from itinera.operators import network as NW


def random_edges(rng, n, m):
    out = {}
    while len(out) < m:
        a, b = rng.sample(range(n), 2)
        out[(min(a, b), max(a, b))] = (rng.randint(1, 30), rng.choice(["TGV", "TER"]))
    return out


@pytest.fixture(scope="module")
def net(spark):
    """A hub that touches a third of all edges, a random core and two lonely nodes."""
    rng = random.Random(5)
    pairs = random_edges(rng, 40, 60)
    pairs.update({(0, k): (rng.randint(1, 90), "TRAIN") for k in range(1, 40)})
    stations = spark.createDataFrame(
        [(f"{k:02d}", f"S{k}", f"s{k}", f"C{k % 7}", f"c{k % 7}", 40.0 + k / 10, 1.0 + k / 10, None, k) for k in range(42)],
        "uic_code string, station_name string, station_name_normalized string, city_name string, "
        "city_name_normalized string, latitude double, longitude double, segment_drg string, seq bigint")
    rows = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", m, c) for (a, b), (m, c) in pairs.items()],
                                 "origin_uic string, destination_uic string, duration_minutes int, line_code string")
    network = NW.build_network(stations, rows)
    return NW.Network(*[t.cache() for t in network]), pairs


def dijkstra(edges, source):
    """Labels (cost, hops, path, minutes) in the tie order of the operator."""
    graph = {}
    for a, b, minutes, cost in edges:
        graph.setdefault(a, []).append((b, minutes, cost))
    best, heap = {}, [(0, 0, [source], 0)]
    while heap:
        cost, hops, path, minutes = heapq.heappop(heap)
        if path[-1] in best:
            continue
        best[path[-1]] = (cost, hops, path, minutes)
        for b, m, c in graph.get(path[-1], []):
            if b not in best:
                heapq.heappush(heap, (cost + c, hops + 1, [*path, b], minutes + m))
    return best


@pytest.mark.parametrize("hub_degree", [1_000_000, 4])
def test_shortest_paths_match_dijkstra(spark, net, hub_degree):
    network, _ = net
    edges = [(r["src"], r["dst"], r["minutes"], int(r["cost"] * 1000)) for r in network.edges.collect()]
    asked = [(f"{a:02d}", f"{b:02d}") for a in (0, 3, 17, 40) for b in (0, 3, 9, 25, 38, 41)] + [("99", "00")]
    out = GR.shortest_paths(network.nodes, network.edges,
                            spark.createDataFrame(asked, "origin_uic string, destination_uic string"), hub_degree).collect()
    assert len(out) == len(set(asked))
    for r in out:
        want = dijkstra(edges, r["origin_uic"]).get(r["destination_uic"])
        if r["origin_uic"] == "99":
            assert r["error"] == "InvalidStationError"
        elif want is None:
            assert r["error"] == "NoPathError" and r["path"] is None
        else:
            assert (int(r["cost"] * 1000), r["hops"], r["path"], r["minutes"]) == want and r["error"] is None


@pytest.mark.parametrize("hub_degree, hot_labels", [(1_000_000, 100_000), (4, 100_000), (4, 1)])
def test_components(spark, net, hub_degree, hot_labels, monkeypatch):
    monkeypatch.setattr(GR, "HOT_LABELS", hot_labels)
    rng = random.Random(11)
    links = [(f"n{rng.randint(0, 120):03d}", f"n{rng.randint(0, 120):03d}") for _ in range(70)]
    links += [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)] + [("c000", f"c{k:03d}") for k in range(50, 80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    nodes = spark.createDataFrame([(n,) for n in [*parent, "lonely"]], "node string")
    edges = spark.createDataFrame(links, "src string, dst string")
    parts = GR.connected_components(nodes, edges, hub_degree)
    got = {r["node"]: r["component"] for r in parts.collect()}
    assert got == {**{n: find(n) for n in parent}, "lonely": "lonely"}
    row = GR.component_summary(parts).first()
    assert row["components"] == len(set(got.values())) and row["nodes"] == len(got) and not row["is_connected"]


def test_diameter_and_degrees(spark, net):
    network, pairs = net
    linked = network.edges.select(F.col("src").alias("node")).distinct()
    row = GR.hop_diameter(linked, network.edges, hub_degree=4).first()
    assert (row["is_connected"], row["diameter"]) == (True, 2)
    everyone = network.nodes.select(F.col("uic").alias("node"))
    assert GR.hop_diameter(everyone, network.edges).first()["diameter"] is None
    stats = GR.degree_stats(network.nodes, network.edges).first()
    assert (stats["nodes"], stats["edges"], stats["orphans"], stats["max_degree"]) == (42, len(pairs), 2, 39)
    assert GR.top_connected(network.nodes, network.edges, 1).first()["uic"] == "00"
    both = network.edges.select("src", "dst")
    assert both.exceptAll(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).isEmpty()


def test_diameter_bounds_match_all_searches(spark):
    """A core with long tails: few searches settle what a search from every node says; one directed edge."""
    rng = random.Random(1)
    links = {(rng.randrange(30), rng.randrange(30)) for _ in range(90)} | {(k, k + 1) for k in range(29)}
    links |= {(100 + k if k else 0, 101 + k) for k in range(6)} | {(200 + k if k else 7, 201 + k) for k in range(4)}
    links |= {(k, 300 + k) for k in range(25)}
    links = {(a, b) for a, b in links if a != b}
    both = links | {(b, a) for a, b in links}
    for edges in (both, both - {(106, 105)}):
        near = {}
        for a, b in edges:
            near.setdefault(a, []).append(b)
        nodes, far, connected = {x for e in edges for x in e}, 0, True
        for start in nodes:
            hops, queue = {start: 0}, [start]
            for x in queue:
                for y in near.get(x, []):
                    if y not in hops:
                        hops[y] = hops[x] + 1
                        queue.append(y)
            connected, far = connected and len(hops) == len(nodes), max(far, *hops.values())
        ids = spark.createDataFrame([(str(n),) for n in nodes], "node string")
        rows = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
        row = GR.hop_diameter(ids, rows, first_searches=6).first()
        assert (row["is_connected"], row["diameter"]) == (connected, far if connected else None)
        assert row["searches"] <= len(nodes) / 2


def test_shortest_paths_of_a_long_chain(spark, monkeypatch):
    """Many rounds merge their tables, and ties are broken by hops, then by path."""
    monkeypatch.setattr(GR._Rounds, "MOST", 3)
    rows = [(f"{k:02d}", f"{k + 1:02d}", 2) for k in range(14)] + [("00", "x", 1), ("x", "01", 1), ("00", "b", 1), ("b", "z", 1), ("00", "a", 1), ("a", "z", 1)]
    edges = spark.createDataFrame(rows, "src string, dst string, minutes int").withColumn("cost", F.col("minutes").cast("decimal(18,3)"))
    nodes = spark.createDataFrame([(n,) for n in {x for a, b, _ in rows for x in (a, b)}], "uic string")
    asked = spark.createDataFrame([("00", "14"), ("00", "z"), ("05", "00"), ("07", "07")], "origin_uic string, destination_uic string")
    out = {(r["origin_uic"], r["destination_uic"]): r for r in GR.shortest_paths(nodes, edges, asked).collect()}
    assert out["00", "14"]["path"] == [f"{k:02d}" for k in range(15)] and out["00", "14"]["hops"] == 14 and out["00", "14"]["minutes"] == 28
    assert out["00", "z"]["path"] == ["00", "a", "z"] and out["05", "00"]["error"] == "NoPathError" and out["07", "07"]["path"] == ["07"]
    assert GR.shortest_paths(nodes, edges, asked.limit(0)).count() == 0


def test_given_routes_and_details(spark, net):
    network, pairs = net
    routes = spark.createDataFrame([("a", ["00", "05", "00"]), ("b", ["00"]), ("c", ["00", "77"]), ("d", ["40", "41"]), ("e", [])],
                                   "id string, path array<string>")
    out = {r["id"]: (r["total_minutes"], r["error"]) for r in GR.given_route_time(routes, network.nodes, network.edges, "id").collect()}
    assert out == {"a": (2 * pairs[(0, 5)][0], None), "b": (None, "too_short"), "c": (None, "unknown_station"),
                   "d": (None, "missing_edge"), "e": (None, "too_short")}
    legs = GR.route_segments(routes.filter("id = 'a'"), network.nodes, network.edges, ["id"]).orderBy("seq").collect()
    assert [(r["from_name"], r["to_name"], r["duration"]) for r in legs] == \
        [("S0", "S5", pairs[(0, 5)][0]), ("S5", "S0", pairs[(0, 5)][0])]


def test_records_and_coordinates(spark, net):
    network, _ = net
    paths = GR.shortest_paths(network.nodes, network.edges, spark.createDataFrame(
        [("03", "03"), ("00", "01"), ("40", "00"), ("x", "00")], "origin_uic string, destination_uic string"))
    out = {r["origin_uic"]: r for r in GR.route_records(paths, network.nodes).collect()}
    assert out["03"]["stations"] == ["S3"] and out["03"]["total_time"] == 0 and out["03"]["num_stops"] == 0
    assert not out["40"]["success"] and "No path between S40 and S0" in out["40"]["error"] and "not found" in out["x"]["error"]
    places = network.nodes.withColumn("seq", F.monotonically_increasing_id())
    routes = spark.createDataFrame([("r", ["s3", "C5", "nowhere"])], "id string, stations array<string>")
    rows = GR.route_coordinates(routes, places, ["id"]).orderBy("seq").collect()
    assert rows[0]["latitude"] == pytest.approx(40.3) and rows[1]["latitude"] is not None and rows[2]["latitude"] is None
    near = GR.neighbours(network.nodes, network.edges, spark.createDataFrame([("00",)], "uic string"))
    assert near.count() == 39


def test_network_build(spark):
    stations = spark.createDataFrame(
        [("1;9", "A", "a", "X", "x", 48.0, 2.0, None, 0), ("2", "B", "b", "X", "x", None, None, None, 1), ("3", "C", "c", "Y", "y", 48.1, 2.1, None, 2)],
        "uic_code string, station_name string, station_name_normalized string, city_name string, city_name_normalized string, "
        "latitude double, longitude double, segment_drg string, seq bigint")
    rows = spark.createDataFrame([("9", "2", 30, "TER"), ("2", "1", 20, "TGV"), ("1", "7", 5, "TGV"), ("3", "3", 5, "TGV")],
                                 "origin_uic string, destination_uic string, duration_minutes int, line_code string")
    groups = spark.createDataFrame([("X", "1", 0, 15), ("X", "2", 1, 15), ("X", "3", 2, 15), ("X", "8", 3, 15)],
                                   "city string, uic string, seq bigint, minutes int")
    network = NW.build_network(stations, rows, groups)
    got = sorted((r["src"], r["dst"], r["minutes"], r["line_code"], float(r["cost"])) for r in network.edges.collect())
    assert got == [("1", "2", 20, "TGV", 25.0), ("1", "3", 15, "CORRESP", 30.0), ("2", "1", 20, "TGV", 25.0),
                   ("2", "3", 15, "CORRESP", 30.0), ("3", "1", 15, "CORRESP", 30.0), ("3", "2", 15, "CORRESP", 30.0)]
    small = NW.build_network(stations, rows, subset=["1", "2"])
    assert small.nodes.count() == 2 and small.edges.count() == 2
    quality = {r["metric"]: r["value"] for r in NW.network_quality(
        network, GR.connected_components(network.nodes.select(F.col("uic").alias("node")), network.edges)).collect()}
    assert quality["components"] == 1 and quality["one_way_edges"] == 0 and quality["with_coordinates"] == 2


def test_timetable_hot_trip(spark):
    """A trip far above the group limit gives the same segments."""
    rows = [("hot", f"{(8 + i // 60) % 30:02d}:{i % 60:02d}:00", f"X-{87000000 + i % 50}", i) for i in range(600)]
    rows += [(f"t{j}", f"{10 + i}:00:00", f"X-{87000000 + (i * j) % 9}", i) for j in range(60) for i in range(5)]
    times = spark.createDataFrame(rows, "trip_id string, departure_time string, stop_id string, stop_sequence int")
    plain = sorted(map(tuple, NW.stop_segments(times).collect()))
    assert sorted(map(tuple, NW.stop_segments(times, group_limit=50).collect())) == plain and len(plain) > 500


def test_nearest_station_brute_force(spark):
    rng = random.Random(2)
    sites = [(f"s{i}", rng.uniform(-60, 60), rng.uniform(-20, 20)) for i in range(150)]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-20, 20)) for i in range(150)]
    s = spark.createDataFrame(sites, "uic string, latitude double, longitude double")
    p = spark.createDataFrame(points, "point_id int, lat double, lon double")
    from itinera.functions.transport import haversine_km
    got = {r["point_id"]: r["uic"] for r in NW.nearest_station(p, s, 300.0).collect()}
    far = p.crossJoin(s).withColumn("km", haversine_km("lon", "lat", "longitude", "latitude")).filter("km <= 300")
    want = {r["point_id"]: r["u"] for r in far.groupBy("point_id").agg(F.min_by("uic", "km").alias("u")).collect()}
    assert got == want and want


@pytest.mark.parametrize("radius, levels", [(400.0, 1), (400.0, 3), (3000.0, 4), (30000.0, 2)])
def test_nearest_station_on_the_whole_sphere(spark, radius, levels):
    from itinera.functions.transport import haversine_km

    rng = random.Random(8)
    anywhere = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    places = [(90.0, 0.0), (-90.0, 50.0), (89.9, 170.0), (89.9, -10.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.9), (10.0, -179.9), (-60.0, -179.99)]
    dense = [(45 + rng.uniform(0, 0.5), 5 + rng.uniform(0, 0.5)) for _ in range(60)]  # a third of all in one cell
    sites = [(f"s{i:03}", *at) for i, at in enumerate([*places[1::2], *dense, *[anywhere() for _ in range(120)], (1.0, 1.0), (1.0, 1.0)])]
    points = [(i, *at) for i, at in enumerate([*places, *dense[::2], (45.2, 5.6), *[anywhere() for _ in range(120)], (1.0, 1.1)])]
    s = spark.createDataFrame([*sites, ("none", None, 3.0)], "uic string, latitude double, longitude double")
    p = spark.createDataFrame([*points, (999, 4.0, None)], "point_id int, lat double, lon double")
    got = {r["point_id"]: r["uic"] for r in NW.nearest_station(p, s, radius, levels).collect()}
    near = p.dropna().crossJoin(s.dropna()).withColumn("km", haversine_km("lon", "lat", "longitude", "latitude")).filter(F.col("km") <= radius)
    want = {r["point_id"]: r["b"]["uic"] for r in near.groupBy("point_id").agg(F.min(F.struct("km", "uic")).alias("b")).collect()}
    assert got == want and len(want) > 30
    assert NW.nearest_station(p.limit(0), s, radius, levels).isEmpty() and NW.nearest_station(p, s.limit(0), radius, levels).isEmpty()
