"""Network queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.functions import transport as X
from itinera.plans.adjacency import HUB_DEGREE, Adjacency
from itinera.plans.ranking import next_in_group
from itinera.plans.tables import TableStore


# ------------------------------------------------------------ lookups and degrees

def station_info(nodes: DataFrame, codes: DataFrame) -> DataFrame:
    """Node attributes of the given codes (uic); unknown codes keep nulls."""
    return codes.join(nodes, "uic", "left")


def neighbours(nodes: DataFrame, edges: DataFrame, codes: DataFrame) -> DataFrame:
    """(uic, neighbour, station_name, minutes); order by (uic, minutes, neighbour) to read."""
    near = edges.select(F.col("src").alias("uic"), F.col("dst").alias("neighbour"), "minutes")
    names = nodes.select(F.col("uic").alias("neighbour"), "station_name")
    return (codes.select("uic").distinct().join(near, "uic").join(names, "neighbour", "left")
            .select("uic", "neighbour", "station_name", "minutes"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node, 0 for orphans: (uic, degree)."""
    counts = edges.groupBy(F.col("src").alias("uic")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("uic").join(counts, "uic", "left") \
        .select("uic", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, undirected edges, average / least / largest degree, orphans (one row)."""
    return degrees(nodes, edges).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.floor(F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("bigint").alias("edges"),
        F.avg("degree").alias("avg_degree"), F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("orphans"))


def top_connected(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """the k nodes with most neighbours, code breaking ties."""
    return (degrees(nodes, edges).join(nodes.select("uic", "station_name"), "uic")
            .orderBy(F.desc("degree"), "uic").limit(k))


# ------------------------------------------------------------------ J7: components

HOT_LABELS = 100_000


def _looked_up(rows: DataFrame, table: DataFrame, key: str, store: TableStore, name: str, hub_degree: int) -> DataFrame:
    """``rows`` joined with ``table``, unique by ``key``; hot keys by broadcast while they are few."""
    used = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known, seen = store.write(used.join(table, key), name, hot=F.count_if(F.col("_n") > hub_degree))
    if not 0 < seen["hot"] <= HOT_LABELS:
        return rows.join(known.drop("_n"), key)
    hot, rest = (known.filter(which).drop("_n") for which in (F.col("_n") > hub_degree, F.col("_n") <= hub_degree))
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def _node_number(node: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), node)


def _turned(number: Column, turn: int) -> Column:
    """The bits of a number moved round by ``turn`` places: another order of the same numbers, and -turn is the way back."""
    turn %= 64
    return number if not turn else F.shiftleft(number, turn).bitwiseOR(F.shiftrightunsigned(number, 64 - turn))


def connected_components(nodes: DataFrame, edges: DataFrame, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """(node, component), the component being its smallest node.

    Nodes are numbered by a hash, which is checked to be unique and drawn again
    if it is not. Every round each node moves to the first of itself and its
    neighbours, in an order of its own, and edges are rewritten between the
    nodes moved to; that about halves the nodes that have edges (Bogeholz et
    al., "In-database connected component analysis", 2020), so later rounds cost
    a fraction of the first. At the end the moves are followed back from the
    last round to the first. Labels of normal size are looked up in a shuffle
    join, the few that cover more than ``hub_degree`` nodes by broadcast, so a
    component of any size is spread over all tasks. Beyond ``HOT_LABELS`` of
    them, each is a small share of the nodes and the shuffle join takes them too.
    """
    store = TableStore(nodes.sparkSession, "components")
    linked = edges.filter(F.col("src") != F.col("dst"))
    ids, _ = store.write(nodes.select("node").unionByName(linked.select(F.explode(F.array("src", "dst")).alias("node")))
                         .filter(F.col("node").isNotNull()).distinct(), "nodes")
    seed = 0
    while not ids.groupBy(_node_number(F.col("node"), seed)).count().filter("count > 1").isEmpty():
        seed += 1
    left, seen = store.write(linked.select(_node_number(F.col("src"), seed).alias("a"), _node_number(F.col("dst"), seed).alias("b")),
                             "edges-0", n=F.count(F.lit(1)))
    moves = []
    while seen["n"]:
        turn = 13 * len(moves)
        near = lambda n, o: F.struct(F.col(n).alias("node"), _turned(F.col(o), turn).alias("o"))  # noqa: B023, E731
        first = left.select(F.inline(F.array(near("a", "b"), near("b", "a")))).groupBy("node").agg(F.min("o").alias("o"))
        moved, _ = store.write(first.select("node", _turned(F.least("o", _turned(F.col("node"), turn)), -turn).alias("to")),
                               f"moves-{len(moves)}")
        ends = (left.join(moved.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
                .join(moved.select(F.col("node").alias("b"), F.col("to").alias("y")), "b"))
        moves.append(moved)
        left, seen = store.write(ends.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                                 f"edges-{len(moves)}", n=F.count(F.lit(1)))
        store.drop(f"edges-{len(moves) - 1}")
    roots = None
    for k, moved in reversed(list(enumerate(moves))):
        if roots is not None:
            # a node moved to in the last place of its edges has no later move
            moved = moved.join(roots.select(F.col("node").alias("to"), F.col("to").alias("last")), "to", "left") \
                .select("node", F.coalesce("last", "to").alias("to"))
        roots, _ = store.write(moved, f"roots-{k}")
    numbered = ids.withColumn("_id", _node_number(F.col("node"), seed))
    if roots is None:
        labels = numbered.withColumn("root", F.col("_id"))
    else:
        labels = numbered.join(roots.select(F.col("node").alias("_id"), "to"), "_id", "left") \
            .withColumn("root", F.coalesce("to", "_id"))
    labels, seen = store.write(labels.select("node", "root"), "labels", n=F.count(F.lit(1)))
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    named = labels.join(least, "root") if seen["n"] <= hub_degree \
        else _looked_up(labels, least, "root", store, "least", hub_degree)
    named, _ = store.write(named.select("node", "component"), "components")
    for name in ["nodes", "labels", "least", f"edges-{len(moves)}", *(f"{kind}-{k}" for kind in ("moves", "roots") for k in range(len(moves)))]:
        store.drop(name)  # a table that was not written is skipped
    return named


def component_summary(components: DataFrame) -> DataFrame:
    """Nodes, components, largest size, connected flag (one row)."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("nodes"),
                     F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"),
                     (F.count(F.lit(1)) == 1).alias("is_connected"))


# --------------------------------------------------------------------- J8: diameter

class _Rounds:
    """Rows that each round adds to a state, as one table a round.

    A round writes only what is new. Beyond ``MOST`` tables they are merged to
    one by ``merge``, so a row is rewritten once in so many rounds at the most.
    """

    MOST = 8

    def __init__(self, store: TableStore, name: str, merge):
        self.store, self.name, self.merge = store, name, merge
        self.tables: list[DataFrame] = []
        self.names: list[str] = []
        self.written = 0

    def add(self, rows: DataFrame, **counters: Column) -> tuple[DataFrame, dict]:
        """Write the rows of a round; returns them and their counters. Older rounds may be merged then."""
        last = self._write(rows, **counters)
        if len(self.tables) > self.MOST:
            older = self.rows()
            names, self.names, self.tables = self.names, self.names[-1:], []
            self.tables = [self._write(self.merge(older))[0]]
            self.names.reverse()
            for name in names[:-1]:
                self.store.drop(name)
        self.tables.append(last[0])
        return last

    def _write(self, rows: DataFrame, **counters: Column) -> tuple[DataFrame, dict]:
        self.written += 1
        self.names.append(f"{self.name}-{self.written}")
        return self.store.write(rows, self.names[-1], **counters)

    def rows(self) -> DataFrame:
        out = self.tables[0]
        for table in self.tables[1:]:
            out = out.unionByName(table)
        return out


def hop_distances(edges: DataFrame, sources: DataFrame, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """Fewest hops from each source to every node it reaches: (source, node, hops).

    Breadth first: a round writes only the pairs that it is the first to reach.
    """
    store = TableStore(edges.sparkSession, "hops")
    graph = Adjacency(edges.select("src", "dst").distinct(), store, hub_degree)
    reached = _Rounds(store, "reached", lambda rows: rows)
    last, _ = reached.add(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("hops", F.lit(0)))
    hops = 0
    while True:
        hops += 1
        ahead = graph.expand(last.select("source", "node")).select("source", F.col("dst").alias("node")).distinct()
        fresh = ahead.join(reached.rows().select("source", "node"), ["source", "node"], "left_anti")
        last, seen = reached.add(fresh.withColumn("hops", F.lit(hops)), n=F.count(F.lit(1)))
        if not seen["n"]:
            return reached.rows()


def hop_diameter(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None,
                 hub_degree: int = HUB_DEGREE, first_searches: int = 64) -> DataFrame:
    """(is_connected, diameter, searches); the diameter is null unless all nodes reach all nodes.

    A node's eccentricity is at most that of a searched node plus the way to
    it, so a search from a few nodes bounds all others (Takes and Kosters,
    "Determining the diameter of small world networks", 2011). Nodes whose
    bound does not exceed the longest way found so far need no search. Rounds
    search from those with the highest upper and the lowest lower bounds, twice
    as many each time, until no node is left; the state is searches x nodes,
    not nodes squared. Directed edges are allowed; ``searches`` counts the nodes searched from.

    With ``sources`` (node) the search starts there only and gives a lower bound.
    """
    spark = edges.sparkSession
    store = TableStore(spark, "diameter")
    ids, seen = store.write(nodes.select("node").distinct(), "nodes", n=F.count(F.lit(1)))
    total = seen["n"]
    answer = lambda connected, far, searches: spark.range(1).select(
        F.lit(connected).alias("is_connected"), F.lit(far).cast("int").alias("diameter"), F.lit(searches).cast("bigint").alias("searches"))
    if sources is not None:
        reach = hop_distances(edges, sources.select("node").distinct(), hub_degree)
        found = reach.groupBy("source").agg(F.count(F.lit(1)).alias("seen"), F.max("hops").alias("far")) \
            .agg(F.min("seen").alias("least"), F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).first()
        connected = found["least"] == total and total > 0
        return answer(connected, found["far"] if connected else None, found["n"])
    if not total:
        return answer(False, None, 0)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    unknown = F.lit(2 ** 31 - 1)
    bounds, _ = store.write(ids.join(degree, "node", "left").select(
        "node", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(0).alias("low"), unknown.alias("up"), F.lit(False).alias("done")), "bounds-0")
    best, searches, batch, rounds = 0, 0, first_searches, 0
    while True:
        rounds += 1
        left = bounds.filter(~F.col("done") & (F.col("up") > best))
        high = left.orderBy(F.desc("up"), F.desc("degree"), "node").limit((batch + 1) // 2).select("node")
        low = left.orderBy("low", F.desc("degree"), "node").limit((batch + 1) // 2).select("node")
        chosen, picked = store.write(high.unionByName(low).distinct(), f"chosen-{rounds}", n=F.count(F.lit(1)))
        if not picked["n"]:
            return answer(True, best, searches)
        searches += picked["n"]
        far, out = store.write(hop_distances(edges, chosen, hub_degree).groupBy("source").agg(
            F.count(F.lit(1)).alias("seen"), F.max("hops").alias("far")), f"far-{rounds}", least=F.min("seen"), far=F.max("far"))
        if out["least"] < total:
            return answer(False, None, searches)
        best = max(best, out["far"])
        told = (hop_distances(back, chosen, hub_degree).join(far.select("source", "far"), "source").groupBy("node")
                .agg(F.count(F.lit(1)).alias("seen"), F.max("hops").alias("near"), F.min(F.col("hops") + F.col("far")).alias("most")))
        now = (bounds.drop("seen").join(told, "node", "left").join(chosen.withColumn("now", F.lit(True)), "node", "left").select(
            "node", "degree", F.greatest("low", F.coalesce("near", F.lit(0))).alias("low"), F.least("up", F.coalesce("most", unknown)).alias("up"),
            (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"), F.coalesce("seen", F.lit(0)).alias("seen")))
        bounds, out = store.write(now, f"bounds-{rounds}", least=F.min("seen"))
        store.drop(f"bounds-{rounds - 1}")
        if out["least"] < picked["n"]:  # some node does not reach a searched one
            return answer(False, None, searches)
        batch *= 2


# --------------------------------------------------------------- J9: shortest paths

#: Bits of a label that count hops; the cost in thousandths is above them.
_HOP_BITS = 20
_HOPS = (1 << _HOP_BITS) - 1


def _path_levels(best: DataFrame, graph: Adjacency, depth: int, store: TableStore) -> DataFrame:
    """The path of every (source, node) with a label, smallest first among equal labels: (source, node, path, minutes).

    Only tight edges, those that give the label of their end, can be on such a
    path. All paths to a node have equally many stops, so the smallest goes on
    from the smallest path to one of its predecessors: one round for each hop,
    over the nodes that many hops away.
    """
    mine = best.select("source", "node", "label")
    tight = (graph.expand(mine).select("source", F.col("node").alias("before"), F.col("dst").alias("node"), "step",
                                       (F.col("label") + F.col("weight")).alias("label"))
             .join(mine, ["source", "node", "label"]).withColumn("hops", F.col("label").bitwiseAND(F.lit(_HOPS))))
    tight, _ = store.write(tight.select("source", "before", "node", "step", "hops"), "tight")
    start = mine.filter("label = 0").select("source", "node", F.array("source").alias("path"), F.lit(0).cast("bigint").alias("minutes"))
    levels = [store.write(start, "level-0")[0]]
    for hops in range(1, depth + 1):
        ahead = (tight.filter(F.col("hops") == hops).join(levels[-1].withColumnRenamed("node", "before"), ["source", "before"])
                 .groupBy("source", "node").agg(F.min(F.struct("path", (F.col("minutes") + F.col("step")).alias("minutes"))).alias("p")))
        level = ahead.select("source", "node", F.concat("p.path", F.array("node")).alias("path"), "p.minutes")
        levels.append(store.write(level, f"level-{hops}")[0])
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def shortest_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame,
                   hub_degree: int = HUB_DEGREE) -> DataFrame:
    """Cheapest route for a table of (origin_uic, destination_uic).

    Result: pair, path, cost, minutes, hops, error. Ties are broken by
    (cost, hops, path) (P7). Unknown ends give ``InvalidStationError``, unreachable
    ones ``NoPathError``, equal ends a path of one node.

    Relaxation by deltas over (source, node): a round expands the labels that
    improved and writes only those that improve in turn. A label is a cost and
    its hops in one long; no path travels. A source is bounded by the dearest of its targets once
    all are reached, before edges are followed and after. Paths are made at the
    end, along the edges that are tight. Edge costs are positive, up to thousandths;
    a sum too large for a label raises an overflow instead of a wrong route.
    """
    store = TableStore(edges.sparkSession, "paths")
    pairs, _ = store.write(pairs.select("origin_uic", "destination_uic").distinct(), "pairs")  # often dear to derive, and read in four places
    known = nodes.select("uic")
    wanted = (pairs.join(known.withColumnRenamed("uic", "origin_uic"), "origin_uic", "left_semi")
              .join(known.withColumnRenamed("uic", "destination_uic"), "destination_uic", "left_semi"))
    targets = wanted.select(F.col("origin_uic").alias("source"), F.col("destination_uic").alias("node"))
    weight = (F.col("cost") * 1000).cast("bigint") * (1 << _HOP_BITS) + 1
    graph = Adjacency(edges.select("src", "dst", weight.alias("weight"), F.col("minutes").alias("step")), store, hub_degree)
    nothing = F.lit(None).cast("bigint")
    asked = (targets.withColumns({"label": nothing, "target": F.lit(True)})
             .unionByName(targets.select("source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("label"), F.lit(False).alias("target")))
             .groupBy("source", "node").agg(F.min("label").alias("label"), F.max("target").alias("target")))
    merge = lambda rows: rows.groupBy("source", "node").agg(F.min("label").alias("label"), F.max("target").alias("target"))
    state = _Rounds(store, "labels", merge)
    last, seen = state.add(asked, n=F.count(F.lit(1)))
    while seen["n"]:
        limits = (merge(state.rows().filter("target")).groupBy("source")
                  .agg(F.when(F.count_if(F.col("label").isNull()) == 0, F.max("label")).alias("limit")))
        far = lambda label: F.col("limit").isNull() | (label <= F.col("limit").bitwiseOR(F.lit(_HOPS)))
        frontier = last.filter("label is not null").join(limits, "source").filter(far(F.col("label")))
        ahead = (graph.expand(frontier.select("source", "node", "label", "limit")).withColumn("label", F.col("label") + F.col("weight"))
                 .filter(far(F.col("label"))).select("source", F.col("dst").alias("node"), "label", nothing.alias("old"), F.lit(False).alias("target")))
        merged = (state.rows().withColumn("old", F.col("label")).unionByName(ahead).groupBy("source", "node")
                  .agg(F.min("label").alias("label"), F.min("old").alias("old"), F.max("target").alias("target")))
        better = merged.filter(F.col("label").isNotNull() & (F.col("old").isNull() | (F.col("label") < F.col("old"))))
        last, seen = state.add(better.select("source", "node", "label", "target"), n=F.count(F.lit(1)))
    best = merge(state.rows()).filter("label is not null")
    hops = F.col("label").bitwiseAND(F.lit(_HOPS))
    best, deep = store.write(best, "best", hops=F.max(F.when(F.col("target"), hops)))
    paths = _path_levels(best, graph, deep["hops"] or 0, store)
    found = (best.filter("target").join(paths, ["source", "node"])
             .select(F.col("source").alias("origin_uic"), F.col("node").alias("destination_uic"), "path",
                     (F.shiftright("label", _HOP_BITS).cast("decimal(18,0)") / 1000).cast("decimal(18,3)").alias("cost"), "minutes",
                     hops.cast("int").alias("hops")))
    ends = known.withColumn("_known", F.lit(True))
    checked = (pairs
               .join(ends.select(F.col("uic").alias("origin_uic"), F.col("_known").alias("_o")), "origin_uic", "left")
               .join(ends.select(F.col("uic").alias("destination_uic"), F.col("_known").alias("_d")), "destination_uic", "left")
               .join(found, ["origin_uic", "destination_uic"], "left"))
    error = (F.when(F.col("_o").isNull() | F.col("_d").isNull(), "InvalidStationError")
             .when(F.col("path").isNull(), "NoPathError"))
    return checked.select("origin_uic", "destination_uic", "path", "cost", "minutes", "hops",
                          error.alias("error"))


# ---------------------------------------------------------------- J10-J12: routes

def _route_rows(routes: DataFrame, keys: list[str], path: str) -> DataFrame:
    return routes.select(*keys, F.posexplode(path).alias("pos", "uic"))


def route_records(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Station names along each route, total time, intermediate stops, error text."""
    keys = ["origin_uic", "destination_uic"]
    names = nodes.select("uic", "station_name")
    stops = (_route_rows(paths, keys, "path").join(names, "uic", "left")
             .groupBy(*keys)
             .agg(F.array_sort(F.collect_list(F.struct(
                 "pos", F.coalesce("station_name", "uic").alias("name")))).alias("s"))
             .select(*keys, F.col("s.name").alias("stations")))
    name = lambda end: names.select(F.col("uic").alias(f"{end}_uic"),
                                    F.col("station_name").alias(f"{end}_name"))
    joined = (paths.join(stops, keys, "left").join(name("origin"), "origin_uic", "left")
              .join(name("destination"), "destination_uic", "left"))
    shown = lambda end: F.coalesce(f"{end}_name", f"{end}_uic")
    message = (F.when((F.col("error") == "InvalidStationError") & F.col("origin_name").isNull(),
                      F.concat(F.lit("Origin station '"), "origin_uic", F.lit("' not found")))
               .when(F.col("error") == "InvalidStationError",
                     F.concat(F.lit("Destination station '"), "destination_uic", F.lit("' not found")))
               .when(F.col("error") == "NoPathError",
                     F.concat(F.lit("No path between "), shown("origin"), F.lit(" and "), shown("destination"))))
    return joined.select(*keys, "origin_name", "destination_name", F.col("error").isNull().alias("success"),
                         "path", "stations", F.coalesce("minutes", F.lit(0)).alias("total_time"),
                         F.when(F.col("path").isNotNull(), F.greatest(F.size("path") - 2, F.lit(0)))
                         .otherwise(0).alias("num_stops"), message.alias("error"))


def _steps(routes: DataFrame, key: list[str], path: str) -> DataFrame:
    hops = F.transform(F.sequence(F.lit(0), F.size(path) - 2), lambda i: F.struct(
        i.alias("seq"), F.get(path, i).alias("src"), F.get(path, i + 1).alias("dst")))
    return routes.filter(F.size(path) >= 2).select(*key, F.explode(hops).alias("h")).select(*key, "h.*")


def route_segments(routes: DataFrame, nodes: DataFrame, edges: DataFrame, key: list[str],
                   path: str = "path") -> DataFrame:
    """One row per hop with names, minutes, km and class; order by (key, seq)."""
    names = nodes.select("uic", "station_name")
    return (_steps(routes, key, path)
            .join(edges.select("src", "dst", "minutes", "distance_km", "line_code"), ["src", "dst"], "left")
            .join(names.select(F.col("uic").alias("src"), F.col("station_name").alias("from_name")), "src", "left")
            .join(names.select(F.col("uic").alias("dst"), F.col("station_name").alias("to_name")), "dst", "left")
            .select(*key, "seq", F.col("src").alias("from_uic"), F.col("dst").alias("to_uic"),
                    F.coalesce("from_name", "src").alias("from_name"),
                    F.coalesce("to_name", "dst").alias("to_name"),
                    F.col("minutes").alias("duration"), "distance_km",
                    F.coalesce("line_code", F.lit("TRAIN")).alias("line_code")))


def given_stops_time(stops: DataFrame, nodes: DataFrame, edges: DataFrame, key: str, order: str = "pos",
                     **options) -> DataFrame:
    """J12 for routes given one stop per row (key, pos, uic): (key, total_minutes, error).

    Errors in order: too_short, unknown_station, missing_edge. A route of any
    length is spread over tasks; only its sums are brought together.
    """
    known = nodes.select("uic", F.lit(True).alias("_known"))
    links = edges.select(F.col("src").alias("uic"), F.col("dst").alias("next_uic"), "minutes")
    legs = (next_in_group(stops.select(key, order, "uic"), [key], [order], ["uic"], **options)
            .join(known, "uic", "left").join(links, ["uic", "next_uic"], "left"))
    sums = legs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_known").isNull()).alias("unknown"),
        F.sum("minutes").alias("minutes"),
        F.count_if(F.col("next_uic").isNotNull() & F.col("minutes").isNull()).alias("missing"))
    error = (F.when(F.col("n") < 2, "too_short").when(F.col("unknown") > 0, "unknown_station")
             .when(F.col("missing") > 0, "missing_edge"))
    return sums.withColumn("error", error).select(
        key, F.when(F.col("error").isNull(), F.col("minutes")).cast("int").alias("total_minutes"), "error")


def given_route_time(routes: DataFrame, nodes: DataFrame, edges: DataFrame, key: str,
                     path: str = "path") -> DataFrame:
    """J12 for routes given as arrays; a route without stops is too short."""
    stops = routes.select(key, F.posexplode(path).alias("pos", "uic"))
    empty = routes.filter(F.coalesce(F.size(path), F.lit(0)) <= 0).select(
        key, F.lit(None).cast("int").alias("total_minutes"), F.lit("too_short").alias("error"))
    return given_stops_time(stops, nodes, edges, key).unionByName(empty)


def route_coordinates(routes: DataFrame, stations: DataFrame, key: list[str], stops: str = "stations") -> DataFrame:
    """C17: coordinates per stop, by station name, else by city name (case-insensitive).

    ``stations`` has (station_name, city_name, latitude, longitude, seq); the first
    row per name counts and rows with missing values are ignored.
    """
    full = stations.dropna(subset=["station_name", "city_name", "latitude", "longitude"])

    def by(column: str, prefix: str) -> DataFrame:
        place = F.struct("seq", "latitude", "longitude")
        return (full.groupBy(F.lower(column).alias("_name")).agg(F.min(place).alias("p"))
                .select("_name", F.col("p.latitude").alias(f"{prefix}_lat"),
                        F.col("p.longitude").alias(f"{prefix}_lon")))

    rows = routes.select(*key, F.posexplode(stops).alias("seq", "stop")).withColumn("_name", F.lower("stop"))
    return (rows.join(by("station_name", "s"), "_name", "left").join(by("city_name", "c"), "_name", "left")
            .select(*key, "seq", "stop", F.coalesce("s_lat", "c_lat").alias("latitude"),
                    F.coalesce("s_lon", "c_lon").alias("longitude")))


def with_clock_label(df: DataFrame, minutes: str = "minutes") -> DataFrame:
    """Add ``duration_label``."""
    return df.withColumn("duration_label", X.clock_label(minutes))
