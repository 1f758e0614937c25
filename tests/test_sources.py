import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from itinera.operators import labels as LB
from itinera.operators import network as NW
from itinera.operators import stations as ST
from itinera.operators.gazetteer import build_gazetteer, default_aliases, default_names
from itinera.plans import resolution as RS
from itinera.sources import readers as RD
from itinera.sources import writers as WR

ORDERS = '''sentenceID,sentence
1,"Je veux aller de Paris à Lyon, ""vite"""
2,Quel temps fait-il?
3,Train pour Nice depuis Brest
4,Je vais de Paris à Londres
5,Billet Lyon Metz
6,Je vais à Paris
'''


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def lines(folder):
    out = []
    for name in sorted(glob.glob(f"{folder}/part-*.csv")):
        with open(name, encoding="utf-8") as f:
            out += f.read().splitlines()
    header = out[0]
    return [header, *sorted(line for line in out if line != header)]


def test_read_orders(spark, tmp_path):
    rows = RD.read_orders(spark, write(tmp_path / "o.csv", ORDERS)).collect()
    assert rows[0]["sentence"] == 'Je veux aller de Paris à Lyon, "vite"' and len(rows) == 6
    with pytest.raises(ValueError, match="missing columns"):
        RD.read_orders(spark, write(tmp_path / "bad.csv", "id,text\n1,a\n"))
    with pytest.raises(ValueError, match="no data rows"):
        RD.read_orders(spark, write(tmp_path / "head.csv", "sentenceID,sentence\n"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        RD.read_orders(spark, str(tmp_path / "none.csv"))


def test_utf8_report(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "good.csv", "é à ç")
    write(folder / "bad.csv", "abcé", "latin-1")
    write(folder / "late.csv", "éa", "utf-8")
    (folder / "late.csv").write_bytes("éa".encode() + b"\xff\xfe")
    bad = {r["path"].rsplit("/", 1)[1]: r["first_bad_byte"] for r in RD.invalid_utf8_files(spark, str(folder)).collect()}
    assert bad == {"bad.csv": 4, "late.csv": 4}


def first_error(data):
    try:
        data.decode("utf-8")
        return 0
    except UnicodeDecodeError as error:
        return error.start + 1


def test_first_invalid_byte(spark):
    parts = [b"a", b"\xc3\xa9", b"\xe2\x82\xac", b"\xf0\x9f\x98\x80", b"\xef\xbf\xbd", b"\x80", b"\xc3", b"\xc0\xaf", b"\xe0\x9f\xbf",
             b"\xed\xa0\x80", b"\xed\x9f\xbf", b"\xf0\x8f\xbf\xbf", b"\xf4\x8f\xbf\xbf", b"\xf4\x90\x80\x80", b"\xf5", b"\xff", b"\xe2\x82", b"\xf0\x9f\x98"]
    rng = random.Random(3)
    texts = [b"", *parts, *[b"".join(rng.choice(parts[:5] if rng.random() < 0.8 else parts) for _ in range(rng.randrange(1, 12))) for _ in range(1500)],
             *[bytes(rng.randrange(128, 256) for _ in range(rng.randrange(1, 6))) for _ in range(1500)], b"x" * 2_000_000 + b"\xe9"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, b binary").select("i", RD.first_invalid_byte("b").alias("at")).collect()
    assert {r["i"]: r["at"] for r in got} == {i: first_error(t) for i, t in enumerate(texts)}
    assert spark.range(1).select(RD.first_invalid_byte(F.lit(None).cast("binary")).alias("at")).first()["at"] is None


@pytest.mark.parametrize("split", [None, 64])
def test_utf8_positions_in_splits(spark, tmp_path, split):
    folder, rng, want = tmp_path / "raw", random.Random(5), {}
    folder.mkdir()
    for i in range(12):
        lines = ["é" * rng.randrange(30) + "\ufffd" * (i % 2) + "\r" * (i % 3) for _ in range(40)]
        data = [line.encode() for line in lines]
        for k in rng.sample(range(40), i % 4):
            data[k] += rng.choice([b"\xc3", b"\xc0\xaf", b"\xed\xa0\x80", b"\x80", b"\xe2\x82"])
        whole = (b"\xef\xbb\xbf" if i % 5 == 3 else b"") + b"\n".join(data) + (b"\n" if i % 2 else b"")
        (folder / f"f{i}").write_bytes(whole)
        if first_error(whole):
            want[f"f{i}"] = (len(whole), first_error(whole))
    (folder / "empty").write_bytes(b"")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names if split else ():
            spark.conf.set(n, str(split))
        got = RD.invalid_utf8_files(spark, str(folder)).collect()
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    assert len(want) > 5 and {r["path"].rsplit("/", 1)[1]: (r["length"], r["first_bad_byte"]) for r in got} == want


@pytest.mark.parametrize("split", [None, 48])
def test_line_breaks_in_quotes_across_splits(spark, tmp_path, split):
    rng, want = random.Random(11), []
    folder = tmp_path / "m"
    folder.mkdir()
    words = ["Paris", "é à", "a,b", 'say ""hi""', "\n", "\n\n", "\nx,y\n", "1,2", "z" * 70]
    for f in range(4):
        text = "sentenceID,sentence,note" + ("\r\n" if f == 2 else "\n")
        for i in range(30):
            value = "s" + "".join(rng.choice(words if f else words[:2]) for _ in range(rng.randrange(0, 5)))
            shown = f'"{value}"' if f or i % 2 else value
            want.append((f"{f}-{i}", value.replace('""', '"')))
            text += f'{f}-{i},{shown},""' + ("\r\n" if f == 2 else "\n") + ("\n" if i % 9 == 4 else "")
        (folder / f"f{f}.csv").write_bytes((text.rstrip("\n") if f == 3 else text).encode())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names if split else ():
            spark.conf.set(n, str(split))
        got = RD.read_orders(spark, str(folder), multi_line=True)
        assert sorted((r["sentenceID"], r["sentence"]) for r in got.collect()) == sorted(want)
        plain = RD.read_orders(spark, str(folder / "f0.csv"), multi_line=True)
        assert sorted(tuple(r) for r in plain.collect()) == sorted(w for w in want if w[0].startswith("0-"))
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    common = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(folder)).select("sentenceID", "sentence")
    assert sorted(tuple(r) for r in common.collect()) == sorted(want)


def test_gazetteer_files(spark, tmp_path):
    WR.write_gazetteer_json(default_names(spark), default_aliases(spark), str(tmp_path / "g"))
    names, aliases = RD.read_gazetteer_json(spark, str(tmp_path / "g"))
    assert names.count() == 68 and aliases.count() == 35
    doc = json.loads(open(glob.glob(f"{tmp_path}/g/part-*.json")[0], encoding="utf-8").read())
    assert doc["cities"] == sorted(doc["cities"]) and doc["aliases"]["nice"] == ["nice", "nise", "nices"]
    csv = write(tmp_path / "c.csv", "ville,x\nParis,1\nLyon,2\n")
    assert [r["name"] for r in RD.read_names_csv(spark, csv, "ville").orderBy("seq").collect()] == ["Paris", "Lyon"]
    assert RD.read_names_csv(spark, csv).count() == 0


def test_token_examples(spark, tmp_path):
    good = {"tokens": ["de", "Paris"], "labels": ["O", "B-ORIGIN"], "metadata": {"sentenceID": "1", "is_valid": 1}}
    bad = [{**good, "labels": ["O"]}, {**good, "labels": ["O", "B-CITY"]}]
    path = write(tmp_path / "n.json", json.dumps([good, *bad], ensure_ascii=False))
    examples = RD.read_token_examples(spark, path)
    assert sorted(r["problem"] for r in LB.label_problems(examples).collect()) == ["label", "length"]
    WR.write_token_examples(examples, str(tmp_path / "out"))
    assert RD.read_token_examples(spark, str(tmp_path / "out"), json_lines=True).count() == 3


GTFS = {
    "stops.txt": "stop_id,stop_name,stop_desc,stop_lat,stop_lon\n" + "".join(
        f"StopPoint:OCE-{87000000 + i},{n},x,{48 - i / 10},{2 + i / 10}\n" for i, n in enumerate(
            ["Paris Gare de Lyon", "Lyon Part Dieu", "Nice", "Brest", "Metz"])) + "StopArea:X,Ailleurs,x,1,1\n",
    "routes.txt": "route_id,route_short_name,route_long_name,route_type\nR1,001G,TGV INOUI,2\nR2,TER,,2\n",
    "trips.txt": "trip_id,route_id,service_id\nT1,R1,s\nT2,R1,s\nT3,R2,s\nT4,R2,s\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(
        f"{t},x,{h:02d}:{m:02d}:00,StopPoint:OCE-{87000000 + s},{i}\n" for t, calls in {
            "T1": [(0, 8, 0), (1, 10, 0)], "T2": [(0, 23, 0), (1, 25, 2)], "T3": [(1, 9, 0), (2, 9, 50), (3, 9, 50)],
            "T4": [(1, 12, 0), (2, 12, 48)]}.items() for i, (s, h, m) in enumerate(calls)),
}


@pytest.fixture()
def network(spark, tmp_path):
    for name, text in GTFS.items():
        write(tmp_path / name, text)
    read = lambda t: RD.read_gtfs(spark, str(tmp_path), t)
    stations = ST.build_stations(read("stops"))
    rows = NW.connections(NW.stop_segments(read("stop_times")), NW.trip_classes(read("trips"), read("routes")))
    named = NW.with_names(NW.symmetric(rows), read("stops"))
    return stations, named, NW.build_network(stations, named)


def test_timetable_to_network(network):
    stations, named, net = network
    assert sorted((r["uic_code"], r["city_name"]) for r in stations.collect())[0] == ("87000000", "Paris") and stations.count() == 5
    got = sorted((r["origin_name"], r["destination_name"], r["duration_minutes"], r["line_code"], r["trip_count"]) for r in named.collect())
    assert got == [("Lyon Part Dieu", "Nice", 49, "TER", 2), ("Lyon Part Dieu", "Paris Gare de Lyon", 121, "TGV", 2),
                   ("Nice", "Lyon Part Dieu", 49, "TER", 2), ("Paris Gare de Lyon", "Lyon Part Dieu", 121, "TGV", 2)]
    assert net.edges.count() == 4


def test_snapshot(spark, network, tmp_path):
    path, built = str(tmp_path / "snap"), []

    def build():
        built.append(1)
        return network[2]

    with pytest.raises(FileNotFoundError):
        WR.load_network(spark, path)
    assert WR.get_or_build_network(spark, path, build).edges.count() == 4
    assert WR.get_or_build_network(spark, path, build).nodes.count() == 5 and built == [1]
    WR.get_or_build_network(spark, path, build, force_rebuild=True)
    assert built == [1, 1]


@pytest.mark.parametrize("mode, header, first", [
    ("nlp", "sentenceID,Departure,Destination", "1,Paris,Lyon"),
    ("route", "sentenceID,Departure,Destination", "1,Paris Gare de Lyon,Lyon Part Dieu")])
def test_batch(spark, network, tmp_path, mode, header, first):
    stations, _, net = network
    gaz = build_gazetteer(default_names(spark).unionByName(
        spark.createDataFrame([("Londres", "city", 900)], "name string, kind string, seq bigint")))
    foreign = spark.createDataFrame([("londres",)], "norm string")
    out = str(tmp_path / "out")
    counters = RS.run_batch(write(tmp_path / "o.csv", ORDERS), out, mode, gaz, ST.city_station_map(stations), net, foreign)
    row = counters.first().asDict()
    assert row == {"total": 6, "valid": 5, "invalid": 1, "success": 1, "errors": 3, "nlp_errors": 0, "mapping_errors": 0,
                   "foreign_errors": 1, "pathfinding_errors": 2}
    got = lines(out)
    assert got[0] == header and first in got and "2,INVALID,INVALID" in got
    if mode == "nlp":
        assert "6,INVALID,Paris" in got and "3,Brest,Nice" in got


def test_wide_routes(spark, tmp_path):
    df = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "b", "c", "d"])], "sentenceID string, route array<string>")
    assert WR.wide_routes(df).columns == ["sentenceID", "Departure", "Step1", "Step2", "Destination"]
    WR.write_routes(df, str(tmp_path / "w"))
    assert lines(tmp_path / "w") == ["sentenceID,Departure,Step1,Step2,Destination", "1,a,b,,", "2,a,b,c,d"]
    assert df.select(WR.route_text("route").alias("r")).first()["r"] == "a,b"
    with pytest.raises(ValueError, match="missing columns"):
        WR.wide_routes(df.drop("route"))
    with pytest.raises(ValueError, match="no routes"):
        WR.wide_routes(df.limit(0))
    with pytest.raises(ValueError, match="missing columns"):
        WR.write_flat(df, str(tmp_path / "x"))


def test_reference_tables_and_report(spark, tmp_path):
    c = write(tmp_path / "c.csv", "origin_uic,destination_uic,duration_minutes,distance_km\n1;9,2,30,12.5\n")
    assert RD.read_connections(spark, c).first()["duration_minutes"] == 30
    m = write(tmp_path / "m.csv", "city_name_normalized,station_name,uic_code\nparis,P,1;2\nparis,Q,3\n")
    assert ST.city_station_map(RD.read_city_map(spark, m)).first()["uic"] == "1"
    s = write(tmp_path / "s.csv", "uic_code,station_name,latitude\n1,A,48.5\n")
    assert RD.read_stations(spark, s).first()["latitude"] == 48.5
    lab = write(tmp_path / "l.csv", "sentenceID,sentence,origin,destination,is_valid,difficulty,category,notes\n1,a,,,0,easy,x,\n")
    truth = RD.read_labelled_orders(spark, lab)
    assert truth.first()["origin"] == ""
    from itinera.operators import evaluate as EV
    summary, slices, robust = EV.full_evaluation(truth, truth.select("sentenceID", "origin", "destination"))
    WR.write_report(WR.evaluation_report(summary, slices, robust, "rules", "tiny", {"note": "x"}), str(tmp_path / "rep"))
    doc = json.loads(open(glob.glob(f"{tmp_path}/rep/part-*.json")[0], encoding="utf-8").read())
    assert doc["metadata"]["model_name"] == "rules" and doc["metrics"]["true_negatives"] == 1
    WR.write_sorted(truth, ["sentenceID"], str(tmp_path / "sorted"))
    WR.write_errors(truth, str(tmp_path / "errors"))
    assert lines(tmp_path / "errors")[1].startswith("1,a")
