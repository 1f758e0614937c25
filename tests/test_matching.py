import random

import pytest

from itinera.operators import matching as MT
from itinera.operators import stations as ST
from itinera.operators.gazetteer import build_gazetteer


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def words(rng, n, letters="abc", longest=14):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)})


@pytest.mark.parametrize("bound, allowed", [
    (MT.EditBound(k=0), lambda a, b: 0),
    (MT.EditBound(k=1), lambda a, b: 1),
    (MT.EditBound(k=2), lambda a, b: 2),
    (MT.EditBound(k=3), lambda a, b: 3),
    (MT.EditBound(floor=0.7), lambda a, b: (300 * max(len(a), len(b)) - 1) // 1000),
    (MT.EditBound(floor=0.5), lambda a, b: (500 * max(len(a), len(b)) - 1) // 1000),
])
def test_edit_pairs_match_brute_force(spark, bound, allowed):
    rng = random.Random(7)
    left, right = words(rng, 120), words(rng, 120)
    if bound.k is None:
        left, right = [w for w in left if w], [w for w in right if w]
    got = {(r["q_key"], r["c_key"], r["distance"]) for r in MT.edit_pairs(
        spark.createDataFrame([(w,) for w in left], "q_key string"),
        spark.createDataFrame([(w,) for w in right], "c_key string"), bound).collect()}
    want = {(a, b, d) for a in left for b in right if (d := levenshtein(a, b)) <= allowed(a, b)}
    assert got == want and want


def test_few_candidates_although_most_words_share_a_piece(spark):
    rng = random.Random(3)
    right = sorted({"station" + "".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(1500)})
    left = [w[:9] + w[10:] for w in right[::10]]
    frame = lambda rows, c: spark.createDataFrame([(w,) for w in rows], f"{c} string")
    asked, known, bound = frame(left, "q_key"), frame(right, "c_key"), MT.EditBound(k=2)
    assert MT.edit_candidates(asked, known, bound).count() < 0.05 * len(left) * len(right)
    got = {(r["q_key"], r["c_key"]) for r in MT.edit_pairs(asked, known, bound).collect()}
    assert got == {(a, b) for a in left for b in right if levenshtein(a, b) <= 2}


def names(spark, items):
    return spark.createDataFrame([(n, i) for i, n in enumerate(items)], "name string, seq bigint")


def test_closest_entry(spark):
    asked = spark.createDataFrame([("Pari",), ("Lyone",), ("Zzz",), ("paris",), ("Lyo",), ("",), (None,)], "query string")
    out = {r["query"]: r["match"] for r in MT.closest_entry(asked, names(spark, ["Paris", "Lyon", "Pavis"])).collect()}
    assert out == {"Pari": "Paris", "Lyone": "Lyon", "paris": "Paris", "Lyo": "Lyon"}


@pytest.fixture(scope="module")
def towns(spark):
    rows = [(n, "city", i) for i, n in enumerate([
        "Paris", "Saint-Laurent-du-Var", "Saint-Laurent-de-Mure", "Saint-Malo", "Aix-en-Provence", "Aix-les-Bains",
        "Marseille", "Nantes", "Nice", "Montpellier"])]
    return build_gazetteer(spark.createDataFrame(rows, "name string, kind string, seq bigint")).cache()


def ask(spark, items):
    return spark.createDataFrame([(i,) for i in items], "query string")


def test_resolution(spark, towns):
    out = {r["query"]: (r["canonical"], r["how"]) for r in MT.resolve_entities(ask(spark, [
        "PARIS", "Pari", "saint-lau", "Montp", "Marsseille", "Zzzzzzzzz", "Aix", "", None]), towns).collect()}
    assert out == {"PARIS": ("Paris", "exact"), "Pari": ("Paris", "prefix"), "saint-lau": (None, "ambiguous"),
                   "Montp": ("Montpellier", "prefix"), "Marsseille": ("Marseille", "similar"),
                   "Zzzzzzzzz": (None, "unknown"), "Aix": (None, "ambiguous")}


def test_suggestions(spark, towns):
    found = MT.suggestions(ask(spark, ["saint lau", "Nice", "Aix", "saint-m", "nante"]), towns)
    lists = {}
    for r in found.orderBy("query", "stage", "distance", "seq").collect():
        lists.setdefault(r["query"], []).append(r["canonical"])
    assert lists == {"saint lau": ["Saint-Laurent-du-Var", "Saint-Laurent-de-Mure"], "Nice": ["Nice"],
                     "Aix": ["Aix-les-Bains", "Aix-en-Provence"], "saint-m": ["Saint-Malo"], "nante": ["Nantes"]}
    linked = spark.createDataFrame([("nice", "1", 0), ("aix-en-provence", "2", 1)], "city_norm string, uic string, seq bigint")
    out = {r["query"]: (r["n_suggestions"], r["n_with_station"], r["accepted"], r["ambiguous"])
           for r in MT.suggestion_summary(found, linked, 5).collect()}
    assert out["Aix"] == (2, 1, None, True) and out["Nice"] == (1, 1, "Nice", False) and out["saint lau"][3] is False


def test_city_map(spark):
    rows = [("aix-en-provence", "A", "10"), ("aix-les-bains", "B", "11"), ("paris", "P1", "1;2"), ("paris", "P2", "3"),
            ("le mans centre", "M", "5")]
    table = ST.city_station_map(spark.createDataFrame(
        [(c, n, u, i) for i, (c, n, u) in enumerate(rows)], "city_name_normalized string, station_name string, uic_code string, seq bigint"))
    out = {r["city"]: (r["uic"], r["m"]) for r in ST.map_cities(
        spark.createDataFrame([("Paris",), ("Aix",), ("Le Mans",), ("Ai",), ("",), (None,)], "city string"), "city", table,
        match_col="m").collect()}
    assert out == {"Paris": ("1", "exact"), "Aix": ("10", "prefix"), "Le Mans": ("5", "prefix"), "Ai": (None, None),
                   "": (None, None), None: (None, None)}


def test_both_paths_on_null_and_repeated_ids_and_aliases(spark):
    from itinera.operators.matching import find_places

    names = spark.createDataFrame([("paris", "Paris"), ("parris", "Paris"), ("lyon", "Lyon"), ("metz", "Metz"), ("tours", "Tours")],
                                  "norm string, canonical string")
    rows = [(None, "de Metz a Tours"), (1, "billet Paris Parris Lyon"), (1, "billet Lyon Metz"), (2, "rien")]
    df = spark.createDataFrame(rows, "sentenceID bigint, sentence string")
    found = [sorted((r.sentence, tuple(r.places)) for r in find_places(df, names, "sentence", "sentenceID", inline_keys=k).collect()) for k in (100, 1)]
    assert found[0] == found[1] == sorted([("de Metz a Tours", ("metz", "tours")), ("billet Paris Parris Lyon", ("paris", "lyon")),
                                           ("billet Lyon Metz", ("lyon", "metz")), ("rien", ())])
