import pytest

from itinera.operators import evaluate as EV
from itinera.operators.gazetteer import build_gazetteer

TRUTH = [
    (1, "Je veux aller de Paris à Lyon", "Paris", "Lyon", 1, "easy", "standard"),
    (2, "Billet Marseille Nice", "Marseille", "Nice", 1, "medium", "no_markers"),
    (3, "trajet tours reeims", "Tours", "Reims", 1, "hard", "misspelling"),
    (4, "Soit Toulouse soit Nice", "", "", 0, "medium", "ambiguous"),
    (5, "Comment aller à Bordeaux", "", "", 0, "easy", "incomplete_dest"),
    (6, "Un train de Lille à Strasbourg", "Lille", "Strasbourg", 1, "easy", "standard"),
    (7, "Je pars de grenoble", "", "", 0, "easy", "incomplete_dest"),
    (8, "Billet Aix-en-Provence Montpellier", "Aix-en-Provence", "Montpellier", 1, "hard", "compound_name"),
    (9, "keneq gulyrosado", "", "", 0, "easy", "garbage"),
    (10, "De Nantes vers Rennes", "Nantes", "Rennes", 1, "medium", "standard"),
]
PREDICTED = [
    (1, "Paris", "Lyon"), (2, "Marseille", "Nice"), (3, "INVALID", "Tours"), (4, "Nice", "Toulouse"),
    (5, "INVALID", "Bordeaux"), (6, "Lille", "Strasbourg"), (7, "INVALID", "Grenoble"), (8, "INVALID", "Montpellier"),
    (9, "INVALID", "INVALID"), (10, "Nantes", "Rennes"),
]


@pytest.fixture(scope="module")
def tables(spark):
    truth = spark.createDataFrame(TRUTH, "sentenceID int, sentence string, origin string, destination string, "
                                         "is_valid int, difficulty string, category string").cache()
    return truth, spark.createDataFrame(PREDICTED, "sentenceID int, origin string, destination string").cache()


def test_golden_rows(tables):
    summary, slices, robust = EV.full_evaluation(*tables)
    s = summary.first().asDict()
    assert (s["total_valid_orders"], s["origin_correct"], s["destination_correct"], s["exact_match"]) == (6, 4, 5, 4)
    assert (s["true_positives"], s["true_negatives"], s["false_positives"], s["false_negatives"]) == (4, 3, 1, 2)
    assert s["validity_accuracy"] == 0.7 and s["validity_precision"] == 0.8
    assert s["validity_recall"] == pytest.approx(4 / 6) and s["validity_f1"] == pytest.approx(8 / 11)
    table = {(r["slice_kind"], r["slice"]): (r["total"], r["correct"]) for r in slices.collect()}
    assert table[("category", "standard")] == (3, 3) and table[("difficulty", "hard")] == (2, 0) and table[("all", "all")] == (6, 4)
    scores = {r["slice"]: r["accuracy"] for r in robust.collect()}
    assert scores["misspelling"] == 0.0 and scores["no_capitals"] is None and scores["difficulty_easy"] == 1.0
    matrix = {r["actual"]: (r["predicted_invalid"], r["predicted_valid"]) for r in EV.confusion(EV.compare(*tables)).collect()}
    assert matrix == {"invalid": (3, 1), "valid": (2, 4)}


def test_missing_predictions(tables):
    truth, predicted = tables
    some = predicted.filter("sentenceID > 2")
    count = lambda **o: EV.validity(EV.compare(truth, some, **o)).first()["true_positives"]
    assert (count(), count(legacy_missing=True)) == (2, 4)
    row = EV.validity(EV.compare(truth, some)).first()
    assert sum(row[c] for c in ("true_positives", "true_negatives", "false_positives", "false_negatives")) == 10


def test_errors(tables):
    joined = EV.compare(*tables, how="inner")
    outcomes = {r["outcome"]: r["n"] for r in EV.error_distribution(joined).collect()}
    assert outcomes == {"both_correct": 4, "both_wrong": 1, "origin_wrong_only": 1}
    assert EV.error_kinds(joined).first().asDict() == {"errors": 2, "swapped": 0, "duplicated": 0, "origin_missing": 2, "dest_missing": 0}
    worst = EV.misidentified(joined).filter("end = 'origin'").orderBy("place").collect()
    assert [(r["place"], r["errors"], r["occurrences"]) for r in worst] == [("Aix-en-Provence", 1, 1), ("Tours", 1, 1)]
    examples = EV.failure_examples(joined, 1, difficulty="hard").collect()
    assert {r["sentenceID"] for r in examples} == {3, 8}
    assert EV.worst_slices(EV.slice_breakdown(joined), 1).first()["accuracy"] == 0.0
    found = {r["issue"] for r in EV.findings(EV.metric_rows(joined), EV.finding_rules(joined.sparkSession)).collect()}
    assert found == {"Misspelling Handling", "Compound Name Matching", "Baseline Ceiling"}


def test_whole_set_simple_and_fuzzy(spark, tables):
    truth, _ = tables
    predicted = spark.createDataFrame([(1, "Pari", "Lyon"), (2, "Marseille", "Nice"), (4, None, None), (5, None, "Bordeaux")],
                                      "sentenceID int, origin string, destination string")
    joined = EV.compare(truth, predicted)
    row = EV.whole_set(joined).first()
    assert (row["total"], row["valid_orders"], row["correct"], row["true_positive"]) == (10, 6, 4, 2)
    assert row["origin_accuracy"] <= 1.0 and row["origin_wrong"] + row["dest_wrong"] + row["both_wrong"] + row["correct"] == 10
    names = spark.createDataFrame([("Paris", "city", 0), ("Lyon", "city", 1)], "name string, kind string, seq bigint")
    fuzzy = EV.fuzzy_accuracy(joined, build_gazetteer(names)).filter("slice_kind = 'all'").first()
    assert (fuzzy["total"], fuzzy["correct"]) == (6, 2)
    raw = spark.createDataFrame([("Paris", "Lyon", "Paris", "Lyon"), (None, None, "INVALID", "INVALID"), (None, "Nice", "Lyon", "Nice")],
                                "origin string, destination string, expected_origin string, expected_destination string")
    assert EV.simple_accuracy(raw).first()["correct"] == 2


def test_model_comparison(tables):
    truth, predicted = tables
    base = EV.slice_breakdown(EV.compare(truth, predicted))
    other = EV.slice_breakdown(EV.compare(truth, truth.select("sentenceID", "origin", "destination")))
    rows = {(r["slice_kind"], r["slice"]): r["improvement"] for r in EV.compare_models(base, other, 1).collect()}
    assert rows[("all", "all")] == pytest.approx(1 / 3) and ("category", "standard") in rows and len(rows) == 5
