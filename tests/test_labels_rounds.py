from pyspark.sql import functions as F

from itinera.functions import text as T
from itinera.operators import labels as LB
from itinera.plans import resolution as RS


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_look_at_the_sentence_once(spark, gazetteer):
    """Fuzzy keys of all tokens come from one expression, not one for each window; hyphens, marks and odd tokens keep their hits."""
    rows = [(1, "De Saint-Étienne à Lyonn, vite!", "Saint-Étienne", "Lyon", 1), (2, "PARIS... Nïce", "Paris", "Nice", 1),
            (3, "Bonjour", "", "", 0), (4, None, None, "Paris", 1), (5, "Billet @home ’x’ Le  Havre-Paris", "Le Havre", "Paris", 1)]
    orders = spark.createDataFrame(rows, "sentenceID int, sentence string, origin string, destination string, is_valid int")
    out = LB.bio_labels(orders, gazetteer)
    assert plan_of(out).count("[^a-z0-9]") <= 2 and plan_of(out).count("BroadcastHashJoin") == 2
    got = {r["sentenceID"]: (list(r["tokens"]), list(r["labels"])) for r in out.collect()}
    assert got[1] == (["De", "Saint", "-", "Étienne", "à", "Lyonn", ",", "vite", "!"],
                      ["O", "B-ORIGIN", "I-ORIGIN", "I-ORIGIN", "O", "B-DEST", "O", "O", "O"])
    assert got[2] == (["PARIS", "...", "Nïce"], ["B-ORIGIN", "O", "B-DEST"])
    assert got[3] == (["Bonjour"], ["O"]) and got[4] == ([], [])
    assert got[5][0] == ["Billet", "@home", "’x’", "Le", "Havre", "-", "Paris"]
    assert got[5][1] == ["O", "O", "O", "B-ORIGIN", "I-ORIGIN", "O", "B-DEST"]


def test_names_of_labels_are_looked_up_by_counted_rows(spark, gazetteer):
    tokens = spark.createDataFrame([(1, ["de", "Paris", "Lyonn"], ["O", "B-ORIGIN", "B-DEST"]), (2, ["x"], ["O"]), (2, ["Nice"], ["B-DEST"])],
                                   "sentenceID int, tokens array<string>, labels array<string>")
    out = RS.extract_from_labels(tokens, gazetteer)
    assert "SortMergeJoin" not in plan_of(out) and plan_of(out).count("BroadcastHashJoin") == 2
    assert sorted((r["sentenceID"], r["origin"] or "", r["destination"] or "", r["valid"]) for r in out.collect()) == [
        (1, "Paris", "Lyon", True), (2, "", "", False), (2, "", "Nice", False)]
