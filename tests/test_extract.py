import pytest
from pyspark.sql import functions as F

from itinera.operators import extract as EX
from itinera.operators import labels as LB
from itinera.operators.gazetteer import (add_aliases, build_gazetteer, default_aliases, default_names, gazetteer_stats,
                                         lookup, with_aliases)
from itinera.operators.matching import find_places, place_mentions

SENTENCES = [
    ("Je veux aller de Paris à Lyon", "Paris", "Lyon", "keywords"),
    ("Train pour Marseille depuis Toulouse", "Toulouse", "Marseille", "keywords"),
    ("Port-Boulet vers La Rochelle", "Port-Boulet", "La Rochelle", "heuristic"),
    ("À quelle heure y a-t-il des trains vers Lyon en partance de Paris?", "Paris", "Lyon", "keywords"),
    ("Je voudrais un billet Bordeaux Nice", "Bordeaux", "Nice", "direct_format"),
    ("Un ticket Paris Lyon svp", "Paris", "Lyon", "direct_format"),
    ("Toulouse Paris demain", "Toulouse", "Paris", "heuristic"),
    ("Je vais à Paris", None, "Paris", "heuristic"),
    ("Je pars de Lyon", "Lyon", None, "heuristic"),
    ("Comment me rendre à Tours depuis Orléans", "Orléans", "Tours", "keywords"),
    ("je veux aller de paris a lyon", "Paris", "Lyon", "keywords"),
    ("Paris Lyon Marseille Nice", "Paris", "Nice", "heuristic"),
    ("Quel temps fait-il à Paris?", None, None, "invalid"),
    ("Quelle heure est-il?", None, None, "invalid"),
    ("Bonjour comment allez-vous?", None, None, "invalid"),
    ("azerty qwerty", None, None, "invalid"),
    ("Je pars demain", None, None, "invalid"),
    ("", None, None, "invalid"),
]


@pytest.mark.parametrize("inline_keys", [20_000, 0])
def test_extract(spark, gazetteer, inline_keys):
    orders = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SENTENCES)], "sentenceID int, sentence string")
    out = EX.extract_orders(orders, gazetteer, inline_keys=inline_keys).orderBy("sentenceID").collect()
    got = [(r["sentence"], r["origin"], r["destination"], r["method"]) for r in out]
    assert got == [(s, o, d, m) for s, o, d, m in SENTENCES]
    assert [r["valid"] for r in out] == [m != "invalid" for *_, m in SENTENCES]


def test_mentions_order_and_gap_between_variants(spark, gazetteer):
    text = "la rochelle puis Le Mans, Paris et encore PARIS aix-en-provence"
    orders = spark.createDataFrame([(1, text), (2, "rien du tout")], "sentenceID int, sentence string")
    for inline in (20_000, 0):
        found = {r["sentenceID"]: r["places"] for r in find_places(orders, gazetteer, "sentence", "sentenceID", inline_keys=inline).collect()}
        assert found == {1: ["paris", "aix-en-provence", "la rochelle", "le mans"], 2: []}
    rows = place_mentions(orders, gazetteer, "sentence", "sentenceID").orderBy("rank").collect()
    assert [r["canonical"] for r in rows] == ["Paris", "Aix-en-Provence", "La Rochelle", "Le Mans"]


def test_whole_word_option(spark, gazetteer):
    orders = spark.createDataFrame([(1, "Nantes")], "sentenceID int, sentence string")
    method = lambda strict: EX.extract_orders(orders, gazetteer, token_match=strict).first()["method"]
    assert (method(False), method(True)) == ("heuristic", "invalid")


def test_gazetteer(spark, gazetteer):
    names = spark.createDataFrame([("Paris", "city", 0), ("PARIS", "station", 9), ("Lyon", "city", 1), (None, "city", 2)],
                                  "name string, kind string, seq bigint")
    built = {r["norm"]: (r["canonical"], r["seq"]) for r in build_gazetteer(names).collect()}
    assert built == {"paris": ("PARIS", 0), "lyon": ("Lyon", 1)}
    aliases = add_aliases(default_aliases(spark), spark.createDataFrame([("Lyon", "Lugdunum")], "city string, alias string"))
    stats = gazetteer_stats(default_names(spark), gazetteer, aliases).first().asDict()
    assert stats == {"cities": 50, "stations": 18, "total_locations": 66, "aliases": 36}
    looked = lookup(spark.createDataFrame([("MARSEILLE",), ("Gotham",)], "n string"), "n", gazetteer).orderBy("n").collect()
    assert [(r["canonical"], r["is_member"]) for r in looked] == [(None, False), ("Marseille", True)]
    wider = with_aliases(gazetteer, aliases).filter(F.col("norm") == "parris").first()
    assert wider["canonical"] == "Paris"


SPANS = [
    ("Je veux aller de Paris à Lyon", "O O O O B-ORIGIN O B-DEST", "Paris", "Lyon"),
    ("de Port - Boulet à Aix - en - Provence", "O B-ORIGIN I-ORIGIN I-ORIGIN O B-DEST I-DEST I-DEST I-DEST I-DEST",
     "Port-Boulet", "Aix-en-Provence"),
    ("Bonjour vous", "O O", None, None),
    ("billet Paris Lyon", "O B-ORIGIN B-DEST", "Paris", "Lyon"),
    ("de Paris Lyon Nice", "B-ORIGIN I-ORIGIN B-ORIGIN O", "Lyon", None),
    ("a b c", "I-DEST B-DEST I-ORIGIN", None, "b"),
]


def test_spans(spark):
    rows = [(i, t.split(" "), ls.split(" ")) for i, (t, ls, _, _) in enumerate(SPANS)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, labels array<string>")
    out = EX.decode_spans(df).orderBy("id").collect()
    assert [(r["origin"], r["destination"]) for r in out] == [(o, d) for *_, o, d in SPANS]
    spans = {}
    for r in EX.all_spans(df, "id").orderBy("id", "start").collect():
        spans.setdefault(r["id"], []).append((r["entity"], r["kind"], r["start"], r["stop"]))
    assert spans[1] == [("Port-Boulet", "ORIGIN", 1, 4), ("Aix-en-Provence", "DEST", 5, 10)]
    assert spans[4] == [("de Paris", "ORIGIN", 0, 2), ("Lyon", "ORIGIN", 2, 3)]
    assert spans[5] == [("b", "DEST", 1, 2), ("c", "ORIGIN", 2, 3)]
    assert 2 not in spans


def test_length_mismatch_fails(spark):
    df = spark.createDataFrame([(["Paris", "Lyon"], ["B-ORIGIN"])], "tokens array<string>, labels array<string>")
    with pytest.raises(Exception, match="differ in length"):
        EX.decode_spans(df).collect()


def test_person_names(spark):
    df = spark.createDataFrame([
        (["avec", "Florence", "a", "Nice"], ["O", "B-ORIGIN", "O", "B-DEST"], "Florence", "Nice"),
        (["de", "Florence", "pour", "Nancy"], ["O", "B-ORIGIN", "O", "B-DEST"], "Florence", "Nancy")],
        "tokens array<string>, labels array<string>, origin string, destination string")
    out = [(r["origin"], r["destination"]) for r in EX.drop_person_names(df).orderBy("tokens").collect()]
    assert out == [(None, "Nice"), ("Florence", None)]


def test_labels(spark, gazetteer):
    rows = [(1, "Je vais de Paris à Port-Boulet", "Paris", "Port-Boulet", 1), (2, "vers Lyon depuis Pari", "Paris", "Lyon", 1),
            (3, "Bonjour Paris", "", "", 0)]
    df = spark.createDataFrame(rows, "sentenceID int, sentence string, origin string, destination string, is_valid int")
    labelled = LB.bio_labels(df, gazetteer)
    out = {r["sentenceID"]: r["labels"] for r in labelled.collect()}
    assert out == {1: ["O", "O", "O", "B-ORIGIN", "O", "B-DEST", "I-DEST", "I-DEST"],
                   2: ["O", "B-DEST", "O", "B-ORIGIN"], 3: ["O", "O"]}
    stats = {r["label"]: r["n"] for r in LB.label_stats(labelled).collect()}
    assert stats == {"O": 8, "B-ORIGIN": 2, "I-ORIGIN": 0, "B-DEST": 2, "I-DEST": 2}
    words = labelled.select(F.col("sentenceID").alias("ex_id"), F.posexplode("labels").alias("word_id", "label"))
    sub = spark.createDataFrame([(2, 0, None), (2, 1, 0), (2, 2, 1), (2, 3, 1), (2, 4, None)], "ex_id int, pos int, word_id int")
    aligned = [r["label_id"] for r in LB.align_subwords(sub, words).orderBy("pos").collect()]
    assert aligned == [-100, 0, 3, -100, -100]


def test_completeness(spark):
    df = spark.createDataFrame([("Paris", "Lyon"), (None, "Lyon"), ("Paris", None), ("", "Lyon")], "o string, d string")
    assert [r[0] for r in df.select(EX.is_complete(F.col("o"), F.col("d"))).collect()] == [True, False, False, False]
