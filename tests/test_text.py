import pytest
from pyspark.sql import functions as F

from itinera.functions import text as T
from itinera.functions import transport as X


def values(spark, items, fn):
    rows = [(i, v) for i, v in enumerate(items)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("o", fn(F.col("t")))
    return [r["o"] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("fn, text, expected", [
    (T.normalize_text, "  Je  veux  aller à Paris  ", "je veux aller à paris"),
    (T.normalize_text, "a b c\td", "a b c d"),
    (T.normalize_text, None, ""),
    (lambda c: T.normalize_text(c, lowercase=False), "TOULOUSE PARIS", "TOULOUSE PARIS"),
    (T.remove_accents, "à Paris depuis Sète", "a Paris depuis Sete"),
    (T.remove_accents, "français", "français"),
    (lambda c: T.remove_accents(c, False), "été élève à l'école, français", "ete eleve a l'ecole, francais"),
    (lambda c: T.remove_accents(c, False), "été", "ete"),
    (T.normalize_hyphens, "Port–Boulet—Tours−Paris‐a‑b", "Port-Boulet-Tours-Paris-a-b"),
    (T.normalize_apostrophes, "l’hôtel ‘x` y´", "l'hôtel 'x' y'"),
    (lambda c: T.normalize_apostrophes(c, legacy=True), "l’hôtel", "l’hôtel"),
    (T.remove_non_alphanumeric, "Paris (capital)", "Paris capital"),
    (lambda c: T.remove_non_alphanumeric(c, keep_hyphens=False), "Port-Boulet?", "Port Boulet"),
    (T.remove_non_alphanumeric, "l'hôtel", "l'hôtel"),
    (T.tokenize, "Je veux aller à Paris", ["Je", "veux", "aller", "à", "Paris"]),
    (T.tokenize, "Port-Boulet", ["Port", "Boulet"]),
    (lambda c: T.tokenize(c, True), "Aix-en-Provence, Paris?", ["Aix-en-Provence", ",", "Paris", "?"]),
    (T.tokenize, None, []),
    (T.matching_form, "  À quelle heure pour Port–Boulet?  ", "a quelle heure pour port-boulet"),
    (T.matching_form, "Aix—en—Provence, Sète!", "aix-en-provence sete"),
    (T.matching_form, "œuvre française", "uvre française"),
    (T.split_name, "Saint-Pierre des Corps", ["Saint", "Pierre", "des", "Corps"]),
    (T.fuzzy_key, "Aix-en-Provence", "aixenprovence"),
    (T.quoted_fragments, "De \"Paris\" à 'Lyon' demain", ["Paris", "Lyon"]),
    (T.clean_id, "  123  ", "123"),
    (T.comparison_form, " Aix-en-Provence ", "aix-en-provence"),
    (T.comparison_form, "invalid", "INVALID"),
    (T.comparison_form, None, ""),
    (T.station_form, "Saint-Étienne (Loire) ", "saint-etienne loire"),
    (T.label_tokens, "de Port-Boulet à Lyon?", ["de", "Port", "-", "Boulet", "à", "Lyon", "?"]),
    (lambda c: T.join_tokens(T.label_tokens(c)), "Aix-en-Provence Le Mans", "Aix-en-Provence Le Mans"),
    (T.drop_leading_prepositions, "de Paris", "Paris"),
    (T.drop_leading_prepositions, "À de  Nice", "Nice"),
    (T.drop_leading_prepositions, "de a", "de a"),
    (T.word_count, " a  b c ", 3),
    (X.station_code, "StopPoint:OCETGV INOUI-87756056", "87756056"),
    (X.station_code, "StopArea:X", None),
    (X.clock_to_seconds, "25:10:05", 90605),
    (X.city_from_station, "Paris Gare de Lyon", "Paris"),
    (X.city_from_station, "Lyon Part Dieu", "Lyon"),
    (X.city_from_station, "Aix-en-Provence", "Aix-en-Provence"),
    (X.city_from_station, "Saint-Malo TGV", "Saint-Malo TGV"),
    (X.city_from_station, "Le Mans", "Le"),
    (lambda c: X.city_from_station(c, articles=("Le",)), "Le Mans", "Le Mans"),
    (lambda c: X.service_class(c, F.lit("")), "TGV INOUI", "TGV"),
    (lambda c: X.service_class(F.lit(""), c), "Nice Ville", "TRAIN"),
    (lambda c: X.clock_label(c.cast("int")), "125", "2h05"),
    (lambda c: X.clock_label(c.cast("int")), "45", "45 min"),
])
def test_values(spark, fn, text, expected):
    assert values(spark, [text], fn) == [expected]


def test_costs(spark):
    rows = spark.createDataFrame([(100, "TGV"), (100, "IC"), (100, "TER"), (10, "CORRESP"), (100, None), (100, "X")],
                                 "m int, c string")
    out = [float(r[0]) for r in rows.select(X.routing_cost("m", "c")).collect()]
    assert out == [105.0, 113.0, 123.0, 25.0, 123.0, 123.0]


def test_distance(spark):
    km = spark.range(1).select(X.haversine_km(F.lit(2.3522), F.lit(48.8566), F.lit(4.8357), F.lit(45.764))).first()[0]
    assert abs(km - 391.5) < 1.0


def test_output_line(spark):
    df = spark.createDataFrame([("1", "Paris", None)], "i string, o string, d string")
    assert df.select(T.output_line("i", "o", "d")).first()[0] == "1,Paris,INVALID"


def test_other_characters_are_all_but_the_kept(spark):
    """Every code point (but U+FEFF, which the decoder takes for a mark), against the negated class of H5."""
    points = spark.range(1, 0x110000).filter("id not between 55296 and 57343 and id != 65279")
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    rows = points.select(F.concat(F.lit("a"), char, F.lit("b")).alias("c"))
    for hyphens in (True, False):
        for marks in (True, False):
            keep = "a-zA-ZÀ-ÿ0-9" + (r"\-" if hyphens else "") + ("'" if marks else "")
            wanted = F.regexp_replace("c", f"[^{keep}]+", " ")
            got = T.remove_non_alphanumeric("c", keep_hyphens=hyphens, keep_apostrophes=marks)
            assert rows.filter(got != wanted).count() == 0
    assert rows.filter(T.remove_non_alphanumeric("c") != "a b").count() == 26 + 26 + 64 + 10 + 2
