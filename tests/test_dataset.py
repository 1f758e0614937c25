import pytest
from pyspark.sql import functions as F

from itinera.operators import dataset as DS


@pytest.fixture(scope="module")
def rows(spark):
    """200 rows; one sentence makes up a third of them."""
    data = []
    for i in range(1, 201):
        valid = int(i % 4 != 0)
        sentence = "je pars" if i % 3 == 0 else f"trajet numero {i // 2}"
        data.append((i, sentence, "Paris" if valid else "", "Lyon" if valid else "", valid, ["easy", "medium", "hard"][i % 3],
                     ["standard", "misspelling", "garbage"][i % 3 if valid else 2], ""))
    return spark.createDataFrame(data, "sentenceID int, sentence string, origin string, destination string, is_valid int, "
                                       "difficulty string, category string, notes string").cache()


def test_dedupe_and_resequence(rows):
    out = DS.dedupe_resequence(rows).orderBy("sentenceID").collect()
    seen, expected = set(), []
    for r in rows.orderBy("sentenceID").collect():
        if r["sentence"] not in seen:
            seen.add(r["sentence"])
            expected.append(r["sentence"])
    assert [r["sentence"] for r in out] == expected
    assert [r["sentenceID"] for r in out] == list(range(1, len(expected) + 1))
    check = {r["check"]: r["status"] for r in DS.structure_check(DS.dedupe_resequence(rows), len(expected)).collect()}
    assert set(check.values()) == {"ok"}
    bad = {r["check"]: r["status"] for r in DS.structure_check(rows.drop("notes"), 7).collect()}
    assert bad == {"row_count": "failed", "missing_columns": "failed", "duplicate_sentences": "failed", "sequential_ids": "ok"}
    assert DS.duplicate_sentences(rows, 1).first()["sentence"] == "je pars"


def test_seeded_orders(rows):
    shuffled = DS.shuffle_resequence(rows)
    assert DS.sequence_check(shuffled).first()["is_sequential"]
    assert shuffled.orderBy("sentenceID").first()["sentence"] == DS.shuffle_resequence(rows).orderBy("sentenceID").first()["sentence"]
    trimmed = DS.trim_exact(rows, 50)
    assert trimmed.count() == 50 and DS.sequence_check(trimmed).first()["is_sequential"]
    assert DS.trim_exact(rows, 1000).count() == 200
    sample = DS.sample_per_category(rows, 3)
    assert {r["category"]: r["count"] for r in sample.groupBy("category").count().collect()} == \
        {"standard": 3, "misspelling": 3, "garbage": 3}


def test_top_up(spark, rows):
    existing = rows.filter("sentenceID <= 10")
    out = DS.top_up(existing, rows, 30).orderBy("sentenceID").collect()
    assert [r["sentenceID"] for r in out] == list(range(1, 31)) and len({r["sentence"] for r in out}) == 30


@pytest.mark.parametrize("limit", [5_000_000, 20])
def test_split(rows, limit):
    split = DS.stratified_split(rows, group_limit=limit)
    sizes = {(r["is_valid"], r["split"]): r["count"] for r in split.groupBy("is_valid", "split").count().collect()}
    assert sizes == {(1, "test"): 22, (1, "val"): 22, (1, "train"): 106, (0, "test"): 7, (0, "val"): 7, (0, "train"): 36}
    assert DS.leaked_ids(split).isEmpty()
    part = lambda s: split.filter(F.col("split") == s)
    assert DS.common_ids(part("train"), part("test")).isEmpty()
    table = {r["category"]: r for r in DS.split_crosstab(split).collect()}
    assert sum(r["total"] for r in table.values()) == 200
    assert all(abs(r["train_share"] + r["val_share"] + r["test_share"] - 1) < 1e-9 for r in table.values())
    assert sum(r["total"] for r in DS.split_stats(split).collect()) == 200


def test_split_ratios(rows):
    with pytest.raises(ValueError):
        DS.stratified_split(rows, train=0.9)


def test_statistics(rows):
    stats = {(r["slice_kind"], r["slice"]): (r["n"], r["percent"]) for r in DS.dataset_stats(rows).collect()}
    assert stats[("all", "all")] == (200, 100.0) and stats[("validity", "valid")] == (150, 75.0)
    assert sum(n for (k, _), (n, _) in stats.items() if k == "category") == 200
    lengths = {r["slice"]: r for r in DS.length_stats(rows).collect()}
    assert (lengths["all"]["min_words"], lengths["all"]["max_words"]) == (2, 3)
    assert {r["place"]: r["uses"] for r in DS.place_usage(rows, 5).collect()} == {"Paris": 150, "Lyon": 150}


def test_distribution(spark, rows):
    targets = spark.createDataFrame([("standard", 50), ("garbage", 10), ("absent", 5)], "category string, expected int")
    shares = spark.createDataFrame([("easy", 0.3333), ("hard", 0.1)], "difficulty string, share double")
    out = {(r["check"], r["slice"]): r["status"] for r in DS.distribution_check(rows, targets, shares).collect()}
    assert out[("category", "standard")] == "ok" and out[("category", "garbage")] == "failed" and out[("category", "absent")] == "failed"
    assert out[("difficulty", "easy")] == "ok" and out[("difficulty", "hard")] == "failed"
    assert out[("labels", "valid_without_origin")] == "ok" and len(out) == 9


def test_order_check(spark):
    df = spark.createDataFrame([(1, 10), (3, 20), (2, 30)], "sentenceID int, seq bigint")
    assert {r["sentenceID"]: r["expected"] for r in DS.in_file_order(df, "seq").collect()} == {3: 2, 2: 3}


def test_templates(spark):
    templates = spark.createDataFrame([(0, "de {origin} a {destination}", "standard", "easy", False), (1, "Billet {origin} {destination}", "x", "easy", True)],
                                      "t int, template string, category string, difficulty string, lower boolean")
    places = spark.createDataFrame([(0, "Paris"), (1, "Lyon"), (2, "Nice")], "k int, name string")
    out = DS.expand_templates(templates, places, 2, 3)
    assert out.count() == 12 and out.filter("origin = destination").isEmpty() and out.select("sentence").distinct().count() == 12
    assert DS.sequence_check(out).first()["is_sequential"] and out.filter("sentence = 'billet paris lyon'").count() == 1
    typo = spark.createDataFrame([("Pau",), ("Toulouse",), ("Bordeaux",)], "n string").select("n", DS.misspell(F.col("n")).alias("m")).collect()
    assert all(r["m"] == r["n"] if len(r["n"]) <= 4 else abs(len(r["m"]) - len(r["n"])) == 1 for r in typo)


def test_split_keeps_rows_of_a_null_stratum(spark):
    from itinera.operators.dataset import stratified_split

    rows = [(i, "s", None if i % 2 else 1) for i in range(20)]
    df = spark.createDataFrame(rows, "sentenceID bigint, sentence string, is_valid int")
    for limit in (3, 1000):
        out = stratified_split(df, group_limit=limit)
        assert out.count() == 20
        assert {(r.is_valid, r.split): r["count"] for r in out.groupBy("is_valid", "split").count().collect()} == {
            (v, s): n for v in (None, 1) for s, n in (("test", 1), ("val", 1), ("train", 8))}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_cuts_with_repeated_and_null_ids(spark, kind):
    data = [(str(7 if i % 3 == 0 else i) if kind == "string" else (7 if i % 3 == 0 else i), f"s{i % 90}", 1) for i in range(120)]
    df = spark.createDataFrame([*data, (None, "none", 1), (None, None, 1)], f"sentenceID {kind}, sentence string, is_valid int")
    for n in (0, 1, 2, 45, 121, 122, 500):
        out = DS.trim_exact(df, n)
        assert [r["sentenceID"] for r in out.orderBy("sentenceID").collect()] == list(range(1, min(n, 122) + 1))
        old = df.filter("sentence IN ('s1', 's2')")
        both = [r["sentence"] for r in DS.top_up(old, df, n).orderBy("sentenceID").collect()]
        assert len(both) == len(set(both)) == min(n, 92) and set(both[:2]) <= {"s1", "s2"}


def test_templates_drawn_without_repeats(spark):
    templates = spark.createDataFrame([(0, "de {origin} a {destination}", "x", "easy", False), (1, "billet {origin} {destination}", "y", "easy", True)],
                                      "t int, template string, category string, difficulty string, lower boolean")
    places = spark.createDataFrame([(i, f"P{i}") for i in range(9)], "k int, name string")
    every = {r["sentence"] for r in DS.expand_templates(templates, places, 2, 9).collect()}
    for n in (0, 1, 50, 144, 900):
        rows = DS.expand_templates(templates, places, 2, 9, n=n).orderBy("sentenceID").collect()
        drawn = [r["sentence"] for r in rows]
        assert [r["sentenceID"] for r in rows] == list(range(1, min(n, 144) + 1))
        assert len(set(drawn)) == len(drawn) and set(drawn) <= every
    other = [r["sentence"] for r in DS.expand_templates(templates, places, 2, 9, n=50, seed=7).orderBy("sentenceID").collect()]
    assert other != [r["sentence"] for r in DS.expand_templates(templates, places, 2, 9, n=50).orderBy("sentenceID").collect()]
