"""Joins whose sides are guessed too small must not be broadcast."""

import pytest

from itinera.operators import extract as EX
from itinera.operators import matching as MT
from itinera.plans import lookup as LK


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def orders(spark):
    return spark.createDataFrame([(1, "Je vais de Paris à Lyon"), (2, "Bonjour"), (3, None)], "sentenceID int, sentence string")


def test_rows_meet_their_hits_by_shuffle(orders, gazetteer):
    found = MT.find_places(orders, gazetteer, "sentence", "sentenceID", inline_keys=0)
    assert "BroadcastHashJoin [_row" not in plan_of(found)
    assert sorted((r["sentenceID"], list(r["places"])) for r in found.collect()) == [(1, ["paris", "lyon"]), (2, []), (3, [])]


def test_large_dictionary_is_not_broadcast(orders, gazetteer, monkeypatch):
    monkeypatch.setattr(LK, "BROADCAST_ROWS", 1)
    found = EX.extract_orders(orders, gazetteer, inline_keys=0)
    assert "BroadcastExchange" not in plan_of(found)
    got = {r["sentenceID"]: (r["origin"], r["destination"]) for r in found.collect()}
    assert got == {1: ("Paris", "Lyon"), 2: (None, None), 3: (None, None)}
    mentions = MT.place_mentions(orders, gazetteer, "sentence", "sentenceID", inline_keys=0)
    assert "BroadcastExchange" not in plan_of(mentions)
    assert sorted((r["rank"], r["canonical"]) for r in mentions.collect()) == [(1, "Paris"), (2, "Lyon")]


def test_whole_product_is_unfolded_without_joins_on_its_rows(spark, monkeypatch):
    from itinera.operators import dataset as DS

    monkeypatch.setattr(DS, "PLACE_BLOCK", 2)
    templates = spark.createDataFrame([(0, "de {origin} a {destination}", "x", "easy", False), (1, "Vers {destination} de {origin}", "y", "hard", True)],
                                      "t int, template string, category string, difficulty string, lower boolean")
    places = spark.createDataFrame([(i, f"P{i}") for i in range(5)], "k int, name string")
    out = DS.expand_templates(templates, places, 2, 5)
    assert "SortMergeJoin" not in plan_of(out) and "BroadcastHashJoin" not in plan_of(out)
    want, n = [], 0
    for t in range(2):
        for o in range(5):
            for d in (d for d in range(5) if d != o):
                n += 1
                want.append((n, f"vers p{d} de p{o}" if t else f"de P{o} a P{d}", f"P{o}", f"P{d}", "hard" if t else "easy"))
    assert sorted((r["sentenceID"], r["sentence"], r["origin"], r["destination"], r["difficulty"]) for r in out.collect()) == want
