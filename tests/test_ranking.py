import random

import pytest
from pyspark.sql import functions as F

from itinera.plans import ranking as R
from itinera.plans.tables import TableStore, checkpoint_root


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randint(0, 200)}", rng.random(), i) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, v double, id bigint").repartition(5).cache()


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hot_groups_are_found(skewed):
    hot = R.hot_groups(skewed, ["k"], 500)
    assert {r["k"] for r in skewed.filter(hot).collect()} == {"hot"}
    assert R.hot_groups(skewed, ["k"], 2000) is None


def test_rank_paths_agree(skewed):
    plain = pairs(R.rank_in_group(skewed, ["k"], ["v", "id"]), "id", "rank")
    assert pairs(R.rank_in_group(skewed, ["k"], ["v", "id"], group_limit=100), "id", "rank") == plain


def test_next_paths_agree(skewed):
    plain = {r["id"]: r["next_id"] for r in R.next_in_group(skewed, ["k"], ["v"], ["id"]).collect()}
    split = {r["id"]: r["next_id"] for r in R.next_in_group(skewed, ["k"], ["v"], ["id"], group_limit=100).collect()}
    assert split == plain and len(plain) == 3000


def test_ordinal_is_dense_and_ordered(skewed):
    out = R.ordinal(skewed, ["v", "id"]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in out] == list(range(1, 3001))
    assert [(r["v"], r["id"]) for r in out] == sorted((r["v"], r["id"]) for r in out)


def test_top_keeps_few_rows_per_task(skewed):
    top = R.top_in_group(skewed, ["k"], ["v"], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert top.filter(F.col("k") == "hot").count() == 2


def test_first_in_group(skewed):
    got = {r["k"]: r["id"] for r in R.first_in_group(skewed, ["k"], ["v"]).collect()}
    best = {}
    for r in skewed.collect():
        if r["k"] not in best or r["v"] < best[r["k"]][0]:
            best[r["k"]] = (r["v"], r["id"])
    assert got == {k: i for k, (_, i) in best.items()}


class FakeSession:
    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_store_folder(spark):
    store = TableStore(spark, "x")
    table, seen = store.write(spark.range(10), "t", n=F.count(F.lit(1)))
    assert store.path.startswith(checkpoint_root(spark)) and seen == {"n": 10} and table.count() == 10
    store.drop("t")
    with pytest.raises(Exception, match="t"):
        spark.read.parquet(f"{store.path}/t")
    assert checkpoint_root(FakeSession(spark_checkpoint_dir="s3://bucket/x/", spark_master="yarn")) == "s3://bucket/x"
    assert checkpoint_root(FakeSession(spark_master="local[2]"))
    with pytest.raises(ValueError):
        checkpoint_root(FakeSession(spark_master="spark://host"))


@pytest.mark.parametrize("limit", [5, 1000])
def test_null_keys_on_both_paths(spark, limit):
    rows = [(None if i % 2 else "a", i, i * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, x int")
    ranked = {(r.g, r.i): r["rank"] for r in R.rank_in_group(df, ["g"], ["i"], group_limit=limit).collect()}
    assert ranked == {(g, i): i // 2 + 1 for g, i, _ in rows}
    following = {(r.g, r.i): r.next_x for r in R.next_in_group(df, ["g"], ["i"], ["x"], group_limit=limit).collect()}
    assert following == {(g, i): (i + 2) * 3 if i < 38 else None for g, i, _ in rows}


@pytest.mark.parametrize("values", [[], [7], [5] * 400, list(range(-300, 300)), [0, 2**61, 2**61 + 1, -5, 3],
                                    [(i * 7919) % 1009 * 10**12 for i in range(2000)], [None, 3, None, 1, 3, 3, 2]])
def test_nth_smallest(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v bigint")
    held = sorted(v for v in values if v is not None)
    for n in {0, 1, 2, len(held) // 2, len(held), len(held) + 1}:
        got = R.nth_smallest(df, "v", n)
        if not 1 <= n <= len(held):
            assert got is None
        else:
            want = held[n - 1]
            assert got == (want, sum(v < want for v in held), held.count(want))


@pytest.mark.parametrize("n", [0, 1, 250, 399, 400, 5000])
def test_first_n_numbers_ties(spark, n):
    rows = [(i, 4 if i % 3 == 0 else i % 50) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, v bigint")
    got = sorted(tuple(r) for r in R.first_n(df, F.col("v"), n, ["id"]).collect())
    assert got == sorted(sorted(rows, key=lambda r: (r[1], r[0]))[:n])
