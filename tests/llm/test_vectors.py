import numpy as np
import pytest

from itinera.llm import embedding_dedup


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, cls string, cell int")


def made(seed, n, d, labels):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + rng.normal(size=d) * rng.choice([0.0, 0.2, 0.35])
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(labels)), "clash", 0))
    odd = [(None, rows[0][1], rows[0][2]), (n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [float("nan")] + [1.0] * (d - 1), 1), (n + 3, rows[3][1], None),
           (n + 4, [None] + [1.0] * (d - 1), 1), (n + 5, [1e-30] * d, 1), (n + 6, [2e-30] * d, 1), (n + 7, [1.0], 1), (n + 8, [], 1), (n + 9, [float("inf")] * d, 1)]
    return rows + [r + ("clash", 0) for r in odd] + rows[:3]


def brute(rows):
    good = [i for i, r in enumerate(rows) if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, i in enumerate(good):
        for j in good[:x]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(root(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates(spark, block):
    rows = made(1, 200, 6, 2)
    got = embedding_dedup.near_duplicates(table(spark, rows), cell_rows=20, block=block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(table(spark, [])).count() == 0
    only = embedding_dedup.near_duplicates(table(spark, [(5, None, 1, "", 0)])).collect()
    assert [tuple(r) for r in only] == [(5, 0, 5, True)]
