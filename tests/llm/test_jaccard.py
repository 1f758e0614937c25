import random
import re

import numpy as np
import pyarrow as pa
import pytest

from itinera.llm import common, jaccard
from itinera.plans.tables import TableStore


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i:i + 4]) for i in range(max(len(w) - 3, 1))) if w else frozenset())
    return out


def brute(ids, texts):
    every = sets(texts)
    up = list(range(len(every)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(every):
        for j in range(i):
            b = every[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(every)):
        groups.setdefault(root(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((ids[i], len(s), least[root(i)]) for i, s in enumerate(every)), key=str)


def found(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs).collect()), key=str)


def made(seed, groups, copies, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(text))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = made(seed, 25, 8, 160) + [None, "", " \n", "one two", "One\x0btwo", "é È", "x " * 900, "x " * 901]
    texts += ["common passage " * 3 + t for t in made(seed + 9, 6, 1, 30)]
    ids = [i if i != 7 else None for i in range(len(texts))]
    ids[9] = 8
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts)], "doc_id bigint, text string, cls string, key int")
    assert found(docs) == brute(ids, texts)


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(400):
        text = list(base)
        text[i % 118] = f"own{i}"
        text[(i * 7) % 118] = f"other{i}"
        texts.append(" ".join(text))
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(7)
    assert found(docs) == brute(ids, texts)


def test_empty(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    assert found(docs) == brute([r.doc_id for r in rows], [r.text for r in rows])


def test_prefix_keeps_enough_shared():
    rng = np.random.default_rng(4)
    level = rng.integers(0, 30, jaccard.COUNTERS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(0, 2**63, 3).astype(np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
            continue
        (x, k), (y, m) = (jaccard.prefix(s, level, float(rng.random()), 85) for s in (a, b))
        assert len(np.intersect1d(x, y)) >= min(k, m)
        o, rest = -(-85 * (len(a) + len(b)) // 185), [-(-85 * len(s) // 100) for s in (a, b)]
        assert len(np.intersect1d(x, y)) >= o - max(rest[0] - k, rest[1] - m)
        apart = int(np.bitwise_count((jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_shared_tokens_stream_in_any_batches():
    rng = np.random.default_rng(5)
    rows = sorted((int(t), int(c)) for t, c in zip(rng.integers(0, 20, 120), rng.integers(0, 9, 120)))
    want = sorted({(t, c, min(y for x, y in rows if x == t)) for t, c in rows if len({y for x, y in rows if x == t}) > 1})
    for step in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i:i + step]], pa.int64()), pa.array([r[1] for r in rows[i:i + step]], pa.int64()),
                                               pa.array([1] * len(rows[i:i + step]), pa.int32()), pa.array([1] * len(rows[i:i + step]), pa.int32())],
                                              ["token", "cls", "n", "k"]) for i in range(0, len(rows), step)]
        got = [x for b in jaccard._shared_tokens(batches) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist())]
        assert sorted(got) == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint"), TableStore(spark, "t"), "t").collect()}
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint"), TableStore(spark, "t"), "t").count() == 0


def test_pairs_meet_once_not_at_each_shared_token(spark):
    rng = random.Random(8)
    tokens = {c: sorted(rng.sample(range(60), 40)) for c in range(30)}
    bits = ", ".join(f"{b} bigint" for b in jaccard._BITS)
    rows = [(t, c, 100, 1, c // 3, 0, *[0] * jaccard.WORDS) for c, ts in tokens.items() for t in ts]
    split = spark.createDataFrame(rows, f"token bigint, cls bigint, n int, k int, part bigint, main bigint, {bits}")
    got = [tuple(r) for r in jaccard._met(jaccard._placed(split), 85).collect()]
    want = {(a, b) for a in tokens for b in tokens if a < b and a // 3 != b // 3 and set(tokens[a]) & set(tokens[b])}
    assert set(got) == want
    assert len(got) < 1.1 * len(want)


def test_group_whose_first_class_is_an_outlying_copy_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(160)]

    def copy(edits, places):
        text = list(base)
        for place in rng.sample(places, edits):
            text[place] = f"x{rng.random()}"
        return " ".join(text)

    one = lambda t: jaccard._class(jaccard.shingle_set(t.encode(), 4))
    copies = [copy(1, range(160)) for _ in range(400)]
    first = min(map(one, copies))
    outlying = next(t for t in iter(lambda: copy(3, range(160)), None) if one(t) < first)
    met = {}
    write = TableStore.write

    def counted(self, df, name, **counters):
        out = write(self, df, name, **counters)
        met[name] = out[0].count() if name.endswith(("pairs", "links")) or name == "met" else 0
        return out

    monkeypatch.setattr(TableStore, "write", counted)
    texts = [*copies, outlying]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs) == brute(list(range(len(texts))), texts)
    assert met["leaders-links"] < 100 and met["met"] < 100 and sum(v for k, v in met.items() if k.endswith("pairs")) < 10 * len(texts)
