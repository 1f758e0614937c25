import hashlib
import random

import duckdb
import pytest

from itinera.llm import substrings as S
from itinera.llm.queries import ORACLES, QUERIES

SPACE = " \t\n\r\x0b\x0c"


def split(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(rows, window=20):
    """Every run of words by its first place, in lists; rows alike are one document."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    assert len({d[:2] for d in docs}) == len(docs)  # texts of one id are ordered by hash, which this does not know
    first, out = {}, {}
    for known, i, text in docs:
        w = split(text)
        gone = set()
        for k in range(len(w) - window + 1):
            run = tuple(w[k:k + window])
            if first.setdefault(run, (known, i, k)) != (known, i, k):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i if known else None, text] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return sorted(((i, *out[i, t or ""]) for i, t in rows), key=str)


def rows_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS key", "2 AS h", "3 AS start", "4 AS pid", "5 AS id")
    return sorted(map(tuple, S.remove_repeats(df, **options).collect()), key=str)


def corpus(seed, n, vocabulary, longest):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    texts = [draw.choices(words, k=draw.randint(0, longest)) for _ in range(n)]
    passage = draw.choices(words, k=50)
    for k in range(n // 2):
        a, b = draw.randrange(n), draw.randrange(n)
        i, m = draw.randrange(len(texts[a]) + 1), draw.randint(10, 60)
        texts[b][draw.randrange(len(texts[b]) + 1):0] = texts[a][i:i + m]
        if k % 3 == 0:
            texts[b] += passage
    return [(k, draw.choice(SPACE).join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed, vocabulary, window, minimizer", [(1, 5000, 20, 5), (2, 2, 6, 2), (3, 40, 5, 3), (4, 300, 20, 5)])
def test_against_plain_loops(spark, seed, vocabulary, window, minimizer):
    rows = corpus(seed, 40, vocabulary, 120)
    want = plain(rows, window)
    assert sum(r[2] > 0 for r in want) > 3
    assert rows_of(spark, rows, window=window, minimizer=minimizer) == want


def test_given_documents_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = sorted((r[:4] for r in plain(docs)), key=str)
    assert sum(r[2] > 0 for r in want) > 5
    assert sorted(map(tuple, QUERIES["op11_substring_dedup"](spark, folder).collect()), key=str) == want
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(db.sql(ORACLES["op11_substring_dedup"]).fetchall(), key=str) == want


def test_nulls_repeats_long_texts_and_parts(spark):
    word = lambda k: f"é{k}"
    long = " ".join(word(k % 500) for k in range(3000))
    rows = [(None, long), (1, None), (2, ""), (3, long), (3, long), (4, "a " * 100), (5, "a a"), (6, " ".join(map(word, range(30)))),
            (7, "x " + " ".join(map(word, range(5, 25)))), (8, "x " + " ".join(map(word, range(5, 24))) + " y")]
    assert rows_of(spark, rows, part=64) == rows_of(spark, rows) == plain(rows)
    assert rows_of(spark, [(1, None)]) == [(1, 0, 0, S._SHA_EMPTY, "")]
    assert S.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_texts_of_one_id(spark):
    words = " ".join(f"v{k}" for k in range(25))
    got = rows_of(spark, [(1, words + " p"), (1, words + " q")])
    assert [r[2] for r in got].count(25) == 1 and [r[2] for r in got].count(0) == 1


def test_false_repeats_stay(spark):
    """With hashes that hold most runs for equal, only the digests tell."""
    rows = [(k, " ".join(f"u{k}-{j}" for j in range(60)) + " shared passage" * (k > 1)) for k in range(4)]
    assert [r[:3] for r in rows_of(spark, rows, bits=2, minimizer=1)] == [(k, 60 + 2 * (k > 1), 0) for k in range(4)]
