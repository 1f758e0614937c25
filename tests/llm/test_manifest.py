import hashlib
import zlib

import duckdb
import pytest

from itinera.llm import manifest as M
from itinera.llm.queries import ORACLES, QUERIES
from itinera.plans.tables import TableStore

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain(rows):
    """The whole tree in lists."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*[enc(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    for rs in groups.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            claim, sides = dict(r), []
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                claim["n_chars"] += 1
            x = leaf(claim)
            for levels, at in ((trees[g], i), (top, k)):
                for nodes in levels[:-1]:
                    other = at ^ 1
                    if other < len(nodes):
                        sides.append(nodes[other])
                        x = digest(nodes[other], x) if other < at else digest(x, nodes[other])
                    else:
                        x = digest(x)
                    at >>= 1
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], root, digest(*sides), x, x == root))
    return sorted(out, key=str)


def rows_of(df, **options):
    return sorted(map(tuple, M.manifest(df, **options).collect()), key=str)


ODD = ([(1, "a", None, 3, "x"), (1, "a", None, 3, "x"), (1, "b", None, None, "y"), (None,) * 5, (None, "q", None, 2, "z"), (-5, "a", "", 1, ""),
        (2**62, "a", "é", 9223372036854775807, "t"), (-2**63, "a", "é", 1, "long " * 20000), (7, "a", "é", 1, "t"), (7, "a", "é", 2, "t"),
        (8, "a", "é", 2, "t"), (71, "a", "é", 2, "t")]
       + [(i * 1000003, "s", "fr", i, "w") for i in range(40)] + [(14, "s", "de", i, "w") for i in range(9)])


@pytest.mark.parametrize("slots", [1024, 2])
def test_nulls_repeats_and_scattered_ids(spark, slots):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'x' AS grp", "1 AS slot", "2 AS leaf")
    assert rows_of(df, slots=slots) == plain([dict(zip(SCHEMA.replace(",", "").split()[::2], r)) for r in ODD])


def test_given_documents_and_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([r.asDict() for r in docs.collect()])
    assert sorted(map(tuple, QUERIES["op13_manifest"](spark, "/root/testdata/sf0.001").collect()), key=str) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 3
    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(db.sql(ORACLES["op13_manifest"]).fetchall(), key=str) == want


def test_empty_one_row_and_many_groups(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(empty) == [] and M.manifest(empty).schema["doc_id"].dataType.simpleString() == "bigint"
    one = spark.createDataFrame([(3, None, "x", 1, None)], SCHEMA)
    (row,) = rows_of(one)
    assert row[1] == row[2] == row[3] and row[4] == digest()
    many = [(i, "s", f"lang{i}", 1, "t") for i in range(37)]
    assert rows_of(spark.createDataFrame(many, SCHEMA), slots=4) == plain([dict(zip(SCHEMA.replace(",", "").split()[::2], r)) for r in many])


def test_ranks_of_directory(spark):
    ids = [(g, (i * i * 7919) % (1 << 40) - (1 << 20)) for g in range(3) for i in range(300)]
    df = spark.createDataFrame(ids, "grp bigint, id bigint").selectExpr("*", "unhex(sha2(string(id), 256)) AS leaf")
    got = M.coordinates(df, TableStore(spark, "t")).collect()
    for g in range(3):
        mine = sorted((r.id, r.slot) for r in got if r.grp == g)
        assert [s for _, s in mine] == list(range(300))
