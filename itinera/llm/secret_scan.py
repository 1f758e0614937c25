"""Secret scan with corpus-wide ownership: widely copied examples against owner-specific credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itinera.llm.common import lookup_join, set_apart, text_or_empty
from itinera.plans.tables import TableStore

#: Kinds in the order of spans that start together; ``token`` spans are the method's own.
KINDS = ("assign", "access", "hex", "token")
#: A value that this many owners hold is an example that was copied around.
EXAMPLE_OWNERS = 3
#: Least bits of entropy for each character of a value that looks live.
LIVE_BITS, TOKEN_BITS = 2.0, 3.5

_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX, _HEX_BYTES = re.compile(r"[0-9a-f]{32,}"), re.compile(rb"[0-9a-f]{32}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_DIGIT, _TOKEN_BYTES = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z0-9+/_-]{20}")
_SPAN = "struct<start:bigint,kind:int,end:bigint,hash:string,bits:double>"


def entropy(value: str) -> float:
    """Bits for each character by the value's own character frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find_spans(raw: bytes) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of a whole text, by start and kind; token spans overlap no other."""
    low = raw.lower()
    assign, access = any(n in low for n in _NAMES), b"AKIA" in raw
    long_hex = _HEX_BYTES.search(raw) is not None
    tokens = _DIGIT.search(raw) is not None and _TOKEN_BYTES.search(raw) is not None
    if not (assign or access or long_hex or tokens):
        return []
    text = raw.decode("utf-8", "replace")
    found = []
    if assign:
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if access:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if long_hex:
        found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    if tokens:
        taken = sorted((s, e) for s, _, e, _ in found)
        at = 0
        for m in _TOKEN.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            free = all(s >= m.end() or e <= m.start() for s, e in taken[at:at + 4])
            if free and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= TOKEN_BITS:
                found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def _scan(batches):
    for batch in batches:
        spans, digests, counts = [], [], ([], [], [])
        for text in batch.column(4):
            found = find_spans(text.as_py())
            base = [f for f in found if f[1] < 3]
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
            for k, c in enumerate(counts):
                c.append(sum(f[1] == k for f in base))
            spans.append([{"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest(),
                           "bits": entropy(v)} for s, k, e, v in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()),
                                   ("hash", pa.string()), ("bits", pa.float64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(4)] + [pa.array(c, pa.int64()) for c in counts]
            + [pa.array(digests, pa.string()), pa.array(spans, kind)],
            ["key", "doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def row_key(id_column: str, text_column: str) -> Column:
    """Key of a row's content; rows alike in id and text share it and have the same spans."""
    return F.xxhash64(F.col(id_column), F.coalesce(F.col(text_column), F.lit("")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner_column: str = "source",
                 repository_column: str | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Secrets of every whole text with a verdict from who holds each value in the corpus.

    One pass finds named assignments, access keys and long hex strings (base
    spans) and bare tokens of high entropy. Hashes of their values are counted
    by distinct owners and repositories (``repository_column``, else the
    document): a value of ``example_owners`` owners or more is an ``example``;
    any other of enough entropy is ``live``, the rest ``weak``. Bare tokens
    become spans only if live, so they need a look at the whole corpus.

    Returns (key, doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example, details) for each row; ``details`` is an array of (start, kind,
    end, hash, verdict, owners, repositories), kind being an index of ``KINDS``
    and positions code points. Null and empty texts have no spans. A null owner
    counts as one owner of its own. Repeated rows are each returned. Other
    columns are not looked at. Values themselves are never kept, only hashes.
    """
    store = TableStore(docs.sparkSession, "secrets")
    rows = docs.select(row_key(id_column, text_column).alias("key"), F.col(id_column).alias("doc_id"),
                       F.coalesce(F.col(owner_column).cast("string"), F.lit("\u0000")).alias("owner"),
                       F.coalesce(F.col(repository_column or id_column).cast("string"), F.lit("\u0000")).alias("repository"),
                       text_or_empty(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_scan, f"key bigint, doc_id {kind}, owner string, repository string, n_assign bigint, "
                                   f"n_access bigint, n_hex bigint, base_sha256 string, found array<{_SPAN}>")
    found, _ = store.write(found, "found")
    each = found.filter(F.size("found") > 0).select("key", "owner", "repository", F.inline("found"))
    held = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    held = held.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    verdict = (F.when(F.col("owners") >= example_owners, "example")
               .when(F.col("bits") >= LIVE_BITS, "live").otherwise("weak"))
    span = F.struct("start", "kind", "end", "hash", "verdict", "owners", "repositories")
    judged = (each.select("key", "start", "kind", "end", "hash", "bits").distinct().join(held, "hash")
              .withColumn("verdict", verdict).filter("kind < 3 or verdict = 'live'")
              .groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("details")))
    judged, seen = store.write(judged, "judged", n=F.count(F.lit(1)))
    out = lookup_join(found.drop("found", "owner", "repository"), judged, ["key"], "left", seen["n"])
    of = lambda v: F.coalesce(F.size(F.filter("details", lambda s: s["verdict"] == v)), F.lit(0)).cast("bigint")
    details = F.coalesce("details", F.array().cast(judged.schema["details"].dataType))
    return out.withColumn("details", details).select(
        "key", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _joined(F.col("details")).alias("spans"),
        of("live").alias("n_live"), of("example").alias("n_example"), "details")


def redact_secrets(docs: DataFrame, scanned: DataFrame, mask: str = "[secret]", id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """The documents with every live span replaced by ``mask``; examples and clean texts stay as they are.

    Columns and rows are those of ``docs``; spans that overlap are replaced as one.
    """
    docs, back = set_apart(docs, "_key", "_spans")
    live = F.filter("details", lambda s: s["verdict"] == "live")
    store = TableStore(docs.sparkSession, "redact")
    marks, seen = store.write(scanned.filter("n_live > 0").select(F.col("key").alias("_key"), live.alias("_spans"))
                              .dropDuplicates(["_key"]), "live", n=F.count(F.lit(1)))
    both = lookup_join(docs.withColumn("_key", row_key(id_column, text_column)), marks, ["_key"], "left", seen["n"])
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("text"))
    text = F.col(text_column)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] + 1 >= acc["at"]
        gap = F.substring(text, acc["at"].cast("int"), (s["start"] + 1 - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"),
                        F.when(fresh, F.concat(acc["text"], gap, F.lit(mask))).otherwise(acc["text"]).alias("text"))

    rest = lambda acc: F.concat(acc["text"], F.substring(text, acc["at"].cast("int"), F.length(text)))
    masked = F.when(F.col("_spans").isNull(), text).otherwise(F.aggregate("_spans", start, step, rest))
    return both.withColumn(text_column, masked).select(*docs.columns).withColumnsRenamed(back)
