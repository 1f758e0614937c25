"""Unigram piece encoding and decoding: Viterbi over a double-array trie, byte fallback, whitespace marker."""

from __future__ import annotations

import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.llm.common import once_per_worker, text_or_empty

#: Chunks a worker keeps the ids of; all are forgotten when there are more.
CACHED = 400_000
_MARK = "▁"
_CHUNK = re.compile(rb" +[^ ]*|[^ ]+")
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # fixed values: piece types of the model file


@dataclass
class PieceModel:
    """A vocabulary as arrays: double-array trie over bytes, log score and bytes of each id."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    score: list[float]
    spelling: list[bytes]
    byte_id: list[int]
    dummy_prefix: bool
    unknown_score: float
    separate: bool


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value arrays of a trie; state t = base[s] + byte is a child of s if check[t] = s."""
    root: dict = {}
    for key, i in keys:
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = i
    size = 4 * sum(len(k) for k, _ in keys) + 4096
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    low, waiting = 1, [(0, root)]
    while waiting:
        state, node = waiting.pop()
        value[state] = node.get(-1, -1)
        children = sorted(b for b in node if b >= 0)
        if not children:
            continue
        offsets = np.array(children)
        start, step = low, 256
        while True:
            free = np.flatnonzero(~used[start:start + step]) + start - offsets[0]
            free = free[free > 0]
            fits = free[~used[free[:, None] + offsets].any(axis=1)]
            if len(fits):
                break
            start, step = start + step, min(2 * step, 65536)
        at = int(fits[0])
        base[state] = at
        used[at + offsets] = True
        check[at + offsets] = state
        if used[low:low + 256].mean() > 0.95:
            low += 256
        waiting += [(at + b, node[b]) for b in children]
    last = int(np.flatnonzero(used)[-1]) + 257
    return base[:last], check[:last], value[:last]


def load_pieces(path: str) -> PieceModel:
    """Read a SentencePiece model file; its piece scores are taken as the log scores of a unigram model."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spelling, score, byte_id, keys = [], [], [0] * 256, []
    for i, p in enumerate(proto.pieces):
        score.append(float(p.score))
        if p.type == _BYTE:
            byte_id[int(p.piece[1:-1], 16)] = i
            spelling.append(bytes([int(p.piece[1:-1], 16)]))
        elif p.type in (_UNKNOWN, _CONTROL):
            spelling.append(b"")
        else:
            spelling.append(p.piece.encode())
            keys.append((spelling[-1], i))
    mark = _MARK.encode()
    crossing = any(mark in k.replace(mark, b" ").lstrip(b" ").replace(b" ", mark) for k, _ in keys)
    usual = [score[i] for _, i in keys if score[i] > -1e8] or [0.0]
    return PieceModel(*double_array(keys), score, spelling, byte_id, proto.normalizer_spec.add_dummy_prefix,
                      min(usual) - 10.0, not crossing and not any(b"\n" in k for k, _ in keys))


class PieceEncoder(dict):
    """Best segmentation of chunks, remembered by chunk as little-endian 32-bit bytes.

    Where no piece has a marker after another character or holds a line break
    (``model.separate``), a text's best path is the best paths of its chunks (a
    run of markers and what follows it), so chunks are solved apart; else the
    whole text is one chunk.
    """

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model, self.mark = model, _MARK.encode()
        self.base, self.check, self.value = model.base.tolist(), model.check.tolist(), model.value.tolist()

    def viterbi(self, chunk: bytes) -> list[int]:
        """Ids of the path of best total score; ties keep the path found first, of longer last pieces."""
        base, check, value, score, n = self.base, self.check, self.value, self.model.score, len(chunk)
        best, back, label = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        unknown = self.model.unknown_score
        for i in range(n):
            here = best[i]
            if here == -np.inf:
                continue
            first = chunk[i]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            state, single = 0, False
            for j in range(i, n):
                to = base[state] + chunk[j]
                if check[to] != state:
                    break
                state = to
                if (v := value[to]) >= 0:
                    single |= j + 1 == i + width
                    if (s := here + score[v]) > best[j + 1]:
                        best[j + 1], back[j + 1], label[j + 1] = s, i, v
            if not single and (s := here + unknown) > best[end := min(n, i + width)]:
                best[end], back[end], label[end] = s, i, -1
        out: list[int] = []
        at = n
        while at:
            if label[at] >= 0:
                out.append(label[at])
            else:
                out += [self.model.byte_id[b] for b in reversed(chunk[back[at]:at])]
            at = back[at]
        return out[::-1]

    def __missing__(self, chunk: bytes) -> bytes:
        if self.model.separate and b"\n" in chunk and chunk != b"\n":
            first, *rest = chunk.split(b"\n")
            feed = self[b"\n"]
            return (self[first] if first else b"") + b"".join(feed + (self[r] if r else b"") for r in rest)
        found = np.array(self.viterbi(chunk), dtype="<u4").tobytes()
        self[chunk] = found
        return found

    def encode(self, text: bytes) -> bytes:
        if len(self) > CACHED:
            self.clear()
        if not text:
            return b""
        text = text.decode("utf-8", "replace").encode()
        if not self.model.separate:
            return self[(self.mark if self.model.dummy_prefix else b"") + text.replace(b" ", self.mark)]
        mark = self.mark
        text = (b" " if self.model.dummy_prefix else b"") + text
        if b"  " in text:
            return b"".join([self[c.replace(b" ", mark)] for c in _CHUNK.findall(text)])
        head, *rest = text.split(b" ")
        return (self[head] if head else b"") + b"".join([self[mark + w] for w in rest])

    def decode(self, ids: bytes) -> bytes:
        """Text of ids: pieces and fallback bytes joined, markers as spaces, the dummy space dropped."""
        spelt = b"".join(map(self.model.spelling.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        text = spelt.replace(self.mark, b" ")
        return text[1:] if self.model.dummy_prefix and text[:1] == b" " else text


def _encoder(shared) -> PieceEncoder:
    key, model = shared
    return once_per_worker(key, lambda: PieceEncoder(model.value))


def _share(spark: SparkSession, path: str) -> tuple:
    return uuid.uuid4().hex, spark.sparkContext.broadcast(load_pieces(path))


def _encode(batches, shared):
    encoder = _encoder(shared)
    low = min(encoder.model.byte_id)
    for batch in batches:
        ids = [encoder.encode(t.as_py()) for t in batch.column(1)]
        arrays = [np.frombuffer(x, dtype="<u4") for x in ids]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(ids, pa.binary()), pa.array(list(map(len, arrays)), pa.int64()),
            pa.array([int(((a >= low) & (a < low + 256)).sum()) for a in arrays], pa.int64()),
            pa.array(list(map(zlib.crc32, ids)), pa.int64())], ["doc_id", "ids", "n_pieces", "n_bytes", "ids_crc32"])


def _decode(batches, shared):
    encoder = _encoder(shared)
    for batch in batches:
        text = [None if x is None else encoder.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])


def encode_documents(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode whole texts: (doc_id, ids as little-endian 32-bit bytes, n_pieces, n_bytes, ids_crc32).

    Text is taken as it is (no normalising), a dummy space comes first if the
    model asks for one, spaces become the marker, and a character without a
    piece becomes its UTF-8 bytes. An empty or null text has no pieces.
    Null and repeated ids stay; other columns are not looked at. The model is
    read on the driver and shared as arrays of the vocabulary's size. One pass
    over the texts, no shuffle.
    """
    shared = _share(docs.sparkSession, model_path)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _encode(b, shared),
                           f"doc_id {kind}, ids binary, n_pieces bigint, n_bytes bigint, ids_crc32 bigint")


def decode_documents(encoded: DataFrame, model_path: str, id_column: str = "doc_id") -> DataFrame:
    """Texts of encoded documents: (doc_id, text); null ids give a null text. The inverse of ``encode_documents``."""
    shared = _share(encoded.sparkSession, model_path)
    rows = encoded.select(F.col(id_column).alias("doc_id"), "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _decode(b, shared), f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, decode, and say whether the text came back: the columns of encoding without ids, plus
    ``decoded_chars`` and ``same`` (a null text counts as empty)."""
    shared = _share(docs.sparkSession, model_path)
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def both(batches):
        for batch in batches:
            encoded = next(_encode(iter([batch]), shared))
            encoder = _encoder(shared)
            back = [encoder.decode(x) for x in encoded.column(1).to_pylist()]
            given = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [encoded.column(i) for i in (0, 2, 3, 4)]
                + [pa.array([len(x.decode("utf-8", "replace")) for x in back], pa.int64()),
                   pa.array([x == y for x, y in zip(back, given)], pa.bool_())],
                ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "decoded_chars", "same"])

    return rows.mapInArrow(both, f"doc_id {kind}, n_pieces bigint, n_bytes bigint, ids_crc32 bigint, "
                                 "decoded_chars bigint, same boolean")
