"""Power-of-two packing: a document becomes pieces whose lengths are powers of two, one sequence each."""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from itinera.llm.common import once_per_worker, text_or_empty

#: Longest sequence.
LONGEST = 4096
#: Chunks a worker keeps the ids of; all are forgotten when there are more.
CACHED = 400_000


_MARKS = b".,;:!?&$%#*|()-"  # after a letter, a run of these to the chunk's end is a word of its own


class ChunkEncoder(dict):
    """Ids of white-space-free chunks of UTF-8 as little-endian 32-bit bytes.

    A text's ids are those of its chunks in turn, because the vocabulary drops
    white space and no id crosses it. Chunks of Latin script are cut by the
    vocabulary's own pattern and given to its model; any other goes through the
    whole tokenizer.
    """

    def __init__(self, model: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(model)
        pattern = json.loads(model)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        steps = [s["type"] for s in (json.loads(model).get("normalizer") or {}).get("normalizers", [])]
        self.short = steps == ["NFC", "Replace", "Lowercase"]  # else every chunk goes through the whole tokenizer
        self.words, self.plain = regex.compile(pattern), regex.compile(r"[\x21-\x7E¡-ɉ]+")
        self.model, self.bytes = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            spelt = word if word.isascii() and word.isalnum() else self.bytes.pre_tokenize_str(word)[0][0]
            ids = [t.id for t in self.model.tokenize(spelt)]
            found = self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def __missing__(self, chunk: bytes) -> bytes:
        core = chunk.rstrip(_MARKS)
        text = core.decode("utf-8", "replace")
        if self.short and core.isalpha():
            found = self._word(text.lower())
        elif self.short and core and b"<|" not in chunk and text[-1].isalpha() and self.plain.fullmatch(text) \
                and (text := unicodedata.normalize("NFC", text).lower())[-1].isalpha():  # a capital may end in a mark
            found = self._word(text) if text.isalpha() else b"".join(map(self._word, self.words.findall(text)))
        else:
            core = chunk
            ids = self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(core) < len(chunk):
            found += self._word(chunk[len(core):].decode())
        self[chunk] = found
        return found

    def encode(self, text: bytes) -> bytes:
        if len(self) + len(self.known) > CACHED:
            self.clear()
            self.known.clear()
        return b"".join(map(self.__getitem__, text.split()))


def binary_pieces(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole longest ones, then falling powers of two."""
    start = 0
    while start < n:
        length = min(longest, 1 << (n - start).bit_length() - 1)
        yield start, length
        start += length


def _pack(batches, vocabulary, key: str, end: int, longest: int, with_ids: bool):
    encoder = once_per_worker(key, lambda: ChunkEncoder(vocabulary.value))
    tail = np.array([end], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    for batch in batches:
        out: dict[str, list] = {n: [] for n in names}
        ids: list[bytes] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            packed = memoryview(encoder.encode(text.as_py()) + tail)
            n = len(packed) // 4
            for start, length in binary_pieces(n, longest):
                piece = packed[4 * start:4 * (start + length)]
                for name, value in zip(names, (doc, start, length, zlib.crc32(piece), n)):
                    out[name].append(value)
                if with_ids:
                    ids.append(bytes(piece))
        columns = [pa.array(out["doc_id"], type=batch.schema.field(0).type)] + [pa.array(out[n], pa.int64()) for n in names[1:]]
        yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []),
                                         names + (["ids"] if with_ids else []))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, longest: int = LONGEST, id_column: str = "doc_id",
                   text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """Cut documents into sequences by binary decomposition, without padding and across no document border.

    ``vocabulary`` is the path of the tokenizer file (read on the driver, its
    size is the vocabulary's). A document is the ids of its text, then
    ``end_id``. It is cut into pieces of ``longest`` (a power of two), then one
    piece per binary digit of the rest, longest first. Each piece is a sequence
    of its own: (doc_id, start, length, ids_crc32, doc_tokens, bucket,
    sequence_id, offset, ids as little-endian 32-bit bytes). ``bucket`` is the
    power of two, so batches are drawn from rows of one bucket.

    A null or empty text is the end id alone. Null or repeated ids stay as they
    are; ``sequence_id`` is each row's own. One pass over the texts, no shuffle;
    other columns are not looked at. No documents give no pieces.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    key = uuid.uuid4().hex
    rows = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    pieces = rows.mapInArrow(lambda b: _pack(b, shared, key, end_id, longest, with_ids), schema)
    return pieces.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(),
                               "offset": F.lit(0).cast("bigint")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write packed sequences with one folder per length, as a trainer reads them."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)
