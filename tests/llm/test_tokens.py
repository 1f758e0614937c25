import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from itinera.llm import packing, pieces

WORDS = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "\n\n", "Hello  world", "it's the dog's 12,345 (x)!!", "café CAFÉ naïve\tété\x1cx\x85y\xa0z",
         "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ Straße", "漢字 ひらがな ☃ e\u0301 \u0301", "x" * 5000,
         "AKIA12 &&& ### it'S we'LL", "word " * 3000, "\x00\x01", "ŉ ǰ ﬁ"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(4, "Hello  world", "clash", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, length string, ids int")


def test_packing_matches_tokenizer(docs, spark):
    whole = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(docs, WORDS).collect()
    by_doc = {}
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length == 1 << r.bucket and r.offset == 0 and zlib.crc32(r.ids) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append((r.start, ids.tolist(), r.doc_tokens))
    assert len({r.sequence_id for r in got}) == len(got)
    for i, t in enumerate(TEXTS):
        want = whole.encode(t or "", add_special_tokens=False).ids + [2]
        found = sorted(by_doc[i if i != 3 else None])
        if i == 4:
            assert len(found) == 2 * len({s for s, _, _ in found})
            continue
        assert [x for _, ids, _ in found for x in ids] == want, t
        assert {n for *_, n in found} == {len(want)}


def test_packing_of_given_documents(spark):
    whole = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {}
    for r in packing.pack_documents(docs, WORDS).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, dtype="<u4").tolist()))
    for r in docs.collect():
        assert [x for _, ids in sorted(got[r.doc_id]) for x in ids] == whole.encode(r.text, add_special_tokens=False).ids + [2]


def test_packing_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(none, WORDS).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(none, WORDS, longest=100)
    assert list(packing.binary_pieces(4096 * 2 + 5, 4096)) == [(0, 4096), (4096, 4096), (8192, 4), (8196, 1)]


def brute(model, chunk):
    """Best total by plain dynamic programming over all pieces."""
    table = {s: model.score[i] for i, s in enumerate(model.spelling)
             if s and i not in model.byte_id}
    best = [0.0] + [-np.inf] * len(chunk)
    for i in range(len(chunk)):
        if best[i] == -np.inf:
            continue
        width = next(w for w in range(1, 5) if i + w == len(chunk) or chunk[i + w] & 0xC0 != 0x80)
        if chunk[i:i + width] not in table:
            best[i + width] = max(best[i + width], best[i] + model.unknown_score)
        for j in range(i + 1, min(len(chunk), i + 64) + 1):
            if chunk[i:j] in table:
                best[j] = max(best[j], best[i] + table[chunk[i:j]])
    return best[-1]


def test_viterbi_is_best():
    model = pieces.load_pieces(MODEL)
    encoder = pieces.PieceEncoder(model)
    assert model.separate
    rng = random.Random(5)
    for _ in range(60):
        chunk = "".join(rng.choice("▁theanioruß☃ün\u4e00x") for _ in range(rng.randint(1, 30))).encode()
        ids = encoder.viterbi(chunk)
        assert b"".join(model.spelling[i] for i in ids) == chunk
        unknown = {b for b in model.byte_id}
        total, run = 0.0, b""
        for i in ids:
            if i in unknown:
                run += model.spelling[i]
            else:
                total += model.score[i]
        total += len(run.decode()) * model.unknown_score
        assert total == pytest.approx(brute(model, chunk))


def test_same_as_library_on_known_characters():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    encoder = pieces.PieceEncoder(pieces.load_pieces(MODEL))
    for text in ("the quick brown fox", "Thlyatat of. Onthanen", "über die Straße", "a  b   c"):
        score = lambda ids: sum(encoder.model.score[i] for i in ids)
        mine = np.frombuffer(encoder.encode(text.encode()), dtype="<u4").tolist()
        assert score(mine) >= score(library.encode(text)) - 1e-3
        assert library.decode(mine) == text


def test_round_trip(docs, spark):
    encoded = pieces.encode_documents(docs, MODEL)
    back = {(r.doc_id, r.text) for r in pieces.decode_documents(encoded, MODEL).collect()}
    assert back == {(i if i != 3 else None, t or "") for i, t in enumerate(TEXTS)}
    assert all(r.same for r in pieces.round_trip(docs, MODEL).collect())
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert pieces.round_trip(given, MODEL).filter("not same").count() == 0
    assert pieces.round_trip(docs.limit(0), MODEL).count() == 0
