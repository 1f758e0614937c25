import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from itinera.llm import alignment as A
from itinera.llm.queries import QUERIES

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(FIRST, encoding="utf-8") as f, open(SECOND, "rb") as g:
        return A.Tokenizers(f.read(), g.read())


def plain(texts, both):
    """Whole texts through the libraries, groups and links by loops over bytes."""
    a, b = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a.encode_special_tokens = True
    tokens, counts = [], Counter()
    for text in texts:
        raw = b" " + (text or "").encode()
        x, y = a.encode(raw.decode(), add_special_tokens=False).ids, b.encode(text or "")
        ok = text and b"".join(both.bytes_a[i] for i in x) == raw == b"".join(both.bytes_b[i] for i in y)
        owner = lambda ids, of: [k for k, i in enumerate(ids) for _ in range(len(of[i]))]
        links = sorted(set(zip(owner(x, both.bytes_a), owner(y, both.bytes_b)))) if ok else []
        tokens.append((x, y, links) if ok else None)
        counts.update((x[i], y[j]) for i, j in links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for t in tokens:
        if t is None:
            out.append((0,) * 6 + ("",))
            continue
        x, y, links = t
        groups, i, j, la, lb = [([], [])], 0, 0, 0, 0
        while i < len(x) or j < len(y):
            if la <= lb:
                la += len(both.bytes_a[x[i]])
                groups[-1][0].append(x[i])
                i += 1
            else:
                lb += len(both.bytes_b[y[j]])
                groups[-1][1].append(y[j])
                j += 1
            if la == lb:
                groups.append(([], []))
        groups.pop()
        shown = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        n = [counts[x[i], y[j]] for i, j in links]
        out.append((len(x), len(y), len(groups), len(links), sum(c == best[y[j]] for c, (_, j) in zip(n, links)), sum(n),
                    hashlib.sha256(shown.encode()).hexdigest()))
    return out


CHARS = ["a", "b", "the", "ing", " ", "  ", " ", "\n", "\t", "é", "日本", "😀", "١", "12", "'s", " ", "　", ".", ",", "<|endoftext|>", "</s>", "<0x41>",
         "é", "​", "ß", "Word", "\u0085", "\x1c", "-", "_"]


def some_texts(n=400):
    draw = random.Random(5)
    texts = ["".join(draw.choices(CHARS, k=draw.randint(1, 60))) for _ in range(n)]
    return texts + [None, "", " ", "  ", "a", "▁ x", "x ▁", "\n", "word " * 3000, "x" * 20000, "日本語" * 3000, ("é " * 50 + "\n") * 100]


def rows_of(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS key", "2 AS n_a", "'x' AS pair")
    return [tuple(r)[1:] for r in sorted(A.align(df, FIRST, SECOND, **options).collect())]


def test_against_plain_loops(spark, both):
    texts = some_texts()
    want = plain(texts, both)
    assert sum(w[0] > 0 for w in want) > 300 and sum(w[0] == 0 for w in want) >= 4
    assert rows_of(spark, texts) == want
    assert rows_of(spark, texts, size=7, fan=2) == want  # ranges that cut segments, many steps of the tree
    assert rows_of(spark, texts, size=300, most_pairs=0) == want  # counts joined by shuffle


def test_fragments_are_a_monoid(both):
    text = "Some wörds wîth unterschiedlichen Grenzen, antidisestablishmentarianism 日本語 and 12345678 numbers"
    whole = A.aligned(both, text)
    size, draw = 1 + len(text.encode()), random.Random(2)
    one = A.fragment(whole, 0, size, A.no_weights)
    for _ in range(200):
        cuts = [0, *sorted(draw.sample(range(1, size), 3)), size]
        x, y, z, w = (A.fragment(whole, lo, hi, A.no_weights) for lo, hi in zip(cuts, cuts[1:]))
        assert (x + y) + (z + w) == x + ((y + z) + w) == one == one + A.Fragment() == A.Fragment() + one


def test_both_libraries_of_the_first_vocabulary_agree(both):
    slow = Tokenizer.from_file(FIRST)
    slow.encode_special_tokens = True
    texts = [" " + t for t in some_texts(3000) if t]
    assert both.encode_a.__self__.__class__.__name__ == "Encoding"
    assert [both.encode_a(t) for t in texts] == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def test_given_documents(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op12_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *w) for r, w in zip(docs, plain([r.text for r in docs], both)))


def test_repeated_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "same text"), (None, "same text"), (1, None), (1, "same text"), (1, "x y " * 9000), (1, "x y " * 9000)], "doc_id bigint, text string")
    rows = A.align(df, FIRST, SECOND).collect()
    assert len(rows) == 6 and len({tuple(r)[1:] for r in rows if r.n_a == 2}) == 1 and sum(r.n_a == 2 for r in rows) == 3
    assert sum(r.n_a > 9000 for r in rows) == 2
    assert A.align(df.limit(0), FIRST, SECOND).count() == 0
