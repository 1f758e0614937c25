"""Rows that must not be lost or changed: odd column names, unlabelled tables, rare languages, other scripts, odd capitals."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from itinera.llm import jaccard, language_id, line_dedup, packing, secret_scan

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LINE = "A long enough line about the weather in the mountains today"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1) for i, t, g in rows], SCHEMA)


def test_columns_named_like_the_helpers(spark):
    rows = [(1, LINE + "\nkey = x", "en"), (2, LINE + "\nsecret_token = 'Zk38dkfK39dkfjQ02'", "en"), (2, LINE, "en"), (3, "Another text of its own", "en")]
    extra = ["_key", "_row", "_twice", "_drop", "_again", "_stays", "_spans", "_lang", "_kept", "n_lines", "n_dropped"]
    docs = docs_of(spark, rows).selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in extra])
    stages = [line_dedup.dedup_lines(docs), jaccard.keep_one(docs), secret_scan.redact_secrets(docs, secret_scan.scan_secrets(docs)),
              language_id.keep_identified(docs)]
    for k, out in enumerate(stages):
        kept = [c for c in extra if k or c not in ("n_lines", "n_dropped")]
        assert sorted(out.columns) == sorted(docs.columns) and len(set(out.columns)) == len(out.columns)
        found = out.collect()
        assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in kept)
    assert all(isinstance(r.n_lines, int) for r in stages[0].collect())


def test_short_lines_of_other_scripts_are_measured_in_characters(spark):
    docs = docs_of(spark, [(1, "привет мир", "ru"), (1, "привет мир", "ru"), (2, "привет мир", "ru"), (3, "привет большой мир", "ru"), (4, "привет большой мир", "ru")])
    out = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert out == [(1, "привет мир")] * 2 + [(2, "привет мир"), (3, "привет большой мир"), (4, "")]


def test_unlabelled_many_and_rare_languages(spark, monkeypatch):
    plain = [(k, f"the words of text number {k} are here", None) for k in range(5)]
    assert language_id.keep_identified(docs_of(spark, plain)).count() == 5
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>Some words of a page</p>")], "page_id bigint, url string, html string")
    (page,) = language_id.identify_pages(pages, docs_of(spark, plain)).collect()
    assert page.lang == "und" and not page.accepted
    assert language_id.identify_pages(pages, docs_of(spark, plain).limit(0)).count() == 1
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    many = [(k, f"mot{chr(97 + k % 9) * 2} " * 30 + f"{chr(97 + k % 9)}ng " * 20, f"x{k % 9}") for k in range(90)] + [(100, "", "x1"), (101, "12 34", "x8")]
    kept = {r.doc_id: r.lang for r in language_id.keep_identified(docs_of(spark, many)).collect()}
    assert all(kept[k] == f"x{k % 9}" for k in range(90)) and 100 not in kept and 101 not in kept


def test_packed_ids_are_the_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = packing.ChunkEncoder(f.read())
    whole, draw = Tokenizer.from_file(path), random.Random(4)
    letters = list("aZé,.;:!?()-'İıßÅçÉǅŉ1ñÑŒœ") + ["̇", "İ,", "word", "'S", "<|", "日", " "]
    texts = ["".join(draw.choices(letters, k=draw.randint(1, 12))) for _ in range(20000)] + ["İ,", "İSTANBUL!", "DİYARBAKIR."]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        got = encoder.encode(text.encode())
        assert [int.from_bytes(got[i:i + 4], "little") for i in range(0, len(got), 4)] == want.ids, repr(text)
