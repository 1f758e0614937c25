"""Registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itinera.llm import (alignment, embedding_dedup, html_text, jaccard, language_id, line_dedup, manifest, neighbours, packing, pieces,
                         private_data, secret_scan, substrings)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents")).drop("key", "details")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents")).drop("key")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                  with_ids=False)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find_private(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_line_dedup": op2_line_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_html": op5_html,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_alignment": op12_alignment,
    "op13_manifest": op13_manifest,
}



def _fields(count: str) -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"
    return " || ".join(map(field, ("doc_id", "source", "lang", count, "text")))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op4_embedding_dedup": """
        WITH RECURSIVE good AS (
            SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r
              AND len(a.v) = len(b.v)
              AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
        reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
        SELECT vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, min(reach.c) AS component_id,
               vec_id = min(reach.c) AS kept
        FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id""",
    "op6_jaccard_join": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'),
                                       lambda x: x <> '') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.doc_id)
        SELECT doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(reach.c) AS component_id
        FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op11_substring_dedup": """
        WITH words AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        runs AS (SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)),
        later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM runs) WHERE k > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS i FROM later),
        g AS (SELECT r, list(i) AS places, count(*) AS n FROM gone GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(places, k)) END, ' '), '')) AS kept_sha256
        FROM words LEFT JOIN g USING (r)""",
    "op13_manifest": f"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, doc_id, lang, {_fields('n_chars')} AS plain, {_fields('n_chars + 1')} AS more,
                   list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
                                                lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM documents),
        leaves AS (
            SELECT r, doc_id, lang, sha256(plain) AS leaf, sha256(CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN more ELSE plain END) AS claim,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(plain)) - 1 AS slot FROM docs),
        up(lang, lv, slot, h) AS (
            SELECT lang, 0, slot, leaf FROM leaves UNION ALL
            SELECT lang, lv + 1, slot // 2, sha256(string_agg(h, '' ORDER BY slot))
            FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM up) WHERE n > 1 GROUP BY lang, lv, slot // 2),
        height AS (SELECT lang, max(lv) AS top FROM up GROUP BY lang),
        subroots AS (SELECT up.lang, top, h, row_number() OVER (ORDER BY up.lang NULLS FIRST) - 1 AS slot
                     FROM up JOIN height ON up.lang IS NOT DISTINCT FROM height.lang WHERE lv = top),
        above(lv, slot, h) AS (
            SELECT 0, slot, h FROM subroots UNION ALL
            SELECT lv + 1, slot // 2, sha256(string_agg(h, '' ORDER BY slot))
            FROM (SELECT *, count(*) OVER () AS n FROM above) WHERE n > 1 GROUP BY lv, slot // 2),
        climb(r, lang, lv, slot, x, sides) AS (
            SELECT r, lang, 0, slot, claim, '' FROM leaves UNION ALL
            SELECT c.r, c.lang, c.lv + 1, c.slot // 2,
                   sha256(CASE WHEN s.h IS NULL THEN x WHEN c.slot % 2 = 1 THEN s.h || x ELSE x || s.h END), sides || coalesce(s.h, '')
            FROM climb c JOIN height t ON t.lang IS NOT DISTINCT FROM c.lang AND c.lv < t.top
            LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM c.lang AND s.lv = c.lv AND s.slot = xor(c.slot, 1)),
        rise(r, lv, slot, x, sides) AS (
            SELECT r, 0, g.slot, x, sides FROM climb c JOIN subroots g ON g.lang IS NOT DISTINCT FROM c.lang AND c.lv = g.top UNION ALL
            SELECT c.r, c.lv + 1, c.slot // 2,
                   sha256(CASE WHEN s.h IS NULL THEN x WHEN c.slot % 2 = 1 THEN s.h || x ELSE x || s.h END), sides || coalesce(s.h, '')
            FROM rise c LEFT JOIN above s ON s.lv = c.lv AND s.slot = xor(c.slot, 1) WHERE c.lv < (SELECT max(lv) FROM above)),
        root AS (SELECT h FROM above WHERE lv = (SELECT max(lv) FROM above))
        SELECT l.doc_id, l.leaf, g.h AS subroot, root.h AS root, sha256(sides) AS proof_sha256, x AS folded_root, x = root.h AS verified
        FROM leaves l JOIN subroots g ON g.lang IS NOT DISTINCT FROM l.lang JOIN rise ON rise.r = l.r
        AND rise.lv = (SELECT max(lv) FROM above), root""",
}
