"""The registered queries of the text operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import (
    bpe, embedding_dedup, hard_negatives, jaccard_join, language_id, lexical_search, nearest, packing, pii, quality_rules, sharding,
    substring_dedup, token_counts,
)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(_table(spark, sf, "documents"), WORD_BPE)


def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf, "documents"), BYTE_BPE, token_counts.new_cache(spark))


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), WORD_BPE)


def op10_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(_table(spark, sf, "documents"))


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(_table(spark, sf, "documents"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf, "documents"))


def op7_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_components(_table(spark, sf, "documents"))


def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.detect(_table(spark, sf, "documents"))


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove(_table(spark, sf, "documents"), digest=True)


def op1_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf, "embeddings"), label=moved)


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op13_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf, "embeddings"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard": op7_jaccard,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_shards": op10_shards,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical_search": op12_lexical_search,
    "op13_nearest": op13_nearest,
}
_WORDS = r"'[^\x20\x09-\x0D]+'"
_NEXT = lambda n: ", ".join(f"lead(word, {i}) OVER o" for i in range(n))
_FINITE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_REACH = """linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(d, r) AS (SELECT id, id FROM ids UNION SELECT reach.d, linked.b FROM reach JOIN linked ON reach.r = linked.a),
    part AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)"""

#: What plain SQL can say; the other operators are tested against libraries and brute force.
ORACLE: dict[str, str] = {
    "op1_embedding_dedup": f"""
    WITH RECURSIVE good AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS double)) AS v FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    ids AS (SELECT vec_id AS id FROM embeddings),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
              ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
              WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    {_REACH}
    SELECT d AS vec_id, (SELECT count(*) FROM linked WHERE a = d) AS n_links, component_id, d = component_id AS kept
    FROM part""",
    "op2_substring_dedup": f"""
    WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM lists),
    windows AS (SELECT doc_id, i, word, CASE WHEN lead(i, 12) OVER o IS NOT NULL THEN concat_ws(' ', {_NEXT(13)}) END AS g
                FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    first AS (SELECT g, min(doc_id) AS least FROM windows WHERE g IS NOT NULL GROUP BY g),
    marked AS (SELECT windows.*, coalesce(least < doc_id, false) AS again FROM windows LEFT JOIN first USING (g)),
    covered AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
                FROM marked)
    SELECT doc_id, count(i) AS n_words, count(i) FILTER (WHERE gone) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM lists LEFT JOIN covered USING (doc_id) GROUP BY doc_id""",
    "op7_jaccard": f"""
    WITH RECURSIVE lists AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                    'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM lists),
    windows AS (SELECT doc_id, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN concat_ws(' ', {_NEXT(5)}) END AS g
                FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    sets AS (SELECT DISTINCT doc_id, g FROM windows WHERE g IS NOT NULL
             UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM lists WHERE len(ws) BETWEEN 1 AND 4),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
               FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
    links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
              WHERE 100 * c >= 80 * (p.n + q.n - c)),
    ids AS (SELECT doc_id AS id FROM documents),
    {_REACH}
    SELECT d AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM part LEFT JOIN sizes ON sizes.doc_id = d""",
    "op11_hard_negatives": f"""
    WITH good AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS v
        FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
    pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, cast(list_dot_product(a.v, b.v) AS bigint) AS score
              FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
    positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
    ranked AS (SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
                      row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
               FROM positives JOIN pairs USING (anchor_id)
               WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
    SELECT anchor_id, positive_id, cast(rank AS integer) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5""",
    "op12_lexical_search": f"""
    WITH terms AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
    lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
    total AS (SELECT count(*) AS nn, sum(n) AS l FROM lengths),
    sizes AS (SELECT doc_id, 75 + (25 * n * nn) // cast(l AS bigint) AS m FROM lengths, total),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
    weights AS (SELECT term, cast(floor(1000 * ln(cast(2 * any_value(nn) + 2 AS double) / cast(2 * count(*) + 1 AS double))) AS bigint) AS w
                FROM tf, total GROUP BY term),
    asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
    scored AS (SELECT item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS bigint) AS score
               FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id) GROUP BY item_id, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    SELECT item_id, cast(rank AS integer) AS rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op13_nearest": f"""
    WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS v FROM embeddings
                  WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.v, b.v) AS score
              FROM good a JOIN good b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
    SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
