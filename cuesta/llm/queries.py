"""The published queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, decontaminate, langid, linededup, lm, media, minhash, phrases, pii, quality, rules, toxicity
from ._spark import held_out, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2))


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out("doc_id", 5, 0))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), n=13)
    return decontaminate.digest(found)


def op6_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept", "n_links")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out("doc_id", 7, 2))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out("doc_id", 5, 0))


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described_media(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return alignment.digest(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), p.path(VOCABULARY), p.PATTERN)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out("doc_id", 5, 0))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_language_id,
        op2_quality_ranking,
        op3_line_dedup,
        op4_bpe_transducer,
        op5_decontamination,
        op6_minhash_near_duplicates,
        op7_language_model,
        op8_personal_data,
        op9_toxicity,
        op10_media_chunks,
        op11_token_alignment,
        op12_phrase_collocations,
        op13_quality_rules,
    ]
    return {f.__name__: f for f in own}


#: Whole-table SQL; the others are tested against brute force (see tests/llm).
ORACLE_SQL: dict[str, str] = {
    "op12_phrase_collocations": r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents)) WHERE len(words) > 0),
sized AS (SELECT lang, words, unnest([1, 2, 3, 4]) AS n FROM pieces),
starts AS (SELECT lang, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM sized WHERE len(words) >= n),
f AS (SELECT lang, n, array_to_string(words[i:i + n - 1], ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL),
totals AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, n AS size, phrase, string_split(phrase, ' ') AS words, a FROM f WHERE n > 1 AND a >= 30),
cut_at AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
cuts AS (
  SELECT c.lang, c.phrase, c.words, c.a, k, x.a AS l, y.a AS r, 2000000::HUGEINT * c.a // (x.a + y.a) AS score
  FROM cut_at c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
stay AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.lang = b.lang AND c.size > len(b.words) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100::HUGEINT * c.a >= 80::HUGEINT * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, t.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals t USING (lang) WHERE rank <= 2000"""
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
