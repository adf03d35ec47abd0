"""The operators over the test tables, each with its production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from bindery.llm import (
    bagminhash, chaining, compression_bands, crf_language, decontamination, html_text,
    lexical_search, line_dedup, packing, periodic_runs, sharding, stupid_backoff,
    suffix_dedup,
)

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff.scored(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op3_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text"
    )


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.report(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_language.identified(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compression_bands.quality(docs).drop("text")


def periodic_tails(ids: list, counts: np.ndarray) -> list:
    """For one id in ten, by its CRC, the words of a periodic tail of its text.

    A null id leaves its text as it is.
    """
    taken = [None] * len(ids)
    for i, (doc_id, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
        h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            taken[i] = np.concatenate([np.arange(a), a + np.arange(n - a) % p])
    return taken


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    )
    return periodic_runs.collapsed(docs, periodic_tails).select(
        "doc_id", "n_runs", "start", "length", "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.cleaned(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


#: Terms by a pattern of the characters that are in none, scores in 64-bit integers.
LEXICAL_SEARCH_SQL = r"""
WITH folded AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents
    UNION ALL SELECT 'i', item_id, text FROM benchmark
), split AS (
    SELECT kind, id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM folded WHERE text IS NOT NULL
), docs AS (
    SELECT id AS doc_id, terms, len(terms)::BIGINT AS n FROM split WHERE kind = 'd' AND len(terms) > 0
), totals AS (
    SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), postings AS (
    SELECT doc_id, term, count(*)::BIGINT AS tf
    FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY doc_id, term
), frequency AS (
    SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term
), asked AS (
    SELECT DISTINCT id AS item_id, term
    FROM (SELECT id, unnest(terms) AS term FROM split WHERE kind = 'i')
), scored AS (
    SELECT item_id, doc_id, sum(
        CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)
        * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))
    )::BIGINT AS score
    FROM asked JOIN frequency USING (term) JOIN postings USING (term) JOIN docs USING (doc_id), totals
    GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0
) WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_stupid_backoff": op1_stupid_backoff,
        "op2_decontamination": op2_decontamination,
        "op3_chaining": op3_chaining,
        "op4_packing": op4_packing,
        "op5_sharding": op5_sharding,
        "op6_html_text": op6_html_text,
        "op7_line_dedup": op7_line_dedup,
        "op8_bagminhash": op8_bagminhash,
        "op9_language": op9_language,
        "op10_quality": op10_quality,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_lexical_search": op12_lexical_search,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """Of what SQL can express; tests hold the other operators against brute force."""
    return {"op12_lexical_search": LEXICAL_SEARCH_SQL}
