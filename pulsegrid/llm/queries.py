"""The registered queries of this subpackage, one for each operator, and their SQL.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import crc_mod, documents, table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on each machine; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(documents(spark, sf_dir), crc_mod(5) == 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove

    return remove(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.counted(pii.find(documents(spark, sf_dir)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove

    return remove(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import hits

    return hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree_lm import score

    return score(documents(spark, sf_dir), crc_mod(7) == 2)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import verdicts

    judged = verdicts(documents(spark, sf_dir), "source", ["doc_id"])
    return judged.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digest

    return encode_digest(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import groups

    found = groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    counted = count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import align

    return align(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sort_means import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from . import near_vectors, quality, sort_means, substring_dedup

    return {"op2_substring_dedup": substring_dedup.SQL, "op7_quality_rules": quality.SQL, "op11_near_vectors": near_vectors.SQL, "op13_sort_means": sort_means.sql()}
