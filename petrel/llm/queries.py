"""The queries opN_<name> of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from .common import prepare


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents")).drop("source", "epochs")


def op1_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import digest

    return digest(_read(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict

    return predict(_read(spark, sf_dir, "documents"))


def op3_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(_read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import predict

    return predict(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digest

    return digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import every, top_k

    return top_k(_read(spark, sf_dir, "embeddings"), every())


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import digest

    return digest(_read(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL for the whole tables at the scales of the tests. Fitted models (op2, op5) and a tokenizer's files (op10) are none of SQL's."""
    from . import decontaminate, line_dedup, maxscore, mixing, ngram_join, substring_dedup, warc

    return {
        "op1_site_lines": line_dedup.QUERY_SQL,
        "op3_warc_pages": warc.QUERY_SQL,
        "op4_ngram_join": ngram_join.QUERY_SQL,
        "op6_source_mix": mixing.QUERY_SQL.format(documents="documents"),
        "op7_benchmark_hits": decontaminate.QUERY_SQL,
        "op8_top_vectors": maxscore.QUERY_SQL,
        "op9_repeated_spans": substring_dedup.QUERY_SQL,
    }
