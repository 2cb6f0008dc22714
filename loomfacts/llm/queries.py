"""Queries of the text problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .encode import encode, token_counts
from .handwritten import not_handwritten
from .mix import mix
from .parse_check import failing_files, failure_rates
from .residue import alignment_report, repeated_pages, residue_documents


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failing_files(table(spark, sf_dir, "source_files"), explain=False).select("id")


def p1_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failing_files(table(spark, sf_dir, "source_files"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_rates(table(spark, sf_dir, "source_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "repositories")).select("id")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "repositories"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(table(spark, sf_dir, "documents"))


def p8_repeated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_pages(table(spark, sf_dir, "documents"))


def p8_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_failures": p1_failures, "p1_rates": p1_rates,
    "p2_found": p2_found, "p2_reasons": p2_reasons,
    "p6_ids": p6_ids, "p6_token_counts": p6_token_counts,
    "p7_mix": p7_mix, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_kinds": p8_kinds, "p8_repeated_pages": p8_repeated_pages, "p8_alignment": p8_alignment,
}
SQL: dict[str, str] = {}
