"""The subpackage's queries and their SQL oracles."""

from __future__ import annotations

from . import bpe_trie, exact_dedup, html_extract, language_id, licenses, line_dedup, near_dup, packing, quality, token_files
from .common import documents


def op2_bpe(spark, sf_dir):
    return bpe_trie.digests(documents(spark, sf_dir))


def op4_token_files(spark, sf_dir):
    return token_files.round_trip(documents(spark, sf_dir))


def op5_html_extraction(spark, sf_dir):
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.train(docs))


def op8_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(documents(spark, sf_dir), width=4)


def op9_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op10_quality_rules(spark, sf_dir):
    return quality.assess(documents(spark, sf_dir))


QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_licenses": licenses.op3_licenses,
    "op4_token_files": op4_token_files,
    "op5_html_extraction": op5_html_extraction,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_near_dup": op8_near_dup,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op10_quality_rules": quality.ORACLE,
}
