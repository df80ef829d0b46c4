"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fm_dedup, licenses, media, mixing, near_dedup, packing, sharding, suffix_dedup, toxicity

OPERATORS = {
    "op1_label_propagation_sharding": sharding,
    "op2_suffix_array_dedup": suffix_dedup,
    "op3_license_scan": licenses,
    "op4_nnpu_toxicity": toxicity,
    "op5_fm_index_dedup": fm_dedup,
    "op6_media_columns": media,
    "op7_msd_radix_dedup": exact_dedup,
    "op8_block_mixing": mixing,
    "op9_minimum_bin_slack": packing,
    "op10_minhash_near_dedup": near_dedup,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in OPERATORS.items() if hasattr(module, "ORACLE")}
