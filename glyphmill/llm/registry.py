"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, exactdedup, mixing, pii, secretscan, simhash, tokenio, toxicity, urlfilter
from .oracles import ORACLE_SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        exactdedup.op1_exact_dedup,
        ann.op2_permutation_index,
        secretscan.op3_secret_scan,
        toxicity.op4_toxicity,
        urlfilter.op5_url_filter,
        pii.op6_pii_scan,
        bpe.op7_byte_bpe,
        tokenio.op8_token_files,
        simhash.op9_simhash,
        mixing.op10_pareto_mix,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
