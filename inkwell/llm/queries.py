"""The queries op1 to op13 and the pipeline, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, importance, licenses, linededup, mixing, neardup, pii, quality, secrets, sql, suffixdedup, topk, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_topk_search": topk.op2_topk_search,
        "op3_mixing": mixing.op3_mixing,
        "op4_secret_scan": secrets.op4_secret_scan,
        "op5_near_dedup": neardup.op5_near_dedup,
        "op6_bpe": bpe.op6_bpe,
        "op7_personal_data": pii.op7_personal_data,
        "op8_line_dedup": linededup.op8_line_dedup,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_suffix_dedup": suffixdedup.op10_suffix_dedup,
        "op11_url_filter": urlfilter.op11_url_filter,
        "op12_importance": importance.op12_importance,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk_search": sql.OP2,
        "op3_mixing": sql.OP3,
        "op4_secret_scan": sql.OP4,
        "op8_line_dedup": sql.OP8,
        "op9_quality_rules": sql.OP9,
        "op11_url_filter": sql.OP11,
        "op12_importance": sql.OP12,
        "op13_filter_audit": sql.OP13,
    }
