"""The queries of this folder and their SQL."""

from __future__ import annotations

from scrivener.llm import decontam, linededup, lmscore, packing, quality, secrets, simhash, suffixes, tokencount, toolcalls
from scrivener.llm.common import table


def _documents(module):
    return lambda spark, sf_dir: module.query(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_line_dedup": _documents(linededup),
        "op2_decontamination": lambda spark, d: decontam.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op3_lm_score": _documents(lmscore),
        "op4_secret_scan": _documents(secrets),
        "op5_suffix_dedup": _documents(suffixes),
        "op6_best_fit_packing": _documents(packing),
        "op7_token_counts": _documents(tokencount),
        "op8_quality_rules": _documents(quality),
        "op9_tool_calls": lambda spark, d: toolcalls.query(table(spark, d, "conversations")),
        "op10_simhash_dedup": _documents(simhash),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": linededup.ORACLE,
        "op2_decontamination": decontam.ORACLE,
        "op4_secret_scan": secrets.ORACLE,
        "op8_quality_rules": quality.ORACLE,
        "op9_tool_calls": toolcalls.ORACLE,
    }
