"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: name -> (module, function, module's SQL or None)
QUERIES = {
    "op1_skip_chain_pii": ("pii", "op1_skip_chain_pii", None),
    "op2_url_gbt": ("urls", "op2_url_gbt", None),
    "op3_license_scan": ("licenses", "op3_license_scan", "ORACLE_SQL"),
    "op4_decontaminate": ("decontam", "op4_decontaminate", "ORACLE_SQL"),
    "op5_token_output": ("tokens", "op5_token_output", None),
    "op6_minhash_dedup": ("minhash", "op6_minhash_dedup", "ORACLE_SQL"),
    "op7_warc_derivatives": ("warc", "op7_warc_derivatives", None),
    "op8_line_dedup": ("lines", "op8_line_dedup", "ORACLE_SQL"),
    "op9_quality_rules": ("quality", "op9_quality_rules", "ORACLE_SQL"),
    "op10_mix_sources": ("mixing", "op10_mix_sources", None),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"fringeflow.llm.{module}"), function) for name, (module, function, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"fringeflow.llm.{module}"), sql) for name, (module, _, sql) in QUERIES.items() if sql}
