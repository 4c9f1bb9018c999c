"""Queries of this subpackage by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: query name -> (module, function, name of its SQL or None)
TABLE = {
    "op1_warc": ("warc", "op1_warc", "OP1_SQL"),
    "op2_substrings": ("substrings", "op2_substrings", "OP2_SQL"),
    "op3_toxicity": ("toxicity", "op3_toxicity", None),
    "op4_mixing": ("mixing", "op4_mixing", None),
    "op5_near_duplicates": ("neardup", "op5_near_duplicates", "OP5_SQL"),
    "op7_top_k": ("topk", "op7_top_k", "OP7_SQL"),
    "op8_quality": ("quality", "op8_quality", None),
    "op9_sentence_spans": ("spans", "op9_sentence_spans", None),
    "op10_decontaminate": ("decontaminate", "op10_decontaminate", None),
    "op6_lines": ("lines", "op6_lines", "OP6_SQL"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"wavecrest.llm.{module}"), function) for name, (module, function, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"wavecrest.llm.{module}"), sql) for name, (module, _, sql) in TABLE.items() if sql}
