"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, embedding_cells, line_templates, pii_crf, quality_model, secret_ledger, shingle_forest, url_rules

QUERIES = {
    "op1_secret_ledger": secret_ledger.op1_secret_ledger,
    "op2_line_templates": line_templates.op2_line_templates,
    "op3_shingle_forest": shingle_forest.op3_shingle_forest,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_pii_crf": pii_crf.op7_pii_crf,
    "op8_quality_model": quality_model.op8_quality_model,
    "op9_embedding_cells": embedding_cells.op9_embedding_cells,
    "op10_bpe": bpe.op10_bpe,
}
ORACLE_SQL = {
    "op1_secret_ledger": secret_ledger.ORACLE,
    "op2_line_templates": line_templates.ORACLE,
    "op3_shingle_forest": shingle_forest.ORACLE,
    "op4_chat_format": chat_format.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op9_embedding_cells": embedding_cells.ORACLE,
}
