"""Corpus pipeline, part of plumbline.llm: see plumbline/llm/pipeline.py."""

from __future__ import annotations

from plumbline.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, decontaminated, line_dedup, near_dedup, quality, run, tokens

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "decontaminated", "line_dedup", "near_dedup", "quality", "run", "tokens"]
