"""The corpus pipeline, documents to token ids, for whoever looks for it here; hearken.llm.pipeline has it."""

from __future__ import annotations

from hearken.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
