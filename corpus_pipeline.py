"""From raw documents to encoded, deduplicated, decontaminated ones: the stages of graphloom.llm.pipeline, where they are
described.  This module belongs to that subpackage and cannot be imported without it."""

from graphloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
