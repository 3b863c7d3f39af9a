"""From raw documents to training sequences; see ``STAGES``."""

from __future__ import annotations

from skewmatch.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
