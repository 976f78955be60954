"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from veriref.plans import analytics, catalogues, completion, files, judging, records, references, retrieval  # noqa: F401  (they register their queries)
from veriref.plans.base import ORACLES, QUERIES

FLAGSHIP = "quick_verdict_report"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
