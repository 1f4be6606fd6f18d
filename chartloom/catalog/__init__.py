"""Every query of the engine over the driver's tables, with an oracle where SQL can express it."""

from chartloom.catalog import charts, evaluation, history, imports, indexes, layout, panel, quality, retrieval, timelines
from chartloom.catalog.registry import ORACLE_SQL, QUERIES

flagship = retrieval.flagship

__all__ = ["ORACLE_SQL", "QUERIES", "charts", "evaluation", "flagship", "history", "imports", "indexes", "layout", "panel", "quality", "retrieval", "timelines"]
