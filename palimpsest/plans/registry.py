"""Named queries over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

from palimpsest.plans import documents, relational, versioned

QUERIES: dict = relational.QUERIES | versioned.QUERIES | documents.QUERIES
ORACLES: dict[str, str] = relational.ORACLES | versioned.ORACLES | documents.ORACLES


def flagship(spark, sf_dir):
    return versioned.live_by_event_type(spark, sf_dir)
