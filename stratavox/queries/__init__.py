"""Queries of the library's operators over the given tables, each with SQL where SQL can express it."""

from __future__ import annotations

from . import assays, geology, logs, pieces, readers, realisations, reports, rows, structures

QUERIES = {**assays.QUERIES, **geology.QUERIES, **logs.QUERIES, **pieces.QUERIES, **readers.QUERIES, **realisations.QUERIES, **structures.QUERIES, **reports.QUERIES, **rows.QUERIES}
ORACLES = {**assays.ORACLES, **geology.ORACLES, **logs.ORACLES, **pieces.ORACLES, **readers.ORACLES, **realisations.ORACLES, **structures.ORACLES, **reports.ORACLES, **rows.ORACLES}
