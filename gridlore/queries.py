"""The query catalogue: name -> function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from .catalogue import ORACLES, QUERIES
from .plans import queries_cells, queries_decision, queries_ek, queries_focal, queries_functions, queries_intervals, queries_more, queries_shapes, queries_spectra  # noqa: F401

FLAGSHIP = "ek_equi_join"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
