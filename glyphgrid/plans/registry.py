"""Registered queries of the raster, glyph and label operators, and their SQL counterparts.

A query's name begins with the operators it shows. The SQL beside it is written apart from the DataFrame operators and
is run by another engine on the same tables.
"""

from __future__ import annotations

from . import aggregates, letters, neighbourhoods, text  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "t5_s15_refinement_step"
