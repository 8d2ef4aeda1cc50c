"""Every registered query of the engine, and its SQL for DuckDB."""

from __future__ import annotations

from speechmill.plans.oracles import ORACLES
from speechmill.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
