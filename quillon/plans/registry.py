"""Every query of the core operators by name, and the SQL that must agree with it."""

from __future__ import annotations

from quillon.plans.oracle import ORACLE
from quillon.plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
