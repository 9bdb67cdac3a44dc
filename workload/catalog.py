"""All registered queries, gathered from the modules that define them."""
from __future__ import annotations

import workload.analysis  # noqa: F401
import workload.cleaning  # noqa: F401
import workload.profiling  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
