"""Severity order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values; everything else, INFO included, ranks 0 -----------------------------------
SEVERITY_RANKS = [("CRITICAL", 4), ("HIGH", 3), ("MEDIUM", 2), ("LOW", 1)]


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for name, value in reversed(SEVERITY_RANKS):
        rank = F.when(severity == name, F.lit(value)).otherwise(rank)
    return rank
