"""Column functions over taints. Two orders exist and are kept apart: the join of the lattice, and the rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taintloom.functions.domains import RANK, TIER


def lookup(table: dict, key: Column | str) -> Column:
    """The value of a fixed table as a CASE, null where there is none."""
    c = F.col(key) if isinstance(key, str) else key
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def rank(taint: Column | str) -> Column:
    return lookup(RANK, taint)


def tier(taint: Column | str) -> Column:
    return lookup(TIER, taint)


def taint_join(taint: str) -> Column:
    """The lattice join of a group as one aggregate: equal taints join to themselves, unknown ones to the
    weakest of them, all else to MIXED_RAW. Associative, so partial aggregation before the shuffle is exact."""
    t = F.col(taint)
    return F.when(F.min(t) == F.max(t), F.min(t)).when(F.bool_and(t.startswith("UNKNOWN_")), F.max_by(t, rank(t))).otherwise(F.when(F.count(t) > 0, F.lit("MIXED_RAW")))


def least_trusted(taint: str) -> Column:
    """The taint of the highest rank in a group."""
    return F.max_by(F.col(taint), rank(taint))


def evidence_ceiling(structural: Column, semantic: Column, integrity: Column, institutional: Column) -> Column:
    """The most trusted taint that restoration evidence supports."""
    return (
        F.when(~structural, "UNKNOWN_RAW")
        .when(~institutional, F.when(semantic, "UNKNOWN_ASSURED").otherwise("UNKNOWN_GUARDED"))
        .when(semantic & integrity, "INTEGRAL")
        .when(semantic, "ASSURED")
        .otherwise("GUARDED")
    )
