"""Maintenance cost of statistics, exact decimals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostModel:
    """base + per_column * columns for each mechanism; measured models have per_column 0."""

    mcv_base: Decimal
    mcv_column: Decimal
    fd_base: Decimal
    fd_column: Decimal
    unit: str = "units"

    def of(self, mechanism: str, columns: int = 2) -> Decimal:
        base, each = {"mcv": (self.mcv_base, self.mcv_column), "fd": (self.fd_base, self.fd_column)}[mechanism]
        return base + each * columns

    def column(self, mechanism: Column) -> Column:
        kind = lambda m: F.lit(self.of(m)).cast("decimal(38,18)")
        return F.when(mechanism == "mcv", kind("mcv")).when(mechanism == "fd", kind("fd"))


def preset(mcv_base=0, mcv_column=1, fd_base=1, fd_column=1) -> CostModel:
    return CostModel(*map(Decimal, map(str, (mcv_base, mcv_column, fd_base, fd_column))))


def measured(mcv_ms: float, fd_ms: float) -> CostModel:
    return CostModel(Decimal(str(mcv_ms)), Decimal(0), Decimal(str(fd_ms)), Decimal(0), "ms")


def design_cost(candidates: DataFrame, design: Sequence[str], model: CostModel, budget: Decimal) -> DataFrame:
    """cost, members, feasible of one design."""
    chosen = candidates.where(F.col("candidate_id").isin(list(design)))
    return chosen.agg(
        F.coalesce(F.sum(model.column(F.col("mechanism"))), F.lit(0).cast("decimal(38,18)")).alias("cost"), F.count("*").alias("members")
    ).withColumn("feasible", F.col("cost") <= F.lit(budget).cast("decimal(38,18)"))


def feasible_additions(candidates: DataFrame, spent: Decimal, model: CostModel, budget: Decimal) -> DataFrame:
    """candidate_id, cost, feasible: which candidates can still be paid for."""
    cost = model.column(F.col("mechanism"))
    return candidates.select(
        "candidate_id", cost.alias("cost"), (cost + F.lit(spent).cast("decimal(38,18)") <= F.lit(budget).cast("decimal(38,18)")).alias("feasible")
    )
