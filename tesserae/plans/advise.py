"""From a table and a workload to a recommended set of statistics, in restartable stages."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import ddl
from tesserae.operators import candidates, estimation, statistics
from tesserae.plans import search
from tesserae.plans.costs import CostModel
from tesserae.sources import artifacts, workload

SAMPLE_ROWS = 30_000


def prepare(
    table: DataFrame, relation: str, queries: DataFrame, mechanisms: Sequence[str] = ("mcv", "fd"), cap: int | None = None, positive_only: bool = True
) -> dict[str, DataFrame]:
    """Queries that count, what they say, ranked candidates and incidence."""
    spark = table.sparkSession
    used = workload.check_workload(queries.where(F.col("target_relation") == relation), positive_only)
    inspection = workload.inspect(used)
    positions = spark.createDataFrame([(relation, c, k) for k, c in enumerate(table.columns)], "relation string, column string, position int")
    found = candidates.ranked(candidates.generate(workload.predicates(inspection), positions, mechanisms), cap)
    return {"queries": used, "inspection": inspection, "candidates": found, "incidence": candidates.incidence(found, inspection)}


def sample_of(table: DataFrame, rows: int = SAMPLE_ROWS, seed: str = "22929") -> tuple[DataFrame, int]:
    """A sample of at most `rows` rows by seeded hash of their values, and the table's row count."""
    key = F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"})
    total = table.count()
    if total <= rows:
        return table, total
    return statistics.bottom_k(table.withColumn("_key", key), "_key", rows, seed).drop("_key"), total


def inputs(table: DataFrame, prepared: dict[str, DataFrame], target: int = 100, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Selectivities, factors of present candidates, truths and rows: what evaluation needs."""
    spark = table.sparkSession
    sample, rows = sample_of(table, sample_rows)
    sample = sample.cache()
    equal = workload.predicates(prepared["inspection"]).where(F.col("op").isin("=", "in"))
    preds = equal.select("query_id", "column", F.explode("constants").alias("value"))
    own = prepared["candidates"]
    pairs = [(r["c1"], r["c2"]) for r in own.select("c1", "c2").distinct().collect()]
    columns = sorted({r["column"] for r in preds.select("column").distinct().collect()})
    if not columns:
        raise ValueError("no query has a predicate that statistics could help")
    distinct = statistics.distinct_counts(sample, columns).withColumn("rows", F.lit(rows))
    singles = estimation.single_selectivities(preds, statistics.column_mcv(sample, columns, target), distinct)
    if pairs:
        present = statistics.acquire(sample, own, pairs, target)
        factors = estimation.pair_factors(preds, singles, present, statistics.pair_mcv(sample, pairs, target), statistics.fd_degrees(sample, pairs))
    else:
        factors = spark.createDataFrame([], "query_id string, candidate_id string, mechanism string, precedence_rank int, c1 string, c2 string, factor double")
    return singles, factors, prepared["queries"].select("query_id", "truth"), rows


def advise(
    table: DataFrame, relation: str, queries: DataFrame, budget: Decimal, cost: CostModel, out: str | Path | None = None,
    target: int = 100, local: bool = True, cap: int | None = None, sample_rows: int = SAMPLE_ROWS,
) -> dict:
    """Search, and render what it found; with out, sealed documents are written there."""
    prepared = prepare(table, relation, queries, cap=cap)
    singles, factors, truths, rows = inputs(table, prepared, target, sample_rows)
    own = search.catalog(prepared["candidates"])
    known = {r[0] for r in singles.select("query_id").distinct().collect()}
    evaluator = search.Evaluator.from_frames(singles, factors, truths.where(F.col("query_id").isin(sorted(known))), rows)
    empty = sum(evaluator.full(frozenset()).values())
    result = search.Search(own, evaluator, cost, budget).run(local)
    by_id = {c.candidate_id: c for c in own}
    design = [{"candidate_id": c, "relation": relation, "mechanism": by_id[c].mechanism, "columns": [by_id[c].c1, by_id[c].c2]} for c in result.design]
    plan = ddl.deployment(design, target)
    summary = {
        "relation": relation, "rows": rows, "objective_empty": empty, "objective": result.objective, "cost": result.cost, "budget": budget,
        "design": design, "evaluations": result.evaluations, "pruned": result.pruned, "infeasible": result.infeasible, "complete": result.complete,
    }
    if out is not None:
        lineage = {"schema": artifacts.schema_digest(table), "workload": artifacts.content_digest(prepared["queries"])}
        artifacts.write_document(Path(out) / "result.json", summary)
        artifacts.write_document(Path(out) / "trajectory.json", {"moves": result.trajectory})
        artifacts.write_recommendation(Path(out) / "recommendation.json", plan, lineage)
    return summary | {"plan": plan, "trajectory": result.trajectory}


def validate(table: DataFrame, relation: str, queries: DataFrame, design: Sequence[str], target: int = 100) -> DataFrame:
    """The frozen estimates of a design against those on statistics of the whole table."""
    prepared = prepare(table, relation, queries)
    frozen = inputs(table, prepared, target)
    fresh = inputs(table, prepared, target, sample_rows=table.count())
    one, other = (estimation.estimates(s, f, t, n, design).select("query_id", "contribution", "estimate") for s, f, t, n in (frozen, fresh))
    return one.join(other.select("query_id", F.col("estimate").alias("fresh_estimate"), F.col("contribution").alias("fresh_contribution")), "query_id")
