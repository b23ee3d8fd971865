import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tesserae.functions import ddl, scores
from tesserae.operators import calibration, candidates, comparison, statistics
from tesserae.sources import artifacts, workload

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 6 and all(r["qerror_empty"] >= 1 and r["qerror_best"] >= 1 for r in rows)


@pytest.mark.parametrize("where,mode,reasons", [
    ("a = 1 AND b = 'x'", "precise-structural", []),
    ("a IN (1, 2) AND b IS NULL AND c <= -2.5", "precise-structural", []),
    ("a = 1 OR b = 2", "conservative-fallback", ["boolean-or"]),
    ("NOT a = 1", "conservative-fallback", ["boolean-not"]),
    ("a = b", "conservative-fallback", ["column-to-column"]),
    ("lower(a) = 'x'", "conservative-fallback", ["unresolved-column-reference"]),
    ("a IS NOT NULL AND b <> 3", "conservative-fallback", ["unsupported-null-test", "unsupported-operator"]),
    ("a = 'x and y'", "conservative-fallback", ["unsupported-expression"]),
])
def test_inspection(spark, where, mode, reasons):
    df = spark.createDataFrame([("q", f"SELECT count(*) FROM t WHERE {where};", "t"), ("none", "SELECT count(*) FROM t", "t")], "query_id string, sql string, target_relation string")
    got = {r["query_id"]: r for r in workload.inspect(df).collect()}
    assert (got["q"]["mode"], got["q"]["reasons"]) == (mode, reasons)
    assert got["none"]["reasons"] == ["no-where"]
    assert bool(got["q"]["leaves"]) == (mode == "precise-structural")


def test_constants(spark):
    df = spark.createDataFrame([("q", "select count(*) from t where a in ('x', 'y z') and b >= 10", "t")], "query_id string, sql string, target_relation string")
    got = {(r["column"], r["op"]): r["constants"] for r in workload.predicates(workload.inspect(df)).collect()}
    assert got == {("a", "in"): ["x", "y z"], ("b", ">="): ["10"]}


def test_workload_document(spark, tmp_path):
    path = tmp_path / "w.json"
    queries = [{"query_id": f"q{k}", "sql": "SELECT count(*) FROM t", "truth": t, "target_relation": "t"} for k, t in enumerate([5, 0, 7])]
    path.write_text(json.dumps({"schema_version": 1, "workload_id": "w", "queries": queries}, indent=1))
    df = workload.read_workload(spark, str(path))
    assert workload.check_workload(df, positive_only=True).count() == 2
    with pytest.raises(ValueError):
        workload.check_workload(df)
    with pytest.raises(ValueError):
        workload.check_workload(df.unionByName(df), positive_only=True)
    assert workload.effective(df).where("effective").count() == 2


def test_statistics_survive_repartitioning_and_nulls(spark):
    df = spark.createDataFrame([(k % 3 if k % 4 else None, k % 5, None) for k in range(200)], "a int, b int, c string")
    one = sorted(map(tuple, statistics.pair_mcv(df, [("a", "b")], 50).where("v1 is not null").collect()))
    other = sorted(map(tuple, statistics.pair_mcv(df.repartition(7), [("a", "b")], 50).where("v1 is not null").collect()))
    assert one == other and one
    assert {r["column"]: r["null_frac"] for r in statistics.null_fractions(df, ["a", "c"]).collect()} == {"a": 0.25, "c": 1.0}
    assert statistics.column_mcv(df, ["c"], 5).count() == 0
    truncated = statistics.column_mcv(df, ["b"], 2).orderBy("rank").collect()
    assert [(r["value"], r["freq"]) for r in truncated] == [("0", 0.2), ("1", 0.2)]


def test_truths_in_several_jobs(spark, monkeypatch):
    monkeypatch.setattr(statistics, "PREDICATES_A_JOB", 2)
    got = {r["query_id"]: r["truth"] for r in statistics.truth_counts(spark.range(10), {f"q{k}": f"id < {k}" for k in range(5)}).collect()}
    assert got == {f"q{k}": k for k in range(5)}


def test_incidence_misses_nothing(spark):
    """A query that is not incident keeps its estimate under any candidate."""
    from tesserae.queries import evaluation_inputs, edges

    _, factors, _, _ = evaluation_inputs(spark, SF)
    used = {(r["candidate_id"], r["query_id"]) for r in factors.select("candidate_id", "query_id").collect()}
    assert used <= {(r["candidate_id"], r["query_id"]) for r in edges(spark).collect()}


def test_fit_is_exact_on_a_plane(spark):
    rows = [(k % 7, k % 5, 0.2 + 0.003 * (k % 7) + 0.005 * (k % 5)) for k in range(60)]
    fit = calibration.plane_fit(spark.createDataFrame(rows, "n_mcv int, n_fd int, mean double"), "n_mcv", "n_fd", "mean")
    assert (fit["intercept"], fit["per_mcv"], fit["per_fd"]) == pytest.approx((0.2, 0.003, 0.005))
    assert fit["r2"] == pytest.approx(1)
    held = calibration.predictions(spark.createDataFrame([(10, 10, 0.28)], "n_mcv int, n_fd int, mean double"), fit)
    assert all(calibration.accepted(fit, held, worst_cv=0.02).values())
    assert not calibration.accepted(fit, held, worst_cv=0.5)["repeatable"]


def test_scores(spark):
    row = spark.range(1).select(
        scores.q_error(F.lit(0.0), F.lit(4.0)).alias("q"), scores.jaccard(F.array(), F.array()).alias("empty"),
        scores.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("third"),
        scores.percentile_bucket(F.lit(3), F.lit(200)).alias("bucket"), scores.rank_percentile(F.lit(1), F.lit(8)).alias("first"),
    ).first()
    assert tuple(row) == (4.0, 1.0, pytest.approx(1 / 3), "top_5pct", 100.0)


def test_deployment_text():
    design = [{"candidate_id": "c1", "relation": "public.T", "mechanism": "mcv", "columns": ["a", 'b"x']}, {"candidate_id": "c2", "relation": "public.T", "mechanism": "fd", "columns": ["a", "c"]}]
    plan = ddl.deployment(design, 100)
    assert plan["deploy"][0].endswith('(mcv) ON "a", "b""x" FROM "public"."T";')
    assert plan["deploy"][-1] == 'ANALYZE "public"."T";'
    assert [s.split('"')[1] for s in plan["rollback"]] == plan["names"][::-1]
    ddl.check_statements([*plan["deploy"], *plan["rollback"]])
    with pytest.raises(ValueError):
        ddl.check_statements(["ALTER DATABASE x;"])
    with pytest.raises(ValueError):
        ddl.deployment(design, True)


def test_names_agree_with_their_column_form(spark):
    row = spark.range(1).select(ddl.object_name_column(F.lit("c9"), F.lit("Some.Table"), F.array(F.lit("Ab c"), F.lit("d"))).alias("n")).first()
    assert row["n"] == ddl.object_name("c9", "Some.Table", ["Ab c", "d"])


def test_artifacts_notice_changes(spark, tmp_path):
    sealed = artifacts.write_document(tmp_path / "a.json", {"x": 1, "created_at": "now"})
    assert artifacts.read_document(tmp_path / "a.json") == sealed
    assert artifacts.seal({"x": 1, "created_at": "later"})["digest"] == sealed["digest"]
    (tmp_path / "a.json").write_text(json.dumps(sealed | {"x": 2}))
    with pytest.raises(ValueError):
        artifacts.read_document(tmp_path / "a.json")
    df = spark.range(20).withColumn("v", F.col("id") % 3)
    built = []
    build = lambda: built.append(1) or df
    for hit in (False, True):
        got, from_cache = artifacts.cached_statistics(spark, str(tmp_path), {"t": "x", "target": 100}, build)
        assert from_cache is hit and got.count() == 20
    assert len(built) == 1
    assert artifacts.content_digest(df) == artifacts.content_digest(df.repartition(3))


def test_comparisons_with_missing_queries(spark):
    a = spark.createDataFrame([("q1", 2.0), ("q2", 3.0)], "query_id string, contribution double")
    b = spark.createDataFrame([("q1", 1.0), ("q3", 3.0)], "query_id string, contribution double")
    got = {r["query_id"]: r["direction"] for r in comparison.changes(a, b).collect()}
    assert got == {"q1": "improved", "q2": "unmatched", "q3": "unmatched"}


def test_candidates_are_cut_before_they_are_ranked(spark):
    preds = spark.createDataFrame([(f"q{k}", r, c) for r in ("t", "u") for k, c in enumerate("abab")] + [("q", r, c) for r in ("t", "u") for c in "abc"], "query_id string, relation string, column string")
    places = spark.createDataFrame([(r, c, k) for r in ("t", "u") for k, c in enumerate("abc")], "relation string, column string, position int")
    all_of = candidates.generate(preds, places)
    assert all_of.count() == 12
    cut = candidates.ranked(all_of, cap=2).orderBy("precedence_rank").collect()
    assert [(r["relation"], r["mechanism"], r["c2"], r["precedence_rank"]) for r in cut] == [("t", "mcv", "b", 0), ("t", "mcv", "c", 1), ("u", "mcv", "b", 2), ("u", "mcv", "c", 3)]


def test_many_designs_equal_one_by_one(spark):
    from tesserae.operators import estimation
    from tesserae.queries import catalog, evaluation_inputs

    inputs = [*(d.cache() for d in evaluation_inputs(spark, SF)[:3]), 6000]
    ids = [r["candidate_id"] for r in catalog(spark).orderBy("precedence_rank").collect()]
    designs = {"two": ids[:2], "all": ids, "mixed": [ids[3], ids[1]]}
    rows = [(d, c) for d, own in designs.items() for c in own]
    got = {r["design"]: r["objective"] for r in estimation.design_objectives(*inputs, spark.createDataFrame(rows, "design string, candidate_id string")).collect()}
    for name, own in designs.items():
        assert got[name] == pytest.approx(estimation.objective(estimation.estimates(*inputs, own)).first()["objective"])
