import json
from decimal import Decimal

import pytest

from tesserae.__main__ import main
from tesserae.operators import statistics
from tesserae.plans import costs
from tesserae.plans.advise import advise, prepare, sample_of, validate
from tesserae.sources import artifacts, workload


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k % 10, k % 10, str(k % 4), k % 3 if k % 5 else None) for k in range(1000)]
    return spark.createDataFrame(rows, "a int, b int, c string, d int").cache()


@pytest.fixture(scope="module")
def document(spark, table, tmp_path_factory):
    where = {"q1": "a = 1 AND b = 1", "q2": "a = 2 AND b = 2 AND c = '2'", "q3": "c = '1' AND d = 2", "q4": "a = 3 OR b = 3", "q5": "a = 1 AND b = 2"}
    counts = {r["query_id"]: r["truth"] for r in statistics.truth_counts(table, where).collect()}
    queries = [{"query_id": q, "sql": f"SELECT count(*) FROM t WHERE {w}", "truth": counts[q], "target_relation": "t"} for q, w in where.items()]
    path = tmp_path_factory.mktemp("w") / "workload.json"
    path.write_text(json.dumps({"schema_version": 1, "workload_id": "w", "queries": queries}))
    return str(path)


def test_advise_finds_the_dependent_pair(spark, table, document, tmp_path):
    queries = workload.read_workload(spark, document)
    found = advise(table, "t", queries, Decimal(4), costs.preset(), tmp_path / "out")
    assert [d["columns"] for d in found["design"]][0] == ["a", "b"]
    assert found["objective"] < found["objective_empty"] and found["cost"] <= 4
    assert artifacts.read_document(tmp_path / "out" / "result.json")["objective"] == found["objective"]
    again = advise(table.repartition(5), "t", queries, Decimal(4), costs.preset())
    assert again["plan"]["digest"] == found["plan"]["digest"]
    checked = validate(table, "t", queries, [d["candidate_id"] for d in found["design"]]).collect()
    assert checked and all(r["contribution"] == r["fresh_contribution"] for r in checked)
    nothing = advise(table, "t", queries, Decimal(0), costs.preset())
    assert nothing["design"] == [] and nothing["objective"] == nothing["objective_empty"]


def test_fallback_queries_touch_all_candidates(spark, table, document):
    prepared = prepare(table, "t", workload.read_workload(spark, document))
    edges = prepared["incidence"].where("query_id = 'q4'").count()
    assert edges == prepared["candidates"].count() and prepared["queries"].where("query_id = 'q5'").count() == 0


def test_sample_is_the_same_for_any_partitioning(spark, table):
    one, rows = sample_of(table, 50)
    other, _ = sample_of(table.repartition(7), 50)
    assert rows == 1000 and sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and one.count() == 50


def test_command_line(spark, table, document, tmp_path, capsys):
    table.write.parquet(str(tmp_path / "t"))
    args = ["advise", "--table", str(tmp_path / "t"), "--relation", "t", "--workload", document, "--budget", "4", "--out", str(tmp_path / "o")]
    assert main(args) == 0
    assert "CREATE STATISTICS" in capsys.readouterr().out
    assert main([*args[:-1], str(tmp_path / "p"), "--target", "0"]) == 2
