"""Registered queries of the advisor's operators and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import ddl, scores
from tesserae.operators import calibration, candidates, comparison, estimation, rankings, statistics
from tesserae.plans import costs, search
from tesserae.sources import workload as workloads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Sums of doubles depend on their order in the last place; reports round them off."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# The workload of the examples: counting queries on lineitem.
WHERE = {
    "q01": "l_returnflag = 'R' AND l_linestatus = 'F'",
    "q02": "l_returnflag = 'N' AND l_linestatus = 'O'",
    "q03": "l_returnflag = 'A' AND l_linenumber = 1",
    "q04": "l_linestatus = 'F' AND l_linenumber IN (1, 2)",
    "q05": "l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 7",
    "q06": "l_linenumber = 3",
    "q07": "l_returnflag = 'N' OR l_linestatus = 'F'",
    "q08": "NOT l_returnflag = 'N'",
    "q09": "l_quantity >= 25 AND l_returnflag = 'A'",
    "q10": "l_returnflag = l_linestatus",
    "q11": "lower(l_returnflag) = 'x'",
    "q12": "l_returnflag = 'Z' AND l_linestatus = 'F'",
    "q13": "l_returnflag IS NULL",
    "q14": "l_shipdate IS NOT NULL",
    "q15": "l_tax <> 0.5",
}
#: The precise equality queries of it, as (query, column, constant).
PREDICATES = [
    ("q01", "l_returnflag", "R"), ("q01", "l_linestatus", "F"), ("q02", "l_returnflag", "N"), ("q02", "l_linestatus", "O"),
    ("q03", "l_returnflag", "A"), ("q03", "l_linenumber", "1"), ("q04", "l_linestatus", "F"), ("q04", "l_linenumber", "1"),
    ("q04", "l_linenumber", "2"), ("q05", "l_returnflag", "R"), ("q05", "l_linestatus", "O"), ("q05", "l_linenumber", "7"),
    ("q06", "l_linenumber", "3"),
]
COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber"]
PAIRS = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber")]
PRECISE = sorted({q for q, _, _ in PREDICATES})


def workload(spark: SparkSession, truths: DataFrame | None = None) -> DataFrame:
    rows = [(q, f"SELECT count(*) FROM lineitem WHERE {w}", "lineitem") for q, w in WHERE.items()]
    return spark.createDataFrame(rows, "query_id string, sql string, target_relation string")


def predicate_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREDICATES, "query_id string, column string, value string")


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.truth_counts(table(spark, sf_dir, "lineitem"), {q: WHERE[q] for q in PRECISE})


def catalog(spark: SparkSession) -> DataFrame:
    """All pairs of the precise queries as MCV and dependency candidates, ranked."""
    positions = spark.createDataFrame([("lineitem", c, k) for k, c in enumerate(COLUMNS)], "relation string, column string, position int")
    own = predicate_rows(spark).withColumn("relation", F.lit("lineitem"))
    return candidates.ranked(candidates.generate(own, positions))


def evaluation_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    items = table(spark, sf_dir, "lineitem")
    preds = predicate_rows(spark)
    rows = items.count()
    mcv = statistics.column_mcv(items, COLUMNS, 100)
    spread = statistics.distinct_counts(items, COLUMNS).withColumn("rows", F.lit(rows))
    singles = estimation.single_selectivities(preds, mcv, spread)
    factors = estimation.pair_factors(preds, singles, catalog(spark), statistics.pair_mcv(items, PAIRS, 100), statistics.fd_degrees(items, PAIRS))
    # A few rows for each query of the workload, which the estimators read more than once.
    return singles.cache(), factors.cache(), truths(spark, sf_dir).cache(), rows


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of the precise queries without statistics and under the best single candidate."""
    singles, factors, truth, rows = evaluation_inputs(spark, sf_dir)
    best = estimation.singleton_profile(singles, factors, truth, rows).orderBy(F.desc("reduction"), "candidate_id").limit(1)
    empty = estimation.estimates(singles, factors.limit(0), truth, rows)
    one = estimation.estimates(singles, factors.join(F.broadcast(best.select("candidate_id")), "candidate_id", "left_semi"), truth, rows)
    return empty.select("query_id", "truth", F.col("estimate").alias("estimate_empty"), F.col("contribution").alias("qerror_empty")).join(
        one.select("query_id", F.col("estimate").alias("estimate_best"), F.col("contribution").alias("qerror_best")), "query_id"
    )


def values_sql(rows, names: str) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names}))"


UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM lineitem" for c in COLUMNS)
VALUE_COUNTS = f"SELECT \"column\", value, count(*) AS n FROM ({UNPIVOT}) GROUP BY ALL"
PAIR_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{a}' AS c1, '{b}' AS c2, CAST({a} AS VARCHAR) AS v1, CAST({b} AS VARCHAR) AS v2 FROM lineitem" for a, b in PAIRS
)
PAIR_COUNTS = f"SELECT c1, c2, v1, v2, count(*) AS n FROM ({PAIR_UNPIVOT}) GROUP BY ALL"

# --- statistics ------------------------------------------------------------------------------


@query(f"""
WITH c AS ({VALUE_COUNTS}), t AS (SELECT "column", sum(n) AS rows FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM c WHERE value IS NOT NULL)
SELECT "column", value, rank::INTEGER AS rank, round(n / rows, 9) AS freq FROM r JOIN t USING ("column") WHERE rank <= 5
""")
def column_mcv(spark, sf_dir):
    return rounded(statistics.column_mcv(table(spark, sf_dir, "lineitem"), COLUMNS, 5))


@query("""
SELECT "column", round(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) / count(*), 9) AS null_frac
FROM (SELECT 'even_size' AS "column", CASE WHEN p_size % 2 = 0 THEN p_size END AS value FROM part
      UNION ALL SELECT 'p_size', p_size FROM part) GROUP BY 1
""")
def null_frac(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("even_size", F.when(F.col("p_size") % 2 == 0, F.col("p_size")))
    return rounded(statistics.null_fractions(part, ["even_size", "p_size"]))


@query("""
SELECT 'event_type' AS "column", count(DISTINCT event_type) AS n_distinct FROM events
UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events
""")
def n_distinct(spark, sf_dir):
    return statistics.distinct_counts(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("""
SELECT (i - 1)::INTEGER AS bucket, round(b[i], 6) AS bound
FROM (SELECT quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS b FROM lineitem), range(1, 12) t(i)
""")
def histogram_bounds(spark, sf_dir):
    return rounded(statistics.histogram_bounds(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10), 6)


@query(f"""
WITH c AS ({PAIR_COUNTS}), t AS (SELECT c1, c2, sum(n) AS rows FROM c GROUP BY ALL),
a AS (SELECT c1, c2, v1, sum(n) AS n1 FROM c GROUP BY ALL), b AS (SELECT c1, c2, v2, sum(n) AS n2 FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY n DESC, v1, v2) AS rank FROM c)
SELECT c1, c2, v1, v2, rank::INTEGER AS rank, round(n / rows, 9) AS freq, round((n1 / rows) * (n2 / rows), 9) AS base_freq
FROM r JOIN t USING (c1, c2) JOIN a USING (c1, c2, v1) JOIN b USING (c1, c2, v2) WHERE rank <= 10
""")
def pair_mcv_all(spark, sf_dir):
    return rounded(statistics.pair_mcv(table(spark, sf_dir, "lineitem"), PAIRS, 10))


@query("""
WITH p AS (SELECT n_name AS a, n_regionkey AS b, count(*) AS n FROM nation GROUP BY ALL),
x AS (SELECT a, count(*) AS k, sum(n) AS n FROM p GROUP BY a), y AS (SELECT b, count(*) AS k, sum(n) AS n FROM p GROUP BY b)
SELECT 'n_name' AS determinant, 'n_regionkey' AS dependent, round(sum(CASE WHEN k = 1 THEN n ELSE 0 END) / sum(n), 9) AS degree FROM x
UNION ALL SELECT 'n_regionkey', 'n_name', round(sum(CASE WHEN k = 1 THEN n ELSE 0 END) / sum(n), 9) FROM y
""")
def fd_degree(spark, sf_dir):
    return rounded(statistics.fd_degrees(table(spark, sf_dir, "nation"), [("n_name", "n_regionkey")]))


@query(f"""
SELECT c.candidate_id, CASE WHEN c.mechanism = 'mcv' OR coalesce(degree, 0) > 0 THEN 'PRESENT' ELSE 'ABSENT_NATIVE' END AS state
FROM {values_sql([("m", "mcv"), ("d", "fd")], "candidate_id, mechanism")} c,
  (SELECT greatest(
     (SELECT sum(CASE WHEN k = 1 THEN n ELSE 0 END) FROM (SELECT event_type, count(DISTINCT user_id) AS k, count(*) AS n FROM events GROUP BY 1)),
     (SELECT sum(CASE WHEN k = 1 THEN n ELSE 0 END) FROM (SELECT user_id, count(DISTINCT event_type) AS k, count(*) AS n FROM events GROUP BY 1))) AS degree)
""")
def acquisition_states(spark, sf_dir):
    own = spark.createDataFrame([("m", "mcv", "event_type", "user_id"), ("d", "fd", "event_type", "user_id")], "candidate_id string, mechanism string, c1 string, c2 string")
    found = statistics.acquire(table(spark, sf_dir, "events"), own, [("event_type", "user_id")], 100)
    return found.select("candidate_id", "state")


@query("SELECT count(*) AS rows, sha256('c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double,c_mktsegment:string') AS schema_digest FROM customer")
def relation_fingerprint(spark, sf_dir):
    return statistics.fingerprint(table(spark, sf_dir, "customer"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('22929' || o_orderkey::VARCHAR), o_orderkey LIMIT 300")
def sample_bottom_k(spark, sf_dir):
    return statistics.bottom_k(table(spark, sf_dir, "orders"), "o_orderkey", 300, "22929").select("o_orderkey", "o_orderstatus")


@query("""
SELECT size::INTEGER AS size, seed, position::INTEGER AS position, key FROM (
  SELECT size, seed, c_custkey AS key, row_number() OVER (PARTITION BY size, seed ORDER BY md5(seed || '/' || c_custkey::VARCHAR), c_custkey) AS position
  FROM customer, (VALUES (30), (100), (300)) a(size), (VALUES ('A'), ('B'), ('C')) b(seed)) WHERE position <= size
""")
def sample_grid(spark, sf_dir):
    return statistics.sample_grid(table(spark, sf_dir, "customer"), "c_custkey", [30, 100, 300], ["A", "B", "C"])


# --- workload --------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{q}' AS query_id, count(*) FILTER (WHERE {w}) AS truth FROM lineitem" for q, w in WHERE.items()))
def truth_counts(spark, sf_dir):
    return statistics.truth_counts(table(spark, sf_dir, "lineitem"), WHERE)


REASONS = {"q07": "boolean-or", "q08": "boolean-not", "q10": "column-to-column", "q11": "unresolved-column-reference", "q14": "unsupported-null-test", "q15": "unsupported-operator"}


@query(f"SELECT query_id, CASE WHEN reason = '' THEN 'precise-structural' ELSE 'conservative-fallback' END AS mode, reason AS reasons FROM {values_sql([(q, REASONS.get(q, '')) for q in WHERE], 'query_id, reason')}")
def predicate_inspection(spark, sf_dir):
    return workloads.inspect(workload(spark)).select("query_id", "mode", F.array_join("reasons", ",").alias("reasons"))


PARSED = [(q, c, "in" if (q, c) == ("q04", "l_linenumber") else "=", "1,2" if (q, c) == ("q04", "l_linenumber") else v) for q, c, v in PREDICATES if (q, c, v) != ("q04", "l_linenumber", "2")] + [
    ("q09", "l_quantity", ">=", "25"), ("q09", "l_returnflag", "=", "A"), ("q12", "l_returnflag", "=", "Z"), ("q12", "l_linestatus", "=", "F"), ("q13", "l_returnflag", "is null", ""),
]


@query(f"SELECT query_id, \"column\", op, constants FROM {values_sql(PARSED, 'query_id, \"column\", op, constants')}")
def predicate_constants(spark, sf_dir):
    found = workloads.predicates(workloads.inspect(workload(spark)))
    return found.select("query_id", "column", "op", F.array_join("constants", ",").alias("constants"))


@query(f"SELECT DISTINCT query_id, \"column\" FROM {values_sql(PARSED, 'query_id, \"column\", op, constants')}")
def predicate_columns(spark, sf_dir):
    return workloads.predicates(workloads.inspect(workload(spark))).select("query_id", "column").distinct()


@query("SELECT query_id FROM (" + " UNION ALL ".join(f"SELECT '{q}' AS query_id, count(*) FILTER (WHERE {w}) AS truth FROM lineitem" for q, w in WHERE.items()) + ") WHERE truth > 0")
def effective_workload(spark, sf_dir):
    counted = workload(spark).join(statistics.truth_counts(table(spark, sf_dir, "lineitem"), WHERE), "query_id")
    return workloads.effective(counted).where("effective").select("query_id")


# --- candidates ------------------------------------------------------------------------------

PREDS_SQL = values_sql(PREDICATES, 'query_id, "column", value')
POSITIONS_SQL = values_sql([(c, k) for k, c in enumerate(COLUMNS)], '"column", position')
CANDIDATES_SQL = f"""
SELECT 'cand_' || substr(sha256('lineitem|' || mechanism || '|' || c1 || ',' || c2), 1, 20) AS candidate_id, 'lineitem' AS relation, mechanism, c1, c2,
       (row_number() OVER (ORDER BY CASE mechanism WHEN 'mcv' THEN 0 ELSE 1 END, p1, p2, c1, c2) - 1)::INTEGER AS precedence_rank
FROM (SELECT DISTINCT a."column" AS c1, b."column" AS c2, x.position AS p1, y.position AS p2
      FROM {PREDS_SQL} a JOIN {PREDS_SQL} b USING (query_id) JOIN {POSITIONS_SQL} x ON x."column" = a."column" JOIN {POSITIONS_SQL} y ON y."column" = b."column"
      WHERE x.position < y.position), (VALUES ('mcv'), ('fd')) m(mechanism)
"""


@query(CANDIDATES_SQL)
def candidate_rank(spark, sf_dir):
    return catalog(spark)


@query(f"SELECT candidate_id, mechanism FROM ({CANDIDATES_SQL}) WHERE precedence_rank < 4")
def candidate_cap(spark, sf_dir):
    positions = spark.createDataFrame([("lineitem", c, k) for k, c in enumerate(COLUMNS)], "relation string, column string, position int")
    own = predicate_rows(spark).withColumn("relation", F.lit("lineitem"))
    return candidates.ranked(candidates.generate(own, positions), cap=4).select("candidate_id", "mechanism")


@query("SELECT p_brand, p_type, 'cand_' || substr(sha256('part|mcv|' || p_brand || ',' || p_type), 1, 20) AS candidate_id FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def candidate_id(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    return pairs.select("p_brand", "p_type", scores.candidate_id(F.lit("part"), F.lit("mcv"), F.array("p_brand", "p_type")).alias("candidate_id"))


EDGES_SQL = f"""
SELECT candidate_id, q.query_id, CASE WHEN q.reason <> '' THEN 'fallback' ELSE 'columns' END AS reason
FROM ({CANDIDATES_SQL}) c, {values_sql([(q, REASONS.get(q, '')) for q in WHERE], 'query_id, reason')} q
WHERE q.reason <> '' OR (EXISTS (SELECT 1 FROM {values_sql(PARSED, 'query_id, "column", op, constants')} p WHERE p.query_id = q.query_id AND p."column" = c1)
  AND EXISTS (SELECT 1 FROM {values_sql(PARSED, 'query_id, "column", op, constants')} p WHERE p.query_id = q.query_id AND p."column" = c2))
"""


def edges(spark: SparkSession) -> DataFrame:
    return candidates.incidence(catalog(spark), workloads.inspect(workload(spark)))


@query(EDGES_SQL)
def incidence_edges(spark, sf_dir):
    return edges(spark)


@query(f"WITH c AS ({CANDIDATES_SQL}) SELECT DISTINCT query_id FROM ({EDGES_SQL}) WHERE candidate_id IN (SELECT candidate_id FROM c WHERE precedence_rank IN (0, 2))")
def affected_swap(spark, sf_dir):
    two = catalog(spark).where("precedence_rank in (0, 2)").select("candidate_id")
    return edges(spark).join(two, "candidate_id", "left_semi").select("query_id").distinct()


@query(f"""
WITH e AS (SELECT DISTINCT candidate_id, query_id FROM ({EDGES_SQL})), s AS (SELECT candidate_id, count(*) AS n FROM e GROUP BY 1),
p AS (SELECT a.candidate_id AS x, b.candidate_id AS y, count(*) AS k FROM e a JOIN e b ON a.query_id = b.query_id AND a.candidate_id < b.candidate_id GROUP BY ALL)
SELECT (SELECT count(DISTINCT query_id) FROM e) AS queries, (SELECT count(DISTINCT candidate_id) FROM e) AS candidates, count(*) AS overlapping_pairs,
       round(avg(k / (sx.n + sy.n - k)), 9) AS mean_jaccard FROM p JOIN s sx ON sx.candidate_id = x JOIN s sy ON sy.candidate_id = y
""")
def incidence_diversity(spark, sf_dir):
    return rounded(candidates.diversity(edges(spark)))


@query(f"""
WITH g AS (SELECT candidate_id, string_agg(DISTINCT query_id, ',' ORDER BY query_id) AS queries FROM ({EDGES_SQL}) GROUP BY 1)
SELECT queries, string_agg(candidate_id, ',' ORDER BY candidate_id) AS candidates, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 1
""")
def duplicate_incidence(spark, sf_dir):
    return candidates.duplicate_incidence(edges(spark))


# --- estimation ------------------------------------------------------------------------------

ESTIMATE_SQL = f"""
v AS ({VALUE_COUNTS}), total AS (SELECT count(*) AS rows FROM lineitem),
s AS (SELECT query_id, p."column" AS col, least(1.0, sum(coalesce(n, 0) / rows)) AS sel
      FROM {PREDS_SQL} p LEFT JOIN v ON v."column" = p."column" AND v.value = p.value, total GROUP BY ALL),
t AS ({" UNION ALL ".join(f"SELECT '{q}' AS query_id, count(*) FILTER (WHERE {WHERE[q]}) AS truth FROM lineitem" for q in PRECISE)}),
e0 AS (SELECT query_id, greatest(1.0, round_even(any_value(rows) * product(sel), 0)) AS estimate FROM s, total GROUP BY query_id),
c AS ({CANDIDATES_SQL}), pc AS ({PAIR_COUNTS}), deg AS (
  SELECT c1, c2, sum(CASE WHEN k = 1 THEN n ELSE 0 END) / sum(n) AS degree FROM (SELECT c1, c2, v1, count(*) AS k, sum(n) AS n FROM pc GROUP BY ALL) GROUP BY ALL),
f AS (SELECT a.query_id, candidate_id, mechanism, precedence_rank, c.c1, c.c2, sum(coalesce(n, 0) / rows) AS factor
      FROM c JOIN {PREDS_SQL} a ON a."column" = c.c1 JOIN {PREDS_SQL} b ON b."column" = c.c2 AND a.query_id = b.query_id
      LEFT JOIN pc ON pc.c1 = c.c1 AND pc.c2 = c.c2 AND pc.v1 = a.value AND pc.v2 = b.value, total WHERE mechanism = 'mcv' GROUP BY ALL
      UNION ALL
      SELECT x.query_id, candidate_id, mechanism, precedence_rank, c.c1, c.c2, x.sel * (degree + (1 - degree) * y.sel)
      FROM c JOIN s x ON x.col = c.c1 JOIN s y ON y.col = c.c2 AND x.query_id = y.query_id JOIN deg ON deg.c1 = c.c1 AND deg.c2 = c.c2 WHERE mechanism = 'fd'),
one AS (SELECT f.query_id, candidate_id, greatest(1.0, round_even(any_value(rows) * any_value(factor) * coalesce(product(sel) FILTER (WHERE col NOT IN (c1, c2)), 1.0), 0)) AS estimate
        FROM f JOIN s USING (query_id), total GROUP BY f.query_id, candidate_id),
base AS (SELECT query_id, estimate, truth::DOUBLE AS truth, greatest(estimate / truth, truth / estimate) AS contribution FROM e0 JOIN t USING (query_id)),
alone AS (SELECT candidate_id, query_id, contribution AS before, greatest(o.estimate / truth, truth / o.estimate) AS after FROM one o JOIN base USING (query_id)),
profile AS (SELECT candidate_id, count(*) AS affected, sum(before - after) AS reduction, count(*) FILTER (WHERE after < before) AS improved,
            count(*) FILTER (WHERE after = before) AS unchanged, count(*) FILTER (WHERE after > before) AS worsened FROM alone GROUP BY 1)
"""


@query(f"WITH {ESTIMATE_SQL} SELECT query_id, estimate, truth, round(contribution, 9) AS contribution FROM base")
def est_independent(spark, sf_dir):
    singles, factors, truth, rows = evaluation_inputs(spark, sf_dir)
    return rounded(estimation.estimates(singles, factors.limit(0), truth, rows))


def _single_design(rank: int) -> str:
    return f"""WITH {ESTIMATE_SQL}, own AS (SELECT o.* FROM one o JOIN c USING (candidate_id) WHERE precedence_rank = {rank}),
m AS (SELECT b.query_id, coalesce(own.estimate, b.estimate) AS estimate, truth FROM base b LEFT JOIN own USING (query_id))
SELECT query_id, estimate, truth, round(greatest(estimate / truth, truth / estimate), 9) AS contribution FROM m"""


def _under(spark, sf_dir, rank: int) -> DataFrame:
    singles, factors, truth, rows = evaluation_inputs(spark, sf_dir)
    return rounded(estimation.estimates(singles, factors.where(F.col("precedence_rank") == rank), truth, rows))


@query(_single_design(0))
def est_pair_mcv(spark, sf_dir):
    return _under(spark, sf_dir, 0)


@query(_single_design(3))
def est_fd(spark, sf_dir):
    return _under(spark, sf_dir, 3)


@query(f"WITH {ESTIMATE_SQL} SELECT query_id, round(contribution, 9) AS contribution FROM base")
def qerror_per_query(spark, sf_dir):
    return est_independent(spark, sf_dir).select("query_id", "contribution")


@query(f"WITH {ESTIMATE_SQL} SELECT round(sum(contribution), 6) AS objective, count(*) AS queries FROM base")
def objective_total(spark, sf_dir):
    singles, factors, truth, rows = evaluation_inputs(spark, sf_dir)
    return rounded(estimation.objective(estimation.estimates(singles, factors.limit(0), truth, rows)), 6)


@query(f"""WITH {ESTIMATE_SQL}, own AS (SELECT o.* FROM one o JOIN c USING (candidate_id) WHERE precedence_rank = 0)
SELECT b.query_id, coalesce(own.estimate, b.estimate) AS estimate, truth, round(greatest(coalesce(own.estimate, b.estimate) / truth, truth / coalesce(own.estimate, b.estimate)), 9) AS contribution,
       own.query_id IS NULL AS reused FROM base b LEFT JOIN own USING (query_id)""")
def move_reuse(spark, sf_dir):
    singles, factors, truth, rows = evaluation_inputs(spark, sf_dir)
    before = estimation.estimates(singles, factors.limit(0), truth, rows)
    added = factors.where("precedence_rank = 0")
    hit = singles.join(added.select("query_id").distinct(), "query_id", "left_semi")
    return rounded(estimation.reuse(before, estimation.estimates(hit, added, truth, rows)))


@query(f"""WITH {ESTIMATE_SQL} SELECT candidate_id, count(*) AS affected, round((SELECT sum(contribution) FROM base) - sum(contribution) + count(*), 6) AS bound
FROM (SELECT DISTINCT candidate_id, query_id FROM f) JOIN base USING (query_id) GROUP BY 1""")
def lower_bound_all(spark, sf_dir):
    singles, factors, truth, rows = evaluation_inputs(spark, sf_dir)
    base = estimation.estimates(singles, factors.limit(0), truth, rows)
    return rounded(estimation.lower_bounds(base, factors.select("candidate_id", "query_id")), 6)


@query(f"WITH {ESTIMATE_SQL} SELECT candidate_id, affected, round(reduction, 6) AS reduction, improved, unchanged, worsened FROM profile")
def singleton_profile(spark, sf_dir):
    return rounded(estimation.singleton_profile(*evaluation_inputs(spark, sf_dir)), 6)


@query(f"WITH {ESTIMATE_SQL} SELECT candidate_id, round(reduction, 6) AS reduction FROM profile JOIN c USING (candidate_id) WHERE reduction > 0 ORDER BY profile.reduction DESC, precedence_rank LIMIT 1")
def greedy_first_round(spark, sf_dir):
    singles, factors, truth, rows = evaluation_inputs(spark, sf_dir)
    finder = search.Search(search.catalog(catalog(spark)), search.Evaluator.from_frames(singles, factors, truth, rows), costs.preset(0, 0, 0, 0), Decimal(1))
    state = finder.evaluator.full(frozenset())
    best = finder.round(frozenset(), state, Decimal(0), search.Result((), 0.0, Decimal(0)), False)
    found = [(best[1].add, float(sum(state.values()) - best[0][0]))] if best else []
    return rounded(spark.createDataFrame(found, "candidate_id string, reduction double"), 6)


@query()
def full_search(spark, sf_dir):
    """Greedy and local search under a budget of six units: the accepted moves."""
    singles, factors, truth, rows = evaluation_inputs(spark, sf_dir)
    finder = search.Search(search.catalog(catalog(spark)), search.Evaluator.from_frames(singles, factors, truth, rows), costs.preset(), Decimal(6))
    steps = [(k, s["phase"], s["kind"], s["add"], s["drop"], s["objective"], float(s["cost"])) for k, s in enumerate(finder.run().trajectory, 1)]
    return spark.createDataFrame(steps, "step int, phase string, kind string, add string, drop string, objective double, cost double")


@query(f"""WITH {ESTIMATE_SQL}, r AS (SELECT candidate_id, reduction, row_number() OVER (ORDER BY round(reduction, 6) DESC, precedence_rank) AS rank, count(*) OVER () AS n FROM profile JOIN c USING (candidate_id))
SELECT candidate_id, round(reduction, 6) AS reduction, rank::INTEGER AS rank FROM r WHERE rank <= ceil(n * 40 / 100.0)""")
def screen_top_fraction(spark, sf_dir):
    profile = rounded(estimation.singleton_profile(*evaluation_inputs(spark, sf_dir)), 6).join(catalog(spark).select("candidate_id", "precedence_rank"), "candidate_id")
    return rankings.screen(profile, rankings.best_first("reduction", "precedence_rank"), 40).select("candidate_id", "reduction", "rank")


@query(f"SELECT candidate_id, CASE mechanism WHEN 'mcv' THEN 2 ELSE 3 END::DOUBLE AS cost, (CASE mechanism WHEN 'mcv' THEN 2 ELSE 3 END + 2) <= 4 AS feasible FROM ({CANDIDATES_SQL})")
def cost_feasible(spark, sf_dir):
    return costs.feasible_additions(catalog(spark), Decimal(2), costs.preset(), Decimal(4)).withColumn("cost", F.col("cost").cast("double"))


@query(f"SELECT sum(CASE mechanism WHEN 'mcv' THEN 1.7474 ELSE 3.3411 END)::DOUBLE AS cost, count(*) AS members, sum(CASE mechanism WHEN 'mcv' THEN 1.7474 ELSE 3.3411 END) <= 20 AS feasible FROM ({CANDIDATES_SQL})")
def design_cost(spark, sf_dir):
    everything = [c.candidate_id for c in search.catalog(catalog(spark))]
    return costs.design_cost(catalog(spark), everything, costs.measured(1.7474, 3.3411), Decimal(20)).withColumn("cost", F.round(F.col("cost").cast("double"), 9))


@query(f"""WITH {ESTIMATE_SQL} SELECT candidate_id AS design, round((SELECT sum(contribution) FROM base) + coalesce(sum(after - before), 0), 6) AS objective, count(query_id) AS changed
FROM c LEFT JOIN alone USING (candidate_id) GROUP BY 1""")
def design_batch(spark, sf_dir):
    """Every candidate as a design of its own, all in one job."""
    designs = catalog(spark).select("candidate_id", F.col("candidate_id").alias("design"))
    return rounded(estimation.design_objectives(*evaluation_inputs(spark, sf_dir), designs), 6)
