"""Registered queries of ranking, comparison, calibration and rendering, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import ddl, scores
from tesserae.operators import calibration, comparison, diagnostics, rankings
from tesserae.operators.statistics import column_mcv
from tesserae.queries import (
    CANDIDATES_SQL, COLUMNS, ESTIMATE_SQL, POSITIONS_SQL, PREDS_SQL, catalog, evaluation_inputs, predicate_rows, query, rounded, table, values_sql,
)


def revenue(spark, sf_dir):
    """customer, orders' value: the items whose ranks and concentration are asked for."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("orders")
    )


REVENUE = "(SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, count(*) AS orders FROM orders GROUP BY 1)"


def order():
    return [F.desc("cents"), F.asc("o_custkey")]


@query(f"""
SELECT o_custkey, rank::INTEGER AS rank, round(100.0 * (n - rank + 1) / n, 9) AS percentile,
  CASE WHEN rank <= ceil(n * 1 / 100.0) THEN 'top_1pct' WHEN rank <= ceil(n * 5 / 100.0) THEN 'top_5pct' WHEN rank <= ceil(n * 10 / 100.0) THEN 'top_10pct'
       WHEN rank <= ceil(n * 20 / 100.0) THEN 'top_20pct' WHEN rank <= ceil(n * 50 / 100.0) THEN 'top_50pct' WHEN rank <= ceil(n * 80 / 100.0) THEN 'top_80pct'
       ELSE 'bottom_20pct' END AS bucket
FROM (SELECT *, row_number() OVER (ORDER BY cents DESC, o_custkey) AS rank, count(*) OVER () AS n FROM {REVENUE})
""")
def percentile_bucket(spark, sf_dir):
    return rounded(rankings.ranked(revenue(spark, sf_dir), order()).select("o_custkey", "rank", "percentile", "bucket"))


@query(f"SELECT o_custkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY cents DESC, o_custkey) AS rank, count(*) OVER () AS n FROM {REVENUE}) WHERE rank <= ceil(n * 7 / 100.0)")
def top_fraction(spark, sf_dir):
    return rankings.screen(revenue(spark, sf_dir), order(), 7).select("o_custkey", "rank")


@query("""SELECT p_brand, p_partkey, rank::INTEGER AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank,
  count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rank <= ceil(n * 10 / 100.0)""")
def top_fraction_grouped(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return rankings.screen(part, [F.desc("p_retailprice"), F.asc("p_partkey")], 10, ["p_brand"]).select("p_brand", "p_partkey", "rank")


@query(f"SELECT o_custkey, cents FROM {REVENUE} ORDER BY cents DESC, o_custkey LIMIT 20")
def top_contributors(spark, sf_dir):
    return revenue(spark, sf_dir).orderBy(*order()).limit(20).select("o_custkey", "cents")


RANKS = f"(SELECT *, row_number() OVER (ORDER BY orders DESC, o_custkey) AS p, row_number() OVER (ORDER BY cents DESC, o_custkey) AS a FROM {REVENUE})"


def recalls(spark, sf_dir):
    return rankings.recall_at(revenue(spark, sf_dir), [F.desc("orders"), F.asc("o_custkey")], order(), "cents", [10, 50, 100])


@query(f"SELECT k::INTEGER AS k, round(count(*) FILTER (WHERE p <= k AND a <= k) / count(*) FILTER (WHERE a <= k), 9) AS recall FROM {RANKS}, (VALUES (10), (50), (100)) t(k) GROUP BY k")
def recall_at_k(spark, sf_dir):
    return rounded(recalls(spark, sf_dir).select("k", "recall"))


@query(f"SELECT k::INTEGER AS k, round(sum(cents) FILTER (WHERE p <= k AND a <= k) / sum(cents) FILTER (WHERE a <= k), 9) AS gain_recall FROM {RANKS}, (VALUES (10), (50), (100)) t(k) GROUP BY k")
def gain_recall(spark, sf_dir):
    return rounded(recalls(spark, sf_dir).select("k", "gain_recall"))


@query(" UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, round(quantile_cont(c_acctbal, {s}), 6) AS value FROM customer" for s in (0.05, 0.25, 0.5, 0.9, 0.99)))
def quantile_linear(spark, sf_dir):
    return rounded(rankings.linear_quantiles(table(spark, sf_dir, "customer"), "c_acctbal", [0.05, 0.25, 0.5, 0.9, 0.99]), 6)


@query(" UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, quantile_disc(c_acctbal, {s}) AS value FROM customer" for s in (0.5, 0.9, 0.95, 1.0)))
def quantile_nearest(spark, sf_dir):
    return rankings.nearest_quantiles(table(spark, sf_dir, "customer"), "c_acctbal", [0.5, 0.9, 0.95, 1.0])


RUNNING = f"(SELECT *, row_number() OVER w AS n, sum(cents) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM {REVENUE} WINDOW w AS (ORDER BY cents DESC, o_custkey))"


@query(f"""SELECT percent::INTEGER AS percent, n::BIGINT AS items, round(upto / total, 9) AS share
FROM {RUNNING}, (SELECT count(*) AS rows, sum(cents) AS total FROM {REVENUE}), (VALUES (1), (5), (10), (20), (50)) t(percent) WHERE n = ceil(rows * percent / 100.0)""")
def concentration(spark, sf_dir):
    return rounded(rankings.concentration(revenue(spark, sf_dir), "cents", "o_custkey", [1, 5, 10, 20, 50]))


@query(f"""SELECT percent::INTEGER AS percent, min(n)::INTEGER AS items FROM {RUNNING}, (SELECT sum(cents) AS total FROM {REVENUE}), (VALUES (50), (80), (90), (95)) t(percent)
WHERE upto >= total * percent / 100.0 GROUP BY percent""")
def concentration_counts(spark, sf_dir):
    return rankings.items_for(revenue(spark, sf_dir), "cents", "o_custkey", [50, 80, 90, 95])


@query("""SELECT o_orderpriority, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1""")
def best_move(spark, sf_dir):
    moves = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return rankings.best_move(moves, ["o_totalprice", "o_orderkey"], ["o_orderpriority"])


# --- comparisons: an order's quantity stands for one evaluation, its value for another -------

PAIRED = "(SELECT l_orderkey::VARCHAR AS query_id, 1 + sum(l_quantity)::DOUBLE AS before, 1 + count(*) * 25.0::DOUBLE AS after FROM lineitem GROUP BY 1)"


def paired(spark, sf_dir):
    """query_id, before, after: whole numbers, so that sums do not depend on order."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("query_id")).agg(
        (F.sum("l_quantity") + 1).alias("before"), (F.count("*") * 25.0 + 1).cast("double").alias("after")
    )


def changed(spark, sf_dir):
    both = paired(spark, sf_dir)
    return comparison.changes(both.select("query_id", F.col("before").alias("contribution")), both.where("query_id <> '7'").select("query_id", F.col("after").alias("contribution")))


CHANGED = f"""(SELECT a.query_id, a.before, b.after, abs(b.after - a.before) AS drift,
  CASE WHEN b.after IS NULL THEN 'unmatched' WHEN b.after < a.before THEN 'improved' WHEN b.after > a.before THEN 'worsened' ELSE 'unchanged' END AS direction
  FROM {PAIRED} a LEFT JOIN (SELECT * FROM {PAIRED} WHERE query_id <> '7') b USING (query_id))"""


@query(f"SELECT * FROM {CHANGED}")
def frozen_vs_fresh(spark, sf_dir):
    return changed(spark, sf_dir)


@query(f"""SELECT count(*) FILTER (WHERE direction = 'improved') AS improved, count(*) FILTER (WHERE direction = 'unchanged') AS unchanged,
  count(*) FILTER (WHERE direction = 'worsened') AS worsened, sum(before) AS before, sum(after) AS after FROM {CHANGED}""")
def change_summary(spark, sf_dir):
    return comparison.change_summary(changed(spark, sf_dir))


@query(f"""SELECT round(quantile_cont(abs(ln(after / before)), 0.5), 9) AS median_abs_log_ratio, round(quantile_cont(abs(ln(after / before)), 0.9), 9) AS p90_abs_log_ratio,
  round(count(*) FILTER (WHERE after > before) / count(*), 9) AS greater, round(count(*) FILTER (WHERE after < before) / count(*), 9) AS less FROM {PAIRED}""")
def vector_diagnostics(spark, sf_dir):
    return rounded(comparison.vector_diagnostics(paired(spark, sf_dir)))


@query(f"""SELECT CASE WHEN q <= 1.05 THEN '<=1.05' WHEN q <= 2 THEN '1.05-2' WHEN q <= 10 THEN '2-10' ELSE '>10' END AS bucket, count(*) AS queries
FROM (SELECT greatest(before / after, after / before) AS q FROM {PAIRED}) GROUP BY 1""")
def ratio_buckets(spark, sf_dir):
    q = paired(spark, sf_dir).withColumn("contribution", scores.q_error(F.col("before"), F.col("after")))
    return comparison.ratio_buckets(q)


@query(f"SELECT sum(before) AS objective, count(*) AS queries FROM {PAIRED} WHERE query_id NOT IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'P')")
def trimmed_objective(spark, sf_dir):
    out = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("query_id"))
    return comparison.trimmed(paired(spark, sf_dir).withColumnRenamed("before", "contribution"), out)


@query(f"""SELECT round(corr(x, y), 9) AS spearman FROM (SELECT (rank() OVER (ORDER BY before) + (count(*) OVER (PARTITION BY before) - 1) / 2.0)::DOUBLE AS x,
  (rank() OVER (ORDER BY after) + (count(*) OVER (PARTITION BY after) - 1) / 2.0)::DOUBLE AS y FROM {PAIRED})""")
def spearman_avg(spark, sf_dir):
    return rounded(comparison.spearman(paired(spark, sf_dir), "before", "after"))


@query(f"""SELECT round(corr(x, y), 9) AS spearman FROM (SELECT (row_number() OVER (ORDER BY before, query_id))::DOUBLE AS x, (row_number() OVER (ORDER BY after, query_id))::DOUBLE AS y FROM {PAIRED})""")
def spearman_ordinal(spark, sf_dir):
    return rounded(comparison.ordinal_spearman(paired(spark, sf_dir), "before", "after", "query_id"))


@query(f"SELECT round(corr(before, after), 9) AS pearson FROM {PAIRED}")
def pearson(spark, sf_dir):
    return rounded(paired(spark, sf_dir).agg(F.corr("before", "after").alias("pearson")))


# --- designs: a supplier nation's parts brands stand for the members of a design -------------

MEMBERS = "(SELECT DISTINCT c_nationkey::VARCHAR AS design, c_mktsegment || (c_custkey % 40)::VARCHAR AS candidate_id FROM customer)"


def members(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("design"), F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("candidate_id")
    ).distinct()


@query(f"""WITH m AS {MEMBERS}, s AS (SELECT design, count(*) AS n FROM m GROUP BY 1),
b AS (SELECT x.design AS design_a, y.design AS design_b, count(*) AS shared FROM m x JOIN m y ON x.candidate_id = y.candidate_id AND x.design < y.design GROUP BY ALL)
SELECT p.design AS design_a, q.design AS design_b, coalesce(shared, 0)::BIGINT AS shared, p.n + q.n - coalesce(shared, 0) AS either, round(coalesce(shared, 0) / (p.n + q.n - coalesce(shared, 0)), 9) AS jaccard
FROM s p JOIN s q ON p.design < q.design LEFT JOIN b ON b.design_a = p.design AND b.design_b = q.design""")
def jaccard_pairs(spark, sf_dir):
    return rounded(comparison.design_overlap(members(spark, sf_dir)))


@query(f"WITH m AS {MEMBERS}, n AS (SELECT count(DISTINCT design) AS n FROM m) SELECT candidate_id, count(DISTINCT design) AS designs, round(count(DISTINCT design) / any_value(n), 9) AS share, count(DISTINCT design) = any_value(n) AS core FROM m, n GROUP BY 1")
def selection_frequency(spark, sf_dir):
    return rounded(comparison.selection_frequency(members(spark, sf_dir)))


RUNS = "(SELECT o_orderpriority AS run, o_custkey::VARCHAR AS query_id, max(o_orderkey)::DOUBLE AS before, (max(o_orderkey) + min(o_orderkey) % 3 - 1)::DOUBLE AS after FROM orders GROUP BY ALL)"


@query(f"""SELECT query_id, CASE WHEN count(*) FILTER (WHERE after < before) = count(*) THEN 'always_improved' WHEN count(*) FILTER (WHERE after = before) = count(*) THEN 'always_unchanged'
  WHEN count(*) FILTER (WHERE after > before) = count(*) THEN 'always_worsened' ELSE 'mixed' END AS category FROM {RUNS} GROUP BY 1""")
def query_stability(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.col("o_custkey").cast("string").alias("query_id")).agg(
        F.max("o_orderkey").cast("double").alias("before"), (F.max("o_orderkey") + F.min("o_orderkey") % 3 - 1).cast("double").alias("after")
    )
    return comparison.query_stability(runs)


@query("""WITH a AS (SELECT p_brand AS value, count(*) / (SELECT count(*) FROM part WHERE p_size <= 12) AS f FROM part WHERE p_size <= 12 AND p_brand <> 'Brand#1' GROUP BY 1),
b AS (SELECT p_brand AS value, count(*) / (SELECT count(*) FROM part WHERE p_size > 12) AS f FROM part WHERE p_size > 12 AND p_brand <> 'Brand#2' GROUP BY 1)
SELECT 'p_brand' AS "column", coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NULL THEN 'right-only' WHEN b.value IS NULL THEN 'left-only' ELSE 'both' END AS "where",
  round(abs(a.f - b.f), 9) AS delta FROM a FULL JOIN b ON a.value = b.value""")
def mcv_overlap(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    one = column_mcv(part.where("p_size <= 12"), ["p_brand"], 1000).where("value <> 'Brand#1'")
    other = column_mcv(part.where("p_size > 12"), ["p_brand"], 1000).where("value <> 'Brand#2'")
    return rounded(comparison.mcv_overlap(one, other))


CELLS = "(SELECT o_orderstatus AS design, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS sample, 1 + o_custkey::DOUBLE AS contribution FROM orders)"


def cells(spark, sf_dir):
    sample = F.when(F.col("o_orderkey") % 3 == 0, "F").when(F.col("o_orderkey") % 3 == 1, "O").otherwise("P")
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("design"), sample.alias("sample"), (F.col("o_custkey") + 1).cast("double").alias("contribution"))


@query(f"SELECT design, " + ", ".join(f"sum(contribution) FILTER (WHERE sample = '{s}') AS \"{s}\"" for s in "FOP") + f" FROM {CELLS} GROUP BY 1")
def cross_matrix(spark, sf_dir):
    return comparison.cross_matrix(cells(spark, sf_dir), ["F", "O", "P"])


@query(f"WITH c AS (SELECT design, sample, sum(contribution) AS objective FROM {CELLS} GROUP BY ALL) SELECT c.design, c.sample, c.objective, round((c.objective - o.objective) / o.objective, 9) AS gap FROM c JOIN c o ON o.sample = c.sample AND o.design = o.sample")
def cross_gaps(spark, sf_dir):
    return rounded(comparison.cross_gaps(cells(spark, sf_dir)))


@query("""WITH p AS (SELECT s_nationkey::VARCHAR AS candidate_id, (sum(round(s_acctbal))::BIGINT % 500 - 200)::DOUBLE AS reduction FROM supplier GROUP BY 1),
t AS (SELECT c_nationkey::VARCHAR AS candidate_id, (c_custkey % 17)::INTEGER AS round, (c_custkey % 400)::DOUBLE AS improvement FROM customer),
m AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY improvement DESC, round) AS n FROM t)
SELECT candidate_id, reduction AS alone, improvement AS in_context, round, improvement - reduction AS gain,
  CASE WHEN reduction <= 0 THEN CASE WHEN improvement > 0 THEN 'rescued' ELSE 'useless' END WHEN improvement > reduction THEN 'synergy' WHEN improvement < reduction THEN 'overlap' ELSE 'additive' END AS kind
FROM p JOIN m USING (candidate_id) WHERE n = 1""")
def interaction_gain(spark, sf_dir):
    profile = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("candidate_id")).agg(
        (F.sum(F.round("s_acctbal")).cast("long") % 500 - 200).cast("double").alias("reduction")
    )
    steps = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("candidate_id"), (F.col("c_custkey") % 17).cast("int").alias("round"), (F.col("c_custkey") % 400).cast("double").alias("improvement")
    )
    return comparison.interaction_gain(profile, steps)


SUMMARY = """(SELECT l_linenumber AS target, count(*) AS runs, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd,
  (max(l_quantity) - min(l_quantity)) / nullif(avg(l_quantity), 0) AS range_over_mean, stddev_samp(l_quantity) / nullif(avg(l_quantity), 0) AS cv FROM lineitem GROUP BY 1)"""


def summary(spark, sf_dir):
    return comparison.objective_summary(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("target"), F.col("l_quantity").alias("objective")))


@query(f"SELECT target, runs, round(mean, 9) AS mean, round(sd, 9) AS sd, round(range_over_mean, 9) AS range_over_mean, round(cv, 9) AS cv FROM {SUMMARY}")
def objective_summary(spark, sf_dir):
    return rounded(summary(spark, sf_dir))


@query(f"SELECT target, round((lag(mean) OVER (ORDER BY target) - mean) / nullif(lag(mean) OVER (ORDER BY target), 0), 9) AS gain FROM {SUMMARY}")
def marginal_gain(spark, sf_dir):
    return rounded(comparison.marginal_gains(summary(spark, sf_dir)))


@query("""WITH s AS (SELECT p_brand AS name, p_type AS kind, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS k FROM part GROUP BY ALL)
SELECT a.name AS name_a, b.name AS name_b, a.kind FROM s a JOIN s b ON a.kind = b.kind AND a.k = b.k AND a.name <> b.name""")
def equivalent_stats(spark, sf_dir):
    objects = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("kind")).agg(F.collect_set("p_name").alias("keys"))
    return comparison.same_statistics(objects, objects)


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_name LIKE 'small%' AND p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1)")
def unexpected_objects(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_size")
    return comparison.unexpected(names.select("name").distinct(), names.where("p_size = 1"), "small")


@query("""SELECT a.p_partkey::VARCHAR AS candidate_id, CASE WHEN a.p_size > 10 AND b.p_size > 5 THEN CASE WHEN a.p_brand = b.p_brand THEN 'present-same' ELSE 'present-changed' END
  WHEN a.p_size <= 10 AND b.p_size <= 5 THEN 'absent-same' WHEN a.p_size > 10 THEN 'present-to-absent' ELSE 'absent-to-present' END AS change
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def payload_changes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    side = lambda shift, limit: part.select((F.col("p_partkey") - shift).cast("string").alias("candidate_id"), F.when(F.col("p_size") > limit, "PRESENT").otherwise("ABSENT_NATIVE").alias("state"), F.col("p_brand").alias("digest"))
    return comparison.payload_changes(side(0, 10), side(1, 5))


# --- calibration -----------------------------------------------------------------------------


@query("""SELECT p_brand, count(*) AS runs, round(avg(p_retailprice), 6) AS mean, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(stddev_samp(p_retailprice), 6) AS sd,
  round(stddev_samp(p_retailprice) / avg(p_retailprice), 6) AS cv, min(p_retailprice) AS min, max(p_retailprice) AS max FROM part GROUP BY 1""")
def timing_summary(spark, sf_dir):
    return rounded(calibration.timing_summary(table(spark, sf_dir, "part"), "p_brand", "p_retailprice"), 6)


@query("""SELECT p_brand, round(stddev_samp(m) / avg(m), 6) AS cv FROM (SELECT p_brand, p_type, avg(p_retailprice) AS m FROM part GROUP BY ALL) GROUP BY 1""")
def subset_variation(spark, sf_dir):
    return rounded(calibration.subset_variation(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_retailprice"), 6)


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_one(spark, sf_dir):
    return rounded(calibration.line_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 6)


@query("""WITH s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS x, sum(z) AS z, sum(y) AS y, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy
  FROM (SELECT l_quantity AS x, l_linenumber::DOUBLE AS z, l_extendedprice AS y FROM lineitem)),
c AS (SELECT xx - x * x / n AS a, xz - x * z / n AS b, zz - z * z / n AS d, xy - x * y / n AS e, zy - z * y / n AS f, * FROM s),
k AS (SELECT (d * e - b * f) / (a * d - b * b) AS p, (a * f - b * e) / (a * d - b * b) AS q, * FROM c)
SELECT round((y - p * x - q * z) / n, 3) AS intercept, round(p, 3) AS per_mcv, round(q, 3) AS per_fd FROM k""")
def ols_three(spark, sf_dir):
    fit = calibration.plane_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber", "l_extendedprice")
    row = [tuple(fit[k] for k in ("intercept", "per_mcv", "per_fd"))]
    return rounded(spark.createDataFrame(row, "intercept double, per_mcv double, per_fd double"), 3)


# --- scalar functions and rendering ----------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 10 + 1) / 100.0 * 2000 ELSE c_custkey % 10 + 1 END::DOUBLE AS n FROM customer""")
def distinct_normalised(spark, sf_dir):
    own = F.col("c_custkey") % 10 + 1
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scores.distinct_values(F.when(F.col("c_custkey") % 3 == 0, -own / 100.0).otherwise(own.cast("double")), F.lit(2000)).alias("n")
    )


@query("""SELECT p_partkey, substr('tess_' || regexp_replace(lower('part_' || p_name || '_' || p_type), '[^a-z0-9]+', '_', 'g'), 1, 40) || '_' || substr(sha256(p_partkey::VARCHAR), 1, 10) AS name FROM part""")
def object_names(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", ddl.object_name_column(key, F.lit("part"), F.array("p_name", "p_type")).alias("name"))


@query()
def deployment_plan(spark, sf_dir):
    """The statements that deploy the first two candidates of the catalog."""
    rows = catalog(spark).where("precedence_rank < 2").orderBy("precedence_rank").collect()
    plan = ddl.deployment([{"candidate_id": r["candidate_id"], "relation": r["relation"], "mechanism": r["mechanism"], "columns": [r["c1"], r["c2"]]} for r in rows], 100)
    return spark.createDataFrame([(k, s) for k, s in enumerate([*plan["deploy"], *plan["rollback"]])], "step int, statement string")


# --- diagnostics -----------------------------------------------------------------------------


@query("SELECT p_brand, count(*) AS n FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200) GROUP BY 1")
def top_composition(spark, sf_dir):
    return diagnostics.composition(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 200, "p_brand")


@query(f"""WITH p AS (SELECT DISTINCT query_id, "column" AS c FROM {PREDS_SQL})
SELECT c AS columns, count(*) AS queries FROM p GROUP BY 1
UNION ALL SELECT a.c || ',' || b.c, count(*) FROM p a JOIN p b ON a.query_id = b.query_id AND a.c < b.c GROUP BY 1""")
def column_pair_frequencies(spark, sf_dir):
    return diagnostics.column_use(predicate_rows(spark))


@query(f'SELECT "column", value, count(DISTINCT query_id) AS queries FROM {PREDS_SQL} GROUP BY ALL')
def constant_frequencies(spark, sf_dir):
    return diagnostics.constant_use(predicate_rows(spark))


LISTS = """l AS (SELECT 'l_linenumber' AS "column", l_linenumber::VARCHAR AS value FROM (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_linenumber::VARCHAR LIMIT 4)),
r AS (SELECT 'l_linenumber' AS "column", l_linenumber::VARCHAR AS value FROM (SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1 ORDER BY n DESC, l_linenumber::VARCHAR LIMIT 4))"""


def two_lists(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return column_mcv(items, ["l_linenumber"], 4), column_mcv(items.where("l_quantity > 25"), ["l_linenumber"], 4)


@query(f"""WITH {LISTS}, c AS (SELECT DISTINCT "column", value FROM {PREDS_SQL})
SELECT c."column", c.value, CASE WHEN l.value IS NOT NULL AND r.value IS NOT NULL THEN 'both' WHEN l.value IS NOT NULL THEN 'left-only' WHEN r.value IS NOT NULL THEN 'right-only' ELSE 'neither' END AS place
FROM c LEFT JOIN l ON l."column" = c."column" AND l.value = c.value LEFT JOIN r ON r."column" = c."column" AND r.value = c.value""")
def constant_representation(spark, sf_dir):
    return diagnostics.constant_places(predicate_rows(spark), *two_lists(spark, sf_dir))


@query(f"""WITH {LISTS} SELECT 'l_linenumber' AS "column",
  coalesce((SELECT string_agg(value, ',' ORDER BY value) FROM r WHERE value NOT IN (SELECT value FROM l)), '') AS added,
  coalesce((SELECT string_agg(value, ',' ORDER BY value) FROM l WHERE value NOT IN (SELECT value FROM r)), '') AS removed""")
def mcv_added_removed(spark, sf_dir):
    return diagnostics.list_changes(*two_lists(spark, sf_dir))


@query(f"SELECT relation, c1, c2, count(DISTINCT mechanism) AS mechanisms FROM ({CANDIDATES_SQL}) GROUP BY ALL HAVING count(DISTINCT mechanism) > 1")
def twin_candidates(spark, sf_dir):
    return diagnostics.twin_candidates(catalog(spark))


WANTED = [("lineitem", "mcv", "l_linestatus", "l_returnflag"), ("lineitem", "fd", "l_returnflag", "nowhere"), ("lineitem", "fd", "l_linenumber", "l_linenumber"), ("lineitem", "fd", "l_linestatus", "l_linenumber")]


@query(f"""SELECT DISTINCT relation, mechanism, CASE WHEN x.position < y.position THEN a ELSE b END AS c1, CASE WHEN x.position < y.position THEN b ELSE a END AS c2,
  least(x.position, y.position)::INTEGER AS p1, greatest(x.position, y.position)::INTEGER AS p2
FROM {values_sql(WANTED, 'relation, mechanism, a, b')} w JOIN {POSITIONS_SQL} x ON x."column" = a JOIN {POSITIONS_SQL} y ON y."column" = b WHERE x.position <> y.position""")
def explicit_candidates(spark, sf_dir):
    positions = spark.createDataFrame([("lineitem", c, k) for k, c in enumerate(COLUMNS)], "relation string, column string, position int")
    return diagnostics.explicit(spark.createDataFrame(WANTED, "relation string, mechanism string, a string, b string"), positions)


@query("""SELECT o_custkey::VARCHAR AS candidate_id, o_orderkey::VARCHAR AS query_id FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 1)""")
def incidence_load(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("candidate_id"), F.col("o_orderkey").cast("string").alias("query_id"))
    left = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("candidate_id"))
    right = table(spark, sf_dir, "lineitem").where("l_quantity = 1").select(F.col("l_orderkey").cast("string").alias("query_id"))
    return diagnostics.known_edges(links, left, right)


@query(f"""WITH w AS (SELECT *, row_number() OVER (ORDER BY cents DESC, o_custkey) <= 50 AS best, row_number() OVER (ORDER BY orders DESC, o_custkey) AS x,
  row_number() OVER (ORDER BY o_custkey) AS y, count(*) OVER () AS n FROM {REVENUE}), r AS (SELECT 'by_orders' AS ranking, best, x AS rank, n FROM w UNION ALL SELECT 'by_key', best, y, n FROM w)
SELECT ranking, percent::INTEGER AS percent, count(*) AS kept, round(count(*) FILTER (WHERE best) / 50, 9) AS recall FROM r, (VALUES (1), (2), (5), (10), (20), (30), (40), (50), (80), (100)) t(percent)
WHERE rank <= ceil(n * percent / 100.0) GROUP BY ALL""")
def screening_recall(spark, sf_dir):
    ways = {"by_orders": [F.desc("orders"), F.asc("o_custkey")], "by_key": [F.asc("o_custkey")]}
    return rounded(diagnostics.screening_recall(revenue(spark, sf_dir), ways, order(), 50, [1, 2, 5, 10, 20, 30, 40, 50, 80, 100]))


@query(f"""WITH g AS (SELECT target, (lag(mean) OVER (ORDER BY target) - mean) / lag(mean) OVER (ORDER BY target) AS gain FROM {SUMMARY}),
m AS (SELECT target, max(gain) OVER (ORDER BY target ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM g)
SELECT min(target) AS knee FROM m WHERE later < 0.002 OR later IS NULL""")
def target_knee(spark, sf_dir):
    return diagnostics.knee(comparison.marginal_gains(summary(spark, sf_dir)), 0.002)


@query("SELECT c_nationkey::VARCHAR AS candidate_id, (c_custkey % 17)::INTEGER AS round, (c_custkey % 90)::DOUBLE AS improvement FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 90 DESC, c_custkey % 17) = 1")
def best_context(spark, sf_dir):
    steps = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("candidate_id"), (F.col("c_custkey") % 17).cast("int").alias("round"), (F.col("c_custkey") % 90).cast("double").alias("improvement")
    )
    return diagnostics.best_context(steps)


@query(f"""SELECT o_custkey AS candidate_id, first, rank::INTEGER AS rank, round(100.0 * (n - rank + 1) / n, 9) AS percentile FROM (SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_totalprice > 480000 GROUP BY 1)
LEFT JOIN (SELECT o_custkey, row_number() OVER (ORDER BY cents DESC, o_custkey) AS rank, count(*) OVER () AS n FROM {REVENUE}) USING (o_custkey)""")
def accepted_retrospective(spark, sf_dir):
    ranked = rankings.ranked(revenue(spark, sf_dir), order()).withColumnRenamed("o_custkey", "candidate_id")
    accepted = table(spark, sf_dir, "orders").where("o_totalprice > 480000").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.min("o_orderkey").alias("first"))
    return rounded(diagnostics.retrospective(accepted, ranked).drop("bucket"))


PROFILE = "(SELECT c_nationkey::VARCHAR AS candidate_id, count(*) AS affected, count(*) FILTER (WHERE c_acctbal > 5000) AS improved, count(*) FILTER (WHERE c_acctbal <= 0) AS worsened, count(*) FILTER (WHERE c_acctbal > 0.01 AND c_acctbal <= 5000 AND c_nationkey % 7 <> 3) AS unchanged, CASE WHEN c_nationkey % 5 <> 4 THEN 1.0::DOUBLE END AS reduction FROM customer WHERE c_nationkey > 2 GROUP BY c_nationkey)"


@query(f"""WITH p AS {PROFILE}, c AS (SELECT n_nationkey::VARCHAR AS candidate_id FROM nation WHERE n_nationkey < 22)
SELECT * FROM (SELECT coalesce(c.candidate_id, p.candidate_id) AS candidate_id, CASE WHEN c.candidate_id IS NULL THEN 'unknown' WHEN affected IS NULL THEN 'missing'
  WHEN improved + unchanged + worsened <> affected THEN 'counts' WHEN reduction IS NULL THEN 'reduction' END AS problem FROM c FULL JOIN p ON c.candidate_id = p.candidate_id) WHERE problem IS NOT NULL""")
def profile_violations(spark, sf_dir):
    low, nation = F.col("c_acctbal"), F.col("c_nationkey")
    profile = table(spark, sf_dir, "customer").where(nation > 2).groupBy(nation).agg(
        F.count("*").alias("affected"), F.count_if(low > 5000).alias("improved"), F.count_if(low <= 0).alias("worsened"),
        F.count_if((low > 0.01) & (low <= 5000) & (nation % 7 != 3)).alias("unchanged"),
    )
    profile = profile.select(nation.cast("string").alias("candidate_id"), "affected", "improved", "worsened", "unchanged", F.when(nation % 5 != 4, 1.0).alias("reduction"))
    known = table(spark, sf_dir, "nation").where("n_nationkey < 22").select(F.col("n_nationkey").cast("string").alias("candidate_id"))
    return diagnostics.profile_violations(profile, known)


@query(f"WITH {ESTIMATE_SQL} SELECT candidate_id, (row_number() OVER (ORDER BY round(reduction, 6) DESC, CASE mechanism WHEN 'mcv' THEN 0 ELSE 1 END, precedence_rank) - 1)::INTEGER AS precedence_rank FROM profile JOIN c USING (candidate_id)")
def frozen_precedence(spark, sf_dir):
    from tesserae.operators import estimation

    profile = rounded(estimation.singleton_profile(*evaluation_inputs(spark, sf_dir)), 6)
    return diagnostics.frozen_precedence(profile, catalog(spark))


@query(f"""SELECT 'lineitem' AS relation, a."column" AS c1, b."column" AS c2, mechanism FROM {POSITIONS_SQL} a JOIN {POSITIONS_SQL} b ON a.position < b.position, (VALUES ('mcv'), ('fd')) m(mechanism)""")
def calibration_pool(spark, sf_dir):
    return diagnostics.calibration_pool(spark.createDataFrame([("lineitem", c, k) for k, c in enumerate(COLUMNS)], "relation string, column string, position int"))


@query("SELECT target::INTEGER AS target, sample, substr(sha256('27a/' || target::VARCHAR || '/' || sample), 1, 16) AS seed, (target * 300)::INTEGER AS capacity FROM (VALUES (100), (300), (1000)) a(target), (VALUES ('A'), ('B'), ('C')) b(sample)")
def target_grid(spark, sf_dir):
    return diagnostics.target_cells(spark, [100, 300, 1000], ["A", "B", "C"], "27a")


@query(f"""SELECT "column", target FROM {values_sql([("l_returnflag", 50), ("l_linestatus", -1), ("l_tax", 20)], '"column", target')} WHERE target <> -1 AND "column" IN (SELECT c1 FROM ({CANDIDATES_SQL}) UNION SELECT c2 FROM ({CANDIDATES_SQL}))""")
def relevant_overrides(spark, sf_dir):
    rows = spark.createDataFrame([("l_returnflag", 50), ("l_linestatus", -1), ("l_tax", 20)], "column string, target int")
    return diagnostics.relevant_overrides(rows, catalog(spark))
