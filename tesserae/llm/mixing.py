"""Mixing sources to target weights in a domain-language-source tree.

Every node's budget is shared among its children by weight, and no child gets more than its
subtree can give (its tokens times the epochs allowed). What a child cannot take goes to its
siblings; only what a whole family cannot take is missing at their parent, where the parent's
siblings take it. A leaf's budget is whole epochs of its documents and a token prefix of the
next, in that epoch's seeded order.

Defined results: a null text has no tokens; null languages and sources are leaves of their
own; repeated rows count each; the order of a leaf is that of hashes of doc_id and text, so rows
with equal or null doc_ids are told apart by their texts, and only equal ones tie; an empty
table gives no rows; other columns are not read by mix() and pass through chosen(). Weights are
whole numbers; a node without one has 1.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import materialize, running_before

LEVELS = ("domain", "lang", "source")
WORD = "[^ \\t-\\r]+"


def default_domain() -> Column:
    """A source's domain: its last character's code modulo 3."""
    return F.concat(F.lit("domain"), F.coalesce(F.ascii(F.right("source", F.lit(1))), F.lit(0)) % 3)


def _text_md5(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _share(children: DataFrame, parent: list[str], weights: Mapping[str, int]) -> DataFrame:
    """Add each child's budget; needs parent columns, name, capacity and parent_budget.

    Children in order of capacity / weight fill up first. With the fuller ones' capacity taken
    off, (budget left) / (weight left) is the level at a child; the greatest level is where
    the water stands.
    """
    weight = F.lit(1)
    for name, w in weights.items():
        weight = F.when(F.col("name") == name, w).otherwise(weight)
    weighted = children.withColumn("weight", weight.cast("long"))
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), "name")
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = weighted.withColumn("_level", (F.col("parent_budget") - before) / after)
    water = F.max("_level").over(Window.partitionBy(*parent))
    return levelled.withColumn("budget", F.least(F.col("capacity").cast("double"), water * F.col("weight"))).drop("_level")


def leaf_budgets(
    leaves: DataFrame, budget: Column, weights: Mapping[str, Mapping[str, int]], max_epochs: int
) -> DataFrame:
    """leaves (domain, lang, source, tokens) with each leaf's budget in tokens; budget: of the root."""
    known = None
    for depth, level in enumerate(LEVELS):
        parent, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("capacity"))
        if known is None:
            root = leaves.agg(F.sum("tokens").alias("tokens")).select(budget.cast("double").alias("parent_budget"))
            nodes = nodes.join(F.broadcast(root.withColumn("_root", F.lit(1))), F.lit(1) == F.col("_root")).drop("_root")
        else:
            same = [nodes[c].eqNullSafe(known[f"_{c}"]) for c in parent]
            nodes = nodes.join(known, on=same).drop(*[f"_{c}" for c in parent])
        named = nodes.withColumns({"name": F.col(level), "_top": F.lit(0)})
        shared = _share(named, ["_top", *parent], weights.get(level, {}))
        known = shared.select(*[F.col(c).alias(f"_{c}") for c in path], F.col("budget").alias("parent_budget"))
    same = [leaves[c].eqNullSafe(known[f"_{c}"]) for c in LEVELS]
    return leaves.join(known, on=same).select(*LEVELS, "tokens", F.floor(F.col("parent_budget") + 1e-6).cast("long").alias("budget"))


def uses(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    percent: int = 80,
    max_epochs: int = 2,
    seed: int = 6,
    domain: Column | None = None,
) -> DataFrame:
    """doc_id, text_md5, domain, lang, source, n_tokens, epoch: a row for each use of a document.

    The budget is `percent` of all tokens.
    """
    counted = materialize(
        docs.select(
            "doc_id", (domain if domain is not None else default_domain()).alias("domain"), "lang", "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), _text_md5("text").alias("text_md5"),
        ),
        "counted",
    )
    leaves = counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, F.floor(F.col("tokens") * percent / 100), weights, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int")
    # One row a leaf; a table, so that a join that is not broadcast can split a hot leaf.
    plan = materialize(
        budgets.withColumn("whole", F.least(whole, F.lit(max_epochs)))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
        .select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "whole", "rest"),
        "plan",
    )
    same = [counted[c].eqNullSafe(plan[f"_{c}"]) for c in LEVELS]
    planned = counted.join(plan, on=same).select(*counted.columns, "whole", "rest")
    rounds = planned.where("whole > 0").select(*counted.columns, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_md5"))
    partial = planned.where("rest > 0").withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 3))
    # A leaf's tokens before a document: of earlier buckets of its hash, then inside its own.
    prefix = running_before(partial, ["_bucket"], ["_key", "doc_id"], {"_before": "n_tokens"}, within=LEVELS)
    part = prefix.where(F.col("_before") + F.col("n_tokens") <= F.col("rest")).select(*counted.columns, F.col("whole").alias("epoch"))
    return rounds.unionByName(part).select("doc_id", "text_md5", *LEVELS, "n_tokens", "epoch")


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    percent: int = 80,
    max_epochs: int = 2,
    seed: int = 6,
    domain: Column | None = None,
) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: a row for each use of a document."""
    return uses(docs, weights, percent, max_epochs, seed, domain).drop("text_md5")


def chosen(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], percent: int, seed: int = 6) -> DataFrame:
    """docs that the mixture uses when it takes each at most once; rows equal in doc_id and text stay together."""
    used = uses(docs, weights, percent, 1, seed).select("doc_id", "text_md5").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("used.doc_id")) & (_text_md5("d.text") == F.col("used.text_md5"))
    return docs.alias("d").join(used.alias("used"), same, "left_semi")


QUERY_WEIGHTS = {
    "domain": {"domain0": 3, "domain1": 2, "domain2": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 1},
}
QUERY_PERCENT, QUERY_EPOCHS, QUERY_SEED = 80, 2, 6


def _case(level: str) -> str:
    weights = QUERY_WEIGHTS.get(level, {})
    return f"CASE {level} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in weights.items()) + " ELSE 1 END" if weights else "1"


def _level_sql(depth: int) -> str:
    """CTEs that share the budgets of one level of the tree."""
    path, parent = ", ".join(LEVELS[: depth + 1]), LEVELS[:depth]
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    source = (
        f"(SELECT sum(tokens) * {QUERY_PERCENT} // 100 AS parent_budget FROM leaves)" if not parent
        else f"(SELECT {', '.join(f'{c} AS _{c}' for c in parent)}, budget AS parent_budget FROM b{depth - 1})"
    )
    on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p._{c}" for c in parent) or "true"
    name = LEVELS[depth]
    order = f"OVER ({part} ORDER BY capacity / w, {name} NULLS FIRST ROWS BETWEEN"
    return f"""
n{depth} AS (SELECT {path}, sum(tokens) * {QUERY_EPOCHS} AS capacity, {_case(name)} AS w FROM leaves GROUP BY {path}),
l{depth} AS (
  SELECT n.*, (parent_budget - coalesce(sum(capacity) {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(w) {order} CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM n{depth} n JOIN {source} p ON {on}
),
b{depth} AS (SELECT {path}, least(capacity::DOUBLE, w * max(level) OVER ({part})) AS budget FROM l{depth})"""


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, 'domain' || (coalesce(ascii(right(source, 1)), 0) % 3) AS domain, lang, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens, md5(coalesce(text, '')) AS text_md5
  FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
{_level_sql(0)},{_level_sql(1)},{_level_sql(2)},
plan AS (
  SELECT b2.domain, b2.lang, b2.source, tokens, floor(b2.budget + 1e-6)::BIGINT AS budget,
         CASE WHEN tokens > 0 THEN least({QUERY_EPOCHS}, floor(b2.budget + 1e-6)::BIGINT // tokens) ELSE 0 END AS whole
  FROM b2 JOIN leaves l ON l.domain = b2.domain AND l.lang IS NOT DISTINCT FROM b2.lang AND l.source IS NOT DISTINCT FROM b2.source
), j AS (
  SELECT d.*, whole, budget - whole * tokens AS rest
  FROM d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source
), u AS (
  SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole::BIGINT)) AS epoch FROM j
  UNION ALL
  SELECT doc_id, domain, lang, source, n_tokens, whole AS epoch
  FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
                    ORDER BY md5('{QUERY_SEED}/' || whole::BIGINT || '/' || coalesce(doc_id::VARCHAR, '') || '/' || text_md5), doc_id) AS upto FROM j WHERE rest > 0)
  WHERE upto <= rest
)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, epoch::INTEGER AS epoch FROM u
"""
