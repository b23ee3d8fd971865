"""Column functions that score estimates, ranks and sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q_error(estimate: Column, truth: Column) -> Column:
    """max(e / t, t / e) with e at least 1; truth must be positive."""
    e = F.greatest(estimate, F.lit(1.0))
    return F.greatest(e / truth, truth / e)


def ratio_bucket(q: Column) -> Column:
    """The class of a q-error: up to 1.05, 2, 10, or more."""
    return (
        F.when(q <= 1.05, "<=1.05").when(q <= 2, "1.05-2").when(q <= 10, "2-10").otherwise(">10")
    )


def rank_percentile(rank: Column, n: Column) -> Column:
    """100 for the first of n ranks, 100 / n for the last."""
    return 100.0 * (n - rank + 1) / n


def percentile_bucket(rank: Column, n: Column) -> Column:
    """The smallest of the top classes that holds a rank; sizes are rounded up."""
    out = F.lit("bottom_20pct")
    for label, percent in (("top_80pct", 80), ("top_50pct", 50), ("top_20pct", 20), ("top_10pct", 10), ("top_5pct", 5), ("top_1pct", 1)):
        out = F.when(rank <= F.ceil(n * percent / 100.0), label).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def candidate_id(relation: Column, mechanism: Column, columns: Column) -> Column:
    """Stable name of a statistics candidate."""
    text = F.concat_ws("|", relation, mechanism, F.array_join(columns, ","))
    return F.concat(F.lit("cand_"), F.substring(F.sha2(text, 256), 1, 20))


def distinct_values(n_distinct: Column, rows: Column) -> Column:
    """A number of distinct values; a negative one is a share of the rows."""
    return F.when(n_distinct < 0, -n_distinct * rows).otherwise(n_distinct)


def direction(before: Column, after: Column) -> Column:
    """Whether an error went down, stayed or went up."""
    return F.when(after < before, "improved").when(after > before, "worsened").otherwise("unchanged")
