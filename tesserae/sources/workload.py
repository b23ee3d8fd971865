"""Workloads of counting queries: reading them, and what their predicates say.

A query is SELECT count(*) FROM one relation WHERE a conjunction. Leaves are recognised by
pattern; whatever else a query holds gives it a reason and the conservative mode, in which
every candidate of its relation may affect it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORKLOAD = "query_id string, sql string, truth double, target_relation string, label string"
CONSTANT = r"(?:'[^']*'|-?[0-9]+(?:\.[0-9]+)?)"
COMPARISON = rf"^([A-Za-z_][A-Za-z0-9_.]*)\s*(=|<=|>=|<|>)\s*({CONSTANT})$"
IN_LIST = rf"(?i)^([A-Za-z_][A-Za-z0-9_.]*)\s+in\s*\(\s*({CONSTANT}(?:\s*,\s*{CONSTANT})*)\s*\)$"
NULL_TEST = r"(?i)^([A-Za-z_][A-Za-z0-9_.]*)\s+is\s+null$"
NOT_NULL = r"(?i)\bis\s+not\s+null\b"
TWO_COLUMNS = r"^[A-Za-z_][A-Za-z0-9_.]*\s*(=|<=|>=|<|>|<>|!=)\s*[A-Za-z_][A-Za-z0-9_.]*$"
OTHER_OPERATOR = r"(?i)(<>|!=|\bbetween\b|\blike\b)"


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """The queries of a workload document."""
    document = spark.read.json(path, schema=f"schema_version int, workload_id string, queries array<struct<{_struct(WORKLOAD)}>>", multiLine=True)
    return document.select(F.inline("queries"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ") for x in ddl.split(",")))


def check_workload(workload: DataFrame, positive_only: bool = False) -> DataFrame:
    """The queries that count; raises for ids that repeat and truths that cannot be used."""
    bad = workload.agg(
        F.count("*").alias("n"),
        F.countDistinct("query_id").alias("ids"),
        F.count_if(F.col("truth").isNull() | F.isnan("truth") | (F.col("truth") < 0) | (F.col("truth") == float("inf"))).alias("unusable"),
        F.count_if(F.col("truth") == 0).alias("zero"),
    ).first()
    if bad["n"] != bad["ids"]:
        raise ValueError("query ids repeat")
    if bad["unusable"] or bad["zero"] and not positive_only:
        raise ValueError("truths must be finite and positive")
    return workload.where("truth > 0")


def where_clause(sql: Column) -> Column:
    return F.trim(F.regexp_extract(sql, r"(?is)\bwhere\b(.*?);?\s*$", 1))


def _leaf(x: Column) -> Column:
    """reason (null where it is understood), column, op and constants of one leaf."""
    constants = F.transform(
        F.regexp_extract_all(F.regexp_extract(x, IN_LIST, 2), F.lit(CONSTANT), F.lit(0)), lambda c: F.btrim(c, F.lit("'"))
    )
    known = lambda column, op, values: F.struct(
        F.lit(None).cast("string").alias("reason"), column.alias("column"), op.alias("op"), values.alias("constants")
    )
    unknown = lambda reason: F.struct(
        F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("op"),
        F.lit(None).cast("array<string>").alias("constants"),
    )
    return (
        F.when(
            F.rlike(x, F.lit(COMPARISON)),
            known(F.regexp_extract(x, COMPARISON, 1), F.regexp_extract(x, COMPARISON, 2), F.array(F.btrim(F.regexp_extract(x, COMPARISON, 3), F.lit("'")))),
        )
        .when(F.rlike(x, F.lit(IN_LIST)), known(F.regexp_extract(x, IN_LIST, 1), F.lit("in"), constants))
        .when(F.rlike(x, F.lit(NULL_TEST)), known(F.regexp_extract(x, NULL_TEST, 1), F.lit("is null"), F.array().cast("array<string>")))
        .when(F.rlike(x, F.lit(NOT_NULL)), unknown("unsupported-null-test"))
        .when(F.rlike(x, F.lit(TWO_COLUMNS)), unknown("column-to-column"))
        .when(F.rlike(x, F.lit(OTHER_OPERATOR)), unknown("unsupported-operator"))
        .when(F.rlike(x, F.lit(r"[A-Za-z_][A-Za-z0-9_]*\s*\(")), unknown("unresolved-column-reference"))
        .otherwise(unknown("unsupported-expression"))
    )


def inspect(workload: DataFrame) -> DataFrame:
    """query_id, relation, mode, reasons, leaves: what can be said about each query."""
    clause = where_clause(F.col("sql"))
    without_null = F.regexp_replace(F.col("clause"), NOT_NULL, "is_not_null")
    leaves = F.transform(F.split("clause", r"(?i)\s+and\s+"), lambda x: _leaf(F.trim(x)))
    found = (
        workload.withColumn("clause", clause)
        .withColumn("leaves", leaves)
        .withColumn(
            "reasons",
            F.when(F.col("clause") == "", F.array(F.lit("no-where")))
            .when(F.rlike(without_null, F.lit(r"(?i)\bor\b")), F.array(F.lit("boolean-or")))
            .when(F.rlike(without_null, F.lit(r"(?i)\bnot\b")), F.array(F.lit("boolean-not")))
            .otherwise(F.array_sort(F.array_distinct(F.filter(F.transform("leaves", lambda x: x["reason"]), lambda r: r.isNotNull())))),
        )
    )
    precise = F.size("reasons") == 0
    return found.select(
        "query_id",
        F.col("target_relation").alias("relation"),
        F.when(precise, "precise-structural").otherwise("conservative-fallback").alias("mode"),
        "reasons",
        F.when(precise, F.col("leaves")).otherwise(F.array().cast(found.schema["leaves"].dataType)).alias("leaves"),
    )


def predicates(inspection: DataFrame) -> DataFrame:
    """query_id, relation, column, op, constants of the queries that are understood."""
    return inspection.select("query_id", "relation", F.inline("leaves")).drop("reason")


def effective(workload: DataFrame) -> DataFrame:
    """effective is the document's own mark, or else a positive truth."""
    own = F.col("effective") if "effective" in workload.columns else F.lit(None).cast("boolean")
    return workload.withColumn("effective", F.coalesce(own, F.col("truth") > 0))
