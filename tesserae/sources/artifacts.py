"""Sealed results: JSON documents with digests, and statistics tables beside them."""

from __future__ import annotations

import json
import os
import tempfile
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.ddl import check_statements, digest

VOLATILE = ("created_at", "local_path")


def _plain(value):
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def seal(document: dict) -> dict:
    """The document with a digest of all that does not change between runs."""
    body = {k: v for k, v in _plain(document).items() if k != "digest"}
    return body | {"digest": digest({k: v for k, v in body.items() if k not in VOLATILE})}


def verify(document: dict) -> dict:
    if seal(document)["digest"] != document.get("digest"):
        raise ValueError("the document was changed after it was sealed")
    return document


def write_document(path: str | Path, document: dict) -> dict:
    """Write a sealed document whole or not at all."""
    sealed, path = seal(document), Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(sealed, f, sort_keys=True, indent=1, ensure_ascii=False)
    os.replace(name, path)
    return sealed


def read_document(path: str | Path) -> dict:
    return verify(json.loads(Path(path).read_text(encoding="utf-8")))


def schema_digest(df: DataFrame) -> str:
    return digest([[f.name, f.dataType.simpleString(), f.nullable] for f in df.schema.fields])


def write_statistics(df: DataFrame, path: str, name: str, target: int) -> dict:
    """A statistics table as Parquet; returns what a repository entry records of it."""
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    stored = df.sparkSession.read.parquet(f"{path}/{name}")
    return {"name": name, "target": target, "rows": stored.count(), "schema": schema_digest(stored), "content": content_digest(stored)}


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows that their order and partitions do not change."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    halves = [F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{k}") for k in range(4)]
    return digest([str(x) for x in df.agg(F.count("*"), *halves).first()])


def read_statistics(spark: SparkSession, path: str, entry: dict) -> DataFrame:
    """The table of a repository entry; raises if it is not the one that was recorded."""
    df = spark.read.parquet(f"{path}/{entry['name']}")
    if schema_digest(df) != entry["schema"] or content_digest(df) != entry["content"]:
        raise ValueError(f"{entry['name']} is not the table that was recorded")
    return df


def cached_statistics(spark: SparkSession, path: str, key: dict, build) -> tuple[DataFrame, bool]:
    """The table of a key from its content-addressed place, built when missing or damaged."""
    name = digest(key)[:20]
    record = Path(path) / f"{name}.json"
    if record.exists():
        try:
            return read_statistics(spark, path, read_document(record)["entry"]), True
        except Exception:  # a damaged entry is built anew
            record.unlink()
    entry = write_statistics(build(), path, name, int(key.get("target", 100)))
    write_document(record, {"key": key, "entry": entry})
    return read_statistics(spark, path, entry), False


def write_recommendation(path: str | Path, plan: dict, lineage: dict) -> dict:
    check_statements([*plan["deploy"], *plan["rollback"]])
    return write_document(path, {"plan": plan, "lineage": lineage, "format_version": 1})
