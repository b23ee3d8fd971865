"""Text of deployable statistics definitions. Nothing here runs against a database."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "tess_"
ALLOWED = ("CREATE STATISTICS ", "ALTER STATISTICS ", "ANALYZE ", "DROP STATISTICS ")


def digest(value) -> str:
    """sha256 of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def quoted(name: str) -> str:
    if not name or "\0" in name:
        raise ValueError("empty or unprintable identifier")
    return '"' + name.replace('"', '""') + '"'


def qualified(name: str) -> str:
    return ".".join(quoted(p) for p in name.split("."))


def object_name(candidate_id: str, relation: str, columns: Sequence[str]) -> str:
    """At most 40 plain characters, and 10 of a digest that keeps names apart."""
    plain = re.sub(r"[^a-z0-9]+", "_", "_".join([relation, *columns]).lower())
    return f"{PREFIX}{plain}"[:40] + "_" + hashlib.sha256(candidate_id.encode()).hexdigest()[:10]


def object_name_column(candidate_id: Column, relation: Column, columns: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.concat_ws("_", relation, F.array_join(columns, "_"))), "[^a-z0-9]+", "_")
    return F.concat(F.substring(F.concat(F.lit(PREFIX), plain), 1, 40), F.lit("_"), F.substring(F.sha2(candidate_id, 256), 1, 10))


def deployment(design: Sequence[dict], target: int) -> dict:
    """Statements that deploy a design, those that take it back, and a digest of both.

    design: candidate_id, relation, mechanism and columns of each member, in order.
    """
    if isinstance(target, bool) or not 1 <= target <= 10_000:
        raise ValueError("the statistics target is a number from 1 to 10000")
    kinds = {"mcv": "mcv", "fd": "dependencies"}
    names = [object_name(c["candidate_id"], c["relation"], c["columns"]) for c in design]
    if len(set(names)) != len(names):
        raise ValueError("two members have one name")
    forward = []
    for name, c in zip(names, design, strict=True):
        columns = ", ".join(quoted(x) for x in c["columns"])
        forward.append(f"CREATE STATISTICS {quoted(name)} ({kinds[c['mechanism']]}) ON {columns} FROM {qualified(c['relation'])};")
        forward.append(f"ALTER STATISTICS {quoted(name)} SET STATISTICS {target};")
    forward += [f"ANALYZE {qualified(r)};" for r in dict.fromkeys(c["relation"] for c in design)]
    back = [f"DROP STATISTICS {quoted(n)};" for n in reversed(names)]
    plan = {"deploy": forward, "rollback": back, "names": names, "target": target}
    return plan | {"digest": digest(plan)}


def check_statements(statements: Sequence[str]) -> None:
    for s in statements:
        if not s.startswith(ALLOWED) or s.count(";") != 1 or not s.endswith(";"):
            raise ValueError(f"not a statistics statement: {s!r}")
