"""Rules over relations: each gives rows of one relation of findings (code, severity, key, message)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions import text as X
from deltaloom.operators.compare import digest
from deltaloom.operators.numbering import numbered

Rule = Callable[[dict[str, DataFrame]], DataFrame]


def finding(rows: DataFrame, code: str, severity: str, key, message: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), F.lit(message).alias("message"))


def findings(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """All rules' findings, each once."""
    return reduce(DataFrame.unionByName, [r(tables) for r in rules]).distinct()


def allow_mismatches(items: DataFrame, allows: DataFrame, on: list[str]) -> DataFrame:
    """Items that no allow covers, and allows that cover nothing: (on..., problem)."""
    a = items.join(allows, on, "left_anti").select(*on, F.lit("needs allow").alias("problem"))
    b = allows.join(items, on, "left_anti").select(*on, F.lit("stray allow").alias("problem"))
    return a.unionByName(b).distinct()


def scope_reason(schema, name, schemas: list[str], exclude: list[str], exclude_objects: list[str], not_managed: list[str]):
    """The first reason why an object is out of scope, null if it is in: its schema is excluded, or not listed (schemas ['*']
    lists every one), or a pattern fits, those of the scope before those of the environment.  Names are compared folded; a
    null name stands for the schema itself, which no pattern fits."""
    owner = X.fold(schema)
    out = F.when(owner.isin([s.lower() for s in exclude]), "schema excluded") if exclude else F.when(F.lit(False), "")
    if schemas != ["*"]:
        out = out.when(~owner.isin([s.lower() for s in schemas]), "schema not listed")
    for label, patterns in (("exclude_objects", exclude_objects), ("not_managed", not_managed)):
        for p in patterns:
            out = out.when(name.isNotNull() & X.glob_matches(p, schema, name), F.lit(f"{label} {p}"))
    return out


def first_pattern(schema, name, patterns: list[str]):
    """The first pattern that fits an object."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(X.glob_matches(p, schema, name), F.lit(p)).otherwise(out)
    return out


def ranked(rows: DataFrame, order: dict[str, dict[str, int]], keys: list[str]) -> DataFrame:
    """rows with ord, their place 0.. in a total order: columns with a table of ranks first, then the keys."""
    ranks = {f"_r{i}": F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.col(c)], F.lit(len(table))) for i, (c, table) in enumerate(order.items())}
    return numbered(rows.withColumns(ranks) if ranks else rows, [*ranks, *keys], "ord").drop(*ranks)


def plan_hash(steps: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """One identity of a plan: `compare.digest` of its steps with their places, so the same steps in another order are
    another plan and no task holds all of them."""
    return digest(numbered(steps, order, "_ord"), ["_ord", *columns]).withColumnRenamed("digest", "plan_hash")
