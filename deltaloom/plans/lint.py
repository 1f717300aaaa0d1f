"""Rules over one revision's files and over two, each giving findings (code, severity, key, message) for `rules.findings`."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions import classify
from deltaloom.functions import text as X
from deltaloom.plans.rules import finding

#: Characters that a reviewed text can't hold (fixed values).
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f  ]"


def paths(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["files"].withColumn("_p", X.path_problem(F.col("path"))).where("_p is not null")
    return rows.select(F.lit("PATH").alias("code"), F.lit("error").alias("severity"), F.col("path").alias("key"), F.col("_p").alias("message"))


def layout(t: dict[str, DataFrame]) -> DataFrame:
    return finding(t["files"].where(F.col("path").startswith("schema/") & X.key_for_path(F.col("path")).isNull() & X.path_problem(F.col("path")).isNull()), "LAYOUT", "error", F.col("path"), "not an object's path")


def twins(t: dict[str, DataFrame]) -> DataFrame:
    """Paths that differ in letter case only."""
    many = t["files"].groupBy(X.fold(F.col("path")).alias("f")).agg(F.count_distinct("path").alias("n")).where("n > 1").select("f")
    return finding(t["files"].join(many, X.fold(F.col("path")) == F.col("f"), "left_semi"), "CASE_TWIN", "error", F.col("path"), "another path differs in letter case only")


def controls(t: dict[str, DataFrame]) -> DataFrame:
    return finding(t["files"].where(F.col("text").rlike(CONTROL)), "CONTROL", "error", F.col("path"), "a control character")


def secrets(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["files"].select("path", F.explode(X.secret_lines(F.col("text"))).alias("line"))
    return rows.select(F.lit("SECRET_LITERAL").alias("code"), F.lit("error").alias("severity"), F.concat_ws(":", "path", F.col("line").cast("string")).alias("key"), F.lit("a secret is never written").alias("message"))


def chain_files(t: dict[str, DataFrame]) -> DataFrame:
    """Lines of the log without a file, and files without a line."""
    held = t["files"].where(F.col("path").startswith("migrations/") & F.col("path").endswith(".sql")).select(F.expr("substr(path, 12)").alias("file"))
    lines = t["chain"].select("file")
    return finding(lines.join(held, "file", "left_anti"), "CHAIN_FILE", "error", F.col("file"), "no file of this line").unionByName(
        finding(held.join(lines, "file", "left_anti"), "CHAIN_LINE", "error", F.col("file"), "no line of this file"))


def overlaps(t: dict[str, DataFrame]) -> DataFrame:
    """Objects of more than one product; objects has products, as `release.products_of` makes it."""
    return finding(t["objects"].where("size(products) > 1"), "PRODUCT_OVERLAP", "error", X.qualified(F.col("schema"), F.col("name")), "more than one product")


ONE_REVISION: list[Callable[[dict[str, DataFrame]], DataFrame]] = [paths, layout, twins, controls, secrets]


def removed(t: dict[str, DataFrame]) -> DataFrame:
    """Objects that are gone without a tombstone."""
    return finding(t["base"].join(t["head"], "key", "left_anti").join(t["tombstones"], "key", "left_anti"), "REMOVED", "error", F.col("key"), "gone without a tombstone")


def kinds(t: dict[str, DataFrame]) -> DataFrame:
    """Objects whose kind changed under their name."""
    a, b = (t[n].select(X.fold(F.col("schema")).alias("s"), X.fold(F.col("name")).alias("n"), F.col("kind").alias(c), F.col("key").alias(f"key_{c}")) for n, c in (("base", "a"), ("head", "b")))
    gone, new = a.join(b.select(F.col("key_b").alias("key_a")), "key_a", "left_anti"), b.join(a.select(F.col("key_a").alias("key_b")), "key_b", "left_anti")
    return finding(gone.join(new, ["s", "n"]).where("a <> b"), "KIND_CHANGE", "error", F.col("key_a"), "another kind under this name")


def respelled(t: dict[str, DataFrame]) -> DataFrame:
    """Objects whose name changed in letter case only."""
    a, b = (t[n].select(X.fold(F.col("key")).alias("k"), F.col("key").alias(c)) for n, c in (("base", "a"), ("head", "b")))
    return finding(a.join(b, "k").where("a <> b"), "CASE_RENAME", "warning", F.col("a"), "only letter case changed")


def residue(t: dict[str, DataFrame]) -> DataFrame:
    """Texts that still name an object that is gone; named: key, schema, name (folded)."""
    gone = t["base"].join(t["head"], "key", "left_anti").select(X.fold(F.col("schema")).alias("schema"), X.fold(F.col("name")).alias("name"))
    return finding(t["named"].join(gone.distinct(), ["schema", "name"], "left_semi"), "RESIDUE", "error", F.col("key"), "names an object that is gone")


TWO_REVISIONS: list[Callable[[dict[str, DataFrame]], DataFrame]] = [removed, kinds, respelled, residue]


def batch_findings(batches: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, code, object, line) of `classify.findings` for each batch."""

    def run(parts):
        for part in parts:
            rows = [(i, *f) for i, t in zip(part[id_], part[text]) for f in classify.findings(t or "")]
            yield pd.DataFrame(rows, columns=[id_, "code", "object", "line"])

    return batches.select(id_, text).mapInPandas(run, f"{id_} {batches.schema[id_].dataType.simpleString()}, code string, object string, line int")


def outlines(batches: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, heads) of `classify.outline` for each batch."""

    def run(parts):
        for part in parts:
            yield pd.DataFrame({id_: part[id_], "heads": [classify.outline(t or "") for t in part[text]]})

    return batches.select(id_, text).mapInPandas(run, f"{id_} {batches.schema[id_].dataType.simpleString()}, heads array<string>")
