"""File sets: working trees, revisions, bundles with their checks, and the deterministic writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, sha256, bytes, content) of all files below root; path is relative to it.  Contents are read by the tasks that
    need them: a query that asks for paths alone reads none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    mark = root.rstrip("/").rsplit("/", 1)[1] + "/"
    return rows.select(
        F.substring_index(F.col("path"), mark, -1).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")


def revisions(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """`tree` of the exported folder of each revision, with its name in revision."""
    out: DataFrame | None = None
    for name, root in roots.items():
        rows = tree(spark, root).withColumn("revision", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no revision")
    return out


def revision_changes(files: DataFrame, base: str, head: str) -> DataFrame:
    """(path, change): added, removed or changed between two revisions."""
    a, b = (files.where(F.col("revision") == r).select("path", F.col("sha256").alias(n)) for r, n in ((base, "a"), (head, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full").where("not a <=> b").select("path", change.alias("change"))


def check_bundle(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) where a bundle and its manifest (path, sha256) say different things, both ways."""
    want = manifest.select("path", F.col("sha256").alias("want"))
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "not listed").otherwise("other content")
    return files.select("path", "sha256").join(want, "path", "full").where("not sha256 <=> want").select("path", problem.alias("problem"))


def manifest_digest(manifest: DataFrame, path: str = "path", sha256: str = "sha256") -> DataFrame:
    """One digest of a manifest, from its data and not from a file's bytes (`compare.digest`)."""
    from deltaloom.operators.compare import digest

    return digest(manifest, [path, sha256])


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A manifest as one JSON line for each file, in the order of paths, the same bytes for the same rows; one file, as a
    bundle's list is what one reader takes."""
    line = F.to_json(F.struct("path", "sha256"))
    manifest.select("path", line.alias("value")).coalesce(1).sortWithinPartitions("path").select("value").write.mode("overwrite").text(path)


def first_seen(releases: DataFrame) -> DataFrame:
    """(file, release): the first release that holds a file; releases: release, file."""
    return releases.groupBy("file").agg(F.min("release").alias("release"))
