"""Row numbers without one task that sees all rows: a range exchange, a sort inside each partition, and an offset for each
partition from a table of one row for each partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.sources.staging import stage


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """df with `index`, the position 0..n-1 in the order of `keys` (nulls first; equal keys by arrival, which takes part in
    the exchange, so a key with a third of all rows is split like any other)."""
    spark = df.sparkSession
    order = [*keys, "_arrival"]
    moved = (
        df.withColumn("_arrival", F.monotonically_increasing_id()).repartitionByRange(parallelism(spark), *order)
        .sortWithinPartitions(*order).drop("_arrival"))
    held = stage(moved.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33).cast("int")
    counts = sorted((r[0], r[1]) for r in held.groupBy(part).agg(F.count(F.lit(1))).collect())  # one row for each partition
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = spark.createDataFrame(offsets, "_part int, _offset bigint")
    return held.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(
        index, F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_offset", "_place")


def numbered_in(df: DataFrame, part: list[str], keys: list[str], index: str) -> DataFrame:
    """`numbered` inside each part: the whole order less the part's first number; parts meet their first number by a join of
    one row for each part."""
    whole = stage(numbered(df, [*part, *keys], index), "numbered-parts")
    first = whole.groupBy(*part).agg(F.min(index).alias("_first"))
    names = {p: f"_p_{p}" for p in part}
    first = first.withColumnsRenamed(names)
    on = None
    for p in part:
        c = F.col(p).eqNullSafe(F.col(names[p]))
        on = c if on is None else on & c
    return whole.join(first, on).withColumn(index, F.col(index) - F.col("_first")).drop("_first", *names.values())
