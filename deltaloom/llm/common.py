"""Shared helpers of the training-data operators.

Staging.  Several operators need a relation twice, or need row numbers that stay the same when a lost
executor makes Spark run a task again: `stage` of `sources.staging` writes such a relation into the shared folder.

Numbering.  `indexed` numbers rows 0..n-1 in a total order without one task seeing all rows: a range
exchange, a sort inside each partition, and an offset for each partition from a table that has one row
for each partition.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.sources.staging import drop, owning, shared_dir, stage, stage_path

__all__ = [
    "ascii_lower", "bitmap", "drop", "free_name", "has_bit", "indexed", "let", "number", "owning", "parallelism", "shared_dir", "stage", "stage_path",
    "with_position", "MAX_BITS",
]


def free_name(taken: Iterable[str], wanted: str) -> str:
    """wanted, with as many underscores before it as make it none of the names taken (compared without case)."""
    used = {t.lower() for t in taken}
    while wanted.lower() in used:
        wanted = "_" + wanted
    return wanted


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row: Catalyst may copy an expression, not a lambda's argument."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_position(df: DataFrame, at: str) -> DataFrame:
    """Adds a bigint that grows along each partition of a *staged* relation's writer: (partition << 33) + row."""
    return df.withColumn(at, F.monotonically_increasing_id())


def indexed(df: DataFrame, keys: list[str], name: str, index: str = "_index") -> DataFrame:
    """df with `index`, the position 0..n-1 in the order of `keys` (nulls first; equal keys by arrival).

    Equal keys may fill several partitions: the arrival number takes part in the range exchange, so a key with
    a third of all rows is split like any other.  The table of offsets has one row for each partition.
    """
    spark = df.sparkSession
    order = [*keys, "_arrival"]
    moved = (
        df.withColumn("_arrival", F.monotonically_increasing_id())
        .repartitionByRange(parallelism(spark), *order)
        .sortWithinPartitions(*order)
        .drop("_arrival")
    )
    held = stage(with_position(moved, "_place"), name)
    return number(held, "_place", index).drop("_place")


def number(held: DataFrame, at: str, index: str) -> DataFrame:
    """Turns the (partition << 33) + row numbers of a staged relation into positions 0..n-1."""
    spark = held.sparkSession
    counts = sorted(
        (r[0], r[1]) for r in held.groupBy(F.shiftright(at, 33).cast("int")).agg(F.count(F.lit(1))).collect()
    )  # one row for each partition of the writer
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = spark.createDataFrame(offsets, "_part int, _offset bigint")
    return (
        held.withColumn("_part", F.shiftright(at, 33).cast("int"))
        .join(F.broadcast(table), "_part")
        .withColumn(index, F.col("_offset") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_offset")
    )


#: Bits of one bitmap: what is sent with each task stays below 8 MB.
MAX_BITS = 1 << 26


def bitmap(slots: DataFrame, slot: str, bits: int) -> Column:
    """A constant array<bigint> with the bits of column `slot` (0..bits-1) set; nulls are left out.

    Aggregated on the executors to one row for each 64 bits, so the driver gets bits / 64 rows at most, and
    bits is checked against MAX_BITS.
    """
    if bits > MAX_BITS:
        raise ValueError(f"a bitmap of {bits} bits is over the limit of {MAX_BITS}")
    size = max(1, bits // 64)
    words = [0] * size
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(slot) % 64).cast("int"))
    rows = (
        slots.where(F.col(slot).isNotNull())
        .groupBy(F.floor(F.col(slot) / 64).cast("int").alias("w"))
        .agg(F.bit_or(set_bit).alias("b"))
        .collect()
    )
    for w, b in rows:
        words[w] = b
    return F.split(F.lit(" ".join(map(str, words))), " ").cast("array<bigint>")


def has_bit(bits: Column, slot: Column) -> Column:
    """Whether bit `slot` of a constant from `bitmap` is set."""
    word = F.element_at(bits, (F.floor(slot / 64) + 1).cast("int"))
    return F.call_function("shiftright", word, (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
