"""Windows, folds and rules over ordered logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.operators.numbering import numbered, numbered_in
from deltaloom.sources.staging import stage

__all__ = [
    "chunks", "effective_order", "followed", "holes", "latest", "latest_of", "not_rising", "numbered", "replay", "segments", "sessions", "top", "uncleared"]


def chunks(rows: DataFrame, part: list[str], order: str, size: int) -> DataFrame:
    """Adds chunk: runs of `size` rows in order, within each part; a part may hold most of the rows."""
    return numbered_in(rows, part, [order], "_n").withColumn("chunk", F.floor(F.col("_n") / size)).drop("_n")


def top(rows: DataFrame, part: str, order: list[str], n: int, salts: int = 64) -> DataFrame:
    """The n last rows of each part with rank 1..n: first the n last of each of `salts` shares of a part, then those of the part."""
    down = [F.desc(c) for c in order]
    some = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy(part, "_salt").orderBy(*down))).where(F.col("rank") <= n).drop("rank", "_salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(*down))).where(F.col("rank") <= n)


def latest_of(rows: DataFrame, part: str, number: str) -> DataFrame:
    """The row of the highest number of each part, as (part, r)."""
    return rows.groupBy(part).agg(F.max_by(F.struct(*[c for c in rows.columns if c != part]), number).alias("r"))


def followed(names: DataFrame, renames: DataFrame, max_steps: int = 100) -> DataFrame:
    """(name, last): names followed through renames (seq, old, new), each used after the one before; a name has one rename
    after a given one, the first."""
    front = stage(names.select("name", F.col("name").alias("last"), F.lit(-1).cast("long").alias("seq")), "followed")
    for _ in range(max_steps):
        step = front.join(renames.select(F.col("seq").alias("at"), F.col("old").alias("last"), "new"), "last").where("at > seq")
        step = step.groupBy("name").agg(F.min(F.struct("at", "new")).alias("m"))
        if step.isEmpty():
            return front.select("name", "last")
        front = stage(front.join(step, "name", "left").select(
            "name", F.coalesce("m.new", "last").alias("last"), F.coalesce("m.at", "seq").alias("seq")), "followed")
    raise ValueError("names are renamed in too many steps")


def not_rising(rows: DataFrame, part: str, order: list[str], number: str) -> DataFrame:
    """Rows whose number is not above every earlier one of their part."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("highest", F.max(number).over(w)).where(F.col(number) <= F.col("highest"))


def holes(log: DataFrame, part: str, pos: str, applied: str) -> DataFrame:
    """Entries that are not applied although a later one of their part is."""
    last = log.where(F.col(applied)).groupBy(part).agg(F.max(pos).alias("last_applied"))
    return log.where(~F.col(applied)).join(last, part).where(F.col(pos) < F.col("last_applied"))


def segments(rows: DataFrame, part: str, order: list[str], marker) -> DataFrame:
    """Adds segment: how many markers stand at or before the row in its part."""
    return rows.withColumn("segment", F.sum(F.when(marker, 1).otherwise(0)).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def sessions(rows: DataFrame, part: str, micros: str, tie: str, gap: int) -> DataFrame:
    """Adds session: a new one begins after a pause of more than `gap` microseconds."""
    w = Window.partitionBy(part).orderBy(micros, tie)
    late = F.coalesce(F.col(micros) - F.lag(micros).over(w) > gap, F.lit(False))
    return rows.withColumn("_late", late).withColumn("session", F.sum(F.col("_late").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_late")


def effective_order(chain: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(pos, root, depth) of a log (pos, replaces): a replacement stands right after what it replaces, so the order
    is (root, depth).  Each line has one replacement at most."""
    front = stage(chain.where("replaces is null").select("pos", F.col("pos").alias("root"), F.lit(0).alias("depth")), "chain")
    out = front
    for depth in range(1, max_depth):
        front = stage(
            chain.where("replaces is not null").join(front.select(F.col("pos").alias("replaces"), "root"), "replaces")
            .select("pos", "root", F.lit(depth).alias("depth")), "chain")
        if front.isEmpty():
            return out
        out = out.unionByName(front)
    raise ValueError("the chain of replacements is too long")


def latest(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """The last row of each part: an aggregate, so a hot part is reduced before it moves."""
    others = [c for c in rows.columns if c != part]
    return rows.groupBy(part).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(part, "_r.*")


def uncleared(failed: DataFrame, clears: DataFrame, key: str, number: str) -> DataFrame:
    """Failures that no later clearing row of the same key undoes."""
    c = clears.groupBy(key).agg(F.max(number).alias("_last"))
    return failed.join(c, key, "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col(number))).drop("_last")


def replay(log: DataFrame, part: str, order: list[str], op: str, allowed: dict[str, dict[str, str]], start: str) -> DataFrame:
    """Folds each part's operations in order through a state machine allowed[state][op] = next state; the first
    operation that the state doesn't allow stops the part: (part, accepted, state, bad_index, bad_op).

    The fold holds one part's operations as an array; a log is one entity's, which is small whatever the number of entities.
    """
    after = F.create_map(*[x for s, ops in allowed.items() for o, n in ops.items() for x in (F.lit(f"{s}\n{o}"), F.lit(n))])
    begin = F.struct(F.lit(0).cast("long").alias("accepted"), F.lit(start).alias("state"), F.lit(None).cast("string").alias("bad_op"))

    def step(a, x):
        to = after[F.concat(a["state"], F.lit("\n"), x[op])]
        good = F.struct((a["accepted"] + 1).alias("accepted"), to.alias("state"), a["bad_op"].alias("bad_op"))
        bad = F.struct(a["accepted"].alias("accepted"), a["state"].alias("state"), x[op].alias("bad_op"))
        return F.when(a["bad_op"].isNotNull(), a).when(to.isNull(), bad).otherwise(good)

    rows = log.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(*order, op))).alias("l"))
    done = rows.select(part, F.aggregate("l", begin, step).alias("r"))
    return done.select(part, "r.accepted", "r.state", F.when(F.col("r.bad_op").isNotNull(), F.col("r.accepted")).alias("bad_index"), "r.bad_op")
