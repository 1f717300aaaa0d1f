"""N-gram Jaccard join by PartEnum signatures.

Sets are banded by size into instances that overlap, so that any two sizes that similar sets can have lie together in
one.  In an instance, similarity bounds the Hamming distance by k.  The feature domain is hashed into n1 groups of n2
partitions.  At most k / (k2 + 1) groups hold more than k2 differences, so two similar sets agree, in some group, on
all but k2 partitions: each set emits a signature for each group and each choice of n2 - k2 of its partitions, and
similar sets share one.  k grows with the sets' sizes, so a set needs only as many of the groups as its own largest
distance asks for; its partners have at least these too.

Spare groups.  With t groups more than that, similar sets share several signatures, whatever the places of their
differences.  A signature of no feature says little, and many sets would share it: a set with at most z empty
choices leaves these out, a set with more emits them.  Similar sets then still share a known number r of signatures (at least
one), while unlike sets mostly share one by chance.  So a set whose signatures with others are fewer than r has no
similar set, and a pair that shares fewer need not be compared.  None of this loses a pair.

From texts to groups.  Equal sets are one class, with one representative.  Signatures are never stored: a pass over
the texts emits (signature, class), once for each class that a task meets, one exchange by signature brings them
together, sorted, and a scan of the sorted rows with a memory of one row keeps the signatures that two classes or
more share.  Signatures shared by exactly the same classes count as one group.

From groups to components.  The sets of a group are compared with its most central member, the leader (linear in the
group), which links most of a family of copies.  Small groups that still mix components are compared pair by pair.
A family has many large groups, whose leaders are linked to one of them, their chief: it stands for all of these, so a
member is told once.  Let D(x) be the symmetric difference of x and the chief.  The distance of x and y
is |D(x)| + |D(y)| - 2 |D(x) and D(y)|, so two members of different components can be similar only
if their differences share a known number of features: a prefix-filtered join on the differences, features that
the chief lacks first, finds those pairs without pairing the members of a group.  That serves members near the leader.
Unlike sets that share a passage share signatures too, and their differences are as large as they are.  1 - similarity is
a metric: with the threshold t, a set similar to one below 2 t - 1 of its leader isn't linked to the leader either.  So all
members that aren't linked to one of their leaders, each once and not once for each leader, are joined on prefixes of the
features that several components hold; most drop out before, as a set needs t of its features held so.  Every link
decision is by exact set sizes.  Both ways of comparing a group are complete; its size only decides which is cheaper.

Links inside a component need not all be tested, so links aren't counted: components are exact, and a family of m
similar texts costs about m comparisons and not m squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import MAX_BITS, bitmap, drop, free_name, has_bit, stage, with_position
from deltaloom.llm.components import components
from deltaloom.llm.textvec import Words, chunks, mix

_U = np.uint64


@dataclass(frozen=True)
class Plan:
    """Similar: num / den or more of the union.  n2 partitions in a group, of which k2 may differ."""

    words: int = 5
    num: int = 8
    den: int = 10
    n2: int = 3
    k2: int = 1

    def instances(self, largest: int) -> list[tuple[int, int]]:
        """(smallest, largest) size of each instance.  One ends where the ratio of two bands does; the next begins with
        the first size that has partners beyond that end."""
        out, low = [], 1
        while low <= largest:
            high = max(low, low * self.den**2 // self.num**2)
            out.append((low, high))
            low = -(-(high + 1) * self.num // self.den)
        return out

    def distance(self, a: int, b: int) -> int:
        """Largest Hamming distance of similar sets of a and b features."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def need(self, n: int, high: int) -> int:
        """Groups that a set of n features needs in an instance: one more than its similar sets can spoil."""
        return self.distance(n, min(high, n * self.den // self.num)) // (self.k2 + 1) + 1

    def groups(self, low: int, high: int) -> tuple[int, int, int]:
        """(n1, t, z): groups, of which t are spare; sets with at most z empty choices leave these out."""
        return _groups(self, low, high)

    def least_shared(self, n1: int, k: int) -> int:
        """Signatures that sets at distance k share at least: differences do most harm where each is the first, then the
        second of its group, and in a partition of its own."""
        left = [comb(self.n2 - d, self.n2 - self.k2) if d <= self.k2 else 0 for d in range(self.k2 + 2)]
        out = n1 * left[0]
        for d in range(self.k2 + 1):
            hit = min(k, n1)
            out, k = out - hit * (left[d] - left[d + 1]), k - hit
        return out

    def shared(self, sizes: np.ndarray) -> np.ndarray:
        """For sets of these sizes, signatures that they share with any similar set at least."""
        out = np.full(len(sizes), 1 << 20)
        for low, high in self.instances(int(sizes.max(initial=1))):
            inside = (sizes >= low) & (sizes <= high)
            out[inside] = np.minimum(out[inside], _promised(self, low, high))
        return out

    def choices(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.n2), self.n2 - self.k2))

    def similar(self, common, a, b):
        """On numbers or columns: den * |A and B| >= num * |A or B|."""
        return common * self.den >= (a + b - common) * self.num


@lru_cache(maxsize=None)
def _groups(plan: Plan, low: int, high: int) -> tuple[int, int, int]:
    need = plan.need(high, high)
    more = need // 8
    choices = (need + more) * len(plan.choices())
    empty = choices * float(np.exp(-((low * high) ** 0.5) * (plan.n2 - plan.k2) / ((need + more) * plan.n2)))
    z = int(np.ceil(empty + 3 * np.sqrt(empty)))
    t = more
    while min(plan.least_shared(k // (plan.k2 + 1) + 1 + t, k) for k in range(plan.distance(high, high) + 1)) <= z:
        t += 1
    return need + t, t, z


@lru_cache(maxsize=None)
def _promised(plan: Plan, low: int, high: int) -> int:
    if plan.distance(high, high) == 0:
        return 1 << 20  # similar sets of these sizes are equal
    _, t, z = plan.groups(low, high)
    return min(plan.least_shared(k // (plan.k2 + 1) + 1 + t, k) for k in range(plan.distance(high, high) + 1)) - z


def distinct_shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct k-word shingles of a run of texts, by doc, then hash."""
    doc, h = Words(texts).shingles(k)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def signatures(h: np.ndarray, plan: Plan, instances: list[tuple[int, int]]) -> np.ndarray:
    """Signatures of one set of distinct hashes."""
    n = len(h)
    if n == 0:
        return np.zeros(0, _U)
    out = []
    spread, place = mix(h), mix(h ^ _U(0x5851F42D4C957F2D))
    for number, (low, high) in enumerate(instances):
        if not low <= n <= high or plan.distance(high, high) == 0:  # at distance 0 similar sets are equal
            continue
        n1, spare, z = plan.groups(low, high)
        own = min(n1, plan.need(n, high) + spare)
        cell = (place % _U(n1 * plan.n2)).astype(np.int64)
        cells = own * plan.n2
        order = np.argsort(cell, kind="stable")
        sums = np.concatenate(([_U(0)], np.cumsum(spread[order], dtype=_U)))
        edge = np.searchsorted(cell[order], np.arange(cells + 1))
        total = (sums[edge[1:]] - sums[edge[:-1]]).reshape(own, plan.n2)
        size = np.diff(edge).reshape(own, plan.n2)
        made, none = [], []
        group = mix(_U(number) * _U(0x100000001B3) + np.arange(own, dtype=_U))
        for c, choice in enumerate(plan.choices()):
            made.append(mix(mix(total[:, choice].sum(axis=1, dtype=_U)) ^ (group + _U(c))))
            none.append(size[:, choice].sum(axis=1) == 0)
        made, none = np.stack(made), np.stack(none)
        keep = ~none
        if none.sum() > z:
            keep |= True
        out.append(made[keep])
    return np.concatenate(out) if out else np.zeros(0, _U)


@dataclass
class SetsOf:
    """The shingle sets of a run of texts: hashes by text, sizes, and two sums of hashes that tell sets apart."""

    h: np.ndarray
    first: np.ndarray
    n: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    cls: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], k: int) -> "SetsOf":
        doc, h = distinct_shingles(texts, k)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        n = np.diff(first)
        sums = lambda x: (s := np.concatenate(([_U(0)], np.cumsum(x, dtype=_U))))[first[1:]] - s[first[:-1]]
        h1, h2 = sums(mix(h)), sums(mix(h ^ _U(0x2545F4914F6CDD1D)))
        return cls(h, first, n.astype(np.int64), h1.view(np.int64), h2.view(np.int64), mix(h1 ^ mix(h2 ^ mix(n.astype(_U)))).view(np.int64))


def features(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, digest (of the text), n (set size), h1, h2, cls (the set's digests), r (`Plan.shared`) for each row."""

    def run(batches):
        for part, texts in chunks(batches, 1):
            s = SetsOf.of(texts, plan.words)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), *(pa.array(x) for x in (s.n, s.h1, s.h2, s.cls, plan.shared(s.n)))],
                names=["doc_id", "digest", "n", "h1", "h2", "cls", "r"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(run, f"doc_id {kind}, digest bigint, n bigint, h1 bigint, h2 bigint, cls bigint, r bigint")


def shared_signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """(sig, cls) of the signatures that sets of two classes or more have."""

    def emit(batches):
        seen: set[tuple] = set()  # classes of this task's rows
        for _, texts in chunks(batches, 0):
            s = SetsOf.of(texts, plan.words)
            instances = plan.instances(int(s.n.max(initial=1)))
            for i, key in enumerate(zip(s.h1.tolist(), s.h2.tolist())):
                if s.n[i] == 0 or key in seen:
                    continue
                seen.add(key)
                sig = signatures(s.h[s.first[i]:s.first[i + 1]], plan, instances).view(np.int64)
                for at in range(0, len(sig), 1 << 20):
                    run = sig[at:at + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(np.full(len(run), s.cls[i]))], names=["sig", "cls"])

    made = docs.select("text").mapInArrow(_gathered(emit), "sig bigint, cls bigint")
    return made.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(_of_several, "sig bigint, cls bigint")


def _gathered(emit):
    """emit's small batches put together to at least 64K rows."""

    def run(batches):
        held, rows = [], 0
        for b in emit(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= 1 << 16:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, cls) sorted by both: each row once, if its signature has another class."""
    last: tuple[int, int] | None = None  # the row before, and whether it is out already
    out_already = False
    for b in batches:
        sig, cls = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if last is not None:
            sig, cls = np.concatenate(([last[0]], sig)), np.concatenate(([last[1]], cls))
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[new], cls[new]
        same = np.concatenate(([False], sig[1:] == sig[:-1]))
        emit = same | np.concatenate((same[1:], [False]))
        if last is not None:
            emit[0] &= not out_already
        out_already = bool(same[-1]) if len(sig) > 1 or last is None else out_already
        last = (int(sig[-1]), int(cls[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(sig[emit]), pa.array(cls[emit])], names=["sig", "cls"])


def among(rows: DataFrame, key: Column, wanted: DataFrame, name: str, inside: bool = True) -> DataFrame:
    """Rows whose key, a hash, may be one of column `name` of `wanted`: all that are, and one in 16 of the others (more beyond
    MAX_BITS / 16 keys), so that a join moves few rows that it drops.  With inside=False the rest."""
    bits = 1 << 10
    while bits < min(MAX_BITS, 16 * wanted.count()):
        bits *= 2
    is_in = has_bit(bitmap(wanted.select(F.pmod(F.col(name), F.lit(bits)).alias("s")), "s", bits), F.pmod(key, F.lit(bits)))
    return rows.where(is_in if inside else ~is_in)


def sets(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """rep and its shingle hashes, from whole texts; wanted: doc_id, digest, rep, n, h1, h2.

    Representatives without doc_id are met by the digest of their text, one row of each.
    """
    columns = ["rep", "text", "n", "h1", "h2"]
    some = among(docs.select("doc_id", "text"), F.xxhash64("doc_id"), wanted.select(F.xxhash64("doc_id").alias("key")), "key")
    rows = some.join(wanted, "doc_id").select(*columns)
    named = docs.where("doc_id is null").select("text", F.xxhash64("text").alias("digest"))
    rows = rows.unionByName(named.dropDuplicates(["digest"]).join(wanted.where("doc_id is null"), "digest").select(*columns))

    def run(batches):
        for part, texts in chunks(batches, 1):
            s = SetsOf.of(texts, plan.words)
            lists = pa.ListArray.from_arrays(pa.array(s.first, pa.int32()), pa.array(s.h.view(np.int64)))
            same = (s.h1 == part.column(3).to_numpy(zero_copy_only=False)) & (s.n == part.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["rep", "h"]).filter(pa.array(same))

    return rows.mapInArrow(run, "rep bigint, h array<bigint>")


#: Pairs of one set that are compared in one task, at about most; a leader of more is dealt out in parts.
PAIRS = 512


def compared(pairs: DataFrame, held: DataFrame, extra: Column, name: str) -> DataFrame:
    """Staged pairs (a, b, ...) with the expression `extra` over the sets ha and hb; held: rep, h."""
    left, right = held.select(F.col("rep").alias("a"), F.col("h").alias("ha")), held.select(F.col("rep").alias("b"), F.col("h").alias("hb"))
    hot = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > PAIRS).select(
        "a", F.ceil(F.col("c") / PAIRS).cast("int").alias("_parts")), "op3-hot")
    on = ["a"]
    if not hot.isEmpty():
        on = ["a", "_part"]
        pairs_, left = (x.join(hot, "a", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))) for x in (pairs, left))
        dealt = pairs_.withColumn("_part", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int"))
        left = left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    else:
        dealt = pairs
    return dealt.join(left, on).join(right, "b").select(*pairs.columns, extra.alias(name))


#: Groups up to this size are compared pair by pair.
SMALL = 12


def _size_filter(a: str, b: str, plan: Plan) -> str:
    return f"least({a}, {b}) * {plan.den} >= greatest({a}, {b}) * {plan.num}"


def near_groups(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_shingles, component_id, n_equal for each row of docs.

    component_id: smallest doc_id that links reach.  n_equal: rows with the same set, this one included.  Null texts
    and texts without words have no shingles and link to nothing, not even each other.  Repeated rows are copies.
    Null doc_ids take part but are never a component's id unless it has no other.  An empty relation gives an empty
    one; columns other than doc_id and text are not looked at, whatever their names.
    """
    return groups_of(docs, plan).select("doc_id", "n_shingles", "component_id", "n_equal")


def keep_one(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row of docs of each component, all columns as they are: the smallest doc_id's (of its texts the one with the
    smallest digest, of repeated rows any).  Rows without shingles all stay."""
    found = stage(groups_of(docs, plan), "op3-rows")
    id_, digest = free_name(docs.columns, "_id"), free_name(docs.columns, "_digest")
    first = found.where("n_shingles > 0").groupBy("group").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), "doc_id", "digest")).alias("k")).select("k.doc_id", "k.digest")
    empty = found.where("n_shingles = 0").select("doc_id", "digest").distinct()
    named = lambda df: df.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest))
    keys = stage(named(first.unionByName(empty)), "op3-keep")
    again = stage(named(found.where("n_shingles > 0").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1")), "op3-repeated")
    gone = stage(named(found).distinct().join(
        keys.select(F.col(id_).alias("i"), F.col(digest).alias("d")), F.col(id_).eqNullSafe(F.col("i")) & (F.col(digest) == F.col("d")), "left_anti"
    ).select(F.xxhash64(id_, digest).alias("key")), "op3-gone")
    drop(found)
    same = lambda df: df["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(df["text"]) == F.col(digest))
    # whole rows move only where they may be among those that go
    key = F.xxhash64(docs["doc_id"], F.xxhash64(docs["text"]))
    kept = among(docs, key, gone, "key", inside=False).union(among(docs, key, gone, "key").join(keys, same(docs), "left_semi"))
    if again.isEmpty():
        return kept
    one = kept.join(again, same(kept), "left_semi")
    one = one.groupBy("doc_id", F.xxhash64("text").alias(digest)).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(id_)).select(f"{id_}.*")
    return kept.join(again, same(kept), "left_anti").unionByName(one)


def groups_of(docs: DataFrame, plan: Plan) -> DataFrame:
    """near_groups with group (a number for each component, null without shingles) and the text's digest."""
    feats = stage(with_position(features(docs, plan), "uid"), "op3-features")
    key = ["n", "h1", "h2"]
    classes = stage(feats.where("n > 0").groupBy(*key, "cls", "r").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "uid"))["uid"].alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "op3-classes")

    shared = stage(shared_signatures(docs, plan), "op3-shared")
    marks = shared.groupBy("sig").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    one = marks.groupBy("c", "x", "y").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("times")).select("sig", "c", "times")
    groups = stage(shared.join(one, "sig").join(classes.select("cls", "rep", "n", "r"), "cls").select("sig", "c", "times", "rep", "n", "r"), "op3-groups")
    drop(shared)
    groups = _pruned(groups, "op3-pruned")
    central = groups.groupBy("rep").agg(F.sum(F.col("c") * F.col("times")).alias("w"))
    leaders = groups.join(central, "rep").groupBy("sig").agg(F.max(F.struct("w", "rep", "n")).alias("m"))
    led = stage(groups.join(leaders, "sig").select("sig", "c", "times", "rep", "n", "r", "m.w", F.col("m.rep").alias("lead"), F.col("m.n").alias("ln")), "op3-led")
    drop(groups)
    others = led.where("rep <> lead")
    common = F.size(F.array_intersect("ha", "hb"))
    is_link = plan.similar(F.col("common"), F.col("na"), F.col("nb"))

    # first each set with the most central of its leaders, then with its leaders in groups that are still mixed
    asked = stage(
        others.groupBy("rep").agg(F.max(F.struct("w", "lead", "ln")).alias("m"), F.first("n").alias("nb"))
        .select(F.col("m.lead").alias("a"), F.col("rep").alias("b"), F.col("m.ln").alias("na"), "nb"), "op3-best")
    ends = others.select("lead").unionByName(others.select(F.col("rep").alias("lead"))).distinct().withColumnRenamed("lead", "rep")
    # uid is unique, so the row of a representative is met by it alone
    wanted = stage(
        classes.select("rep", *key).join(ends, "rep", "left_semi").join(feats.select("uid", "doc_id", "digest"), F.expr("rep = uid")).drop("uid"), "op3-ends")
    held = sets(docs, wanted, plan)
    if not feats.join(wanted.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        held = held.dropDuplicates(["rep"])  # repeated rows
    held = stage(held, "op3-sets")
    drop(wanted)
    best = stage(compared(asked, held, common, "common"), "op3-compared")
    drop(asked)
    first = components(best.where(is_link).select("a", "b"), "op3-first")
    tagged = led.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = tagged.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    open_ = stage(tagged.join(mixed, "sig"), "op3-open")
    drop(led, first)
    open_ = _pruned(open_, "op3-open")

    # a small group's pairs: at most (SMALL - 1) / 2 for each member.  A pair that shares a large group is met there, so
    # one that only small groups have has to have all its signatures in these
    x, y = (open_.where(F.col("c") <= SMALL).select("sig", "times", *(F.col(n).alias(n + e) for n in ("rep", "n", "r", "label"))) for e in "xy")
    few = stage(
        x.join(y.drop("times"), "sig").where("labelx < labely").where(_size_filter("nx", "ny", plan))
        .groupBy(F.col("repx").alias("a"), F.col("repy").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb"))
        .agg(F.sum("times").alias("m"), F.max(F.greatest("rx", "ry")).alias("r")).where("m >= r").drop("m", "r"), "op3-few")
    few_links = stage(compared(few, held, common, "common").where(is_link).select("a", "b"), "op3-few-links")
    drop(few)

    # a large group's members with its leader
    asked = open_.where(F.col("c") > SMALL).where("rep <> lead").select(
        F.col("lead").alias("a"), F.col("rep").alias("b"), F.col("ln").alias("na"), F.col("n").alias("nb")).distinct()
    asked = stage(asked.join(best.select("a", "b", "common"), ["a", "b"], "left"), "op3-wanted")
    drop(open_)
    todo = stage(asked.where("common is null").drop("common"), "op3-todo")
    star = stage(asked.where("common is not null").unionByName(compared(todo, held, common, "common")), "op3-star")
    drop(asked, todo)
    links = stage(
        best.where(is_link).select("a", "b").unionByName(star.where(is_link).select("a", "b")).unionByName(few_links).distinct(), "op3-links")
    drop(best, few_links)
    labels = components(links, "op3-star")

    # a set that is less alike to the leader than 2 t - 1 (t: the threshold) is similar to none that is linked to it
    t, likeness = plan.num / plan.den, F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    near = _cross_pairs(star.where(likeness >= 2 * t - 1 - 1e-9), held, labels, plan)
    far = _far_pairs(star.where(~is_link).select(F.col("b").alias("rep"), F.col("nb").alias("n")).distinct(), held, labels, plan)
    cross = stage(near.unionByName(far).distinct(), "op3-both")
    drop(near, far)
    more = stage(compared(cross, held, common, "common").where(is_link).select("a", "b"), "op3-cross")
    drop(star, held, cross)
    if not more.isEmpty():
        labels = components(links.unionByName(more), "op3-second")
    drop(links, more)
    return _members(feats, classes, labels)


def _pruned(groups: DataFrame, name: str) -> DataFrame:
    """groups (sig, rep, c, times, r, ...) without the sets that share fewer signatures than a similar set would make them,
    and without the groups that are left with one; twice, as groups that go take signatures from others."""
    for _ in range(2):
        enough = groups.groupBy("rep").agg(F.sum("times").alias("s"), F.max("r").alias("r")).where("s >= r").select("rep")
        kept = groups.join(enough, "rep", "left_semi")
        left = kept.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        after = stage(kept.drop("c").join(left, "sig"), name)
        drop(groups)
        groups = after
    return groups


def _families(star: DataFrame, held: DataFrame, labels: DataFrame, plan: Plan) -> DataFrame:
    """a, b, na, nb, common, ours: leaders' members that are in their component (linked to one of its leaders: ours) or
    in another, told once for each chief `a` instead of once for each leader.

    A family of near copies has many leaders, one for each group, and each of them meets most of the family.  A leader's
    chief is the one with the most members among itself and the leaders it is linked to, so it lies in the same component and near.
    Two members of one leader are members of its chief too, and all bounds of `_cross_pairs` hold for any set that both are held against.
    """
    by_rep = labels.withColumnRenamed("node", "rep")
    own = star.join(by_rep.withColumnRenamed("rep", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    lead = by_rep.withColumnRenamed("rep", "a").withColumnRenamed("label", "top")
    linked = plan.similar(F.col("common"), F.col("na"), F.col("nb"))
    tagged = stage(own.join(lead, "a", "left").withColumn("top", F.coalesce("top", "a")).select(
        "a", "b", "na", "nb", "common", linked.alias("ours"), (F.col("label") != F.col("top")).alias("other")), "op3-tagged")
    leaders = stage(tagged.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.max("other").alias("other")), "op3-leaders")
    above = tagged.where("ours").select("a", F.col("b").alias("of")).join(leaders, "a").join(leaders.select(F.col("a").alias("of")), "of", "left_semi")
    chiefs = above.select("of", "c", "a", "na").unionByName(leaders.select(F.col("a").alias("of"), "c", "a", "na")).groupBy("of").agg(
        F.max(F.struct("c", "a", "na")).alias("m")).select("of", F.col("m.a").alias("a"), F.col("m.na").alias("na"))
    chiefs = stage(chiefs, "op3-chiefs")
    open_ = chiefs.join(leaders.where("other").select(F.col("a").alias("of")), "of", "left_semi").select("a").distinct()
    open_ = chiefs.join(open_, "a", "left_semi")
    told = tagged.where("ours or other").select(F.col("a").alias("of"), "b", "nb", "ours").join(open_, "of").where("a <> b")
    told = told.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("ours").alias("ours"))
    told = stage(told.join(tagged.select("a", "b", "common"), ["a", "b"], "left"), "op3-told")
    drop(tagged, leaders, chiefs)
    todo = told.where("common is null").drop("common")
    if todo.isEmpty():
        return told
    todo = stage(todo, "op3-told-todo")
    out = stage(told.where("common is not null").select(*todo.columns, "common").unionByName(
        compared(todo, held, F.size(F.array_intersect("ha", "hb")), "common")), "op3-told-all")
    drop(told, todo)
    return out


def _cross_pairs(star: DataFrame, held: DataFrame, labels: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b, na, nb) of one chief's family, one in the chief's component and one in another, that may be similar.

    With h = |D(x)| and k the largest distance at which sets of sizes nx and ny are similar, similar x and y share
    at least (hx + hy - k) / 2 features of D.  Lower bounds of that for any partner of x: hx - k (as hy >= hx - k),
    and, where x is in the chief's component and so its partner is not, with hy above the chief's distance.  x then
    needs the first hx - bound + 1 features of D(x), in an order that all members share.  The places of a shared
    feature bound what the two differences can share from there on; a pair's first shared feature passes that bound.
    A member of another component that is similar to the chief itself is a pair with it.
    """
    told = _families(star, held, labels, plan)
    part, whole = plan.den - plan.num, plan.den + plan.num
    partner = F.floor(F.col("nb") * plan.den / plan.num)  # largest size of a similar set
    h = F.col("na") + F.col("nb") - 2 * F.col("common")
    k = F.floor((F.col("nb") + partner) * part / whole)
    least_partner = F.ceil(F.col("nb") * plan.num / plan.den)
    beyond = F.floor((F.col("na") + least_partner) * part / whole) + 1
    ours, alike = F.col("ours"), plan.similar(F.col("common"), F.col("na"), F.col("nb"))
    # a member has partners only if its h reaches the least h - k of the other side; a family of one side has no pair
    ends = told.where(ours | ~alike).groupBy("a").agg(F.min(F.when(~ours, h - k)).alias("reach"), F.max(F.when(ours, h)).alias("most"))
    bound = F.greatest(F.lit(1), h - k, F.when(ours, F.ceil((h + beyond - k) / 2)).otherwise(F.lit(1)))
    length = F.greatest(F.lit(0), h - bound + 1).cast("int")
    # lacks, has: sizes of the two parts of D(x), what the chief lacks and what x lacks
    sized = told.join(ends, "a").where((ours & (h >= F.col("reach"))) | (~ours & ~alike & (h - k <= F.col("most")))).select(
        "a", "b", "nb", ours.alias("linked"), length.alias("length"), (F.col("nb") - F.col("common")).alias("lacks"), (F.col("na") - F.col("common")).alias("has")
    ).where("length > 0")
    sized = stage(sized, "op3-sized")
    direct = stage(told.where(~ours & alike).select("a", "b", "na", "nb"), "op3-direct")
    drop(told)
    order = F.slice(F.concat(F.array_sort(F.array_except("hb", "ha")), F.array_sort(F.array_except("ha", "hb"))), F.lit(1), F.col("length"))
    prefix = stage(
        compared(sized, held, order, "e").select("a", "b", "nb", "linked", "lacks", "has", F.posexplode("e").alias("at", "e")), "op3-prefix")
    drop(sized)
    # features that only linked members, or only others, have in their prefixes bring no pair
    mixed = prefix.groupBy("a", "e").agg(F.min("linked").alias("lo"), F.max("linked").alias("hi")).where("lo <> hi").select("a", "e")
    kept = stage(prefix.join(mixed, ["a", "e"], "left_semi"), "op3-mixed")
    drop(prefix)
    x, y = (kept.where(side).select("a", "e", *(F.col(c).alias(c + s) for c in ("b", "nb", "at", "lacks", "has"))) for s, side in (("x", "linked"), ("y", "not linked")))
    # what the differences can share from their first shared feature on, against what similar sets have to share
    rest = (
        "case when atx < lacksx then least(lacksx - atx, lacksy - aty) + least(hasx, hasy) "
        "else least(lacksx + hasx - atx, lacksy + hasy - aty) end")
    needed = f"lacksx + hasx + lacksy + hasy - floor((nbx + nby) * {part} / {whole})"
    pairs = stage(
        x.join(y, ["a", "e"])
        .where(_size_filter("nbx", "nby", plan)).where(f"2 * ({rest}) >= {needed}")
        .select(F.col("bx").alias("a"), F.col("by").alias("b"), F.col("nbx").alias("na"), F.col("nby").alias("nb")).unionByName(direct).distinct(), "op3-pairs")
    drop(kept, direct)
    return pairs


def _far_pairs(far: DataFrame, held: DataFrame, labels: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b, na, nb) of sets of `far` (rep, n), in different components, that may be similar.

    Similar x and y share at least needed(nx + ny) features, and so at least num / den of nx, all of them held by
    several components.  Of x's m such features, rarest first, one of the first m - num / den * nx + 1 is shared; from
    a pair's first shared feature on, what is left of either has to suffice.
    """
    named = labels.withColumnRenamed("node", "rep")
    far = stage(far.join(named, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "op3-far")
    rows = far.join(held, "rep").select("rep", F.col("label").alias("own"), F.explode("h").alias("e"))
    rows = stage(rows, "op3-far-features")
    many = stage(rows.groupBy("e").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo <> hi").select("e", "df"), "op3-far-many")
    least = F.ceil(F.col("n") * plan.num / plan.den)
    # counted before the features of any set are put together, so sets that drop out cost no more than that
    mixed = stage(rows.select("rep", "e").join(many, "e"), "op3-far-mixed")
    drop(rows, many)
    enough = far.join(mixed.groupBy("rep").agg(F.count(F.lit(1)).alias("m")), "rep").where(F.col("m") >= least)
    lists = mixed.join(enough, "rep").groupBy("rep", "n", "label", "m").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("l"))
    lists = lists.select("rep", "n", "label", "m", F.posexplode(F.slice("l", F.lit(1), (F.col("m") - least + 1).cast("int"))).alias("at", "f"))
    prefix = stage(lists.select("rep", "n", "label", "m", "at", "f.e"), "op3-far-prefix")
    drop(mixed, far)
    mixed = prefix.groupBy("e").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("e")
    kept = stage(prefix.join(mixed, "e", "left_semi"), "op3-far-kept")
    drop(prefix)
    x, y = (kept.select("e", *(F.col(c).alias(c + s) for c in ("rep", "n", "label", "m", "at"))) for s in "xy")
    pairs = stage(
        x.join(y, "e").where("labelx < labely").where(_size_filter("nx", "ny", plan))
        .where(f"least(mx - atx, my - aty) * {plan.num + plan.den} >= (nx + ny) * {plan.num}")
        .select(F.col("repx").alias("a"), F.col("repy").alias("b"), F.col("nx").alias("na"), F.col("ny").alias("nb")).distinct(), "op3-far-pairs")
    drop(kept)
    return pairs


def _members(feats: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    table = stage(named.join(ids, "label").select("n", "h1", "h2", "component_id", F.col("label").alias("group"), F.col("copies").alias("n_equal")), "op3-table")
    drop(classes, labels)
    out = feats.select("doc_id", "digest", "n", "h1", "h2").join(table, ["n", "h1", "h2"], "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_equal", F.lit(1).cast("bigint")).alias("n_equal"), "group", "digest")
