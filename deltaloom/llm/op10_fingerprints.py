"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a run of at most PARAGRAPH words within a line; its digest is 48 bits of a hash and 16 check bits
of those.  A sketch has three tables of cells; each digest is added to one cell of each: count and xor of digests.
Sketches of two versions are subtracted cell by cell; a cell with count 1 or -1 and matching check bits holds one
differing digest, which is taken out of its other cells, and so on (peeling).  An empty rest means that all
differing digests were recovered.  If cells remain, the pair is sketched again with more cells.

All is DataFrame expressions: sketches of the base size inside the row; for pairs that need more cells, sketches with
two cells for each digest of both sides, inside the row up to IN_ROW digests (one for each part of the digests) and
beyond that as rows of cells, aggregated by (pair, cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.llm.common import drop, let, parallelism, stage, with_position

PARAGRAPH = 12
#: Cells of each of the three tables of a base sketch.
CELLS = 40
ROUNDS = 16
RETRIES = 4
#: Digests of both sides up to which larger sketches stay inside the row, and those that one of them holds on average.
IN_ROW = 6000
PART = 24
_HIGH, _LOW = -65536, 65535  # masks of a digest's hash and check bits


def _check(key: Column) -> Column:
    return F.xxhash64(key.bitwiseAND(F.lit(_HIGH).cast("bigint")), F.lit(99)).bitwiseAND(F.lit(_LOW).cast("bigint"))


def _pure(c: Column, k: Column) -> Column:
    return (F.abs(c) == 1) & (k.bitwiseAND(F.lit(_LOW).cast("bigint")) == _check(k))


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs; a text without words has none."""
    runs = F.regexp_extract_all(text, F.lit(r"(?:\S+[^\S\n]*){1,%d}" % PARAGRAPH), F.lit(0))
    hashed = F.transform(runs, lambda p: F.xxhash64(F.rtrim(p)).bitwiseAND(F.lit(_HIGH).cast("bigint")))
    return F.array_distinct(F.transform(hashed, lambda x: x.bitwiseOR(_check(x))))


def _slot(key: Column, table: int, cells: Column, seed: Column) -> Column:
    return (F.pmod(F.xxhash64(key, F.lit(table), seed), cells) + cells * table).cast("int")


def signed(keys: Column, sign: int, cells: Column, seed: Column) -> Column:
    """array<struct<c, k, s>>: each digest with its sign and its three cells."""
    return F.transform(keys, lambda k: F.struct(
        F.lit(sign).alias("c"), k.alias("k"), F.array(*[_slot(k, j, cells, seed) for j in range(3)]).alias("s")))


def _by_place(entries: Column, places: Column) -> Column:
    """For each place 0..places - 1 the array of its entries (struct<p, c, k>): one sort and one pass, whatever the number of places."""
    # a mark stands before the entries of each place, and one after the last
    marks = F.transform(F.sequence(F.lit(0), places), lambda p: F.struct(p.alias("p"), F.lit(-2).alias("c"), F.lit(0).cast("bigint").alias("k")))

    def cut(rows: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.get(rows, i)["c"] == -2)
        return let(at, lambda at: F.transform(
            F.sequence(F.lit(0), places - 1), lambda p: F.slice(rows, F.get(at, p) + 2, F.get(at, p + 1) - F.get(at, p) - 1)))

    return let(F.sort_array(F.concat(entries, marks)), cut)


def fold_entries(entries: Column, cells: Column) -> Column:
    """array<struct<c, k>> of 3 * cells cells from signed digests."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"))
    placed = F.flatten(F.transform(entries, lambda e: F.transform(
        e["s"], lambda s: F.struct(s.alias("p"), e["c"].alias("c"), e["k"].alias("k")))))
    return F.transform(_by_place(placed, cells * 3), lambda held: F.aggregate(
        held, zero, lambda a, e: F.struct((a["c"] + e["c"]).alias("c"), a["k"].bitwiseXOR(e["k"]).alias("k"))))


def sketch(keys: Column, cells: int = CELLS) -> Column:
    """array<struct<c, k>> of 3 * cells cells."""
    return fold_entries(signed(keys, 1, F.lit(cells), F.lit(0)), F.lit(cells))


def text_of(sketched: Column, n: Column) -> Column:
    """The fingerprint: number of digests, then each cell's count and xor in hexadecimal."""
    return F.concat_ws(";", n.cast("string"), F.array_join(F.transform(
        sketched, lambda c: F.concat_ws(".", F.hex(c["c"].cast("bigint")), F.hex(c["k"]))), ","))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k")))


def peel(cells: Column, size: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """struct<plus, minus, done>: digests only the first holds, only the second holds, and whether that is all.

    A cell of several digests may pass for one by chance; such a digest is taken out and put back, so it ends on both
    sides, and the sketch then counts as not done.
    """
    longs = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), longs.alias("plus"), longs.alias("minus"), F.lit(True).alias("more"))

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: _pure(c["c"], c["k"]))
        found = F.transform(F.array_distinct(pure), lambda c: F.struct(
            c["c"].alias("c"), c["k"].alias("k"), *[_slot(c["k"], j, size, seed).alias(f"s{j}") for j in range(3)]))

        def after(f: Column) -> Column:
            take = lambda c, i: F.aggregate(
                F.filter(f, lambda p: (p["s0"] == i) | (p["s1"] == i) | (p["s2"] == i)), c,
                lambda x, p: F.struct((x["c"] - p["c"]).alias("c"), x["k"].bitwiseXOR(p["k"]).alias("k")))
            ones = lambda sign: F.transform(F.filter(f, lambda p: p["c"] == sign), lambda p: p["k"])
            return F.when(F.size(f) == 0, F.struct(
                state["cells"].alias("cells"), state["plus"].alias("plus"), state["minus"].alias("minus"), F.lit(False).alias("more"))
            ).otherwise(F.struct(
                F.transform(state["cells"], take).alias("cells"), F.concat(state["plus"], ones(1)).alias("plus"),
                F.concat(state["minus"], ones(-1)).alias("minus"), F.lit(True).alias("more")))

        return F.when(state["more"], let(found, after)).otherwise(state)

    end = lambda s: F.struct(
        s["plus"].alias("plus"), s["minus"].alias("minus"),
        (~F.exists(s["cells"], lambda c: (c["c"] != 0) | (c["k"] != 0)) & ~F.arrays_overlap(s["plus"], s["minus"])).alias("done"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step), end)


def _retry_size(attempt: int) -> Column:
    """Cells of each table: in all, 2 * attempt for each digest of both sides, at least 24."""
    return F.greatest(F.lit(8), ((F.size("left") + F.size("right")) * attempt * 2 / 3).cast("int") + 1)


def _dealt(left: Column, right: Column) -> Column:
    """array<array<struct<p, c, k>>>: signed digests of both sides in parts of about PART, by their hash."""

    def split(parts: Column) -> Column:
        entry = lambda c: lambda k: F.struct(F.pmod(F.xxhash64(k, F.lit("part")), parts).cast("int").alias("p"), F.lit(c).alias("c"), k.alias("k"))
        return _by_place(F.concat(F.transform(left, entry(1)), F.transform(right, entry(-1))), parts)

    return let(F.greatest(F.lit(1), F.ceil((F.size(left) + F.size(right)) / PART).cast("int")), split)


def _recover_part(part: Column) -> Column:
    """struct<plus, minus, done>: numbers of digests of one part, sketched again with more cells while some are left."""

    def again(state: Column, attempt: Column) -> Column:
        def with_cells(m: Column) -> Column:
            entries = F.transform(part, lambda e: F.struct(
                e["c"].alias("c"), e["k"].alias("k"), F.array(*[_slot(e["k"], j, m, attempt) for j in range(3)]).alias("s")))
            return let(peel(fold_entries(entries, m), m, attempt), lambda r: F.struct(
                F.size(r["plus"]).alias("plus"), F.size(r["minus"]).alias("minus"), r["done"].alias("done")))

        cells = F.greatest(F.lit(8), (F.size(part) * attempt * 2 / 3).cast("int") + 1)
        return F.when(state["done"], state).otherwise(let(cells, with_cells))

    start = F.struct(F.lit(0).alias("plus"), F.lit(0).alias("minus"), (F.size(part) == 0).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), start, again)


def recovered(left: Column, right: Column) -> Column:
    """struct<plus, minus, done> of two arrays of distinct digests by larger sketches, one for each part of the digests:
    the work grows with their number and not with its square."""
    add = lambda parts, name: F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, r: n + r[name]).alias(name)
    return let(F.transform(_dealt(left, right), _recover_part), lambda parts: F.struct(
        add(parts, "plus"), add(parts, "minus"), F.forall(parts, lambda r: r["done"]).alias("done")))


def recover_in_row(pairs: DataFrame) -> DataFrame:
    """id, plus, minus, done of pairs (id, left, right), by sketches inside the row."""
    return pairs.withColumn("_p", recovered(F.col("left"), F.col("right"))).select("id", "_p.*")


def recover(pairs: DataFrame, attempt: int = 1) -> DataFrame:
    """id, plus, minus (numbers of digests) of pairs (id, left, right: arrays of distinct digests), by sketches of
    2 * attempt cells for each digest of both sides, as rows (id, slot).

    Peeling rounds run for all pairs together.  Pairs with cells left are sketched again with more cells and other
    hashes; after RETRIES attempts (the chance of one failing is small and falls with each) the digests of both
    sides themselves are compared.
    """
    seed = F.lit(attempt)
    # dealt by pair: the cells of a pair are folded where its digests are, without a further exchange
    keyed = pairs.select("id", "left", "right", _retry_size(attempt).alias("m")).repartition(parallelism(pairs.sparkSession), "id").select("id", "m", F.explode(F.concat(
        F.transform("left", lambda k: F.struct(F.lit(1).alias("c"), k.alias("k"))),
        F.transform("right", lambda k: F.struct(F.lit(-1).alias("c"), k.alias("k"))))).alias("e")).select("id", "m", "e.c", "e.k")

    def spread(rows: DataFrame) -> DataFrame:
        slots = F.explode(F.array(*[_slot(F.col("k"), j, F.col("m"), seed) for j in range(3)]))
        return rows.select("id", "m", slots.alias("s"), "c", "k")

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id", "m", "s").agg(F.sum("c").cast("int").alias("c"), F.bit_xor("k").alias("k")).where("c <> 0 or k <> 0")

    cells = stage(fold(spread(keyed)), "op10-cells")
    got: DataFrame | None = None
    while True:
        pure = stage(
            cells.where(_pure(F.col("c"), F.col("k"))).select("id", "m", "c", "k").distinct(), "op10-pure")
        if pure.isEmpty():
            break
        got = pure if got is None else got.unionByName(pure)
        cells = stage(fold(cells.unionByName(spread(pure.withColumn("c", -F.col("c"))))), "op10-cells")
    counts = pairs.select("id")
    if got is not None:
        sums = got.groupBy("id", "k").agg(F.sum("c").alias("c")).groupBy("id").agg(
            F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("plus"), F.sum(F.when(F.col("c") == -1, 1).otherwise(0)).alias("minus"))
        counts = counts.join(sums, "id", "left")
    else:
        counts = counts.withColumns({"plus": F.lit(0), "minus": F.lit(0)})
    counts = counts.select("id", F.coalesce("plus", F.lit(0)).cast("bigint").alias("plus"), F.coalesce("minus", F.lit(0)).cast("bigint").alias("minus"))
    left_over = cells.select("id").distinct()
    if cells.isEmpty():
        return counts
    failed = stage(pairs.join(left_over, "id", "left_semi"), "op10-failed")
    if attempt >= RETRIES:
        rest = failed.select("id", F.size(F.array_except("left", "right")).cast("bigint").alias("plus"), F.size(F.array_except("right", "left")).cast("bigint").alias("minus"))
    else:
        rest = recover(failed, attempt + 1)
    return counts.join(left_over, "id", "left_anti").unionByName(rest)


def with_next(docs: DataFrame, buckets: int | None = None, **made: Column) -> DataFrame:
    """doc_id, text (null: empty) and next_text, the text of the next doc_id in ascending order (after the last:
    the first); for each of the columns `made` from a row itself also its next_ one.  Null ids sort first; rows with one
    id are ordered by text.

    Rows are dealt by ranges of the id, whose bounds are approximate quantiles, so each task orders its own range
    and texts move once.  The first row of each range is also dealt to the range before it.  Bounds and first ids
    are `buckets` numbers each on the driver, 4 for each shuffle partition unless given.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(made)
    held = ["text", *made]
    n = buckets or 4 * parallelism(spark)
    cut = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n) if n > 1 else F.lit(None)).collect()[0][0] or []
    cut = sorted(set(cut))
    step = max(1, int(len(cut) ** 0.5))
    fine = [cut[i:i + step] for i in range(0, len(cut), step)]

    def longs(xs: list) -> Column:
        return F.split(F.lit(" ".join(map(str, xs))), " ").cast("array<bigint>")

    if cut:
        ends = longs([x[0] for x in fine])
        groups = F.transform(F.split(F.lit("|".join(" ".join(map(str, x)) for x in fine)), r"\|"), lambda x: F.split(x, " ").cast("array<bigint>"))
        below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
        coarse = below(ends)
        bucket = F.when(F.col("doc_id").isNull() | (coarse == 0), F.lit(0)).otherwise(
            (coarse - 1) * step + below(F.element_at(groups, F.greatest(coarse, F.lit(1)))))
    else:
        bucket = F.lit(0)
    dealt = rows.withColumn("_b", bucket.cast("int"))
    first = sorted((r[0], r[1], r[2]) for r in dealt.groupBy("_b").agg(
        F.min("doc_id"), F.max(F.col("doc_id").isNull().cast("int"))).collect())  # one row for each range
    if not first:
        return rows.withColumns({f"next_{c}": F.lit(None).cast(rows.schema[c].dataType) for c in held})
    ghosts = spark.createDataFrame(
        [(b, first[(i + 1) % len(first)][0], first[(i + 1) % len(first)][1], bool(first[(i + 1) % len(first)][2])) for i, (b, _, _) in enumerate(first)],
        "_to int, _from int, _id bigint, _null boolean")
    heads = (
        dealt.join(F.broadcast(ghosts), F.expr("_b = _from and ((_null and doc_id is null) or (not _null and doc_id = _id))"))
        .groupBy("_to").agg(F.min(F.struct(*held)).alias("h"))
        .select(F.col("_to").alias("_b"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "h.*", F.lit(1).alias("_ghost"))
    )
    order = Window.partitionBy("_b").orderBy("_ghost", "doc_id", "text")
    both = dealt.withColumn("_ghost", F.lit(0)).select("_b", "doc_id", *held, "_ghost").unionByName(heads)
    after = {f"next_{c}": F.lead(c).over(order) for c in held}
    return both.withColumns(after).where("_ghost = 0").select("doc_id", *held, *after)


def likeness(n_left: Column, plus: Column, minus: Column) -> Column:
    """Shared digests over all digests; two texts without digests are alike."""
    union = n_left + minus
    return F.when(union == 0, F.lit(1.0)).otherwise((n_left - plus) / union)


def compare(rows: DataFrame, versions: dict[str, tuple[str, str]], cells: int = CELLS) -> DataFrame:
    """rows with, for each name: (left, right) of versions, the columns name_plus and name_minus.

    left and right are names of columns of digests.  rows needs a column _uid.
    """
    sides = sorted({s for pair in versions.values() for s in pair})
    made = rows.withColumns({f"_s_{s}": sketch(F.col(s), cells) for s in sides if f"_s_{s}" not in rows.columns})
    out = made.withColumns({
        f"_p_{name}": peel(difference(F.col(f"_s_{a}"), F.col(f"_s_{b}")), F.lit(cells), F.lit(0)) for name, (a, b) in versions.items()})
    keep = [c for c in rows.columns if c not in sides and not c.startswith("_s_")]
    small = {n: F.size(a) + F.size(b) <= IN_ROW for n, (a, b) in versions.items()}
    tried = out.withColumns({f"_q_{n}": F.when(
        F.col(f"_p_{n}.done"), F.struct(F.size(f"_p_{n}.plus").cast("bigint").alias("plus"), F.size(f"_p_{n}.minus").cast("bigint").alias("minus"), F.lit(True).alias("done"))
    ).when(small[n], recovered(F.col(a), F.col(b))) for n, (a, b) in versions.items()})
    done = {n: F.coalesce(F.col(f"_q_{n}.done"), F.lit(False)) for n in versions}
    held = stage(tried.select(
        *keep, *[F.size(s).alias(f"n_{s}") for s in sides],
        *[F.when(done[n], F.col(f"_q_{n}.{side}")).alias(f"{n}_{side}") for n in versions for side in ("plus", "minus")],
        *[F.when(~done[n], F.struct(F.col(a).alias("left"), F.col(b).alias("right"))).alias(f"_r_{n}") for n, (a, b) in versions.items()],
    ), "op10-compared")
    hard = None
    for i, n in enumerate(versions):
        number = F.col("_uid") * len(versions) + i
        part = held.where(F.col(f"_r_{n}").isNotNull()).select(number.alias("id"), f"_r_{n}.left", f"_r_{n}.right")
        hard = part if hard is None else hard.unionByName(part)
    if not hard.isEmpty():
        more = stage(recover(hard), "op10-recovered")
        # only rows with such a pair move
        failed = F.coalesce(*[F.when(F.col(f"_r_{n}").isNotNull(), True) for n in versions], F.lit(False))
        rest, whole = held.where(failed), held.where(~failed)
        for i, n in enumerate(versions):
            mine = more.where(F.col("id") % len(versions) == i).select(
                F.floor(F.col("id") / len(versions)).alias("_uid"), F.col("plus").alias("_plus"), F.col("minus").alias("_minus"))
            rest = rest.join(mine, "_uid", "left").withColumns({
                f"{n}_plus": F.coalesce(f"{n}_plus", "_plus"), f"{n}_minus": F.coalesce(f"{n}_minus", "_minus")}).drop("_plus", "_minus")
        held = whole.unionByName(rest)
    return held.drop(*[f"_r_{n}" for n in versions])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    Null texts are empty.  The edited text keeps the first half (rounded up) and goes on with as many code points
    of the next document as were dropped, or all it has.
    """
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    # a text's digests travel with it to the row before, which needs them too
    pairs = with_next(docs, own=paragraphs(F.coalesce("text", F.lit("")))).select(
        "doc_id", n.cast("long").alias("n_chars"), "own", F.col("next_own").alias("next"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    keyed = pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", paragraphs(F.col("edited")).alias("edit"), "next")
    held = with_position(keyed, "_uid")
    sketched = held.withColumns({f"_s_{s}": sketch(F.col(s)) for s in ("own", "edit", "next")})
    printed = sketched.withColumns({
        "fingerprint": text_of(F.col("_s_own"), F.size("own")), "edited_fingerprint": text_of(F.col("_s_edit"), F.size("edit"))})
    out = compare(printed, {"edited": ("own", "edit"), "follow": ("own", "next")})
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("n_own"), F.col("edited_plus"), F.col("edited_minus")).alias("near_edited"),
        likeness(F.col("n_own"), F.col("follow_plus"), F.col("follow_minus")).alias("near_next"))
