"""Planning of a release over recorded state: what is pending, what is set aside, held or skipped, and the plan's identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.functions import text as X
from deltaloom.operators import ordered
from deltaloom.sources.logs import PROMOTION
from deltaloom.sources.staging import stage


# ---- the chain -------------------------------------------------------------------------------------------------

def order_of(chain: DataFrame) -> DataFrame:
    """chain (pos, file, replaces, ...) with root, depth: a replacement stands right after what it replaces."""
    own = chain.select(F.col("file").alias("replaces"), F.col("pos").alias("_target"))
    linked = chain.join(own, "replaces", "left")
    placed = ordered.effective_order(linked.select("pos", F.col("_target").alias("replaces")))
    return chain.join(placed, "pos")


def pending(chain: DataFrame, applied: DataFrame, set_aside: DataFrame, released: DataFrame, at_seq: int, seq: int) -> DataFrame:
    """(file, root, depth, status) for each line, and rows of applied files that the chain lacks.

    chain: pos, file, sha256, withdrawn, replaces; applied: file, sha256; set_aside, released: file.  Status, the first that
    fits: 'diverged' (applied with another checksum), 'applied', 'withdrawn', 'satisfied' (a line that it replaces, or one
    that this replaces, ... is applied), then for a pending line 'set aside', 'late' (a replacement before the last applied
    line), 'hole' (before the last applied line, never set aside) or 'pending'; 'unknown' for an applied file that the chain
    lacks; 'ahead' for a pending line that was never set aside of a database whose release at_seq is past seq.
    """
    placed = stage(order_of(chain), "release-order")
    a = applied.select("file", F.col("sha256").alias("_sha"), F.lit(True).alias("_applied"))
    marks = lambda df, name: df.select("file", F.lit(True).alias(name)).distinct()
    rows = placed.join(a, "file", "left").join(marks(set_aside, "_aside"), "file", "left").join(marks(released, "_released"), "file", "left")
    # a line stands for those it replaces: along a root, one that is applied satisfies all after it
    line = Window.partitionBy("root").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_met", F.max(F.coalesce("_applied", F.lit(False))).over(line))
    last = rows.where("_applied").agg(F.max(F.struct("root", "depth")).alias("_last"))  # one row
    rows = rows.join(F.broadcast(last))
    before = F.coalesce(F.struct("root", "depth") < F.col("_last"), F.lit(False))
    known = F.coalesce(F.col("_aside") | F.col("_released"), F.col("_aside"), F.col("_released"), F.lit(False))
    status = (
        F.when(F.col("_applied") & (F.col("_sha") != F.col("sha256")), "diverged").when(F.col("_applied"), "applied").when(F.col("withdrawn"), "withdrawn")
        .when(F.col("_met"), "satisfied").when(F.lit(at_seq > seq) & ~known, "ahead").when(F.col("_aside"), "set aside").when(before & F.col("replaces").isNotNull(), "late")
        .when(before & ~known, "hole").otherwise("pending"))
    out = rows.select("file", "root", "depth", status.alias("status"))
    lost = applied.join(chain.select("file"), "file", "left_anti").select("file", F.lit(None).cast(out.schema["root"].dataType).alias("root"), F.lit(None).cast("int").alias("depth"), F.lit("unknown").alias("status"))
    return out.unionByName(lost)


def is_prefix(applied: DataFrame, chain: DataFrame) -> DataFrame:
    """(is_prefix): whether the first k applied files are exactly the k that the chain knows; applied: place, file.  k and the
    number of known files among the first k are counts, so no order of all rows is needed beyond the given places."""
    known = applied.join(chain.select("file"), "file", "left_semi")
    k = known.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.max("place"), F.lit(0)).alias("last"))
    low = applied.agg(F.coalesce(F.min("place"), F.lit(0)).alias("first"))
    both = F.broadcast(k.join(low))  # one row
    return applied.join(both, how="right").where("place is null or place <= last").groupBy("k").agg(F.count("file").alias("n")).select(
        (F.col("n") == F.col("k")).alias("is_prefix"))


def caught_up(pending_lines: DataFrame, added: DataFrame, seq: int, recorded: int, withdrawn: DataFrame, first_deploy: bool = False, past: bool = False) -> DataFrame:
    """(file, release, ruling): which pending lines a release may run.

    Those it added itself run.  Those of earlier releases are 'carried' in a first deploy, past lines that are set aside, or
    from the release on that added a withdrawn line which the database never took; else they are 'behind': that release has to
    be deployed first.  A line whose release the manifest doesn't know is 'not listed'.
    """
    rows = pending_lines.select("file").join(added, "file", "left")
    never = withdrawn.select("file").join(added, "file").where(F.col("release") > recorded).agg(F.min("release").alias("_from"))  # one row
    rows = rows.join(F.broadcast(never))
    free = F.lit(first_deploy or past) | F.coalesce(F.col("release") >= F.col("_from"), F.lit(False))
    ruling = (
        F.when(F.col("release").isNull() | ~F.col("release").between(1, seq), "not listed").when(F.col("release") == seq, "run")
        .when(free, "carried").otherwise("behind"))
    return rows.select("file", "release", ruling.alias("ruling"))


def renumbered(chain: DataFrame, base_max: int) -> DataFrame:
    """(pos, file, new_file): new lines get the numbers after the base's highest, in their order; numbers come from a range
    exchange with an offset for each partition, so no task orders all lines."""
    from deltaloom.operators.ordered import numbered

    rows = numbered(chain.select("pos", "file"), ["pos"], "n")
    stem = F.expr("substr(file, instr(file, '__') + 2)")
    return rows.select("pos", "file", F.concat(F.lpad((F.col("n") + base_max + 1).cast("string"), 4, "0"), F.lit("__"), stem).alias("new_file"))


# ---- set aside -------------------------------------------------------------------------------------------------

#: Reasons after which a failed run parks its migration.
PARK_REASONS = ["BATCH_FAILED", "DEPENDANT_BROKEN"]


def parked(failed: DataFrame, steps: DataFrame) -> DataFrame:
    """(file, run_id, reason, active): the last failed run of each migration that parks it; a later ok resolve step with the
    note 'unpark <file>' ends it.  failed: run_id, step ('file#n'), reason; steps: run_id, kind, status, note."""
    shape = r"^(.+)#([0-9]+)$"
    runs = failed.where(F.col("step").rlike(shape) & F.col("reason").isin(PARK_REASONS)).select(F.regexp_extract("step", shape, 1).alias("file"), "run_id", "reason")
    last = runs.groupBy("file").agg(F.max_by(F.struct("run_id", "reason"), "run_id").alias("r")).select("file", "r.*")
    ends = steps.where("kind = 'resolve' and status = 'ok' and note like 'unpark %'").groupBy(F.expr("substr(note, 8)").alias("file")).agg(F.max("run_id").alias("_end"))
    return last.join(ends, "file", "left").select("file", "run_id", "reason", (F.col("_end").isNull() | (F.col("_end") <= F.col("run_id"))).alias("active"))


def skipped(steps: DataFrame) -> DataFrame:
    """(file, run_id) of migrations that were recorded as not managed for good."""
    return steps.where("migration is not null and status = 'not_applied' and note like 'not_managed in %'").groupBy(F.col("migration").alias("file")).agg(F.max("run_id").alias("run_id"))


def in_force(aside: DataFrame, steps: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """What is set aside and neither applied meanwhile nor withdrawn."""
    done = steps.where("migration is not null and status = 'ok'").select(F.col("migration").alias("file"))
    return aside.join(done.unionByName(withdrawn.select("file")).distinct(), "file", "left_anti")


def unmanaged_skips(touched: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(file, ruling): 'skipped' where the patterns match every object that a migration touches, 'mixed' (refused) where they
    match some; touched: file, schema, name.  Migrations that they don't match at all have no row."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | X.glob_matches(p, F.col("schema"), F.col("name"))
    counts = touched.groupBy("file").agg(F.min(hit).alias("all"), F.max(hit).alias("some"))
    return counts.where("some").select("file", F.when(F.col("all"), "skipped").otherwise("mixed").alias("ruling"))


def hidden_schemas(objects: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """(schema): schemas of which the patterns match every object."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | X.glob_matches(p, F.col("schema"), F.col("name"))
    return objects.groupBy(X.fold(F.col("schema")).alias("schema")).agg(F.min(hit).alias("all")).where("all").select("schema")


# ---- products and holds ----------------------------------------------------------------------------------------

def is_held(promote_to: Column, env: str) -> Column:
    """env comes after promote_to in the order of promotion; an environment outside it holds nothing."""
    if env not in PROMOTION:
        return F.lit(False)
    place = F.array_position(F.array(*[F.lit(e) for e in PROMOTION]), promote_to)
    return F.coalesce((place > 0) & (F.lit(PROMOTION.index(env) + 1) > place), F.lit(False))


def products_of(objects: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """objects (schema, name, ...) with products, the sorted names of all products whose patterns match; patterns:
    (product, 'schema.name'), a configuration's, so few: they are tried in one pass over the objects."""
    hits = F.array(*[F.when(X.glob_matches(p, F.col("schema"), F.col("name")), F.lit(n)) for n, p in patterns])
    return objects.withColumn("products", F.array_sort(F.array_distinct(F.array_compact(hits))))


def held(touched: DataFrame, products: DataFrame, patterns: Sequence[tuple[str, str]], env: str) -> DataFrame:
    """(file, product, held): the product of each migration that touches one: a held one if there is, else the first.
    touched: file, schema, name; products: product, promote_to."""
    own = products_of(touched, patterns).where("size(products) > 0").select("file", F.get("products", F.lit(0)).alias("product")).distinct()
    marked = own.join(products.select("product", is_held(F.col("promote_to"), env).alias("held")), "product")
    first = marked.groupBy("file").agg(F.min(F.struct((~F.col("held")).alias("free"), "product")).alias("m"))
    return first.select("file", "m.product", (~F.col("m.free")).alias("held"))


def owners_lines(files: DataFrame, patterns: Sequence[tuple[str, str]], owners: dict[str, str]) -> DataFrame:
    """(product, line): lines of a file of code owners: one glob for a pattern and folder where the files that it matches with
    letter case are all the product's, one line for each other file.  files: path, folder, schema, name."""
    own = stage(products_of(files, patterns).select("path", "folder", "schema", "name", F.get("products", F.lit(0)).alias("product")), "owners")
    globs = [(n, p) for n, p in patterns if not set("[]/\\") & set(p)]
    lines: DataFrame | None = None
    done = own.select("path").limit(0)
    for n, p in globs:
        stem = F.concat_ws(".", "schema", "name")
        matched = own.where(stem.rlike(X.glob_part(p).replace("(?is)", "(?s)")))
        good = matched.groupBy("folder").agg(F.min(F.coalesce(F.col("product") == n, F.lit(False))).alias("all")).where("all").select("folder")
        mine = matched.join(good, "folder", "left_semi").where(F.col("product") == n).join(done, "path", "left_anti")
        line = mine.select("folder").distinct().select(F.lit(n).alias("product"), F.concat(F.lit("/"), F.col("folder"), F.lit(f"/{p}.sql")).alias("line"))
        lines, done = line if lines is None else lines.unionByName(line), done.unionByName(mine.select("path"))
    rest = own.where("product is not null").join(done, "path", "left_anti").select("product", F.concat(F.lit("/"), "path").alias("line"))
    lines = rest if lines is None else lines.unionByName(rest)
    names = F.create_map(*[F.lit(x) for pair in owners.items() for x in pair])[F.col("product")]
    return lines.where(names.isNotNull()).select("product", F.concat(F.replace("line", F.lit(" "), F.lit("\\ ")), F.lit(" "), names).alias("line"))


# ---- independence ----------------------------------------------------------------------------------------------

def dependencies(work: DataFrame, aside: DataFrame) -> DataFrame:
    """(work, aside, shared): a change depends on one set aside if it touches what that touches or names, or names what it
    touches; shared: the smallest such object.  Both: id, object, how ('touches' or 'names')."""
    w, a = work.select(F.col("id").alias("work"), "object", F.col("how").alias("w")), aside.select(F.col("id").alias("aside"), "object", F.col("how").alias("a"))
    return w.join(a, "object").where("w = 'touches' or a = 'touches'").groupBy("work", "aside").agg(F.min("object").alias("shared"))


# ---- the plan --------------------------------------------------------------------------------------------------

def module_changes(files: DataFrame, recorded: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(key, action): create, overwrite, alter for files; drop for tombstones of managed objects; orphan for managed objects
    with neither; conflict for a key that has both.  files: key, checksum; recorded: key, sha256, status."""
    managed = recorded.where("status = 'managed'").select(X.fold(F.col("key")).alias("k"), "sha256", F.lit(True).alias("_managed"))
    f = files.select(X.fold(F.col("key")).alias("k"), "key", "checksum", F.lit(True).alias("_file"))
    t = tombstones.select(X.fold(F.col("key")).alias("k"), F.col("key").alias("_dead"))
    rows = f.join(t, "k", "full").join(managed, "k", "full")
    action = (
        F.when(F.col("_file") & F.col("_dead").isNotNull(), "conflict").when(F.col("_file") & F.col("_managed").isNull(), "create")
        .when(F.col("_file") & F.col("sha256").isNull(), "overwrite").when(F.col("_file") & (F.col("sha256") != F.col("checksum")), "alter")
        .when(F.col("_dead").isNotNull() & F.col("_managed"), "drop").when(F.col("_file").isNull() & F.col("_dead").isNull(), "orphan"))
    return rows.withColumn("action", action).where("action is not null").select(F.coalesce("key", "_dead", "k").alias("key"), "action")


def work(pending_lines: DataFrame, changes: DataFrame, nontx: DataFrame) -> DataFrame:
    """(step, object, kind, problem): migrations in chain order, then modules by action and key; a migration that runs outside
    a transaction has to be alone.  pending_lines: file, root, depth; changes: key, action; nontx: file."""
    lone = nontx.select("file", F.lit(True).alias("_alone"))
    steps = pending_lines.join(lone, "file", "left").select(
        F.struct(F.lit(0).alias("phase"), "root", "depth", F.lit("").alias("key")).alias("step"), F.col("file").alias("object"), F.lit("batch").alias("kind"), F.coalesce("_alone", F.lit(False)).alias("_alone"))
    kinds = changes.where("action in ('create', 'overwrite', 'alter', 'drop')")
    phase = F.when(F.col("action") == "drop", 2).otherwise(1)
    root = pending_lines.schema["root"].dataType
    steps = steps.unionByName(kinds.select(
        F.struct(phase.alias("phase"), F.lit(0).cast(root).alias("root"), F.lit(0).alias("depth"), "key").alias("step"), F.col("key").alias("object"),
        F.when(F.col("action") == "drop", "drop_module").otherwise("deploy_module").alias("kind"), F.lit(False).alias("_alone")))
    total = steps.agg(F.count(F.lit(1)).alias("_n"), F.max("_alone").alias("_any"))  # one row
    return steps.join(F.broadcast(total)).select("step", "object", "kind", F.when(F.col("_any") & (F.col("_n") > 1), "NONTX_NOT_ALONE").alias("problem"))


def alignment(differences: DataFrame) -> DataFrame:
    """(phase, ord, statement, review): statements that bring a database to its files, live-only objects kept, risky ones
    marked; differences: key, note, rows (estimated), statement."""
    review = F.when(F.col("note").isin("loses data", "not null"), F.concat(F.lit("REVIEW: "), "note"))
    phase = F.when(F.col("note") == "absent", 0).when(F.col("note") == "only live", 2).otherwise(1)
    return differences.where("note <> 'only live'").select(phase.alias("phase"), "rows", "key", F.when(review.isNotNull(), F.concat(F.lit("-- "), "statement")).otherwise(F.col("statement")).alias("statement"), review.alias("review"))
