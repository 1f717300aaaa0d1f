"""Readers of a database's catalog, as joins over its relations.

Each function takes the relations under the names and columns that it says, so any source that has them will do: an
export in Parquet, a JDBC table, a view.  Filters and columns are left to the optimizer to push into the scans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions import text as X


def in_schemas(schema: Column, schemas: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """The condition that a scope adds to a scan: listed schemas (none: all) without the excluded, compared folded."""
    out = F.lit(True) if not schemas else X.fold(schema).isin([s.lower() for s in schemas])
    return out & ~X.fold(schema).isin([s.lower() for s in exclude]) if exclude else out


def modules(objects: DataFrame, schemas: DataFrame, texts: DataFrame, triggers: DataFrame, events: DataFrame) -> DataFrame:
    """(key, definition, bound, parent, events): texts of modules; for triggers also their table and events.

    objects: object_id, schema_id, name, kind; schemas: schema_id, schema; texts: object_id, definition, bound; triggers:
    object_id, parent_id; events: object_id, event.  Events are put together before the join.
    """
    named = objects.join(schemas, "schema_id").select("object_id", "kind", "schema", "name")
    parents = named.select(F.col("object_id").alias("parent_id"), X.object_key(F.lit("TABLE"), F.col("schema"), F.col("name")).alias("parent"))
    kinds = events.groupBy("object_id").agg(F.array_join(F.array_sort(F.collect_set("event")), ";").alias("events"))
    return (
        named.join(texts, "object_id").join(triggers, "object_id", "left").join(parents, "parent_id", "left").join(kinds, "object_id", "left")
        .select(X.object_key(F.col("kind"), F.col("schema"), F.col("name")).alias("key"), "definition", "bound", "parent", "events"))


def user_objects(objects: DataFrame, schemas: DataFrame, history: DataFrame, scope: Column | None = None) -> DataFrame:
    """(key, is_history) of a scope's objects; history (object_id) marks history tables."""
    marked = history.select("object_id", F.lit(True).alias("h")).distinct()
    rows = objects.join(schemas, "schema_id").where(F.lit(True) if scope is None else scope).join(marked, "object_id", "left")
    return rows.select(X.object_key(F.col("kind"), F.col("schema"), F.col("name")).alias("key"), F.coalesce("h", F.lit(False)).alias("is_history"))


def existing(asked: DataFrame, there: DataFrame, key: str = "key") -> DataFrame:
    """(key, exists) for each asked key."""
    known = there.select(F.col(key), F.lit(True).alias("exists")).distinct()
    return asked.select(key).distinct().join(known, key, "left").select(key, F.coalesce("exists", F.lit(False)).alias("exists"))


def resolved(spark: SparkSession, keys: Sequence[str], ids: DataFrame) -> DataFrame:
    """(key, object_id): a row for each asked key, without an id where there is none.  keys: what a caller wrote down; ids:
    key, object_id."""
    asked = spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
    return asked.join(ids, "key", "left").select("key", "object_id")


def table_columns(columns: DataFrame) -> DataFrame:
    """(object_id, names): the set of names of each table's columns, folded; a table's columns are few."""
    return columns.groupBy("object_id").agg(F.array_sort(F.collect_set(X.fold(F.col("name")))).alias("names"))


def export_facts(branches: Sequence[tuple[str, DataFrame, Column]], optional: Sequence[tuple[str, str, str]] = (), spark: SparkSession | None = None) -> DataFrame:
    """(fact, name): tagged rows of several sources; a source named in `optional` (fact, table, column) that the session doesn't
    have gives none."""
    out = [df.select(F.lit(fact).alias("fact"), name.cast("string").alias("name")) for fact, df, name in branches]
    out += [spark.table(table).select(F.lit(fact).alias("fact"), F.col(c).cast("string").alias("name")) for fact, table, c in optional if spark is not None and spark.catalog.tableExists(table)]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def history_tables(tables: DataFrame) -> DataFrame:
    """(history_key, key): the table of each history table; tables: object_id, history_id, key."""
    own = tables.select(F.col("object_id").alias("history_id"), F.col("key").alias("history_key"))
    return tables.where("history_id is not null").select("history_id", "key").join(own, "history_id").select("history_key", "key")


def single(rows: DataFrame, column: str) -> DataFrame:
    """The one value that a relation has to hold; none or several end the query."""
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.max(column).alias(column))
    return one.select(F.when(F.col("n") == 1, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("rows where one is due: "), F.col("n").cast("string"))).cast(rows.schema[column].dataType)).alias(column))


# ---- nested objects --------------------------------------------------------------------------------------------

def children(rows: DataFrame, parent: str, order: Sequence[str], name: str) -> DataFrame:
    """(parent, name): a parent's rows as an array of structs in order; of one object, so few."""
    return rows.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in (parent, *order)]))).alias(name))


def assembled(parents: DataFrame, key: str, parts: dict[str, DataFrame], rejects: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(models, unsupported): parents with each part's array, and those that a rule rejects as (key, reason), the first rule
    that fits.  parts: name -> (key, name); rejects: reason and condition over the assembled row."""
    whole = parents
    for name, df in parts.items():
        whole = whole.join(df, key, "left").withColumn(name, F.coalesce(name, F.array().cast(df.schema[name].dataType)))
    reason = F.lit(None).cast("string")
    for why, condition in reversed(list(rejects)):
        reason = F.when(condition, why).otherwise(reason)
    marked = whole.withColumn("_reason", reason)
    return marked.where("_reason is null").drop("_reason"), marked.where("_reason is not null").select(key, F.col("_reason").alias("reason"))


def column_rows(columns: DataFrame, types: DataFrame, defaults: DataFrame, computed: DataFrame, identity: DataFrame) -> DataFrame:
    """Columns with their type's text, default, expression and identity: inner on the type, left on the rest by
    (object_id, column_id)."""
    on = ["object_id", "column_id"]
    return (
        columns.join(types, "type_id").join(defaults, on, "left").join(computed, on, "left").join(identity, on, "left")
        .select("object_id", "column_id", "name", X.type_text(F.col("type_name"), F.col("max_length"), F.col("precision"), F.col("scale")).alias("type"), "nullable", "default", "expression", "seed"))


def index_rows(indexes: DataFrame, index_columns: DataFrame) -> DataFrame:
    """Indexes with their number of columns, their highest ordinal and their distinct pairs, which a reader checks: scalar
    subqueries as one aggregate that is joined."""
    facts = index_columns.groupBy("object_id", "index_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("last"), F.count_distinct(F.struct("column_id", "included")).alias("pairs"))
    return indexes.join(facts, ["object_id", "index_id"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "pairs": F.coalesce("pairs", F.lit(0))})


def foreign_key_rows(keys: DataFrame, key_columns: DataFrame, columns: DataFrame) -> DataFrame:
    """(fk, object_id, ref_id, columns, ref_columns): foreign keys with the names of their columns in order."""
    own = columns.select(F.col("object_id"), F.col("column_id"), F.col("name").alias("own_name"))
    ref = columns.select(F.col("object_id").alias("ref_id"), F.col("column_id").alias("ref_column_id"), F.col("name").alias("ref_name"))
    named = key_columns.join(keys.select("fk", "object_id", "ref_id"), "fk").join(own, ["object_id", "column_id"]).join(ref, ["ref_id", "ref_column_id"])
    lists = named.groupBy("fk", "object_id", "ref_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "own_name", "ref_name"))).alias("l"))
    return lists.select("fk", "object_id", "ref_id", F.transform("l", lambda x: x["own_name"]).alias("columns"), F.transform("l", lambda x: x["ref_name"]).alias("ref_columns"))


def name_collisions(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(name, n): names given more than once, or taken already; compared folded."""
    counted = names.groupBy(X.fold(F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    known = taken.select(X.fold(F.col("name")).alias("name"), F.lit(True).alias("t")).distinct()
    return counted.join(known, "name", "left").where("n > 1 or t").select("name", "n")


def present(wanted: DataFrame, live: DataFrame, recorded: DataFrame) -> DataFrame:
    """(name): wanted names that are live and not recorded: collisions of a plan with what it doesn't know."""
    fold = lambda df: df.select(X.fold(F.col("name")).alias("name")).distinct()
    return fold(wanted).join(fold(live), "name", "left_semi").join(fold(recorded), "name", "left_anti")


def declared_options(live: DataFrame, declared: DataFrame, defaults: DataFrame) -> DataFrame:
    """(object, option, value) of live options without those that only repeat the engine's default and that nobody declared.
    live, declared: object, option, value; defaults: option, default."""
    stated = declared.select("object", "option", F.lit(True).alias("stated")).distinct()
    return (
        live.join(defaults, "option", "left").join(stated, ["object", "option"], "left")
        .where("stated or default is null or value <> default").select("object", "option", "value"))


def with_defaults(captures: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Captures of an older form with the values that their missing columns stand for."""
    return captures.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in captures.columns else F.lit(v) for c, v in defaults.items()})


def blockers(column: DataFrame, **sources: DataFrame) -> DataFrame:
    """(kind, name): what stands in the way of a column: tagged rows of each source (object_id, column_id, name) that belong to
    an asked column (object_id, column_id)."""
    out = [df.join(column, ["object_id", "column_id"], "left_semi").select(F.lit(kind).alias("kind"), "name") for kind, df in sources.items()]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()
