"""Table maintenance as new versions of a table (M1-M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselens import fixed_values as fv


def seed_missing(rules: DataFrame, seeds: DataFrame, key: str = "category") -> DataFrame:
    """M1: adds the seeds whose category is not there yet."""
    return rules.unionByName(seeds.join(rules.select(key), key, "left_anti").select(*rules.columns))


def create_rules(rules: DataFrame, new: DataFrame, key: str = "category",
                 order: str = "rule_id") -> tuple[DataFrame, DataFrame]:
    """M2: (rules with the new ones, conflicts).

    A new rule conflicts when its category exists, or an earlier new rule has it.
    """
    first = new.groupBy(key).agg(F.min(order).alias("_first"))
    marked = new.join(first, key).join(
        rules.select(key).distinct().withColumn("_exists", F.lit(True)), key, "left")
    clash = F.col("_exists").isNotNull() | (F.col(order) != F.col("_first"))
    columns = new.columns
    return (
        rules.unionByName(marked.filter(~clash).select(*columns)),
        marked.filter(clash).select(*columns),
    )


def update_rules(rules: DataFrame, updates: DataFrame, key: str = "rule_id") -> DataFrame:
    """M3: changes only the supplied fields.

    ``updates`` has the key, any of the rule columns, and ``supplied``, the array
    of column names that count; a null is a value when its name is supplied.
    """
    fields = [c for c in updates.columns if c not in (key, "supplied")]
    given = updates.select(
        key, F.col("supplied").alias("_supplied"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = rules.join(given, key, "left")

    def value(c: str):
        if c not in fields:
            return F.col(c)
        changed = F.coalesce(F.array_contains("_supplied", c), F.lit(False))
        return F.when(changed, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in rules.columns])


def delete_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti").select(*df.columns)


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """M4: deletes the keys from every table, e.g. documents, chunks, reports, clauses."""
    return {name: delete_rows(df, ids, key) for name, df in tables.items()}


def update_users(users: DataFrame, updates: DataFrame, actor: str) -> DataFrame:
    """M5: ``updates`` (user_id, role, toggle_active), one row per user.

    Unknown roles are ignored, and the actor's own active flag never changes.
    """
    given = updates.select(
        "user_id", F.col("role").alias("_role"), F.col("toggle_active").alias("_toggle"))
    toggled = F.coalesce("_toggle", F.lit(False)) & (F.col("user_id") != actor)
    return (
        users.join(given, "user_id", "left")
        .withColumn("role", F.when(F.col("_role").isin("admin", "user"), F.col("_role"))
                    .otherwise(F.col("role")))
        .withColumn("is_active", F.when(toggled, ~F.col("is_active")).otherwise(F.col("is_active")))
        .select(*users.columns)
    )


def recover_stranded(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6: documents left in ``processing`` become failed; second: how many (one row)."""
    stuck = F.col("status") == "processing"
    recovered = docs.withColumn(
        "error_message", F.when(stuck, fv.STRANDED_MESSAGE).otherwise(F.col("error_message"))
    ).withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))
    return recovered, docs.agg(F.count_if(stuck).alias("recovered"))


def runnable(docs: DataFrame, force: bool = False) -> DataFrame:
    """M7: documents an analysis may start on."""
    return docs if force else docs.filter(F.col("status") != "processing")


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """M8: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
