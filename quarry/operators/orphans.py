"""References to records that do not exist (problem 1).

Parent and child keys are brought into one long form, tagged with the table they belong to, and grouped by table and key; a group
without a parent flag, or whose parent came later than its first child, is suspect. Only the suspect keys, one row each, go back
to the references, so neither the parents nor the healthy references are joined. Hot keys: the grouping combines on the map side
and keeps four scalars per key; the join back is salted.

Nulls: a reference without a key is ``unset`` if its resolution type demands one, else it is no reference. A child or parent
without a time cannot be late. Repeated rows count once. Columns beyond those named are ignored; empty tables give no rows
(no parents: every reference is missing).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import normalize_path

#: Resolution types under which a reference field has to be filled. Fixed values.
DEMANDED = {"resolved_file_path": ("relative", "alias"), "target_package_id": ("package",)}
PARENT = {"resolved_file_path": "files", "target_package_id": "packages"}


def references(imports: DataFrame) -> DataFrame:
    """imports in long form: one row per import and reference field, external imports left out."""
    inner = imports.filter(~F.coalesce(F.col("is_external"), F.lit(False)))
    kind = F.lower(F.trim("resolution_type"))
    raw_path = F.when(F.trim("resolved_file_path") != "", F.col("resolved_file_path"))
    fields = [
        F.struct(
            F.lit(field).alias("ref_field"),
            F.lit(PARENT[field]).alias("parent_table"),
            key.alias("key"),
            F.coalesce(kind.isin(*DEMANDED[field]), F.lit(False)).alias("demanded"),
        )
        for field, key in (("resolved_file_path", normalize_path(raw_path)), ("target_package_id", F.col("target_package_id").cast("string")))
    ]
    return inner.select(F.col("id").alias("import_id"), F.col("created_at").alias("child_at"), F.explode(F.array(*fields)).alias("r")).select("import_id", "child_at", "r.*").filter(F.col("key").isNotNull() | F.col("demanded"))


def parent_keys(files: DataFrame, packages: DataFrame, file_delta: DataFrame) -> DataFrame:
    """The keys that exist, with their time, and those known to be deleted, in the same long form."""
    none = F.lit(None).cast("timestamp")
    gone = F.when(F.col("change") == "deleted", F.col("path")).when(F.col("change") == "renamed", F.col("old_path"))
    parts = [
        files.select(F.lit("files").alias("parent_table"), normalize_path(F.col("file_path")).alias("key"), F.col("created_at").cast("timestamp").alias("parent_at"), F.lit(True).alias("exists"), F.lit(False).alias("deleted")),
        packages.select(F.lit("packages"), F.col("id").cast("string"), F.col("created_at").cast("timestamp"), F.lit(True), F.lit(False)),
        file_delta.select(F.lit("files"), normalize_path(gone), none, F.lit(False), F.lit(True)),
    ]
    return reduce(DataFrame.union, parts).filter(F.col("key").isNotNull())


def suspect_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """One row per referenced key without a parent, or with one that came after its first child."""
    child = refs.filter(F.col("key").isNotNull()).select("parent_table", "key", F.lit(None).cast("timestamp").alias("parent_at"), F.lit(False).alias("exists"), F.lit(False).alias("deleted"), F.col("child_at").cast("timestamp").alias("child_at"), F.lit(True).alias("child"))
    both = child.unionByName(parents.select("*", F.lit(None).cast("timestamp").alias("child_at"), F.lit(False).alias("child")))
    groups = both.groupBy("parent_table", "key").agg(F.max("exists").alias("exists"), F.min("parent_at").alias("parent_at"), F.max("deleted").alias("deleted"), F.min("child_at").alias("first_child"), F.max("child").alias("child"))
    return groups.filter(F.col("child") & (~F.col("exists") | (F.col("parent_at") > F.col("first_child")))).select("parent_table", "key", "exists", "parent_at", "deleted")


def orphans(imports: DataFrame, files: DataFrame, packages: DataFrame, file_delta: DataFrame, salts: int = 8) -> DataFrame:
    """import_id, ref_field, state (missing, deleted, late, unset), parent_table, key, child_at: one row per orphan reference."""
    refs = references(imports)
    suspects = suspect_keys(refs, parent_keys(files, packages, file_delta)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = refs.filter(F.col("key").isNotNull()).withColumn("salt", F.pmod(F.hash("import_id"), F.lit(salts)))
    late = F.col("exists") & (F.col("parent_at") > F.col("child_at"))
    state = F.when(~F.col("exists"), F.when(F.col("deleted"), "deleted").otherwise("missing")).when(late, "late")
    cols = ["import_id", "ref_field", "state", "parent_table", "key", "child_at"]
    joined = keyed.join(suspects, ["parent_table", "key", "salt"]).withColumn("state", state).filter(F.col("state").isNotNull()).select(cols)
    unset = refs.filter(F.col("key").isNull()).withColumn("state", F.lit("unset")).select(cols)
    return joined.unionByName(unset).distinct()


def orphans_by_period(found: DataFrame) -> DataFrame:
    """Counts per referenced table, state and month of the reference."""
    month = F.date_format(F.date_trunc("month", "child_at"), "yyyy-MM")
    return found.groupBy("parent_table", "ref_field", "state", month.alias("month")).agg(F.count("*").alias("n_references"), F.countDistinct("key").alias("n_keys"))
