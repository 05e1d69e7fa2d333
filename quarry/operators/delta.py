"""Differences between snapshots, and changes of tables that can be run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint, numbered

CODE_EXTENSIONS = ("js", "jsx", "ts", "tsx", "py")


#: Rows with one content beyond which they are numbered by ranges, not by one task; the numbers are the same.
MANY = 100_000


def _paired(rows: DataFrame) -> DataFrame:
    """The rows (path, h) with their number k within a content, in order of their paths."""
    most = rows.groupBy("h").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MANY:
        return numbered(rows, "h", "path")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("path")))


def file_changes(old: DataFrame, new: DataFrame, extensions: tuple[str, ...] | None = CODE_EXTENSIONS, min_similarity: float | None = None) -> DataFrame:
    """path, change (added, modified, deleted, renamed), old_path between two snapshots (path, content_hash and, for similarity, content).

    A path that vanished and one that appeared with the same content are a rename, paired in order of their paths; contents that occur
    n times on one side and m on the other give as many renames as the smaller number, and what is left over are copies, which count as
    added. With ``min_similarity``, what is still left is paired by ``similar_pairs``, so that a file moved and edited is a rename too.
    """
    kept = ["path", "content_hash", *(["content"] if min_similarity is not None else [])]
    before = old.select(*kept).withColumnRenamed("content_hash", "h0").dropDuplicates(["path"])
    after = new.select(*kept).withColumnRenamed("content_hash", "h1").dropDuplicates(["path"])
    both = before.select("path", "h0").withColumn("_o", F.lit(1)).join(after.select("path", "h1").withColumn("_n", F.lit(1)), "path", "full_outer")
    both = checkpoint(both.filter("_o IS NULL OR _n IS NULL OR NOT (h0 <=> h1)"))
    none = F.lit(None).cast("string").alias("old_path")
    modified = both.filter("_o = 1 AND _n = 1").select("path", F.lit("modified").alias("change"), none)
    gone = _paired(both.filter("_n IS NULL").select("path", F.col("h0").alias("h")))
    came = _paired(both.filter("_o IS NULL").select("path", F.col("h1").alias("h")))
    moved = came.join(gone.withColumnRenamed("path", "old_path"), ["h", "k"]).select("path", F.lit("renamed").alias("change"), "old_path")
    rest_new = came.select("path").join(moved.select("path"), "path", "left_anti")
    rest_old = gone.select("path").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    if min_similarity is not None:
        moved, rest_new, rest_old = checkpoint(moved), checkpoint(rest_new), checkpoint(rest_old)
        edited = similar_pairs(before.join(rest_old, "path", "left_semi"), after.join(rest_new, "path", "left_semi"), min_similarity)
        moved = moved.unionByName(edited.select("path", F.lit("renamed").alias("change"), "old_path"))
        rest_new = rest_new.join(edited.select("path"), "path", "left_anti")
        rest_old = rest_old.join(edited.select(F.col("old_path").alias("path")), "path", "left_anti")
    added = rest_new.select("path", F.lit("added").alias("change"), none)
    deleted = rest_old.select("path", F.lit("deleted").alias("change"), none)
    changes = modified.unionByName(moved).unionByName(added).unionByName(deleted)
    if extensions is not None:
        changes = changes.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    return changes


def similarities(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """old_path, path, similarity of the files (path, content) of both sides that are at least so similar.

    The similarity is the number of characters in lines that both have, each as often as in the one that has it less often, divided by the
    characters of the longer file. Files meet on lines that both have: on the rarest of each file, so many that two files of that
    similarity must share one (prefix filtering), so that common lines bring no pairs and none is lost.
    """

    def lines(df: DataFrame, side: int) -> DataFrame:
        line = df.select("path", F.explode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("line"))
        counted = line.groupBy("path", F.xxhash64("line").alias("line"), (F.length("line") + 1).alias("size")).agg(F.count("*").alias("times"))
        return counted.withColumn("side", F.lit(side))

    both = checkpoint(lines(old, 0).unionByName(lines(new, 1)))
    frequency = both.groupBy("line").agg(F.count("*").alias("files"))
    rare = Window.partitionBy("side", "path").orderBy("files", "line").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("size") * F.col("times")).over(Window.partitionBy("side", "path"))
    weighed = both.join(frequency, "line").withColumn("total", total).withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("times")).over(rare), F.lit(0)))
    prefix = checkpoint(weighed.filter(F.col("before") <= (1 - least) * F.col("total")).select("side", "path", "line", "total"))
    a = prefix.filter("side = 0").select(F.col("path").alias("old_path"), "line", F.col("total").alias("n0"))
    b = prefix.filter("side = 1").select("path", "line", F.col("total").alias("n1"))
    pairs = a.join(b, "line").filter(F.least("n0", "n1") >= least * F.greatest("n0", "n1")).select("old_path", "path", "n0", "n1").distinct()
    x = both.filter("side = 0").select(F.col("path").alias("old_path"), "line", "size", F.col("times").alias("t0"))
    y = both.filter("side = 1").select("path", "line", F.col("times").alias("t1"))
    shared = pairs.join(x, "old_path").join(y, ["path", "line"]).groupBy("old_path", "path", "n0", "n1").agg(F.sum(F.col("size") * F.least("t0", "t1")).alias("shared"))
    return shared.withColumn("similarity", F.col("shared") / F.greatest("n0", "n1")).filter(F.col("similarity") >= least).select("old_path", "path", "similarity")


def similar_pairs(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """old_path, path, similarity: each file of either side at most once, the most similar pairs first, ties by their paths.

    Taking the best pair of all again and again is the same as taking, round by round, all pairs that are the best of both their files.
    """
    rest = checkpoint(similarities(old, new, least))
    found: list[DataFrame] = []
    while not rest.isEmpty():
        rank = F.struct(-F.col("similarity"), F.col("old_path"), F.col("path"))
        best_old = rest.groupBy("old_path").agg(F.min(rank).alias("r0"))
        best_new = rest.groupBy("path").agg(F.min(rank).alias("r1"))
        mutual = rest.join(best_old, "old_path").join(best_new, "path").filter((F.col("r0") == rank) & (F.col("r1") == rank)).select("old_path", "path", "similarity")
        mutual = checkpoint(mutual)
        found.append(mutual)
        rest = checkpoint(rest.join(mutual.select("old_path"), "old_path", "left_anti").join(mutual.select("path"), "path", "left_anti"))
    if not found:
        return rest
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.unionByName(part)
    return pairs


def definition_changes(old: DataFrame, new: DataFrame, collapse: bool = False) -> DataFrame:
    """file, code_hash, occurrence, change (added, removed, unchanged) of two tables (file, code_hash, position).

    A multiset difference: the n-th definition of a file with a hash meets the n-th one of the other side. ``collapse``: equal hashes of a
    file count once. Null hashes never match.
    """
    order = Window.partitionBy("file", "code_hash").orderBy("position")

    def numbered(df: DataFrame) -> DataFrame:
        if collapse:
            return df.select("file", "code_hash").distinct().withColumn("occurrence", F.lit(1))
        return df.select("file", "code_hash", F.row_number().over(order).alias("occurrence"))

    a, b = numbered(old).withColumn("_o", F.lit(1)), numbered(new).withColumn("_n", F.lit(1))
    joined = a.join(b, ["file", "code_hash", "occurrence"], "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("unchanged")
    return joined.select("file", "code_hash", "occurrence", change.alias("change"))


def delta_rollup(changes: DataFrame, *keys: str) -> DataFrame:
    """Rows per key and kind of change."""
    return changes.groupBy(*keys, "change").agg(F.count("*").alias("n"))


def parse_mode(stored_commit: str | None, commit: str | None) -> str:
    """none for the same commit, full for an unknown one, else incremental."""
    if not stored_commit or not commit:
        return "full"
    return "none" if stored_commit == commit else "incremental"


def summary_mode(delta_is_empty: bool | None, forced: bool) -> str:
    """full if asked for or without a delta, none without changes, else incremental."""
    if forced or delta_is_empty is None:
        return "full"
    return "none" if delta_is_empty else "incremental"


def parse_modes(stored: Column, current: Column) -> Column:
    """``parse_mode`` for a table of repositories."""
    known = (F.coalesce(stored, F.lit("")) != "") & (F.coalesce(current, F.lit("")) != "")
    return F.when(~known, "full").when(stored == current, "none").otherwise("incremental")


def summary_modes(n_changes: Column, forced: Column) -> Column:
    """``summary_mode`` for a table of repositories; a null number of changes says that there is no delta."""
    return F.when(F.coalesce(forced, F.lit(False)) | n_changes.isNull(), "full").when(n_changes == 0, "none").otherwise("incremental")


def schedule(changed: DataFrame, closure: DataFrame, levelled: DataFrame) -> DataFrame:
    """node, phase (changed, ancestor), level: what has to be made again, the changed nodes first, then what depends on them, by level."""
    phases = closure.select("node").join(changed.select("node").distinct().withColumn("_c", F.lit(1)), "node", "left")
    return phases.join(levelled.select("node", "level"), "node").select("node", F.when(F.col("_c") == 1, "changed").otherwise("ancestor").alias("phase"), "level")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those rows whose key it does not have yet, one per key."""
    new = rows.dropDuplicates(keys).join(table.select(*keys).distinct(), keys, "left_anti")
    return table.unionByName(new.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """The table with the rows' values; what is in ``keep`` stays as it was for keys that existed. Null keys match each other."""
    old = table.select(*[F.col(c).alias(f"_old_{c}") for c in table.columns])
    new = rows.dropDuplicates(keys)
    condition = [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys]
    joined = new.withColumn("_new", F.lit(1)).join(old.withColumn("_had", F.lit(1)), condition, "full_outer")
    return joined.select(*[F.when(F.col("_new").isNull() | (F.col("_had").isNotNull() & F.lit(c in keep)), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in table.columns])


def delete_files(files: DataFrame, definitions: DataFrame, references: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files (path) that are gone: their definitions go too, references from these go, references to these lose their target."""
    kept_files = files.join(gone.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").select(*files.columns)
    lost = files.select("id").join(kept_files.select("id"), "id", "left_anti").select(F.col("id").alias("file_id"))
    kept_defs = definitions.join(lost, "file_id", "left_anti").select(*definitions.columns)
    alive = kept_defs.select(F.col("id").alias("_d")).distinct()
    kept_refs = references.join(alive, references["source_definition_id"] == alive["_d"], "left_semi")
    target = alive.select(F.col("_d").alias("_t"))
    nulled = kept_refs.join(target, kept_refs["target_definition_id"] == target["_t"], "left").withColumn("target_definition_id", F.col("_t")).select(*references.columns)
    return kept_files, kept_defs, nulled


def rename_files(files: DataFrame, renames: DataFrame) -> DataFrame:
    """The files with the new paths of renames (old_path, path)."""
    to = renames.filter("old_path IS NOT NULL").groupBy("old_path").agg(F.max("path").alias("_new"))
    return files.join(to, files["file_path"] == to["old_path"], "left").withColumn("file_path", F.coalesce("_new", "file_path")).select(*files.columns)
