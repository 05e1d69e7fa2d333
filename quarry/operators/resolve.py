"""From occurrences of symbols, and from imports, to references between definitions and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.paths import ancestors, normalize_path

DEFINITION_ROLE = 1
#: Lines of a file that meet in one key of an interval join.
BUCKET = 256


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def symbol_names(symbols: DataFrame) -> DataFrame:
    """symbol, display_name: the first name that a document in order gives (symbol, display_name, doc_order, pos)."""
    return symbols.filter("display_name IS NOT NULL").groupBy("symbol").agg(F.min_by("display_name", F.struct("doc_order", "pos")).alias("display_name"))


def symbol_definitions(occurrences: DataFrame, symbols: DataFrame, last_document: bool = False) -> DataFrame:
    """symbol, file, line: where each symbol is defined.

    occurrences: file, symbol, role_bits, start_line, doc_order, pos. An occurrence in a document that declares the symbol counts more
    than one elsewhere; then the earliest document and place win. ``last_document``: a later document always wins.
    """
    defs = occurrences.filter((F.col("role_bits").bitwiseAND(DEFINITION_ROLE) != 0) & ~F.col("symbol").startswith("local "))
    declared = symbols.select("file", "symbol").distinct().withColumn("declares", F.lit(1))
    scored = defs.join(declared, ["file", "symbol"], "left").withColumn("score", F.coalesce("declares", F.lit(0)))
    rank = F.struct(-F.col("doc_order"), F.col("pos")) if last_document else F.struct(-F.col("score"), F.col("doc_order"), F.col("pos"))
    best = scored.groupBy("symbol").agg(F.min_by(F.struct("file", "start_line"), rank).alias("at"))
    return best.select("symbol", F.col("at.file").alias("file"), F.col("at.start_line").alias("line"))


def occurrence_targets(occurrences: DataFrame, definitions_of: DataFrame) -> DataFrame:
    """Each occurrence with the file and line of its symbol's definition; null where the symbol is external."""
    target = definitions_of.select("symbol", F.col("file").alias("target_file"), F.col("line").alias("target_line"))
    return occurrences.filter(~F.col("symbol").startswith("local ")).join(target, "symbol", "left").withColumn("is_external", F.col("target_file").isNull()).withColumn("is_outgoing", F.coalesce(F.col("target_file") != F.col("file"), F.lit(False)))


def file_symbol_edges(targeted: DataFrame) -> DataFrame:
    """from_file, to_file, symbol: one row per occurrence that points into another file."""
    return targeted.filter("is_outgoing").select(F.col("file").alias("from_file"), F.col("target_file").alias("to_file"), "symbol")


def containing(points: DataFrame, ranges: DataFrame, line: Column, innermost: bool | None = None) -> DataFrame:
    """Points joined to the ranges of the same file that contain them.

    Points meet ranges on the file and on a bucket of ``BUCKET`` lines, so that a file with very many ranges is no single key, and a point
    meets only the ranges near it. points: file and what ``line`` reads; ranges: file, definition_id, start_line, end_line. All ranges that contain a point match; with
    ``innermost`` only one per point (point_id): the smallest span, or for False the lowest id.
    """
    spans = ranges.filter("start_line <= end_line").select("file", "definition_id", F.col("start_line").alias("_from"), F.col("end_line").alias("_to"))
    bucket = lambda c: F.floor(c / F.lit(BUCKET)).cast("int")
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to")))))
    near = points.withColumn("_line", line).withColumn("_bucket", bucket(F.col("_line")))
    hit = near.join(spans, ["file", "_bucket"]).filter(F.col("_line").between(F.col("_from"), F.col("_to"))).drop("_bucket")
    if innermost is not None:
        order = [F.col("_to") - F.col("_from"), F.col("definition_id")] if innermost else [F.col("definition_id")]
        hit = first_by(hit, ["point_id"], *order)
    return hit.drop("_line", "_from", "_to")


def references(targeted: DataFrame, ranges: DataFrame, line_base: str = "correct", include_intra_file: bool = False, innermost: bool = False) -> DataFrame:
    """source_definition_id, target_definition_id, once per pair.

    targeted: occurrence_targets with point_id and start_line from 0. Every definition around an occurrence refers to the definition at the
    target's line. ``line_base`` "reference" compares the 0-based line of the occurrence as it is.
    """
    kept = targeted.filter(~F.col("is_external") & (F.lit(include_intra_file) | F.col("is_outgoing")))
    shift = 0 if line_base == "reference" else 1
    around = containing(kept, ranges, F.col("start_line_0") + shift).select("point_id", F.col("definition_id").alias("source_definition_id"), "target_file", "target_line", F.col("file").alias("source_file"))
    aim = kept.select("point_id", F.col("target_file").alias("file"), F.col("target_line").alias("aim_line"))
    target = containing(aim, ranges, F.col("aim_line") + 1, innermost).select("point_id", F.col("definition_id").alias("target_definition_id"))
    return around.join(target, "point_id").filter("source_definition_id <> target_definition_id").select("source_definition_id", "target_definition_id").distinct()


def unique_symbol_definitions(definitions: DataFrame, symbol_lines: DataFrame) -> DataFrame:
    """definition_id, symbol: definitions that start on a line with exactly one symbol (lines from 0 in symbol_lines)."""
    single = symbol_lines.groupBy("file", "line").agg(F.countDistinct("symbol").alias("n"), F.min("symbol").alias("symbol")).filter("n = 1")
    return definitions.join(single, (definitions["file"] == single["file"]) & (definitions["start_line"] - 1 == single["line"])).select("definition_id", "symbol")


def longest_prefix(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """path, owner_id: the owner with the longest directory prefix of a path, at separator boundaries; the root owner ('' or '.') owns the rest.

    paths: path; owners: owner_id, dir. Paths meet owners on equal ancestors, so there is no comparison of every path with every owner.
    """
    directories = owners.select("owner_id", F.when(F.col("dir").isin(".", "/"), F.lit("")).otherwise(normalize_path(F.col("dir"))).alias("dir"))
    above = paths.select("path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("dir"))
    hit = above.join(directories, "dir").groupBy("path").agg(F.max_by("owner_id", F.struct(F.length("dir"), -F.col("owner_id"))).alias("owner_id"))
    return paths.select("path").distinct().join(hit, "path", "left")


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: the files between which an internal import leads, once per pair and without self-loops."""
    target = files.select(F.col("id").alias("dst"), F.col("file_path").alias("key")).dropDuplicates(["dst"])
    inner = imports.filter(~F.coalesce(F.col("is_external"), F.lit(False)) & F.col("resolved_file_path").isNotNull())
    return inner.select(F.col("file_id").alias("src"), normalize_path(F.col("resolved_file_path")).alias("key")).join(target, "key").filter("src <> dst").select("src", "dst").distinct()


def import_references(imports: DataFrame, files: DataFrame, definitions: DataFrame) -> DataFrame:
    """source_definition_id, target_definition_id: a definition refers to one of another file if it names what its file imports from there.

    The joins are on ids and on file and name; which words a definition names is looked up among its own words, not by a search per pair.
    """
    target = files.select(F.col("id").alias("target_file"), F.col("file_path").alias("key")).dropDuplicates(["target_file"])
    inner = imports.filter(~F.coalesce(F.col("is_external"), F.lit(False)) & F.col("resolved_file_path").isNotNull() & F.col("specifier").isNotNull())
    named = inner.select("file_id", "specifier", normalize_path(F.col("resolved_file_path")).alias("key")).join(target, "key").filter("file_id <> target_file").select("file_id", "specifier", "target_file").distinct()
    defs = definitions.select(F.col("id").alias("target_definition_id"), F.col("file_id").alias("target_file"), F.col("name").alias("specifier")).distinct()
    aimed = named.join(defs, ["target_file", "specifier"]).select("file_id", "specifier", "target_definition_id")
    words = definitions.select(F.col("id").alias("source_definition_id"), "file_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("source_code", F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("specifier"))
    return words.join(aimed, ["file_id", "specifier"]).select("source_definition_id", "target_definition_id").distinct()


def file_edges(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """src, dst of files from edges (src, dst) of definitions: projected, without self-loops, once per pair."""
    home = definitions.select(F.col("id").alias("d"), F.col("file_id").alias("f")).distinct()
    a = edges.join(home.select(F.col("d").alias("src"), F.col("f").alias("f1")), "src")
    both = a.join(home.select(F.col("d").alias("dst"), F.col("f").alias("f2")), "dst")
    return both.filter("f1 <> f2").select(F.col("f1").alias("src"), F.col("f2").alias("dst")).distinct()
