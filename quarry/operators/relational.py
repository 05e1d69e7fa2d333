"""Lookups with nested results, aggregates and top-k reports over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import expected_summary_tokens, input_tokens

#: What the columns of kinds may hold; fixed values.
ENUMS = {
    "import_type": ("default", "named", "namespace", "side-effect", "re-export"),
    "resolution_type": ("package", "alias", "relative", "external", "unknown"),
    "definition_type": ("function", "method", "class", "interface", "type_alias", "enum", "module", "constant", "variable"),
    "entity_type": ("file", "definition"),
}


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither null nor empty."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    return df


def invalid_kinds(df: DataFrame, column: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Rows whose kind is set but not allowed."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*(allowed or ENUMS[column])))


def any_contains(columns: list[str], needle: str) -> Column:
    """Whether one of several nullable columns contains a text, regardless of case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return found


def first_match(df: DataFrame, condition: Column, *order: str) -> DataFrame:
    """The first row that meets a condition; an error where there is none."""
    row = df.filter(condition).orderBy(*order).limit(1)
    if row.isEmpty():
        raise LookupError("no row meets the condition")
    return row


def page(df: DataFrame, *order: Column | str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of a total order."""
    ordered = df.orderBy(*order)
    ordered = ordered.offset(offset) if offset else ordered
    return ordered.limit(limit) if limit is not None else ordered


def file_details(files: DataFrame, definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """id, file_path, language, definitions, dependencies, dependents: files with their definitions in order and the neighbouring files of both directions."""
    f = files.select("id", "file_path", "language").dropDuplicates(["id"])
    defs = definitions.select("id", "file_id", "name", "definition_type", "start_line").dropDuplicates(["id"])
    nested = defs.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", F.col("id").alias("definition_id"), "name", "definition_type"))).alias("definitions"))
    paths = f.select(F.col("id").alias("other"), F.col("file_path").alias("path"))
    out = edges.join(paths.withColumnRenamed("other", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("path")).alias("dependencies"))
    into = edges.join(paths.withColumnRenamed("other", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("path")).alias("dependents"))
    none = F.array().cast("array<string>")
    joined = f.join(nested.withColumnRenamed("file_id", "id"), "id", "left").join(out, "id", "left").join(into, "id", "left")
    return joined.withColumn("definitions", F.coalesce("definitions", F.filter(F.array(F.struct(F.lit(0).alias("start_line"), F.lit(0).cast("bigint").alias("definition_id"), F.lit("").alias("name"), F.lit("").alias("definition_type"))), lambda x: F.lit(False)))).withColumn("dependencies", F.coalesce("dependencies", none)).withColumn("dependents", F.coalesce("dependents", none))


def definition_details(definitions: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, file_path, dependencies, dependents: definitions with the names they refer to and those that refer to them."""
    d = definitions.select("id", "name", "file_id").dropDuplicates(["id"])
    home = files.select(F.col("id").alias("file_id"), "file_path").dropDuplicates(["file_id"])
    names = d.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    out = edges.join(names.withColumnRenamed("other", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("other_name")).alias("dependencies"))
    into = edges.join(names.withColumnRenamed("other", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("other_name")).alias("dependents"))
    none = F.array().cast("array<string>")
    return d.join(home, "file_id", "left").join(out, "id", "left").join(into, "id", "left").select("id", "name", "file_path", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents"))


def summary_statistics(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """Rows and summaries of both tables in one row."""
    f = files.select("id", "ai_summary").dropDuplicates(["id"]).agg(F.count("*").alias("files"), F.count_if(F.coalesce("ai_summary", F.lit("")) != "").alias("files_with_summary"))
    d = definitions.select("id", "ai_summary").dropDuplicates(["id"]).agg(F.count("*").alias("definitions"), F.count_if(F.coalesce("ai_summary", F.lit("")) != "").alias("definitions_with_summary"))
    return f.crossJoin(F.broadcast(d))


def embedding_statistics(embeddings: DataFrame, type_column: str = "entity_type") -> DataFrame:
    """Total, files and definitions among embeddings, in one pass."""
    return embeddings.agg(F.count("*").alias("total"), F.count_if(F.col(type_column) == "file").alias("files"), F.count_if(F.col(type_column) == "definition").alias("definitions"))


def token_budget(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """file_id, n_definitions, input_tokens, output_tokens: the estimated tokens of summarising each file from its content and its definitions' summaries."""
    n = definitions.select("id", "file_id").dropDuplicates(["id"]).groupBy("file_id").agg(F.count("*").alias("n_definitions"))
    f = files.select(F.col("id").alias("file_id"), "file_content").dropDuplicates(["file_id"])
    joined = f.join(n, "file_id", "left").withColumn("n_definitions", F.coalesce("n_definitions", F.lit(0)))
    return joined.select("file_id", "n_definitions", input_tokens(F.coalesce("file_content", F.lit("")), F.col("n_definitions")).alias("input_tokens"), expected_summary_tokens(F.lit("file")).alias("output_tokens"))


def level_totals(levelled: DataFrame, costs: DataFrame) -> DataFrame:
    """Per level: nodes, components, tokens and the largest item."""
    return levelled.join(costs, "node").groupBy("level").agg(F.count("*").alias("n_nodes"), F.countDistinct("component").alias("n_components"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))


def workspace_root(packages: DataFrame) -> DataFrame:
    """repository_id, package_id: the package that declares workspaces, else the shallowest path; ties by path and id."""
    depth = F.when(F.col("path").isin(".", "", "/"), 0).otherwise(F.size(F.split("path", "/")))
    key = F.struct((~F.coalesce(F.col("is_workspace_root"), F.lit(False))).alias("a"), depth.alias("b"), F.col("path").alias("c"), F.col("id").alias("d"))
    return packages.groupBy("repository_id").agg(F.min_by("id", key).alias("package_id"))


def integer_average(total: Column, n: Column) -> Column:
    """The integer quotient, 0 where there is nothing to divide by."""
    return F.coalesce(F.floor(F.try_divide(total, n)), F.lit(0)).cast("long")


def top_consumers(costs: DataFrame, k: int = 10, tokens: str = "tokens") -> DataFrame:
    """The k rows with the most tokens (node, tokens), ties by node, with their share of all."""
    total = costs.agg(F.sum(tokens).alias("_total"))
    best = costs.orderBy(F.desc(tokens), "node").limit(k)
    return best.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide(F.col(tokens), F.col("_total"))).drop("_total")


def level_maxima(levelled: DataFrame, costs: DataFrame) -> DataFrame:
    """Per level: the largest item and its tokens, ties by node."""
    return levelled.join(costs, "node").groupBy("level").agg(F.max_by("node", F.struct("tokens", -F.col("node"))).alias("node"), F.max("tokens").alias("tokens"))


def file_references(definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """definition_id, direction (refers to, referred by), other_id, other_name, other_file_id: the references of definitions in long form, both ways.

    The form for whole tables: a name that very many refer to is many rows, not one array.
    """
    d = definitions.select("id", "name", "file_id").dropDuplicates(["id"])
    other = d.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("file_id").alias("other_file_id"))
    pairs = edges.select(F.col("src").alias("definition_id"), F.lit("refers to").alias("direction"), F.col("dst").alias("other_id")).unionByName(edges.select(F.col("dst").alias("definition_id"), F.lit("referred by").alias("direction"), F.col("src").alias("other_id")))
    return pairs.join(other, "other_id").select("definition_id", "direction", "other_id", "other_name", "other_file_id").distinct()


def files_with_references(wanted: DataFrame, files: DataFrame, definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """id, file_path, definitions: the wanted files (id) with their definitions in order, and in each the names it refers to and is referred by.

    Only the rows of the wanted files are nested, so the arrays are those of files that someone asked for.
    """
    ids = wanted.select(F.col("id").alias("file_id")).distinct()
    d = definitions.select(F.col("id").alias("definition_id"), "file_id", "name", "definition_type", "start_line").dropDuplicates(["definition_id"]).join(ids, "file_id", "left_semi")
    refs = file_references(definitions, edges).join(d.select("definition_id"), "definition_id", "left_semi")
    names = refs.groupBy("definition_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("direction") == way, F.col("other_name")))).alias(c) for way, c in (("refers to", "refers_to"), ("referred by", "referred_by"))])
    none = F.array().cast("array<string>")
    full = d.join(names, "definition_id", "left").select("file_id", F.struct("start_line", "definition_id", "name", "definition_type", F.coalesce("refers_to", none).alias("refers_to"), F.coalesce("referred_by", none).alias("referred_by")).alias("d"))
    nested = full.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list("d")).alias("definitions"))
    return files.select("id", "file_path").dropDuplicates(["id"]).join(ids.withColumnRenamed("file_id", "id"), "id", "left_semi").join(nested, "id", "left")
