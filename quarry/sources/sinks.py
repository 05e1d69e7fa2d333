"""Writing corpus tables, partitioned by repository, in ways that can be run again."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLUG = re.compile(r"^[A-Za-z0-9._-]+$")


def write_repository(df: DataFrame, folder: str, repo_slug: str) -> None:
    """Replace one repository's partition of a table."""
    if not SLUG.match(repo_slug) or repo_slug in (".", ".."):
        raise ValueError("not a valid slug")
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/repo_slug={repo_slug}")


def read_repository(spark: SparkSession, folder: str, repo_slug: str | None = None) -> DataFrame:
    """A table, of one repository only where named; then only its partition is listed and read."""
    df = spark.read.parquet(folder)
    return df if repo_slug is None else df.filter(df.repo_slug == repo_slug)


def delete_repository(spark: SparkSession, folder: str, repo_slug: str) -> bool:
    """Remove one repository's partition; whether there was one. The slug cannot lead out of the folder."""
    if not SLUG.match(repo_slug) or repo_slug in (".", ".."):
        raise ValueError("not a valid slug")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/repo_slug={repo_slug}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))


def replace_table(df: DataFrame, folder: str) -> None:
    """Write a table beside its old state and swap them, so that a plan may read what it replaces."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    staged, old = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + ".staged"), jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + ".old")
    df.write.mode("overwrite").parquet(staged.toString())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(staged, target)
    fs.delete(old, True)


def compact(spark: SparkSession, folder: str, files: int) -> None:
    """Rewrite a table into a number of files."""
    replace_table(spark.read.parquet(folder).repartition(files), folder)


def create_table(df: DataFrame, name: str, folder: str) -> None:
    """Write a table and enter it into the catalogue, in place of one of that name."""
    drop_tables(df.sparkSession, name)
    df.write.mode("overwrite").option("path", f"{folder.rstrip('/')}/{name}").saveAsTable(name)


def drop_tables(spark: SparkSession, *names: str) -> None:
    """Take tables out of the catalogue; those that are not there are no error. Names are plain words."""
    for name in names:
        if not re.fullmatch(r"\w+", name):
            raise ValueError("not a valid table name")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def reset_table(spark: SparkSession, name: str, folder: str) -> None:
    """Empty a table and keep its columns."""
    create_table(spark.createDataFrame([], spark.table(name).schema), name, folder)


def analyze(spark: SparkSession, name: str) -> DataFrame:
    """Compute the statistics that the optimizer uses; gives table, column, n_rows, n_distinct, n_nulls of each column.

    Of columns, those of arrays and structures have no statistics and are left out.
    """
    columns = [f.name for f in spark.table(name).schema.fields if f.dataType.typeName() not in ("array", "struct", "map", "variant")]
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {', '.join(f'`{c}`' for c in columns)}")
    size = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}.get("Statistics", "")
    n_rows = int(m.group(1)) if (m := re.search(r"(\d+) rows", size)) else None
    rows = []
    for c in columns:
        found = {r.info_name: r.info_value for r in spark.sql(f"DESCRIBE EXTENDED {name} `{c}`").collect()}
        rows.append((name, c, n_rows, *(int(found[k]) if (found.get(k) or "NULL") != "NULL" else None for k in ("distinct_count", "num_nulls"))))
    return spark.createDataFrame(rows, "table_name string, column_name string, n_rows bigint, n_distinct bigint, n_nulls bigint")


def replace_vectors(mirror: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("entity_type", "entity_id")) -> DataFrame:
    """The mirror with the rows' vectors in place of those with the same keys; pairs go by key, never by position. Of repeated keys the newest row counts, by ``updated_at`` where there is one."""
    newest = [F.desc_nulls_last("updated_at")] if "updated_at" in rows.columns else []
    w = Window.partitionBy(*keys).orderBy(*newest, F.hash(*rows.columns))
    new = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return mirror.join(new.select(*keys), list(keys), "left_anti").select(*mirror.columns).unionByName(new.select(*mirror.columns))
