"""Reading the files of a working tree, and the catalogue of what is loaded."""

from __future__ import annotations

import os
import re
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import ancestors, basename
from quarry.functions.text import glob_regex

#: Patterns of what is never read; fixed values.
DEFAULT_IGNORE = ("node_modules", "__pycache__", ".git", "dist", "build", "venv", ".venv", "*.pyc", "*.min.js", "*.lock")


def restricted(root: str) -> bool:
    """The root of the file system and home directories are not read."""
    path = os.path.realpath(_local(root))
    return path in ("/", os.path.realpath(os.path.expanduser("~")))


def ignored(path: Column, patterns: tuple[str, ...], gitignore: tuple[str, ...] = ()) -> Column:
    """Whether a relative path is left out: by a pattern on the whole path or any part of it, or a line of the root's ignore file on the path or the name."""
    def part_matches(regex: str):
        return lambda part: part.rlike(regex)

    found = F.lit(False)
    for p in patterns:
        regex = glob_regex(p)
        found = found | path.rlike(regex) | F.exists(F.split(path, "/"), part_matches(regex))
    for line in gitignore:
        rule = line.strip()
        if rule and not rule.startswith("#"):
            found = found | path.rlike(glob_regex(rule)) | basename(path).rlike(glob_regex(rule))
    return found


def _local(root: str) -> str:
    """A local root without its scheme; the address of another file system as it is."""
    return re.sub("^file:/*", "/", root)


def read_tree(spark: SparkSession, root: str, recursive: bool = True, ignore: tuple[str, ...] = DEFAULT_IGNORE, gitignore: tuple[str, ...] = (), directories: bool = False) -> DataFrame:
    """path, content, valid: the files below a root, decoded as UTF-8. A file with other bytes keeps a null content and is marked; files without a byte are not listed.

    ``directories``: the directories above the files are listed too, with a slash at their end and without a content. Links to directories
    are read as such; a local root with a link that leads back above itself is refused, as its listing would not end.
    """
    root = _local(root)
    if restricted(root):
        return spark.createDataFrame([], "path string, content string, valid boolean")
    if recursive and (loop := link_loop(root)):
        raise ValueError(f"{loop} leads back to a directory above it")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = (root if "://" in root else PurePosixPath(os.path.realpath(root)).as_posix()).rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), r"^file:/*", "/").substr(F.lit(len(base) + 1), F.lit(1 << 20))
    rows = raw.select(relative.alias("path"), "content")
    hidden = () if PurePosixPath(root).name.startswith(".") else (".*",)
    if recursive:
        rows = rows.filter(~ignored(F.col("path"), (*ignore, *hidden), gitignore))
    text = F.expr("try_validate_utf8(cast(content AS string))")
    files = rows.select("path", text.alias("content"), text.isNotNull().alias("valid"))
    if not directories:
        return files
    above = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return files.unionByName(above.select(F.concat("path", F.lit("/")).alias("path"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("valid")))


def link_loop(root: str) -> str | None:
    """A link below a local root to a directory above itself, if there is one."""
    if not os.path.isdir(root):
        return None
    for folder, names, _ in os.walk(root):
        here = os.path.realpath(folder)
        for name in names:
            path = os.path.join(folder, name)
            if os.path.islink(path) and (here + "/").startswith(os.path.realpath(path).rstrip("/") + "/"):
                return path
    return None


def write_tree(spark: SparkSession, root: str, files: dict[str, bytes]) -> None:
    """Write a few files below a root, in whatever file system it lies: fixtures, notes and configuration, not tables."""
    jvm = spark.sparkContext._jvm
    for path, content in files.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(content))
        out.close()


def languages_of(files: DataFrame, names: dict[str, str], skipped: tuple[str, ...] = ("node_modules", "vendor", "dist", "build")) -> DataFrame:
    """language, n_files of a tree (path) outside of vendored directories."""
    inside = F.exists(F.split("path", "/"), lambda p: p.isin(*skipped))
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return files.filter(~inside).select(F.try_element_at(table, extension).alias("language")).filter("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n_files"))


def concat_indexes(indexes: list[DataFrame]) -> DataFrame:
    """The occurrences of several indexes under one another, with doc_order going on from index to index."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("index_no", F.lit(i)) for i, df in enumerate(indexes)])


def tables(spark: SparkSession) -> DataFrame:
    """The tables and views of the session."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, kind string, temporary boolean")


def table_info(spark: SparkSession, name: str) -> DataFrame:
    """The columns of a table in order."""
    rows = [(i, c.name, c.dataType, c.nullable) for i, c in enumerate(spark.catalog.listColumns(name))]
    return spark.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def raw_sql(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """A statement with named parameters, which are never pasted into its text."""
    return spark.sql(text, args=parameters or None)
