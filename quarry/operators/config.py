"""Packages, workspaces and compiler configurations of monorepos."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import ancestors, basename, dirname, normalize_path
from quarry.functions.text import glob_regex
from quarry.session import checkpoint

PACKAGE_SCHEMA = "name string, main string, exports string, workspaces string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>"
TSCONFIG_SCHEMA = "extends string, compilerOptions struct<baseUrl:string, paths:map<string,array<string>>, outDir:string, rootDir:string, composite:boolean>, references array<struct<path:string>>"
#: Marker files of workspaces, strongest first, and entry points, first choice first; fixed values.
WORKSPACE_MARKERS = ("pnpm-workspace.yaml", "turbo.json", "lerna.json", "rush.json")
WORKSPACE_TYPES = {"pnpm-workspace.yaml": "pnpm", "turbo.json": "turbo", "lerna.json": "lerna", "rush.json": "rush"}
ENTRY_POINTS = ("index.ts", "index.tsx", "src/index.ts", "src/index.tsx", "index.js", "index.jsx")
SKIPPED_DIRS = ("node_modules", "dist", "build", "coverage", "out", "vendor")


def named_files(files: DataFrame, pattern: str) -> DataFrame:
    """The files (path, content) whose name matches a glob, outside skipped and hidden directories."""
    inside = F.exists(F.split(dirname(F.col("path")), "/"), lambda p: p.isin(*SKIPPED_DIRS) | p.startswith("."))
    return files.filter(basename(F.col("path")).rlike(glob_regex(pattern)) & ~inside)


def strip_json_comments(text: Column) -> Column:
    """Comments outside of strings removed, and commas before a closing bracket."""
    bare = F.regexp_replace(text, r"(\"(?:[^\"\\]|\\.)*\")|//[^\n\r]*|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(bare, r"(\"(?:[^\"\\]|\\.)*\")|,(?=\s*[}\]])", "$1")


def parse_packages(files: DataFrame) -> DataFrame:
    """path, dir, name, main, exports, workspaces (globs), dependencies (names of all four maps) of package.json files; broken ones are left out."""
    p = named_files(files, "package.json").filter(F.try_parse_json("content").isNotNull()).withColumn("j", F.from_json("content", PACKAGE_SCHEMA))
    maps = [F.coalesce(F.map_keys(f"j.{m}"), F.array().cast("array<string>")) for m in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    workspaces = F.coalesce(F.from_json("j.workspaces", "array<string>"), F.from_json(F.get_json_object("j.workspaces", "$.packages"), "array<string>"), F.array().cast("array<string>"))
    return p.select("path", dirname(F.col("path")).alias("dir"), F.col("j.name").alias("name"), F.col("j.main").alias("main"), F.col("j.exports").alias("exports"), workspaces.alias("workspaces"), F.array_sort(reduce(F.array_union, maps)).alias("dependencies"))


def parse_tsconfigs(files: DataFrame) -> DataFrame:
    """path, dir, extends, base_url, paths, options (each as JSON text), references of tsconfig*.json files, comments allowed."""
    bare = strip_json_comments(F.col("content"))
    t = named_files(files, "tsconfig*.json").filter(F.try_parse_json(bare).isNotNull()).withColumn("j", F.from_json(bare, TSCONFIG_SCHEMA))
    return t.select("path", dirname(F.col("path")).alias("dir"), F.col("j.extends").alias("extends"), F.col("j.compilerOptions.baseUrl").alias("base_url"), F.col("j.compilerOptions.paths").alias("paths"), F.from_json(F.get_json_object(bare, "$.compilerOptions"), "map<string,string>").alias("options"), F.transform(F.coalesce("j.references", F.array().cast("array<struct<path:string>>")), lambda r: r["path"]).alias("references"))


def workspace_type(files: DataFrame, packages: DataFrame) -> DataFrame:
    """root, type: by the strongest marker file next to a root, else by package.json workspaces (yarn with a yarn.lock, npm without), else none.

    files: root, path; packages: root, dir, workspaces.
    """
    at_root = files.filter(~F.col("path").contains("/")).select("root", "path")
    rank = reduce(lambda acc, im: acc.when(F.col("path") == im[1], F.struct(F.lit(im[0]).alias("r"), F.lit(WORKSPACE_TYPES[im[1]]).alias("t"))), enumerate(WORKSPACE_MARKERS), F)
    marked = at_root.select("root", rank.alias("m")).filter("m IS NOT NULL").groupBy("root").agg(F.min("m").alias("m"))
    yarn = at_root.filter("path = 'yarn.lock'").select("root", F.lit(True).alias("yarn")).distinct()
    declares = packages.filter((F.col("dir") == "") & (F.size("workspaces") > 0)).select("root", F.lit(True).alias("ws")).distinct()
    roots = files.select("root").distinct().join(marked, "root", "left").join(declares, "root", "left").join(yarn, "root", "left")
    by_package = F.when(F.col("ws"), F.when(F.col("yarn"), "yarn").otherwise("npm")).otherwise("none")
    return roots.select("root", F.coalesce("m.t", by_package).alias("type"))


def entry_points(packages: DataFrame, files: DataFrame) -> DataFrame:
    """path, entry_point: exports["."], as text or under import, require or default, then main, then the first usual file that exists.

    packages as from parse_packages; files: path.
    """
    dot = F.coalesce(F.get_json_object("exports", "$['.']"), F.when(~F.coalesce("exports", F.lit("{")).startswith("{"), F.col("exports")))
    exported = F.coalesce(*[F.get_json_object(dot, f"$.{k}") for k in ("import", "require", "default")], F.when(~F.coalesce(dot, F.lit("{")).startswith("{"), dot))
    choices = F.posexplode(F.array(*[F.lit(e) for e in ENTRY_POINTS]))
    usual = packages.select("path", "dir", choices.alias("rank", "choice")).withColumn("file", F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "choice"))
    existing = usual.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").groupBy("path").agg(F.min_by("choice", "rank").alias("usual"))
    return packages.join(existing, "path", "left").select("path", F.coalesce(exported, "main", "usual").alias("entry_point"))


def internal_dependencies(packages: DataFrame) -> DataFrame:
    """src, dst: dependencies of a package on another one of the same root (root, name, dependencies)."""
    wanted = packages.select("root", F.col("name").alias("src"), F.explode("dependencies").alias("dst"))
    return wanted.join(packages.select("root", F.col("name").alias("dst")).distinct(), ["root", "dst"], "left_semi").filter("src <> dst").select("root", "src", "dst").distinct()


def monorepo_class(packages: DataFrame) -> DataFrame:
    """root, class: single_package with at most one package below the root, package_based_monorepo where one depends on another, else direct_import_monorepo."""
    inner = packages.filter("dir <> ''").groupBy("root").agg(F.count("*").alias("n"))
    linked = internal_dependencies(packages).select("root").distinct().withColumn("linked", F.lit(True))
    roots = packages.select("root").distinct().join(inner, "root", "left").join(linked, "root", "left")
    return roots.select("root", F.when(F.coalesce("n", F.lit(0)) <= 1, "single_package").when(F.col("linked"), "package_based_monorepo").otherwise("direct_import_monorepo").alias("class"))


def merged_options(own: Column, parent: Column) -> Column:
    """Options by name, those of the nearer configuration first."""
    none = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(own, none), F.coalesce(parent, none), lambda k, a, b: F.coalesce(a, b))


def extended_options(configs: DataFrame) -> DataFrame:
    """path, base_url, paths, options: compiler options with those of the extended configurations, the nearer ones winning by name; packages' configurations and cycles end a chain.

    Rounds go on until no chain does: a chain visits a configuration once, so there are at most as many rounds as configurations.
    """
    step = F.when(F.col("extends").startswith("."), F.col("extends"))
    target = normalize_path(F.concat_ws("/", F.col("dir"), F.when(step.endswith(".json"), step).otherwise(F.concat(step, F.lit(".json")))))
    options = F.col("options") if "options" in configs.columns else F.lit(None).cast("map<string,string>")
    own = checkpoint(configs.select("path", "base_url", "paths", options.alias("options"), F.when(step.isNotNull(), target).alias("next")))
    parent = own.select(F.col("path").alias("p"), F.col("base_url").alias("b2"), F.col("paths").alias("p2"), F.col("options").alias("o2"), F.col("next").alias("n2"))
    merged = own.withColumn("seen", F.array("path"))
    while not merged.filter("next IS NOT NULL").isEmpty():
        joined = merged.join(parent, (merged["next"] == parent["p"]) & ~F.array_contains("seen", parent["p"]), "left")
        merged = checkpoint(
            joined.select(
                "path", F.coalesce("base_url", "b2").alias("base_url"), F.coalesce("paths", "p2").alias("paths"), merged_options(F.col("options"), F.col("o2")).alias("options"), F.col("n2").alias("next"),
                F.when(F.col("p").isNotNull(), F.concat("seen", F.array("p"))).otherwise(F.col("seen")).alias("seen"),
            )
        )
    return merged.select("path", "base_url", "paths", "options")


def path_mappings(configs: DataFrame, options: DataFrame) -> DataFrame:
    """path, alias, target: path mappings of a configuration and of all it references, directly or not; the nearest configuration wins per alias.

    Targets are given from the root: after the base address of the configuration that states them.
    """
    edges = configs.select("path", "dir", F.explode("references").alias("r"))
    to = normalize_path(F.concat_ws("/", "dir", F.col("r")))
    links = checkpoint(edges.select("path", F.when(to.endswith(".json"), to).otherwise(F.concat(to, F.lit("/tsconfig.json"))).alias("next")).distinct())
    reach = checkpoint(configs.select("path", F.col("path").alias("at"), F.lit(0).alias("depth")))
    frontier, depth = reach, 0
    while True:  # each round reaches a pair of configurations that none before did, so it ends
        depth += 1
        new = frontier.join(links.withColumnRenamed("path", "at"), "at").select("path", F.col("next").alias("at")).distinct().join(reach.select("path", "at"), ["path", "at"], "left_anti")
        frontier = checkpoint(new.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reach = reach.unionByName(frontier)
    stated = options.select(F.col("path").alias("at"), "base_url", F.explode("paths").alias("alias", "targets")).withColumn("target", F.explode("targets"))
    stated = stated.withColumn("target", normalize_path(F.concat_ws("/", dirname(F.col("at")), "base_url", "target")))
    return reach.join(stated, "at").groupBy("path", "alias").agg(F.min_by("target", F.struct("depth", "at", "target")).alias("target"))


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """path, config: the configuration in the nearest directory at or above a file (path); configs: path, dir."""
    above = files.select("path", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("dir"))
    hit = above.join(configs.select("dir", F.col("path").alias("config")), "dir").groupBy("path").agg(F.max_by("config", F.struct(F.length("dir"), F.col("config"))).alias("config"))
    return files.select("path").distinct().join(hit, "path", "left")
