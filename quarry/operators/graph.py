"""Graph operators on edge tables (src, dst).

Iterations run as distributed jobs of a few rounds each and cut their lineage through the shared checkpoint folder. A graph is counted
first; one of at most ``small_graph.LIMIT`` edges, and as many further nodes, goes to a single task, which gives the same result without a
job per round. ``small_limit`` sets that bound, 0 always takes the distributed way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import small_graph as small
from quarry.session import checkpoint


#: Rounds of a relaxation that one job runs between two checkpoints.
HOPS = 4


def _is_small(edges: DataFrame, limit: int, nodes: DataFrame | None = None) -> bool:
    """Whether the edges, and the nodes that go with them, are counted to be few."""
    return limit > 0 and edges.limit(limit + 1).count() <= limit and (nodes is None or nodes.limit(limit + 1).count() <= limit)


def connected_components(edges: DataFrame, max_rounds: int = 60, small_limit: int = small.LIMIT) -> DataFrame:
    """node, component: the smallest node that is reachable regardless of direction, for every node with an edge.

    Alternating large-star and small-star rounds: each round joins by grouping alone, and the number of rounds grows with the logarithm
    of the diameter, not with the diameter. Null ends are dropped, self-loops keep their node.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).filter("node IS NOT NULL").distinct()
    links = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    links, nodes = checkpoint(links), checkpoint(nodes)
    if _is_small(links, small_limit, nodes):
        return small.in_one_task(links.select(F.col("u").alias("src"), F.col("v").alias("dst")), nodes, "node bigint, component bigint", lambda ids, src, dst, extra: {"node": ids, "component": ids[small.components(len(ids), src, dst)]})
    before = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        star = joined.select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        links = checkpoint(star)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    parents = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(parents, nodes.node == parents.u, "left").select("node", F.coalesce("component", "node").alias("component"))


def definition_graph(definitions: DataFrame, references: DataFrame, files: DataFrame, remove_isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, file_id, definition_type, label, title) and edges (src, dst) of references with a target; optionally without nodes that have no edge."""
    edges = references.filter("target_definition_id IS NOT NULL").select(F.col("source_definition_id").alias("src"), F.col("target_definition_id").alias("dst")).distinct()
    titles = files.select(F.col("id").alias("file_id"), F.col("file_path").alias("title")).dropDuplicates(["file_id"])
    nodes = definitions.select(F.col("id").alias("node"), "file_id", "definition_type", F.col("name").alias("label")).dropDuplicates(["node"]).join(titles, "file_id", "left")
    if remove_isolated:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        nodes = nodes.join(ends, "node", "left_semi")
    return nodes.select("node", "file_id", "definition_type", "label", "title"), edges


def _closure_of(ids, src, dst, extra):
    steps = small.closure(len(ids), src, dst, extra)
    return {"node": ids[steps >= 0], "distance": steps[steps >= 0].astype("int32")}


def reverse_closure(edges: DataFrame, seeds: DataFrame, max_rounds: int = 10_000, small_limit: int = small.LIMIT) -> DataFrame:
    """node, distance: the seeds and all that reach one of them along edges, with the least number of steps.

    One round per step: the frontier meets the edges at their target, and what was reached before is left out. Every round is cut off by
    a checkpoint, so the plan does not grow with the depth.
    """
    back = checkpoint(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    starts = checkpoint(seeds.select("node").filter("node IS NOT NULL").distinct())
    if _is_small(back, small_limit, starts):
        return small.in_one_task(back, starts, "node bigint, distance int", _closure_of)
    reached = frontier = starts.withColumn("distance", F.lit(0))
    for step in range(1, max_rounds + 1):
        new = back.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().join(reached.select("node"), "node", "left_anti")
        frontier = checkpoint(new.withColumn("distance", F.lit(step)))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
        if step % 8 == 0:
            reached = checkpoint(reached)
    raise RuntimeError("the closure did not settle")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between given nodes."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def _trimmed(links: DataFrame) -> DataFrame:
    """The edges between nodes that have edges in both directions."""
    ends = links.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    alive = ends.groupBy("node").agg(F.max("out").alias("out"), F.max("into").alias("into")).filter("out = 1 AND into = 1").select("node")
    return links.join(alive.withColumnRenamed("node", "src"), "src", "left_semi").join(alive.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def strongly_connected(edges: DataFrame, max_rounds: int = 200, small_limit: int = small.LIMIT) -> DataFrame:
    """node, component: components in which each node reaches each other one, named by their largest node.

    Forward colouring: each node takes the largest node that reaches it; within a colour, what reaches the colour's own node
    backwards is a component and leaves. Nodes without an edge in or out are components of their own and leave first.
    """
    nodes = checkpoint(edges.select(F.explode(F.array("src", "dst")).alias("node")).filter("node IS NOT NULL").distinct())
    links = checkpoint(edges.filter("src <> dst").select("src", "dst").distinct())
    if _is_small(links, small_limit, nodes):
        return small.in_one_task(links, nodes, "node bigint, component bigint", lambda ids, src, dst, extra: {"node": ids, "component": ids[small.strong(len(ids), src, dst)]})
    done: list[DataFrame] = []
    n_links = links.count()
    for _ in range(max_rounds):
        while True:
            # What nothing leads to, or leads on from nothing, is in no cycle.
            links = checkpoint(_trimmed(links))
            left = links.count()
            if left == n_links:
                break
            n_links = left
        if not n_links:
            break
        colour = checkpoint(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            new = colour.withColumn("before", F.col("colour"))
            for _ in range(HOPS):
                offered = links.join(new.select(F.col("node").alias("src"), F.col("colour").alias("offer")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("offer").alias("offer"))
                new = new.join(offered, "node", "left").select("node", "before", F.greatest("colour", F.coalesce("offer", "colour")).alias("colour"))
            new = checkpoint(new)
            colour = new.select("node", "colour")
            if new.filter("colour <> before").isEmpty():
                break
        same = checkpoint(links.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").filter("c1 = c2").select("src", "dst"))
        members = reverse_closure(same, colour.filter("node = colour").select("node"), small_limit=small_limit).join(colour, "node").select("node", F.col("colour").alias("component"))
        members = checkpoint(members)
        done.append(members)
        gone = members.select("node")
        links = checkpoint(links.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        n_links = links.count()
    else:
        raise RuntimeError("the components did not settle")
    if not done:
        return nodes.select("node", F.col("node").alias("component"))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """src, dst between components."""
    a = components.select(F.col("node").alias("src"), F.col("component").alias("c1"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("c2"))
    return edges.join(a, "src").join(b, "dst").filter("c1 <> c2").select(F.col("c1").alias("src"), F.col("c2").alias("dst")).distinct()


def component_levels(nodes: DataFrame, dag: DataFrame, max_rounds: int = 10_000, small_limit: int = small.LIMIT) -> DataFrame:
    """node, level: 0 without dependencies, else one more than the highest level of a dependency; dag has src -> dst for src depends on dst."""
    dag = checkpoint(dag.select("src", "dst").distinct())
    if _is_small(dag, small_limit):
        linked = small.in_one_task(dag, None, "node bigint, level int", lambda ids, src, dst, extra: {"node": ids, "level": small.levels(len(ids), src, dst).astype("int32")})
        return nodes.select("node").distinct().join(linked, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))
    level = checkpoint(nodes.select("node").distinct().withColumn("level", F.lit(0)))
    for _ in range(max_rounds):
        new = level.withColumn("before", F.col("level"))
        for _ in range(HOPS):
            offered = dag.join(new.select(F.col("node").alias("dst"), "level"), "dst").groupBy(F.col("src").alias("node")).agg((F.max("level") + 1).alias("offer"))
            new = new.join(offered, "node", "left").select("node", "before", F.greatest("level", F.coalesce("offer", F.lit(0))).alias("level"))
        new = checkpoint(new)
        level = new.select("node", "level")
        if new.filter("level <> before").isEmpty():
            return level
    raise RuntimeError("the levels did not settle; the graph has a cycle")


def levels(nodes: DataFrame, edges: DataFrame, small_limit: int = small.LIMIT) -> DataFrame:
    """node, component, level: cycles contracted, then levels from the nodes that depend on nothing."""
    found = strongly_connected(edges, small_limit=small_limit)
    every = nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    every = checkpoint(every)
    level = component_levels(every.select(F.col("component").alias("node")), condensation(edges, every), small_limit=small_limit)
    return every.join(level.withColumnRenamed("node", "component"), "component").select("node", "component", "level")


def filter_levels(levelled: DataFrame, allowed: DataFrame) -> DataFrame:
    """The allowed nodes, with levels numbered again without gaps."""
    kept = levelled.join(allowed.select("node").distinct(), "node", "left_semi")
    numbers = kept.select("level").distinct().withColumn("new_level", (F.row_number().over(Window.orderBy("level")) - 1).cast("int"))
    return kept.join(F.broadcast(numbers), "level").select("node", "component", F.col("new_level").alias("level"))


def transitive_closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """src, dst of all pairs with a path, by joining paths of doubled length; for graphs whose closure is of a size to be kept."""
    paths = checkpoint(edges.filter("src <> dst").select("src", "dst").distinct())
    n = paths.count()
    for _ in range(max_rounds):
        longer = paths.join(paths.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).filter("src <> dst")
        paths = checkpoint(paths.unionByName(longer).distinct())
        now = paths.count()
        if now == n:
            return paths
        n = now
    raise RuntimeError("the closure did not settle")


def transitive_reduction(dag: DataFrame, max_rounds: int = 10_000, small_limit: int = small.LIMIT) -> DataFrame:
    """The edges of an acyclic graph that no longer path replaces.

    A path of several edges goes down at least as many levels, so only edges over two levels or more can be replaced. From the sources of
    these, walks go on as long as they are above the lowest end that the source has such an edge to, so that no pair is kept that cannot
    lead to one of them.
    """
    edges = checkpoint(dag.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    level = checkpoint(component_levels(nodes, edges, small_limit=small_limit))
    steps = edges.join(level.select(F.col("node").alias("dst"), F.col("level").alias("at_level")), "dst")
    steps = checkpoint(steps.join(level.select(F.col("node").alias("src"), F.col("level").alias("from_level")), "src"))
    open_ = checkpoint(steps.filter("from_level - at_level >= 2").select("src", "dst", "at_level"))
    lowest = checkpoint(open_.groupBy("src").agg(F.min("at_level").alias("low")))
    walk = checkpoint(steps.join(lowest, "src").filter("at_level > low").select("src", F.col("dst").alias("at"), "low"))
    seen, found = walk.select("src", "at"), []
    onward = steps.select(F.col("src").alias("at"), F.col("dst").alias("next"), "at_level")
    for step in range(1, max_rounds + 1):
        reached = checkpoint(walk.join(onward, "at").filter("at_level >= low").select("src", F.col("next").alias("at"), "low", "at_level").distinct())
        found.append(open_.select("src", "dst").join(reached.select("src", F.col("at").alias("dst")), ["src", "dst"], "left_semi"))
        walk = checkpoint(reached.filter("at_level > low").select("src", "at", "low").join(seen, ["src", "at"], "left_anti"))
        if walk.isEmpty():
            replaced = found[0]
            for part in found[1:]:
                replaced = replaced.unionByName(part)
            return edges.join(replaced.distinct(), ["src", "dst"], "left_anti")
        seen = seen.unionByName(walk.select("src", "at"))
        if step % 8 == 0:
            seen = checkpoint(seen)
    raise RuntimeError("the walks did not end; the graph has a cycle")


def neighbours(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """centre, node, role: the centre itself, what it depends on and what it is used by; keyed by entity."""
    c = centres.select(F.col("node").alias("centre")).distinct()
    out = c.join(edges, F.col("centre") == F.col("src")).select("centre", F.col("dst").alias("node"), F.lit("depends on").alias("role"))
    into = c.join(edges, F.col("centre") == F.col("dst")).select("centre", F.col("src").alias("node"), F.lit("is used by").alias("role"))
    return c.select("centre", F.col("centre").alias("node"), F.lit("centre").alias("role")).unionByName(out).unionByName(into).distinct()


def file_tree(files: DataFrame) -> DataFrame:
    """path, parent, name, depth, file_id: a node per file and per directory above one."""
    parts = F.split("file_path", "/")
    rows = files.filter("file_path IS NOT NULL").select("id", "file_path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    at = F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")
    leaf = F.col("depth") == F.size(parts)
    nodes = rows.select(at.alias("path"), "depth", F.when(leaf, F.col("id")).alias("file_id"))
    grouped = nodes.groupBy("path", "depth").agg(F.max("file_id").alias("file_id"))
    return grouped.select("path", F.when(F.col("depth") > 1, F.regexp_replace("path", "/[^/]*$", "")).alias("parent"), F.substring_index("path", "/", -1).alias("name"), "depth", "file_id")


def seeds_from_delta(file_delta: DataFrame, files: DataFrame, definitions: DataFrame) -> DataFrame:
    """node, kind: the files that were added, modified or renamed to, and all of their definitions."""
    changed = file_delta.filter(F.col("change").isin("added", "modified", "renamed")).select(F.col("path").alias("file_path")).distinct()
    ids = files.join(changed, "file_path", "left_semi").select(F.col("id").alias("node")).distinct()
    defs = definitions.join(ids.withColumnRenamed("node", "file_id"), "file_id", "left_semi").select(F.col("id").alias("node")).distinct()
    return ids.withColumn("kind", F.lit("file")).unionByName(defs.withColumn("kind", F.lit("definition")))
