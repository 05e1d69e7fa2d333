"""Graphs that are counted to be small, worked out by one task in a few passes instead of one job per round.

The functions on arrays know nothing of Spark; ``in_one_task`` brings the edges, whose number the caller has checked, to one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Edges up to which a graph goes to one task: 16 MB of ids.
LIMIT = 1_000_000


def _adjacency(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(src, kind="stable")
    starts = np.zeros(n + 1, dtype=np.int64)
    np.add.at(starts, src + 1, 1)
    return np.cumsum(starts), dst[order]


def components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The lowest node of each node's connected component; nodes are numbered in order of their ids."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(src.tolist(), dst.tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], dtype=np.int64)


def strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The highest node of each node's strongly connected component (Tarjan's algorithm without recursion)."""
    starts, targets = _adjacency(n, src, dst)
    starts, targets = starts.tolist(), targets.tolist()
    index, low, on, label = [-1] * n, [0] * n, [False] * n, [0] * n
    stack: list[int] = []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, starts[root])]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            node, at = work.pop()
            if at < starts[node + 1]:
                work.append((node, at + 1))
                to = targets[at]
                if index[to] < 0:
                    index[to] = low[to] = count
                    count += 1
                    stack.append(to)
                    on[to] = True
                    work.append((to, starts[to]))
                elif on[to]:
                    low[node] = min(low[node], index[to])
            else:
                if work:
                    above = work[-1][0]
                    low[above] = min(low[above], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on[x] = False
                        members.append(x)
                        if x == node:
                            break
                    top = max(members)
                    for x in members:
                        label[x] = top
    return np.array(label, dtype=np.int64)


def levels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """0 for nodes that depend on nothing, else one more than the highest level of a dependency; raises for a cycle."""
    starts, users = _adjacency(n, dst, src)
    waiting = np.bincount(src, minlength=n).tolist()
    starts, users = starts.tolist(), users.tolist()
    level = [0] * n
    queue = deque(x for x in range(n) if not waiting[x])
    seen = 0
    while queue:
        x = queue.popleft()
        seen += 1
        for at in range(starts[x], starts[x + 1]):
            u = users[at]
            level[u] = max(level[u], level[x] + 1)
            waiting[u] -= 1
            if not waiting[u]:
                queue.append(u)
    if seen < n:
        raise RuntimeError("the graph has a cycle")
    return np.array(level, dtype=np.int64)


def closure(n: int, src: np.ndarray, dst: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Steps along edges to the nearest seed, -1 where none is reached."""
    starts, users = _adjacency(n, dst, src)
    starts, users = starts.tolist(), users.tolist()
    steps = [-1] * n
    queue = deque(seeds.tolist())
    for s in seeds.tolist():
        steps[s] = 0
    while queue:
        x = queue.popleft()
        for at in range(starts[x], starts[x + 1]):
            u = users[at]
            if steps[u] < 0:
                steps[u] = steps[x] + 1
                queue.append(u)
    return np.array(steps, dtype=np.int64)


def in_one_task(edges: DataFrame, extra: DataFrame | None, schema: str, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """``work(ids, src, dst, extra)`` on the edges and further nodes, as numbers of the sorted distinct ids, gives the output's columns."""
    rows = edges.select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b"))
    if extra is not None:
        rows = rows.unionByName(extra.select(F.col("node").cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b")))
    # A column of its own marks the rows without an edge: numbers beside nulls would come as floats, which round ids above 2^53.
    rows = rows.filter("a IS NOT NULL").select("a", F.coalesce("b", F.lit(0)).alias("b"), F.isnull("b").alias("alone"))
    spark_schema = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches):
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        a, b, alone = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(3))
        ids, numbers = np.unique(np.concatenate([a, b[~alone]]), return_inverse=True)
        na = numbers[: len(a)]
        found = work(ids, na[~alone], numbers[len(a) :], na[alone])
        yield pa.RecordBatch.from_arrays([pa.array(found[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)

    return rows.repartition(1).mapInArrow(run, spark_schema)
