"""Summaries from the bottom up: each node is summarised from its own text and the summaries of what it depends on."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import FEW, numbered, remove_folder, shared_folder


class Summarizer(Protocol):
    """Runs in the tasks; ``rows`` are (name, text, summaries of dependencies). It must give the same for the same input, as tasks are retried."""

    def summarize(self, rows: list[tuple[str, str, list[str]]]) -> list[tuple[str, str]]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class PlaceholderSummarizer:
    """Without a model: the start of the text in one line, and how many summaries went in."""

    def summarize(self, rows):
        out = []
        for name, text, deps in rows:
            head = " ".join((text or "")[:100].split())
            out.append((f"{name}: {head}"[:120], f"{name} ({len(deps)} dependencies): {head}"))
        return out


class HashingEmbedder:
    """Without a model: counts of hashed words, scaled to unit length."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts):
        out = []
        for text in texts:
            v = [0.0] * self.dims
            for word in (text or "").lower().split():
                h = xxhash.xxh3_64_intdigest(word)
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


def summarize_levels(nodes: DataFrame, edges: DataFrame, levelled: DataFrame, make: Callable[[], Summarizer] = PlaceholderSummarizer, batch: int = 50) -> DataFrame:
    """node, level, short, full: nodes (node, name, text) summarised level by level.

    The texts are written once, in a part per level, and each level reads its own part alone. It joins the summaries of what it depends on,
    of which only ids and short forms are kept in the joined state, and is written as a part of the result; so a retry repeats one level at
    most, and no text is read twice. Nodes of one component do not wait for each other. Dependencies come sorted, for the same prompt on
    every run.
    """
    spark = nodes.sparkSession
    texts, made, links = (shared_folder(spark, f"fold-{name}") for name in ("texts", "made", "links"))
    prepared = nodes.join(levelled, "node").select("node", "level", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    prepared.write.partitionBy("level").parquet(texts)
    state = levelled.select("node", "component", "level")
    a, b = (state.select(*[F.col(c).alias(f"{side}_{c}") for c in state.columns]) for side in ("src", "dst"))
    deps = edges.withColumnsRenamed({"src": "src_node", "dst": "dst_node"}).join(a, "src_node").join(b, "dst_node").filter("src_component <> dst_component")
    deps.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), F.col("src_level").alias("level")).distinct().write.partitionBy("level").parquet(links)
    schema = "node bigint, short string, full string"

    def summarise(batches: Iterable):
        summarizer = make()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                ids, *columns = whole.slice(at, batch).columns
                out = summarizer.summarize(list(zip(*(c.to_pylist() for c in columns))))
                yield pa.RecordBatch.from_arrays([ids, pa.array([m[0] for m in out], pa.string()), pa.array([m[1] for m in out], pa.string())], names=["node", "short", "full"])

    found = spark.read.schema("node bigint, name string, text string, level int").parquet(texts)
    joined = {r.level: r["count"] for r in spark.read.schema("src bigint, dst bigint, level int").parquet(links).groupBy("level").count().collect()}
    levels = sorted(r.level for r in found.select("level").distinct().collect())
    none = F.array().cast("array<string>")
    for level in levels:
        now = spark.read.schema("node bigint, name string, text string").parquet(f"{texts}/level={level}")
        if level in joined and level > levels[0]:
            # A level's links are counted: few of them, two numbers each, go to the summaries, and what they bring to the texts; many are shuffled.
            few = F.broadcast if joined[level] <= FEW // 10 else lambda df: df
            wanted = spark.read.schema("src bigint, dst bigint").parquet(f"{links}/level={level}")
            short = spark.read.schema("node bigint, short string").parquet(*[f"{made}/level={x}" for x in levels[: levels.index(level)]]).select(F.col("node").alias("dst"), "short")
            known = short.join(few(wanted), "dst").groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("short")).alias("deps"))
            ready = now.join(few(known), "node", "left").withColumn("deps", F.coalesce("deps", none))
        else:
            ready = now.withColumn("deps", none)
        ready.select("node", "name", "text", "deps").mapInArrow(summarise, schema).write.mode("overwrite").parquet(f"{made}/level={level}")
    remove_folder(spark, texts)
    remove_folder(spark, links)
    if not levels:
        return spark.createDataFrame([], "node bigint, level int, short string, full string")
    return spark.read.schema("node bigint, short string, full string, level int").parquet(made).select("node", "level", "short", "full")


def embedding_text(definitions: DataFrame) -> DataFrame:
    """entity_id, text: what is embedded of a definition: its summary, name and type."""
    return definitions.filter("coalesce(ai_summary, '') <> ''").select(F.col("id").alias("entity_id"), F.concat_ws(" ", "ai_summary", "name", "definition_type").alias("text"))


def embed(rows: DataFrame, make: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """entity_id, embedding of rows (entity_id, text)."""

    def run(batches):
        embedder = make()
        for pdf in batches:
            yield pdf[["entity_id"]].assign(embedding=embedder.embed(list(pdf["text"])))

    return rows.select("entity_id", "text").mapInPandas(run, "entity_id bigint, embedding array<float>")


def batch_plan(items: DataFrame, order: list[str], size: int = 50, per_second: float = 15.0, keys: list[str] | None = None, concurrency: int | None = None) -> DataFrame:
    """The items with batch_no, position and the second at which their batch may start, for a rate of requests; batches restart per key.

    With ``concurrency`` also slot, the one of so many workers that takes the batch. Without keys all items are one sequence, which is
    numbered by ranges of its order, not by one task.
    """
    if keys:
        placed = items.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    else:
        placed = numbered(items.withColumn("_all", F.lit(0)).withColumn("_order", F.struct(*order)), "_all", "_order", "_n").withColumn("_n", F.col("_n") - 1).drop("_all", "_order")
    n = F.col("_n")
    planned = placed.withColumn("position", (n % size).cast("int")).withColumn("batch_no", F.floor(n / size).cast("int")).withColumn("planned_second", F.col("batch_no") * F.lit(size / per_second)).drop("_n")
    return planned if concurrency is None else planned.withColumn("slot", F.col("batch_no") % concurrency)


#: Attempts of a request, and the bounds of the seconds between them.
ATTEMPTS, LEAST_WAIT, MOST_WAIT = 5, 4.0, 120.0


def retry_plan(attempts: DataFrame, key: str = "request_id", order: str = "attempt", limit: int = ATTEMPTS) -> DataFrame:
    """key, attempts, state (succeeded, waiting, failed), wait_seconds: what becomes of requests after their attempts (key, attempt, ok).

    A request that failed waits 4 seconds, then twice as long each time, at most 120; after the last attempt it has failed.
    """
    done = attempts.groupBy(key).agg(F.max(order).alias("attempts"), F.max("ok").alias("_ok"))
    state = F.when(F.col("_ok"), "succeeded").when(F.col("attempts") >= limit, "failed").otherwise("waiting")
    wait = F.least(F.lit(LEAST_WAIT) * F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(MOST_WAIT))
    return done.select(key, "attempts", state.alias("state"), F.when(state == "waiting", wait).alias("wait_seconds"))


class Retrying:
    """A summarizer or embedder whose calls are repeated when they fail, with the waits of ``retry_plan``; it runs in the tasks."""

    def __init__(self, inner, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.attempts, self.sleep = inner, attempts, sleep

    def _call(self, f: Callable, argument):
        for attempt in range(1, self.attempts + 1):
            try:
                return f(argument)
            except Exception:
                if attempt == self.attempts:
                    raise
                self.sleep(min(LEAST_WAIT * 2 ** (attempt - 1), MOST_WAIT))

    def summarize(self, rows):
        return self._call(self.inner.summarize, rows)

    def embed(self, texts):
        return self._call(self.inner.embed, texts)


def catalogue(files: DataFrame, definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, prompt: per file a citation of itself, of its definitions, and of the files it depends on and is used by, each in order."""
    f = files.select(F.col("id").alias("file_id"), "file_path").dropDuplicates(["file_id"])
    cite = F.concat(F.lit("["), F.col("file_path"), F.lit("](file::"), F.col("file_id"), F.lit(")"))
    d = definitions.select("id", "file_id", "name").dropDuplicates(["id"])
    defs = d.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("["), "name", F.lit("](file::"), "file_id", F.lit(":definition::"), "id", F.lit(")")))), ", ").alias("defs"))
    cited = f.select(F.col("file_id").alias("other"), cite.alias("c"))
    out = edges.join(cited.withColumnRenamed("other", "dst"), "dst").groupBy(F.col("src").alias("file_id")).agg(F.array_join(F.array_sort(F.collect_set("c")), ", ").alias("uses"))
    into = edges.join(cited.withColumnRenamed("other", "src"), "src").groupBy(F.col("dst").alias("file_id")).agg(F.array_join(F.array_sort(F.collect_set("c")), ", ").alias("used"))
    joined = f.join(defs, "file_id", "left").join(out, "file_id", "left").join(into, "file_id", "left")
    parts = F.concat_ws("\n", F.concat(F.lit("File: "), cite), F.concat(F.lit("Definitions: "), "defs"), F.concat(F.lit("Depends on: "), "uses"), F.concat(F.lit("Used by: "), "used"))
    return joined.select("file_id", parts.alias("prompt"))
