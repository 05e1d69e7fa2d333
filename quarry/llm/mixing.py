"""Mixing sources to target weights (problem 9).

Sizes are tokens of a public tokenizer. The size of the mixture is the largest at which every source that exists reaches its share with
no document used more than the source's ``max_repeats`` times, unless a size is given. A source contributes complete epochs first, and
the rest by weighted sampling without replacement after Efraimidis and Spirakis: each document gets an exponential key with a rate of
its quality weight, and the documents with the smallest keys are taken until their summed tokens reach the rest of the budget.

The sum runs over all documents of a source, of which one may hold a third of everything. So keys fall into ranges of their logarithm,
``RANGES`` to each doubling. An exponential key with any rate, and so any mixture of weights, falls into one such range with a chance of
at most ln(2) / (e * RANGES), 0.03 %. The sums of the ranges decide for all ranges but one per source, and only the documents of that one
are sorted. One pass over the texts gives tokens and weights.

Quality weights are the posterior of prose (problem 10), with a floor, so that a document is made rare but never impossible.

Nulls: documents without a source or without tokens belong to no source. Sources are compared trimmed and in lower case. A target without
documents keeps an actual share of 0, a source without target contributes nothing and is reported; shares are scaled to one over the
sources that exist. A null max_repeats counts as 1. Ties of keys go by doc_id. Repeated rows of a document count once.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import quality, tokens
from quarry.session import checkpoint

RANGES = 1024
FLOOR = 0.1


def normal_source(column: str = "source"):
    return F.lower(F.trim(column))


def sizes(documents: DataFrame, common_words: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, source, n_tokens, weight: one row per document with a source and tokens."""
    rows = documents.select("doc_id", "text", normal_source().alias("source")).filter("source <> ''")
    typed = quality.text_types(rows, common_words, ("source",), partial(tokens.counter, vocabulary))
    return typed.filter("n_tokens > 0").select("doc_id", "source", "n_tokens", F.greatest(F.coalesce("prose_probability", F.lit(0.0)), F.lit(FLOOR)).alias("weight"))


def keyed(sized: DataFrame, seed: int) -> DataFrame:
    """Adds the exponential key and the range it falls into."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    with_key = sized.withColumn("key", -F.log(uniform) / F.col("weight"))
    return with_key.withColumn("range", F.floor(F.log2("key") * F.lit(RANGES)).cast("int"))


def budgets(available: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """source, epochs, rest, binding: complete epochs and further tokens that each source (available_tokens; target_share, max_repeats) is to contribute.

    Worked out by two aggregates over the sources, so their number has no bound.
    """
    present = targets.join(available, "source").filter("available_tokens > 0 AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats", "available_tokens")
    whole = present.agg(F.sum("target_share").alias("_whole"))
    most = F.col("available_tokens") * F.col("max_repeats")
    scaled = present.crossJoin(F.broadcast(whole)).withColumn("_share", F.col("target_share") / F.col("_whole"))
    size = scaled.agg((F.min(most / F.col("_share")) if total is None else F.lit(float(total))).alias("_size"))
    budget = F.least(F.col("_size") * F.col("_share"), most.cast("double"))
    planned = scaled.crossJoin(F.broadcast(size)).withColumn("budget", budget)
    epochs = F.floor(F.col("budget") / F.col("available_tokens") + F.lit(1e-12)).cast("int")
    return planned.select("source", "budget", epochs.alias("epochs"), (F.col("budget") - F.col("available_tokens") * epochs).alias("rest"), (F.col("budget") >= most * F.lit(1 - 1e-9)).alias("binding"))


class Mix:
    """A mixture of documents (doc_id, text, source) after mix_targets (source, target_share, max_repeats)."""

    def __init__(self, documents: DataFrame, targets: DataFrame, common_words: DataFrame, vocabulary: str, seed: int = 20, total: float | None = None):
        self.spark = documents.sparkSession
        self.sized = checkpoint(keyed(sizes(documents, common_words, vocabulary), seed))
        wanted = targets.select(normal_source().alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).filter("source IS NOT NULL AND target_share IS NOT NULL")
        self.targets = wanted.groupBy("source").agg(F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
        self.available = self.sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("n_documents"))
        self.plan = checkpoint(budgets(self.available, self.targets, total))

    def chosen(self) -> DataFrame:
        """doc_id, source, n_tokens, times: the documents of the mixture and how often each is used."""
        sums = self.sized.join(self.plan, "source").groupBy("source", "range", "rest").agg(F.sum("n_tokens").alias("in_range"))
        before = F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")
        # The range in which a source's rest ends: whole ranges before it are taken, those behind it are not. A source whose rest is all it has, or nothing, has none.
        edge = sums.withColumn("before", before).filter("before < rest AND before + in_range > rest").select("source", F.col("range").alias("edge"), "before")
        last = sums.withColumn("before", before).filter("before + in_range <= rest").groupBy("source").agg(F.max("range").alias("last"))
        docs = self.sized.join(checkpoint(self.plan.join(edge, "source", "left").join(last, "source", "left")), "source")
        at_edge = F.coalesce(F.col("range") == F.col("edge"), F.lit(False))
        inner = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", "doc_id"))
        # The document that crosses the budget is taken if that brings the sum nearer to it.
        sorted_ = docs.filter(at_edge).withColumn("extra", (F.col("before") + inner - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
        whole = docs.filter(~at_edge).withColumn("extra", F.coalesce(F.col("range") <= F.col("last"), F.lit(False)).cast("int"))
        cols = ["doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).alias("times")]
        return whole.select(*cols).unionByName(sorted_.select(*cols)).filter("times > 0")

    def shares(self) -> DataFrame:
        """source, target_share, max_repeats, n_documents, available_tokens, used_tokens, most_times, unused_tokens, binding, actual_share, per source of either side.

        unused_tokens are those of documents that are not in the mixture; binding sources are used as often as they may be, and set its size.
        """
        used = self.chosen().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("used_tokens"), F.max("times").alias("most_times"), F.sum("n_tokens").alias("once"))
        joined = self.targets.join(self.available, "source", "full_outer").join(used, "source", "left").join(self.plan.select("source", "binding"), "source", "left")
        filled = joined.select(
            "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "available_tokens", "used_tokens", "most_times")],
            (F.coalesce("available_tokens", F.lit(0)) - F.coalesce("once", F.lit(0))).alias("unused_tokens"), F.coalesce("binding", F.lit(False)).alias("binding"),
        )
        total = filled.agg(F.sum("used_tokens").alias("total"))
        return filled.crossJoin(F.broadcast(total)).withColumn("actual_share", F.when(F.col("total") > 0, F.col("used_tokens") / F.col("total")).otherwise(0.0)).drop("total")
