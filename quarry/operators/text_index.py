"""A full-text index that is written once, read by term, and kept up to date.

The index is a folder with two tables, each partitioned by segment: ``postings`` (term, id, tf; further partitioned by a bucket of the
term's first two signs) and ``documents`` (id, length; null for a deletion). An update writes one further segment; of each id only its
latest segment counts, so nothing that is written is changed, and a reader sees the segments that were whole when it began. ``compact``
merges all segments into one.

A query reads the buckets of its terms alone, with the terms pushed into the scan, and joins the few hits with the ids' latest segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.search import B, K1, LEAST_IDF, query_terms
from quarry.session import remove_folder

BUCKETS = 64
POSTINGS = "term string, id bigint, tf int, segment int, bucket int"
DOCUMENTS = "id bigint, length int, segment int"


def _bucket(term: Column) -> Column:
    """By the first two signs, so that a prefix of two signs or more stands in one bucket."""
    return F.pmod(F.hash(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _segments(self) -> list[int]:
        """The segments that were written whole, as the mark of the documents' table says, which is written last."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("segment=") and self._exists(f"{self.folder}/documents/{n}/_SUCCESS"))

    def _write(self, documents: DataFrame, segment: int) -> None:
        words = documents.select("id", "live", tokens(F.coalesce("text", F.lit(""))).alias("words"))
        terms = words.filter("live").select("id", F.explode("words").alias("term")).groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"))
        placed = terms.withColumn("bucket", _bucket(F.col("term"))).repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term", "id")
        placed.select("term", "id", "tf", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        words.select("id", F.when(F.col("live"), F.size("words")).alias("length")).write.mode("overwrite").parquet(f"{self.folder}/documents/segment={segment}")

    def upsert(self, documents: DataFrame) -> int:
        """Add the documents (id, text), in place of those with the same ids; gives the segment. Repeated ids count once."""
        segment = max(self._segments(), default=-1) + 1
        self._write(documents.filter("id IS NOT NULL").groupBy("id").agg(F.max("text").alias("text")).withColumn("live", F.lit(True)), segment)
        return segment

    def delete(self, ids: DataFrame) -> int:
        """Take the documents (id) out; gives the segment."""
        segment = max(self._segments(), default=-1) + 1
        self._write(ids.select("id").distinct().withColumns({"text": F.lit(None).cast("string"), "live": F.lit(False)}), segment)
        return segment

    def live(self) -> DataFrame:
        """id, length, segment of the documents as they are now."""
        segments = self._segments()
        if not segments:
            return self.spark.createDataFrame([], DOCUMENTS)
        rows = self.spark.read.schema(DOCUMENTS).parquet(f"{self.folder}/documents").filter(F.col("segment").isin(segments))
        if len(segments) == 1:
            return rows.filter("length IS NOT NULL")
        last = rows.groupBy("id").agg(F.max(F.struct("segment", "length")).alias("m"))
        return last.select("id", F.col("m.length").alias("length"), F.col("m.segment").alias("segment")).filter("length IS NOT NULL")

    def postings(self, condition: Column) -> DataFrame:
        """term, id, tf, length of the live documents; the condition is on bucket and term, and is pushed into the scan."""
        rows = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings").filter(condition)
        return rows.select("term", "id", "tf", "segment").join(self.live(), ["id", "segment"]).select("term", "id", "tf", "length")

    def bm25(self, query: str, match_all: bool = True, prefix: bool = False) -> DataFrame:
        """id, rank as ``search.bm25`` gives them, from the index."""
        terms = query_terms(self.spark, query)
        if not terms or not self._segments():
            return self.spark.createDataFrame([], "id bigint, rank double")
        wanted = []
        for i, term in enumerate(terms):
            if prefix and i == len(terms) - 1:
                starts = F.startswith("term", F.lit(term))
                wanted.append(starts & (F.col("bucket") == _bucket(F.lit(term))) if len(term) > 1 else starts)
            else:
                wanted.append((F.col("bucket") == _bucket(F.lit(term))) & (F.col("term") == term))
        any_of = wanted[0]
        for w in wanted[1:]:
            any_of = any_of | w
        hit = [F.startswith("term", F.lit(t)) if prefix and i == len(terms) - 1 else F.col("term") == t for i, t in enumerate(terms)]
        counted = self.postings(any_of).groupBy("id", "length").agg(*[F.sum(F.when(h, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, h in enumerate(hit)])
        totals = self.live().agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
        found = counted.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
        condition = F.lit(match_all)
        score: Column = F.lit(0.0)
        for i in range(len(terms)):
            tf = F.col(f"tf{i}")
            condition = condition & (tf > 0) if match_all else condition | (tf > 0)
            idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
        return counted.filter(condition).crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(found)).select("id", (-score).alias("rank"))

    def compact(self) -> None:
        """Merge all segments into one, so that what was replaced or deleted no longer takes room. Readers that began before keep what they read until the next call."""
        segments = self._segments()
        if len(segments) < 2:
            return
        merged = max(segments) + 1
        live = self.live()
        kept = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings").filter(F.col("segment").isin(segments)).join(live.select("id", "segment"), ["id", "segment"], "left_semi")
        placed = kept.select("term", "id", "tf", "bucket").repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term", "id")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={merged}")
        live.select("id", "length").write.mode("overwrite").parquet(f"{self.folder}/documents/segment={merged}")
        for segment in segments:
            remove_folder(self.spark, f"{self.folder}/documents/segment={segment}")
            remove_folder(self.spark, f"{self.folder}/postings/segment={segment}")
