"""Near-duplicate records with small edits (problem 6).

Small sides that the data make small (copies, keys of more than two, records in likely pairs) are counted first: up to ``FEW`` rows they
are broadcast, beyond that the same join shuffles.

1. ``sketches``: the distinct runs of consecutive tokens of each record as 64-bit hashes, a MinHash of ``BANDS`` times ``ROWS`` minima, a
   key per band from the full minima, and b-bit MinHash: the low ``BITS`` bits of all minima packed into a few longs. It is written
   once to the shared folder, as several later stages read it.
2. ``classes``: records with the same set of runs collapse into one representative, so copies never meet in pairs.
3. ``candidates``: representatives that share the key of a band. A key of two gives its pair at once; larger ones are joined in
   blocks of at most ``BLOCK`` by ``BLOCK``, so that no task holds all of a hot key.
4. ``similar``: candidates whose similarity, estimated from the number of equal bit groups and corrected for chance collisions, may
   reach the threshold are verified on the sets themselves.
5. ``expanded`` gives the pairs of records, where a result has to name them, or ``groups`` the class and group of each record.

The bands find a pair at the threshold of 0.7 with a chance of 1 - (1 - 0.7^4)^40 = 0.99998, more similar ones with a higher one; the
estimate lets pairs through from ``SLACK`` below the threshold, over four standard deviations. There is no cap on bands, keys or partners.

Nulls: a record without code or with fewer than ``least`` tokens is in no pair and no group. Repeated rows count once. Ties cannot occur,
as the smallest id represents a class. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.session import FEW, checkpoint, remove_folder, settled, shared_folder, spread

BANDS, ROWS, BITS, BLOCK, SLACK = 40, 4, 2, 500, 0.2
#: Copies beyond which a set of runs is given its representative by broadcast instead of a shuffle on the set.
MANY = 10_000
HASHES = BANDS * ROWS
LONGS = HASHES * BITS // 64
TOKEN = re.compile(r"[A-Za-z0-9_]+", re.A)
_U = np.uint64
SCHEMA = f"def_id bigint, set_key binary, n_runs int, band_keys array<bigint>, {', '.join(f's{i} bigint' for i in range(LONGS))}, runs array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def run_hashes(tokens: list[str], width: int, known: dict[str, int]) -> np.ndarray:
    """The distinct runs of ``width`` consecutive tokens as sorted hashes. ``known`` holds hashes of tokens between calls."""
    if len(known) > 1_000_000:
        known.clear()
    hashes = []
    for t in tokens:
        h = known.get(t)
        if h is None:
            h = known[t] = xxhash.xxh3_64_intdigest(t)
        hashes.append(h)
    h = np.array(hashes, dtype=np.uint64)
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total = _mix(total + h[i : i + n] + _U(0x9E3779B97F4A7C15))
    return np.unique(total)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    return seeds[:HASHES] | _U(1), seeds[HASHES:]


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES rows of the minima of each set; the sets are slices of ``values`` that begin at ``starts``, none empty."""
    a, b = _coefficients()
    return np.stack([np.minimum.reduceat((values * a[i] + b[i]) >> _U(32), starts) for i in range(HASHES)])


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A key per set and band."""
    keys = np.zeros((BANDS, mins.shape[1]), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(mins.shape[1], band + 1, dtype=np.uint64)
        for row in range(ROWS):
            key = _mix(key + mins[band * ROWS + row] + _U(0x9E3779B97F4A7C15))
        keys[band] = key
    return keys.T


def packed(mins: np.ndarray) -> np.ndarray:
    """The low bits of the minima, LONGS per set."""
    per, low = 64 // BITS, mins & _U((1 << BITS) - 1)
    longs = np.zeros((mins.shape[1], LONGS), dtype=np.uint64)
    for i in range(HASHES):
        longs[:, i // per] |= low[i] << _U(BITS * (i % per))
    return longs


def equal_groups(mine: list[Column], other: list[Column]) -> Column:
    """How many of the bit groups of two packed signatures are equal, by bit counts."""
    ones = F.lit(int("01" * 32, 2)) if BITS == 2 else F.lit(-1)
    differing = F.lit(0)
    for a, b in zip(mine, other):
        x = a.bitwiseXOR(b)
        spread = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones) if BITS == 2 else x
        differing = differing + F.bit_count(spread)
    return F.lit(HASHES) - differing


def estimate(equal: Column) -> Column:
    """The similarity from the share of equal groups, without those that are equal by chance."""
    chance = 1 / (1 << BITS)
    return (equal / F.lit(HASHES) - F.lit(chance)) / F.lit(1 - chance)


def sketches(records: DataFrame, width: int = 3, least: int = 30) -> DataFrame:
    """SCHEMA for each record (def_id, text) with at least ``least`` tokens."""
    spark_schema = StructType.fromDDL(SCHEMA)

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            ids, sets = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = TOKEN.findall(text or "")
                if len(tokens) >= max(least, width):
                    ids.append(i)
                    sets.append(run_hashes(tokens, width, known))
            if not ids:
                continue
            lengths = np.array([len(s) for s in sets])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            values = np.concatenate(sets)
            mins = minima(values, offsets[:-1])
            longs = packed(mins)
            keys = band_keys(mins).reshape(-1).view(np.int64)
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array(lengths.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys)),
                *[pa.array(longs[:, i].copy().view(np.int64)) for i in range(LONGS)],
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in spark_schema])

    return spread(records).mapInArrow(run, spark_schema)


def classes(sketch: DataFrame) -> DataFrame:
    """def_id, rep: each record and the smallest id with the same set of runs.

    Grouping combines before it shuffles. Only sets with copies go back to the records, and those with very many, which are few, by broadcast.
    """
    narrow = sketch.select("def_id", "set_key")
    reps = checkpoint(narrow.groupBy("set_key").agg(F.min("def_id").alias("rep"), F.count("*").alias("_n")).filter("_n > 1"))
    hot = settled(reps.filter(F.col("_n") > MANY).select("set_key", F.col("rep").alias("_hot")), FEW // 10)
    marked = narrow.join(hot, "set_key", "left")
    rest = marked.filter("_hot IS NULL").select("def_id", "set_key").join(reps.filter(F.col("_n") <= MANY).select("set_key", "rep"), "set_key", "left")
    return marked.filter("_hot IS NOT NULL").select("def_id", F.col("_hot").alias("rep")).unionByName(rest.select("def_id", F.coalesce("rep", "def_id").alias("rep"))).distinct()


def pairs_within(rows: DataFrame, sizes: DataFrame, key: str, member: str, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b), a < b, of the members of each key, joined in blocks.

    ``rows`` has key and member, ``sizes`` has key and n. A key of n members is cut into ceil(n / block) parts by a hash of the member, and
    each pair of parts is joined on its own.
    """
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    cut = rows.join(sizes, key).withColumn("parts", parts).withColumn("own", F.pmod(F.hash(member), F.col("parts")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = cut.select(key, F.col("own").alias("l"), every.alias("r"), F.col(member).alias("a"))
    right = cut.select(key, every.alias("l"), F.col("own").alias("r"), F.col(member).alias("b"))
    return left.join(right, [key, "l", "r"]).filter("a < b").select("a", "b")


def candidates(banded: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of representatives that share a key; ``banded`` has def_id and key, and may repeat rows."""
    sizes = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("def_id").alias("a"), F.max("def_id").alias("b")).filter("n > 1 AND a < b")
    sizes = checkpoint(sizes)
    two = sizes.filter("n = 2").select("a", "b")
    more = pairs_within(banded, settled(sizes.filter("n > 2").select("key", "n")), "key", "def_id")
    return two.unionByName(more).distinct()


def similar(sketch: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs at or above the threshold."""
    longs = [f"s{i}" for i in range(LONGS)]
    narrow = sketch.select("def_id", *longs).dropDuplicates(["def_id"])
    a = narrow.select(F.col("def_id").alias("a"), *[F.col(s).alias(f"a_{s}") for s in longs])
    b = narrow.select(F.col("def_id").alias("b"), *[F.col(s).alias(f"b_{s}") for s in longs])
    estimated = estimate(equal_groups([F.col(f"a_{s}") for s in longs], [F.col(f"b_{s}") for s in longs]))
    likely = checkpoint(pairs.join(a, "a").join(b, "b").filter(estimated >= threshold - SLACK).select("a", "b"))
    involved = settled(likely.select(F.explode(F.array("a", "b")).alias("def_id")).distinct())
    runs = sketch.select("def_id", "runs").join(involved, "def_id", "left_semi").dropDuplicates(["def_id"])
    with_a = likely.join(runs.select(F.col("def_id").alias("a"), F.col("runs").alias("runs_a")), "a")
    with_both = with_a.join(runs.select(F.col("def_id").alias("b"), F.col("runs").alias("runs_b")), "b")
    shared = F.size(F.array_intersect("runs_a", "runs_b"))
    either = F.size("runs_a") + F.size("runs_b") - F.col("shared")
    return with_both.withColumn("shared", shared).withColumn("similarity", F.col("shared") / either).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


class NearDuplicates:
    """The stages over one table of records (def_id, text), from a sketch that is written once."""

    def __init__(self, records: DataFrame, threshold: float = 0.7, width: int = 3, least: int = 30):
        spark = records.sparkSession
        folder = shared_folder(spark, "neardup")
        sketches(records, width, least).write.parquet(folder)
        self.sketch = spark.read.schema(SCHEMA).parquet(folder)
        self.members = checkpoint(classes(self.sketch))
        copies = settled(self.members.filter("def_id <> rep").select("def_id"))
        firsts = self.sketch.select("def_id", "band_keys").join(copies, "def_id", "left_anti")
        banded = firsts.select("def_id", F.explode("band_keys").alias("key"))
        self.links = checkpoint(similar(self.sketch, candidates(banded), threshold))
        remove_folder(spark, folder)

    def expanded(self) -> DataFrame:
        """def_id_a, def_id_b, similarity of all pairs of records, copies included."""
        sizes = self.members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1")
        within = pairs_within(self.members, sizes, "rep", "def_id").withColumn("similarity", F.lit(1.0))
        # A class of very many copies is cut into parts like a hot key, and each part meets the partners on its own.
        parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
        cut = self.members.groupBy("rep").agg(F.count("*").alias("n")).select("rep", parts.alias("parts"))
        own = self.members.join(cut, "rep").select("rep", F.pmod(F.hash("def_id"), F.col("parts")).alias("part"), "def_id")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        links = self.links.join(cut.withColumnRenamed("rep", "a"), "a").select("a", "b", "similarity", every.alias("part_a"))
        links = links.join(cut.withColumnRenamed("rep", "b"), "b").select("a", "b", "similarity", "part_a", every.alias("part_b"))
        x = own.select(F.col("rep").alias("a"), F.col("part").alias("part_a"), F.col("def_id").alias("x"))
        y = own.select(F.col("rep").alias("b"), F.col("part").alias("part_b"), F.col("def_id").alias("y"))
        between = links.join(x, ["a", "part_a"]).join(y, ["b", "part_b"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
        return between.unionByName(within).select(F.col("a").alias("def_id_a"), F.col("b").alias("def_id_b"), "similarity")

    def groups(self) -> DataFrame:
        """def_id, class_id, group_id, n_links: group_id is the smallest class of all that are linked, directly or over others."""
        from quarry.operators.graph import connected_components

        edges = self.links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        degree = edges.select(F.explode(F.array("src", "dst")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        labels = connected_components(edges).withColumnRenamed("node", "rep").withColumnRenamed("component", "group_id")
        joined = self.members.join(labels, "rep", "left").join(degree, "rep", "left")
        return joined.select("def_id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def records_of(definitions: DataFrame) -> DataFrame:
    """def_id and text of functions and methods."""
    chosen = definitions.filter(F.col("definition_type").isin("function", "method") & F.col("source_code").isNotNull())
    return chosen.select(F.col("id").alias("def_id"), F.col("source_code").alias("text"))


def miss_rate(similarity: float) -> float:
    """The chance that no band has a pair of this similarity."""
    return math.exp(BANDS * math.log1p(-(similarity**ROWS)))
