"""Pieces that several operators share: text expressions, two-level ranks, bounded filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.session import materialize, ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows of an Arrow batch: documents can be long, and a batch is held whole by a worker.
BATCH_ROWS = 1024
BATCH_BYTES = 32 << 20

#: Largest bounded filter: 2**24 bits are 262,144 rows of 64 bits, about 10 MB when broadcast.
MAX_FILTER_BITS = 1 << 24


def small_batches(spark: SparkSession) -> None:
    """Session defaults of this subpackage: Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes at most, so that
    long texts do not pile up in a worker, and workers that can import the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns as a struct), doc_id, source, text: no column of ``docs`` can clash with a working name."""
    held = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    return docs.select(held, F.col("doc_id").cast("long").alias("doc_id"), source.cast("string").alias("source"), F.col("text").cast("string").alias("text"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes Spark's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def global_rank(df: DataFrame, order: Sequence[Column], name: str, partitions: int = 8) -> DataFrame:
    """Add ``name``: 1, 2, ... in the given order, without one task that holds all rows.

    Range partitions are numbered on their own; what precedes each partition is a table of
    ``partitions`` rows.
    """
    spark = df.sparkSession
    kept = materialize(df.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()), "rank")
    counts = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for p in sorted(counts):
        rows.append((p, before))
        before += counts[p]
    offsets = spark.createDataFrame(rows, "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.withColumn("_rn", within).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_rn") + F.col("_before")).drop("_part", "_rn", "_before")


def bucketed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int) -> DataFrame:
    """Add ``name``: 0, 1, ... within ``keys``, with no task that holds a whole key.

    Rows of a key are dealt to hash buckets of the ordering columns; a window ranks each
    (key, bucket), and a second window over the few bucket counts of a key gives what precedes.
    ``rows`` is the size of the table and sets the number of buckets. Rows must not depend on
    the order in which tasks run: identical rows may swap ranks, others never do.
    """
    buckets = max(256, rows // 100_000)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in [*keys, "_bucket"]]
    ranked = dealt.withColumn("_rn", within).alias("r").join(before.alias("b"), same)
    return ranked.select(*(F.col(f"r.`{c}`") for c in df.columns), (F.col("b._before") + F.col("r._rn") - 1).alias(name))


class BoundedFilter:
    """A blocked Bloom filter as a DataFrame of (word, bits): never more than MAX_FILTER_BITS.

    It only saves shuffles: what it lets through is always decided by an exact join, so a full
    filter costs time and never a result.
    """

    def __init__(self, keys: DataFrame, key: str, count: int):
        bits = 1 << 14
        while bits < 12 * count and bits < MAX_FILTER_BITS:
            bits *= 2
        self.words = bits // 64
        word, mask = self._place(F.col(key))
        found = keys.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
        self.table = materialize(found, "filter")

    def _place(self, key: Column) -> tuple[Column, Column]:
        h = F.xxhash64(key, F.lit(17))
        word = F.pmod(h, F.lit(self.words)).cast("int")
        one = F.lit(1).cast("long")
        shift = lambda by: F.call_function("shiftleft", one, by.cast("int"))
        low, high = F.pmod(F.shiftright(h, 24), F.lit(64)), F.pmod(F.shiftright(h, 40), F.lit(64))
        return word, shift(low).bitwiseOR(shift(high))

    def split(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with ``_maybe``: false only where the key is surely not in the filter."""
        word, mask = self._place(F.col(key))
        tested = df.withColumn("_word", word).withColumn("_mask", mask).join(F.broadcast(self.table), "_word", "left")
        return tested.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))).drop("_word", "_mask", "_bits")
