"""Exact dedup by a log-structured merge index of digests, in DataFrame operations only.

Flush: the rows of a task are its memtable; it leaves the task sorted by digest, and the memtables of a
flush become a run of level 0: one identifier and the number of rows of each digest, sorted by digest in
every file, with a filter of its digests (a Parquet Bloom filter in each file, and one that Spark can
join). A level that holds FANOUT runs is compacted into one run of the next level, so a digest is
rewritten once a level however many flushes there are; compaction keeps one identifier. ``probe`` asks
all runs, each only for what its filter lets through. Rows whose digest the filter of groups does not
know decide themselves without a shuffle. Hits, which are the rows of digests with more than one row, are
read again and compared byte for byte; if texts that differ ever share a digest, their rows are grouped
by the texts themselves.

Cases: a null text is the empty text. A null doc_id is never chosen while the group has another.
Rows repeated under one doc_id share its fate in the index (``keep_rows`` leaves one of them). Ties cannot
be: identifiers are ordered, and equal ones are the same row to the index. A very long text is hashed in
place and travels only as a hit. Other columns are ignored, or carried whole by ``keep_rows``, whatever
their names. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm._common import BoundedFilter, lower_ascii, packed, table, unpacked
from vecloom.session import fresh_path, materialize

#: Runs of a level that are merged into one of the next.
FANOUT = 4
RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000"}


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def digest_of(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


class Run(NamedTuple):
    """A sorted table of (digest, keep_id, group_size) in the shared folder, and a filter of its digests."""

    path: str
    rows: int
    filter: BoundedFilter


class MergeIndex:
    """Levels of sorted runs. ``flush`` adds a run at level 0; a level of FANOUT runs is merged into one run of the next."""

    def __init__(self, spark: SparkSession, keep: str = "smallest", fanout: int = FANOUT):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.choose, self.fanout = spark, F.min if keep == "smallest" else F.max, fanout
        self.levels: list[list[Run]] = [[]]
        self.flushed: list[str] = []

    def flush(self, docs: DataFrame) -> None:
        """Digest ``docs``: each task's rows are written sorted, and merged by digest into a run of level 0."""
        path = fresh_path(self.spark, "memtables")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(normalised(F.col("text"))).alias("digest"))
        rows.sortWithinPartitions("digest").write.parquet(path)
        self.flushed.append(path)
        self._write(self.spark.read.schema("doc_id long, digest string").parquet(path).select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge(level)
            level += 1

    def _write(self, rows: DataFrame, level: int) -> None:
        path = fresh_path(self.spark, f"run-{level}")
        merged = rows.groupBy("digest").agg(self.choose("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        merged.sortWithinPartitions("digest").write.options(**RUN_OPTIONS).parquet(path)
        run = self._read(path)
        count = run.count()
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(Run(path, count, BoundedFilter(run, "digest", count)))

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema("digest string, keep_id long, group_size long").parquet(*paths)

    def _merge(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        self._write(self._read(*(r.path for r in runs)), level + 1)

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def compact(self) -> DataFrame:
        """Merge what there is into one run of the highest level."""
        if len(self.runs()) > 1:
            runs = self.runs()
            self.levels = [[] for _ in self.levels]
            self._write(self._read(*(r.path for r in runs)), len(self.levels) - 1)
        return self.index()

    def index(self) -> DataFrame:
        """The runs as they are; a digest has one row once they are compacted."""
        return self._read(*(r.path for r in self.runs()))

    def entries(self) -> DataFrame:
        """Every row flushed so far: doc_id, digest."""
        return self.spark.read.schema("doc_id long, digest string").parquet(*self.flushed)

    def probe(self, digests: DataFrame) -> DataFrame:
        """digest, keep_id, group_size of those of ``digests`` (digest) that some run has; a run's filter decides what meets it."""
        wanted = digests.select("digest").distinct()
        met = [r.filter.split(wanted, "digest").where("_maybe").select("digest").join(self._read(r.path), "digest") for r in self.runs()]
        if not met:
            return self.spark.createDataFrame([], "digest string, keep_id long, group_size long")
        return reduce(DataFrame.unionByName, met).groupBy("digest").agg(self.choose("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def decide(self, docs: DataFrame) -> DataFrame:
        """doc_id, digest, keep_id, group_size for every flushed row, hits verified against ``docs``.

        Rows whose digest is surely in no group keep themselves; only the others meet the index.
        """
        groups = materialize(self.compact().where("group_size > 1"), "groups")
        tested = BoundedFilter(groups, "digest", groups.count()).split(self.entries(), "digest")
        alone = tested.where("NOT _maybe").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        found = materialize(tested.where("_maybe").select("doc_id", "digest").join(groups, "digest", "left"), "hits")
        alone = alone.unionByName(found.where("keep_id IS NULL AND group_size IS NULL").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
        hits = found.where("group_size IS NOT NULL")
        ids = hits.select("doc_id").distinct()
        maybe = BoundedFilter(ids, "doc_id", ids.count()).split(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), "doc_id").where("_maybe OR doc_id IS NULL")
        norm = maybe.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("digest", digest_of(F.col("norm")))
        texts = norm.groupBy("digest", "norm").agg(self.choose("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        clashes = materialize(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"), "clashes")
        if clashes.isEmpty():
            return alone.unionByName(hits)
        apart = norm.join(clashes, "digest", "left_semi").join(texts.drop("digest"), "norm")
        plain = hits.join(clashes, "digest", "left_anti")
        return alone.unionByName(plain).unionByName(apart.select("doc_id", "digest", "keep_id", "group_size"))


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    index = MergeIndex(docs.sparkSession, keep)
    index.flush(docs)
    found = index.decide(docs)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_rows(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated under one doc_id, one.

    Rows whose doc_id is in no group of two or more pass without a shuffle; the rest meet their
    decision by (doc_id, digest).
    """
    index = MergeIndex(docs.sparkSession, keep)
    index.flush(docs)
    decided = index.decide(docs).where("group_size > 1")
    grouped = materialize(decided.select(F.col("doc_id").alias("id"), F.col("digest").alias("dup"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")), "decisions")
    ids = grouped.select("id").distinct()
    tested = BoundedFilter(ids, "id", ids.count()).split(packed(docs), "doc_id")
    surely = F.col("_maybe") | F.col("doc_id").isNull()
    rest = tested.where(surely).withColumn("digest", digest_of(normalised(F.col("text"))))
    decisions = grouped.groupBy("id", "dup").agg(F.max("kept").alias("kept"))
    met = rest.join(decisions, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("dup")), "left").where("kept IS NULL OR kept")
    return unpacked(tested.where(~surely).select("row").unionByName(met.dropDuplicates(["doc_id", "digest"]).select("row")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (norm)
"""
