"""Mixing sources to target weights by entropy balancing.

Each source has one constraint: the words taken from it equal its target. Among all document rates
between 0 and CAP that meet it, the entropy-balanced ones deviate least from a rate of one; they are
exponentially tilted by the document's size, r = CAP / (1 + (CAP - 1) exp(-x)), x = lambda * size.
lambda maximises the convex dual of the source. Newton steps are distributed: documents enter the dual
through the histogram of (source, size), whose cells Spark sums for the gradient and the curvature of
all sources at once, and the multipliers live in a table of one row a source. Sums are decimals, so
they do not depend on the order of tasks.

Rates become copies along the same histogram, from the largest size down: each size takes the whole
number of copies nearest to its share plus what larger sizes left over; a task streams a source's
distinct sizes and holds only what is left over. A source misses its target by half of its largest
document at most, and by less than its smallest ones where those are many. Which documents of a cell
get one copy more is decided by a hash of doc_id and text against the cell's cut, so that a document's
copies follow from the cells alone and no text is shuffled.

Cases: null text has size 0; a document of size 0 is kept once and takes nothing. Null is a source of
its own, after all others. A source of size 0 has target 0. Ties: documents of one size differ by their
hash only. Rows repeated with one doc_id and text are documents of their own that share the cut, so
they get the same number of copies. Very long texts only lengthen the histogram. Columns of any name
pass through ``mixed_documents`` untouched. An empty table gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm._common import global_rank, packed, small_batches, table, unpacked
from vecloom.session import Scratch, materialize

WEIGHTS = (5, 2, 1)
CAP = 3
#: Newton steps at most (a step that leaves its bracket is a bisection), and when a source is done.
STEPS, NEAR = 60, 1e-9
#: Most (source, size) cells that reach the workers by broadcast, about 40 MB; beyond, rows meet them by a join.
BROADCAST_CELLS = 500_000


def count_words(text: str | None) -> int:
    """Words are runs of anything but space and U+0009 to U+000D; bytes.split() knows exactly these."""
    return len(text.encode("utf-8", "surrogatepass").split()) if text else 0


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and h, the hash that orders the documents of a size, of every row."""
    small_batches(docs.sparkSession)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([count_words(t) for t in b.column(3).to_pylist()], pa.int64()), b.column(2)], ["doc_id", "source", "size", "h"])

    return packed(docs).select("doc_id", "source", _hash(), "text").mapInArrow(sizes, "doc_id long, source string, size long, h long")


def _hash() -> Column:
    return F.xxhash64("doc_id", "text").alias("h")


def _on(a: str, b: str, *keys: str) -> Column:
    """Equality of source (null equals null) and of these keys, for two aliased tables."""
    same = F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    for k in keys:
        same = same & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return same


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target: weights repeat over the sources in code-point order, null last."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = global_rank(found, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight.cast("double")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # a source once above its cap stays there, so this ends
        over = F.col("source_size") * cap < F.col("weight") * level
        seen = ranked.agg(F.sum(F.when(over, F.col("source_size") * cap)).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count(F.when(over, 1)).alias("n")).first()
        if seen["n"] == capped or not seen["open"]:
            break
        capped, level = seen["n"], (total - (seen["held"] or 0)) / seen["open"]
    return ranked.select("source", "source_size", "docs", F.least(F.col("source_size") * float(cap), F.col("weight") * level).alias("target"))


def rate_of(lam: Column, x: Column, cap: int) -> Column:
    return cap / (1 + (cap - 1) * F.exp(F.least(F.greatest(-lam * x, F.lit(-700.0)), F.lit(700.0))))


def solved_rates(cells: DataFrame, cap: int = CAP) -> DataFrame:
    """``cells`` (source, size, docs, source_size, target) with rate: expected words meet the target of each source.

    Newton on the dual of all sources at once. The multiplier is that of size over the words' mean size; a
    source's row holds it with the bracket known so far. Each step is one pass of sums over the cells.
    """
    words = F.col("size") * F.col("docs").cast("double")
    square = F.sum(F.col("docs").cast("decimal(20,0)") * (F.col("size") * F.col("size")).cast("decimal(18,0)"))
    free = (F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size"))
    state = cells.where(free).groupBy("source", "source_size", "target").agg((square / F.col("source_size")).cast("double").alias("mean"))
    state = state.selectExpr("source", "target", "mean", "0D AS lam", "CAST(NULL AS DOUBLE) AS low", "CAST(NULL AS DOUBLE) AS high", "false AS done")
    state = materialize(state, "multipliers")
    for _ in range(STEPS):
        if state.where("NOT done").isEmpty():
            break
        at = cells.alias("c").join(state.where("NOT done").alias("s"), _on("c", "s")).select("s.*", "c.size", "c.docs")
        x = F.col("size") / F.col("mean")
        rate = rate_of(F.col("lam"), x, cap)
        exact = lambda v: F.sum(v.cast("decimal(38,6)")).cast("double")
        sums = at.groupBy("source", "target", "mean", "lam", "low", "high").agg((exact(words * rate) - F.col("target")).alias("gap"), exact(words * rate * (1 - rate / cap) * x).alias("slope"))
        low, high = F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("low")), F.when(F.col("gap") >= 0, F.col("lam")).otherwise(F.col("high"))
        sums = sums.withColumn("done", F.abs("gap") <= F.greatest(NEAR * F.col("target"), F.lit(1e-5))).withColumn("low2", low).withColumn("high2", high)
        far = F.lit(4.0) + F.abs("lam")  # how far a step goes where the bracket is open
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") / F.col("slope"))
        newton = F.least(F.greatest(F.coalesce(newton, -F.signum("gap") * far + F.col("lam")), F.col("lam") - far), F.col("lam") + far)
        inside = (F.col("low2").isNull() | (newton > F.col("low2"))) & (F.col("high2").isNull() | (newton < F.col("high2")))
        step = F.when(F.col("done"), F.col("lam")).when(inside, newton).otherwise((F.col("low2") + F.col("high2")) / 2)
        moved = sums.select("source", "target", "mean", step.alias("lam"), F.col("low2").alias("low"), F.col("high2").alias("high"), "done")
        state = materialize(moved.unionByName(state.where("done")), "multipliers")
    met = cells.alias("c").join(state.select("source", "mean", "lam").alias("s"), _on("c", "s"), "left")
    rate = F.coalesce(rate_of(F.col("s.lam"), F.col("c.size") / F.col("s.mean"), cap), F.lit(float(cap)))
    return met.select("c.*", F.when(F.col("c.size") > 0, rate).otherwise(1.0).alias("rate"))


def rounded_copies(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """``rated`` with copies, the whole number each (source, size) takes: what a size leaves over passes to the next smaller."""
    ordered = rated.repartition("source").sortWithinPartitions("source", F.col("size").desc())
    names = ["source", "size", "docs", "rate"]

    def work(batches):
        last, rest = (), 0.0
        for b in batches:
            copies = []
            for source, size, docs, rate in zip(*(b.column(names.index(c)).to_pylist() for c in names), strict=True):
                if (source,) != last:
                    last, rest = (source,), 0.0
                if size == 0:
                    copies.append(docs)
                    continue
                want = docs * rate * size + rest
                n = min(max(round(want / size), 0), cap * docs)
                copies.append(n)
                rest = want - n * size
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(copies, pa.int64())], ["source", "size", "docs", "copies"])

    return ordered.select(*names).mapInArrow(work, "source string, size long, docs long, copies long")


def cut_hashes(sizes: DataFrame, open_cells: DataFrame, rows: int) -> DataFrame:
    """source, size, cut: the hash of the document of rank ``extra`` in each of ``open_cells`` (source, size, extra).

    Hashes are dealt to ranges; the counts of a cell's ranges tell which one holds the rank, and only that
    one is sorted, so no task holds a large cell.
    """
    ranges = max(256, rows // 100_000)
    part = F.least(F.floor((F.col("h") / F.lit(float(1 << 64)) + 0.5) * ranges), F.lit(ranges - 1)).cast("int").alias("part")
    dealt = sizes.select("source", "size", "h", part)
    counts = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("source", "size").orderBy("part")))
    hit = counts.alias("a").join(open_cells.alias("b"), _on("a", "b", "size")).where("b.extra > a.upto - a.n AND b.extra <= a.upto")
    hit = materialize(hit.selectExpr("a.source", "a.size", "a.part", "b.extra - (a.upto - a.n) AS k"), "cuts")
    inside = dealt.alias("a").join(hit.alias("b"), _on("a", "b", "size", "part")).select("a.*", "b.k")
    nth = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h"))
    return inside.withColumn("nth", nth).where("nth = k").select("source", "size", F.col("h").alias("cut"))


def decide(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, size, source_size, target, base, cut: documents with h <= cut take base + 1 copies, the others base."""
    with Scratch(sizes.sparkSession) as scratch:
        targets = materialize(source_targets(sizes, weights, cap), "targets")
        counted = sizes.groupBy("source", "size").agg(F.count("*").alias("docs"))
        cells = materialize(counted.alias("c").join(targets.alias("t"), _on("c", "t")).select("c.*", "t.source_size", "t.target"), "cells")
        whole = rounded_copies(solved_rates(cells, cap), cap)
        base = F.floor(F.col("copies") / F.col("docs"))
        whole = materialize(whole.select("source", "size", base.alias("base"), (F.col("copies") - base * F.col("docs")).alias("extra")), "copies")
        rows = targets.agg(F.sum("docs")).first()[0] or 0
        cuts = materialize(cut_hashes(sizes, whole.where("extra > 0"), rows), "cut-hashes")
        met = whole.alias("w").join(cuts.alias("k"), _on("w", "k", "size"), "left").select("w.source", "w.size", "w.base", "k.cut")
        return scratch.keep(materialize(met.alias("w").join(targets.alias("t"), _on("w", "t")).select("w.source", "w.size", "t.source_size", "t.target", "w.base", "w.cut"), "decided"))


def copies_of(h: Column, base: Column, cut: Column) -> Column:
    return base + F.when(h <= cut, 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of ``docs``."""
    sizes = materialize(word_counts(docs), "sizes")
    cells = decide(sizes, weights, cap)
    met = sizes.alias("a").join(cells.alias("b"), _on("a", "b", "size"))
    return met.select("a.doc_id", "a.source", "a.size", "b.source_size", "b.target", copies_of(F.col("a.h"), F.col("b.base"), F.col("b.cut")).alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, limit: int = BROADCAST_CELLS) -> DataFrame:
    """The documents as often as the mix takes them, in the columns of ``docs``.

    A second pass over the documents looks each one's cell up; up to ``limit`` cells no row is shuffled.
    """
    cells = decide(materialize(word_counts(docs), "sizes"), weights, cap)
    held = packed(docs).select("row", "source", _hash())
    words_in = lambda b: [count_words(t) for t in b.column(0).field("text").to_pylist()]
    if cells.count() > limit:
        schema = T.StructType([*held.schema.fields, T.StructField("size", T.LongType())])

        def sized(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words_in(b), pa.int64())], ["row", "source", "h", "size"])

        met = held.mapInArrow(sized, schema).alias("a").join(cells.alias("b"), _on("a", "b", "size"))
        met = met.select("a.row", copies_of(F.col("a.h"), F.col("b.base"), F.col("b.cut")).alias("copies")).where("copies > 0")
        return unpacked(met.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")))
    known = {(r["source"], r["size"]): (r["base"], r["cut"]) for r in cells.select("source", "size", "base", "cut").toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def taken(batches):
        known = shared.value
        for b in batches:
            at = []
            for i, (source, h, size) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), words_in(b), strict=True)):
                base, cut = known[source, size]
                at += [i] * (base + (cut is not None and h <= cut))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64()))], ["row"])

    return unpacked(held.mapInArrow(taken, T.StructType(held.schema.fields[:1])))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
