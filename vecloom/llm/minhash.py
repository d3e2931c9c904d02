"""MinHash near-dedup: one-permutation sketches, banded buckets, star-shaped candidate edges.

Texts with the same shingle set form one class (128-bit digest of the set), so copies cost nothing
from here on. A class has a one-permutation sketch of 384 bins with optimal densification; 168 of them make
28 bands of 6: a pair at similarity 0.85 misses all of them with probability 2e-6. The smallest class
of each bucket is its centre, and edges lead from the centre to the members: at most one for each
member and band. Edges whose sketches agree are confirmed on the full shingle sets, confirmed links give
components, and buckets are contracted to them.

What stars alone could lose are links between two members of a bucket that the centre does not connect.
Members of buckets that still hold several components are therefore compared inside: those whose
sketches agree, by their LOW smallest shingle hashes, which are the whole set of most texts, so that what
leaves a bucket are links and hardly anything In waves, every component but a bucket's largest proposes its likeliest links out of it, 4 at first
and 8 times as many in each wave; proposals are confirmed, components merge, and waves go on until no
component has a proposal left. So pairs grow with the components, not with the square of a bucket, and
members that stand apart propose nothing. Buckets of more than TILE members are first dealt by the 36 bands
of 6 that the other 216 bins make (a linked pair misses all with probability 2e-5 at similarity 0.80 and
4e-8 at 0.85); what is still larger is compared tile by tile.

Sketch thresholds lie more than four standard errors under the similarity asked for.

Cases: a null text, or one without words, has no set, is linked with nothing and is its own component. A
null doc_id never names a component that has another. Repeated rows are in the same class. Ties between
proposals go to the smaller node, and a component is named by its smallest doc_id. A very long text is
one set, held by a worker with its batch. Shingles are compared as 64-bit hashes. Columns of any name
pass through ``keep_rows`` untouched; other functions ignore them. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import sketch as sk
from vecloom.llm._common import BoundedFilter, packed, small_batches, table, unpacked
from vecloom.operators.components import connected_components
from vecloom.session import Scratch, materialize

#: Leading sketch bytes that star edges carry for the first comparison.
SHORT = 128
#: Members of a tile; a task holds two tiles of 4.5 KB a member at most.
TILE = 2048
#: Smallest shingle hashes (32 bits of each) that members of a mixed bucket are compared by.
LOW = 1024
#: Proposals of a component in the first wave, and how they grow.
FIRST, GROWTH = 4, 8


def _class_key(shingles: np.ndarray) -> bytes | None:
    if not len(shingles):
        return None
    return np.array(sk.set_digest(shingles), np.int64).tobytes()


def _floor(percent: int, bins: int, errors: float = 4.0) -> float:
    p = percent / 100
    return p - errors * (p * (1 - p) / bins) ** 0.5


def _document_key() -> Column:
    """What finds a document's text again: doc_id, or a hash of the text where it is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("dk")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, dk, n_shingles, cls, bands, sketch and a row id for every row of ``docs``; written once."""
    small_batches(docs.sparkSession)

    def work(batches):
        for b in batches:
            sets = [sk.shingle_set(t) for t in b.column(2).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            low: list = [None] * len(sets)
            if full:
                made = sk.sketch_sets([sets[i] for i in full])
                keys, bytes_ = sk.band_keys(made).view(np.int64), made.astype(np.uint8)
                for i, k, v in zip(full, keys, bytes_, strict=True):
                    bands[i], low[i] = k, v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_key(s) for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                ["doc_id", "dk", "n_shingles", "cls", "bands", "sketch"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _document_key(), F.col("text").cast("string").alias("text"))
    made = picked.mapInArrow(work, "doc_id long, dk long, n_shingles long, cls binary, bands array<long>, sketch binary")
    return materialize(made.withColumn("rid", F.monotonically_increasing_id()), "sketches")


class Classes:
    """The classes of equal shingle sets; a class goes by the smallest row id in it, its node."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.where("cls IS NOT NULL")
        self.reps = materialize(self.rows.groupBy("cls").agg(F.min("rid").alias("node"), F.count("*").alias("n")), "reps")
        again = self.rows.select("rid", "cls").join(self.reps.where("n > 1"), "cls").where("rid <> node").select("rid")
        again = materialize(again, "copies")
        self.copies = BoundedFilter(again, "rid", again.count())

    def get(self, *cols: str) -> DataFrame:
        """node and these columns, a row a class; only possible copies are shuffled."""
        tested = self.copies.split(self.rows.select("rid", *cols), "rid")
        alone, rest = tested.where("NOT _maybe"), tested.where("_maybe").join(self.reps.select(F.col("node").alias("rid")), "rid", "left_semi")
        return alone.unionByName(rest).select(F.col("rid").alias("node"), *cols)


def confirm(edges: DataFrame, docs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``edges`` whose full sets are linked. Texts travel, which are smaller than their sets."""
    info = rows.select("rid", "dk", "cls")
    a, b = (info.select(F.col("rid").alias(x), F.col("dk").alias(f"d{x}"), F.col("cls").alias(f"c{x}")) for x in "ab")
    known = materialize(edges.join(a, "a").join(b, "b"), "pairs")
    keys = known.select(F.col("da").alias("dk")).union(known.select("db")).distinct()
    ids = BoundedFilter(keys, "dk", keys.count())
    texts = ids.split(docs.select(_document_key(), F.col("text").cast("string").alias("text")), "dk").where("_maybe")
    ta, tb = texts.select(F.col("dk").alias("da"), F.col("text").alias("ta")), texts.select(F.col("dk").alias("db"), F.col("text").alias("tb"))
    met = known.join(tb, "db").join(ta, "da").select("a", "b", "ca", "cb", "ta", "tb")

    def work(batches):
        last: tuple = (None, None, None)
        for x in batches:
            good = []
            for ca, cb, text_a, text_b in zip(*(x.column(i).to_pylist() for i in range(2, 6)), strict=True):
                if text_a != last[0]:
                    found = sk.shingle_set(text_a)
                    last = (text_a, found, _class_key(found))
                other = sk.shingle_set(text_b)
                # Of rows repeated under one doc_id, those of another class are not meant.
                good.append(last[2] == ca and sk.linked(last[1], other, percent) and _class_key(other) == cb)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), x.column(1).filter(keep)], ["a", "b"])

    return materialize(met.mapInArrow(work, "a long, b long").distinct(), "links")


def bucket_members(classes: Classes) -> DataFrame:
    """key, node, n for the members of buckets with two classes or more; written once."""
    posted = classes.get("bands").select("node", F.explode("bands").alias("key"))
    stars = materialize(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "stars")
    maybe = BoundedFilter(stars, "key", stars.count()).split(posted, "key").where("_maybe").drop("_maybe")
    return materialize(maybe.join(stars, "key").select("key", "node", "n"), "members")


def star_edges(members: DataFrame, classes: Classes, percent: int) -> DataFrame:
    """(a, b): the centre of some bucket and another member, where sizes and short sketches allow a link."""
    centres = members.groupBy("key").agg(F.min("node").alias("centre"))
    edges = members.join(centres, "key").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    short = classes.get("sketch", "n_shingles").select("node", F.substring("sketch", 1, SHORT).alias("short"), F.col("n_shingles").alias("n"))
    one = lambda x: short.select(F.col("node").alias(x), F.col("short").alias(f"k{x}"), F.col("n").alias(f"n{x}"))
    met = edges.join(one("b"), "b").join(one("a"), "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    least = _floor(percent, SHORT)

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            good = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["a", "b"])

    return materialize(met.select("a", "b", "ka", "kb").mapInArrow(work, "a long, b long"), "edges")


def mixed_members(members: DataFrame, component: DataFrame) -> DataFrame:
    """key, node, n, comp of the buckets that hold several components."""
    labelled = members.join(component, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return materialize(labelled.join(mixed, "key", "left_semi"), "mixed")


def low_hashes(mixed: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, low: the LOW smallest hashes of the sets of these members, sorted; written once."""
    nodes = mixed.select(F.col("node").alias("rid")).distinct()
    wanted = rows.select("rid", F.col("dk").alias("wdk"), "cls").join(nodes, "rid")
    ids = BoundedFilter(wanted.select("wdk").distinct(), "wdk", nodes.count())
    texts = ids.split(docs.select(_document_key(), F.col("text").cast("string").alias("text")), "dk").where("_maybe").select("dk", "text")

    def work(batches):
        for b in batches:
            sets = [sk.shingle_set(t) for t in b.column(1).to_pylist()]
            low = [(x >> np.uint64(32)).astype(np.uint32)[:LOW].tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_class_key(x) for x in sets], pa.binary()), pa.array(low, pa.binary())], ["dk", "c", "low"])

    made = texts.mapInArrow(work, "dk long, c binary, low binary")
    met = made.join(wanted, (F.col("dk") == F.col("wdk")) & (F.col("c") == F.col("cls")))
    return materialize(met.groupBy(F.col("rid").alias("node")).agg(F.first("low").alias("low")), "low")


def similar(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int) -> bool:
    """Whether sets of these sizes can be linked, by their smallest hashes: decided if both are whole, else by four standard errors."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    if nx <= LOW and ny <= LOW:
        shared = int((both[1:] == both[:-1]).sum())
        return 100 * shared >= percent * (len(both) - shared) - 200  # two hashes may be equal by chance, or once in a set
    double = both[1:] == both[:-1]
    kept = min(LOW, len(both) - int(double.sum()))
    first = np.flatnonzero(np.concatenate(([True], ~double)))  # where each distinct value begins
    last = first[kept] if kept < len(first) else len(both)
    return last / kept - 1 >= _floor(percent, kept)


def proposals(mixed: DataFrame, classes: Classes, low: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b, more: for every component but the largest of each bucket, the ``most`` likeliest links out of it, and whether there are others."""
    sketched = classes.get("sketch", "n_shingles")
    small = mixed.where(F.col("n") <= TILE).select("key", F.lit(0).cast("long").alias("sub"), "node", "comp")
    hot = mixed.where(F.col("n") > TILE).select("key", "node", "comp")
    dealt = small
    if not hot.isEmpty():
        keys = sketched.select("node", other_bands(F.col("sketch")).alias("subs"))
        dealt = small.unionByName(hot.join(keys, "node").select("key", F.explode("subs").alias("sub"), "node", "comp"))
        sizes = dealt.groupBy("key", "sub").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "sub", "n")
        dealt = dealt.join(sizes, ["key", "sub"])
    else:
        dealt = dealt.withColumn("n", F.lit(0).cast("long"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
    dealt = dealt.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.select("key", "sub", "node", "comp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("key", "sub", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "node", "comp")
    rows = dealt.join(sketched, "node").join(low, "node").repartition("key", "sub", "ti", "tj").sortWithinPartitions("key", "sub", "ti", "tj")
    least = _floor(percent, sk.BINS)

    def best(group):
        node, comp, size = (np.array(group[c], np.int64) for c in ("node", "comp", "n_shingles"))
        sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(node), -1)
        sets = [np.frombuffer(x, np.uint32) for x in group["low"]]
        names, place, counts = np.unique(comp, return_inverse=True, return_counts=True)
        largest = int(counts.argmax())
        for c in range(len(names)):
            if c == largest:
                continue
            own, rest = np.flatnonzero(place == c), np.flatnonzero(place != c)
            found = []
            for i in own:
                near = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
                agree = (sketch[near] == sketch[i]).mean(axis=1)
                for j, x in zip(near[agree >= least].tolist(), agree[agree >= least].tolist(), strict=True):
                    if similar(sets[i], sets[j], size[i], size[j], percent):
                        found.append((-x, int(node[j]), int(node[i])))
            found.sort()
            for _, x, y in found[:most]:
                yield min(x, y), max(x, y), len(found) > most

    def work(batches):
        for group in groups_of(batches, ["key", "sub", "ti", "tj"]):
            found = list(best(group))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "more"])

    picked = rows.select("key", "sub", "ti", "tj", "node", "comp", "sketch", "n_shingles", "low")
    return materialize(picked.mapInArrow(work, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more")), "proposals")


def other_bands(sketch: Column) -> Column:
    """Keys of the bands that the bins outside the buckets' own bands make."""
    first = sk.ROWS * sk.BANDS
    return F.array(*(F.xxhash64(F.substring(sketch, first + 1 + i, sk.ROWS), F.lit(i)) for i in range(0, sk.BINS - first, sk.ROWS)))


def groups_of(batches, keys: list[str]):
    """Runs of equal keys in sorted batches, each as a dict of lists; holds one group at a time."""
    held: dict[str, list] = {}
    last = None
    for b in batches:
        cols = b.to_pydict()
        tags = list(zip(*(cols[k] for k in keys), strict=True))
        start = 0
        for i in range(len(tags) + 1):
            if i < len(tags) and (i == 0 or tags[i] == tags[i - 1]):
                continue
            if start < i:
                if held and tags[start] != last:
                    yield held
                    held = {}
                for c, v in cols.items():
                    held.setdefault(c, []).extend(v[start:i])
                last = tags[start]
            start = i
    if held:
        yield held


def merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after these links."""
    return connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), "a", "b")


def linked_classes(classes: Classes, docs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """node, component of all classes that are linked with another. What a step writes is deleted after it."""
    spark = docs.sparkSession
    with Scratch(spark) as all_steps:
        with Scratch(spark) as step:
            members = step.keep(bucket_members(classes))
        with Scratch(spark) as step:
            links = confirm(star_edges(members, classes, percent), docs, rows, percent)
            component = step.keep(connected_components(links, "a", "b"))
        with Scratch(spark) as step:
            low = step.keep(low_hashes(mixed_members(members, component), docs, rows))
        tried, most, open_ = None, FIRST, True
        while open_:
            with Scratch(spark) as step:
                found = proposals(mixed_members(members, component), classes, low, percent, most)
                new = found.select("a", "b")
                new = step.keep(materialize(new if tried is None else new.join(tried, ["a", "b"], "left_anti"), "new"))
                links = None if new.isEmpty() else confirm(new, docs, rows, percent)
                if links is not None and not links.isEmpty():
                    component = step.keep(merged(component, links))
                else:
                    open_ = not found.where("more").isEmpty()
            tried = new if tried is None else tried.unionByName(new)
            most *= GROWTH
        return all_steps.keep(component)


def near_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, cls, component_id, members for every row of ``docs``."""
    with Scratch(docs.sparkSession) as scratch:
        rows = sketches(docs)
        classes = Classes(rows)
        component = linked_classes(classes, docs, rows, percent)
        rooted = classes.reps.join(component, "node", "left").select("cls", F.coalesce("component", "node").alias("root"))
        named = rows.select("doc_id", "n_shingles", "cls").join(rooted, "cls", "left")
        names = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("named"), F.count("*").alias("members"))
        out = named.join(names, "root", "left")
        component_id = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("named")).alias("component_id")
        return scratch.keep(materialize(out.select("doc_id", "n_shingles", "cls", component_id, F.coalesce("members", F.lit(1)).alias("members")), "near"))


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    found = near_components(docs, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_rows(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each component (that of the smallest doc_id), in the columns of ``docs``.

    Documents in no group of two or more pass without a shuffle.
    """
    grouped = materialize(near_components(docs, percent).where("members > 1").select("doc_id", "cls", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "decisions")
    ids = grouped.select("doc_id").distinct()
    tested = BoundedFilter(ids, "doc_id", ids.count()).split(packed(docs), "doc_id")
    surely = F.col("_maybe") | F.col("doc_id").isNull()
    rest = tested.where(surely).select("row", "doc_id", "text")
    schema = T.StructType([*rest.schema.fields[:2], T.StructField("cls", T.BinaryType())])

    def work(batches):
        for b in batches:
            keys = pa.array([_class_key(sk.shingle_set(t)) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys], ["row", "doc_id", "cls"])

    decisions = grouped.groupBy(F.col("doc_id").alias("did"), F.col("cls").alias("dcls")).agg(F.max("kept").alias("kept"))
    met = rest.mapInArrow(work, schema).join(decisions, F.col("doc_id").eqNullSafe(F.col("did")) & (F.col("cls") == F.col("dcls")), "left")
    single, paired = met.where("kept IS NULL").select("row"), met.where("kept").dropDuplicates(["doc_id", "cls"]).select("row")
    return unpacked(tested.where(~surely).select("row").unionByName(single).unionByName(paired))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


#: Exact by pairs: for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
l AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
t(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT t.doc_id, l.y FROM t JOIN l ON l.x = t.r),
m AS (SELECT doc_id, min(r) AS component_id FROM t GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
