"""Substring dedup by sliding sentence spans, made exact for words.

Spans are runs of consecutive sentences that reach RUN words: from every sentence the shortest such run
forwards, and to every sentence the shortest one backwards. Their hashes are joined globally; a span that
a smaller doc_id has too is removed, so of each repeated passage the first document keeps it. Sentences
end at . ! ? before white space and at line ends. A text's repeats of its own stay unless ``within`` is
set: then all but the first occurrence in the first document go as well.

Sentence spans miss what begins or ends within sentences, so spans of exactly RUN words are held too,
wherever sentences end. Of the windows of GRAM words in such a span, the one of least hash stands for it;
it depends on the words alone, so a span can only recur where its window does. Windows, two for 27 words,
are counted globally, and only spans of a recurring one are hashed and joined. No repeat of RUN words is
missed, and nothing shorter is touched: the size of a span alone decides. What is removed are the words
that spans cover; a sentence that spans cover whole goes whole.

Texts that are equal to that of a smaller doc_id are not hashed: all their spans repeat.

Cases: a null text stays null; a text under RUN words has no span. A row without a doc_id is a document
after all others. Rows with the same doc_id and text are one document and share its fate. Ties cannot be:
the smaller doc_id is first, in a document the earlier place. Case and white space do not matter. Spans are
compared as 64-bit hashes. A very long text is hashed as one array of words. Columns of any name pass
through, but for n_sentences and n_removed; n_removed counts sentences removed whole or in part. An empty
table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm._common import BoundedFilter, packed, small_batches, table
from vecloom.session import Scratch, materialize

RUN, GRAM = 51, 26
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_WORD = re.compile(r"\S+")


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the text's words, and where its sentences begin, as places of words, the end included."""
    words: list[str] = []
    begins = [0]
    for line in text.splitlines():
        for w in line.split():
            words.append(w)
            if w[-1] in ".!?":
                begins.append(len(words))
        if begins[-1] != len(words):
            begins.append(len(words))
    parts = "\n".join(words).lower().encode("utf-8", "surrogatepass").split(b"\n")
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)) if words else np.empty(0, np.uint64), np.array(begins, np.int64)


class Rolling:
    """Hashes of any runs of words, from the hashes of the words."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        up, self.down = (np.multiply.accumulate(np.full(n, x, np.uint64)) for x in (_STEP, _BACK))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the words from ``first`` to before ``last``."""
        g = (self.total[last] - self.total[first]) * self.down[first] + (last - first).astype(np.uint64)
        for by, x in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            g = (g ^ (g >> np.uint64(by))) * np.uint64(x)
        return g ^ (g >> np.uint64(33))

    def every(self, k: int) -> np.ndarray:
        """Of every ``k`` consecutive words."""
        first = np.arange(max(0, len(self.total) - k))
        return self.of(first, first + k)


def sentence_runs(begins: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first word and after the last of the shortest runs of sentences with ``run`` words, from and to each."""
    starts, ends = begins[:-1], begins[1:]
    to = np.searchsorted(ends, starts + run)
    fro = np.searchsorted(starts, ends - run, side="right") - 1
    forward, back = to < len(ends), fro >= 0
    pairs = np.concatenate([np.stack([starts[forward], ends[to[forward]]]), np.stack([starts[fro[back]], ends[back]])], axis=1)
    return tuple(np.unique(pairs, axis=1)) if pairs.shape[1] else (pairs[0], pairs[1])


def least(a: np.ndarray, k: int) -> np.ndarray:
    """The least of every ``k`` consecutive values."""
    if len(a) < k:
        return a[:0]
    w = 1
    while 2 * w <= k:
        a, w = np.minimum(a[:-w], a[w:]), 2 * w
    return np.minimum(a[: len(a) - (k - w)], a[k - w :])


def chosen(rolling: Rolling) -> np.ndarray:
    """For every RUN words, the least hash of their windows of GRAM words."""
    return least(rolling.every(GRAM), RUN - GRAM + 1)


def marks(rolling: Rolling) -> np.ndarray:
    """The hashes of all windows that some RUN words chose, one for each place."""
    g, width = rolling.every(GRAM), RUN - GRAM + 1
    if len(g) < width:
        return g[:0]
    edge = np.zeros(width - 1, np.uint64)
    return g[g == ~least(~np.concatenate([edge, least(g, width), edge]), width)]


def order_of(doc_id: Column, tag: Column) -> Column:
    """The order of documents: doc_id, and those without one after all others, told apart by their text."""
    return F.coalesce(doc_id.cast("long"), F.lit(2**62) + F.shiftrightunsigned(tag, 3))


SPANS = "h long, ord long, tag long, first int, last int"
_NAMES = ["h", "ord", "tag", "first", "last"]


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of SPANS of (hashes, ord, tag, first, last) for each text."""
    joined = lambda i, t: np.concatenate([r[i] for r in rows]).astype(t) if rows else np.empty(0, t)
    n = [len(r[0]) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(joined(0, np.uint64).view(np.int64)), pa.array(np.repeat([r[1] for r in rows], n).astype(np.int64)), pa.array(np.repeat([r[2] for r in rows], n).astype(np.int64)), pa.array(joined(3, np.int32)), pa.array(joined(4, np.int32))], _NAMES)


def spans(keyed: DataFrame) -> DataFrame:
    """SPANS of the sentence runs of ``keyed`` (ord, tag, text), and of its marks, whose first is -1."""

    def work(batches):
        for b in batches:
            rows = []
            for ord_, tag, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, begins = words_of(text or "")
                if len(h) < RUN:
                    continue
                rolling = Rolling(h)
                first, last = sentence_runs(begins)
                rows.append((rolling.of(first, last), ord_, tag, first, last))
                m = marks(rolling)
                rows.append((m, ord_, tag, np.full(len(m), -1), np.full(len(m), -1)))
            yield _spans(rows)

    return keyed.mapInArrow(work, SPANS)


def recurring(found: DataFrame, within: bool) -> DataFrame:
    """h and first_ord of the hashes that several documents have, or one of them several times if ``within``."""
    seen = found.groupBy("h").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("n"))
    return materialize(seen.where("n > 1" if within else "first_ord < last_ord").select("h", "first_ord"), "recurring")


def repeats(found: DataFrame, within: bool) -> DataFrame:
    """ord, tag, first, last of the spans that an earlier document has, or with ``within`` an earlier place of the first one."""
    twice = recurring(found, within)
    met = BoundedFilter(twice, "h", twice.count()).split(found, "h").where("_maybe").select(*_NAMES).join(twice, "h")
    late = met.where(F.col("ord") > F.col("first_ord")).select("ord", "tag", "first", "last")
    if not within:
        return late
    place = F.struct("tag", "first")
    own = met.where(F.col("ord") == F.col("first_ord"))
    first = own.groupBy("h").agg(F.min(place).alias("place"))
    return late.unionByName(own.join(first, "h").where(place != F.col("place")).select("ord", "tag", "first", "last"))


def with_hits(rows: DataFrame, hits: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``columns`` and at, of the rows that surely have no hits and of the others; ``hits`` has hord, htag, at."""
    tested = BoundedFilter(hits, "htag", hits.count()).split(rows, "tag")
    alone = tested.where("NOT _maybe").select(*columns, F.lit(None).cast(hits.schema["at"].dataType).alias("at"))
    met = tested.where("_maybe").join(hits, (F.col("tag") == F.col("htag")) & (F.col("ord") == F.col("hord")), "left").select(*columns, "at")
    return alone, met


def word_spans(keyed: DataFrame, found: DataFrame, within: bool) -> DataFrame:
    """SPANS of all RUN words whose chosen window recurs; ``found`` has the marks."""
    twice = recurring(found, within).select("h")
    maybe = BoundedFilter(twice, "h", twice.count()).split(found, "h").where("_maybe")
    hits = materialize(maybe.join(twice, "h").groupBy(F.col("ord").alias("hord"), F.col("tag").alias("htag")).agg(F.collect_set("h").alias("at")), "marked")  # of one text

    def work(batches):
        for b in batches:
            rows = []
            for ord_, tag, text, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rolling = Rolling(words_of(text)[0])
                here = np.flatnonzero(np.isin(chosen(rolling), np.array(at, np.int64).view(np.uint64)))
                rows.append((rolling.of(here, here + RUN), ord_, tag, here, here + RUN))
            yield _spans(rows)

    met = with_hits(keyed, hits, ["ord", "tag", "text"])[1].where("at IS NOT NULL")
    return materialize(met.mapInArrow(work, SPANS), "word-spans")


def repeated_spans(keyed: DataFrame, within: bool) -> DataFrame:
    """hord, htag, at: ranges of words to remove from each text of ``keyed`` (ord, tag, text); materialized."""
    with Scratch(keyed.sparkSession) as scratch:
        texts = keyed.groupBy("tag").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
        copied = materialize(texts.where("first_ord < last_ord").select("tag", "first_ord"), "copied")
        tested = BoundedFilter(copied, "tag", copied.count()).split(keyed.select("ord", "tag"), "tag").where("_maybe")
        copies = materialize(tested.join(copied, "tag").where(F.col("ord") > F.col("first_ord")).select("ord", "tag").distinct(), "copies")
        held = BoundedFilter(copies, "tag", copies.count()).split(keyed, "tag")
        once = held.where("NOT _maybe").select("ord", "tag", "text").unionByName(held.where("_maybe").join(copies, ["ord", "tag"], "left_anti").select("ord", "tag", "text"))
        found = materialize(spans(once), "spans")
        hits = repeats(found.where("first >= 0"), within).unionByName(repeats(word_spans(once, found.where("first < 0"), within), within))
        at = hits.groupBy(F.col("ord").alias("hord"), F.col("tag").alias("htag")).agg(F.collect_set(F.struct("first", "last")).alias("at"))  # of one text
        whole = copies.select(F.col("ord").alias("hord"), F.col("tag").alias("htag"), F.array(F.struct(F.lit(0).alias("first"), F.lit(2**31 - 1).alias("last"))).alias("at"))
        return scratch.keep(materialize(at.unionByName(whole), "hits"))


def cut(text: str, at: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the words in these ranges, and how many sentences lost something."""
    words = [m.span() for m in _WORD.finditer(text)]
    if len(words) < RUN:
        return text, 0
    begins = words_of(text)[1]
    kept, last, lost = [], 0, set()
    for a, b in joined([(a, min(b, len(words))) for a, b in at]):
        s, e = words[a - 1][1] if a else words[0][0], words[b - 1][1]
        kept.append(text[last:s])
        last = e
        lost.update(range(int(np.searchsorted(begins, a, side="right")) - 1, int(np.searchsorted(begins, b))))
    return "".join([*kept, text[last:]]), len(lost)


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjacent ranges as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def substring_dedup(docs: DataFrame, within: bool = False) -> DataFrame:
    """``docs`` with repeated passages cut from text, and n_sentences, n_removed (in place of columns so named)."""
    small_batches(docs.sparkSession)
    tag = F.xxhash64("text")
    held = packed(docs).withColumn("tag", tag).withColumn("ord", order_of(F.col("doc_id"), F.col("tag")))
    hits = repeated_spans(held.where("text IS NOT NULL").select("ord", "tag", "text"), within)
    alone, met = with_hits(held, hits, ["row"])
    both = alone.unionByName(met)
    schema = T.StructType([both.schema["row"], T.StructField("left", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def work(batches):
        for b in batches:
            texts, total, gone = [], [], []
            for text, at in zip(b.column(0).field("text").to_pylist(), b.column(1).to_pylist(), strict=True):
                left, n = cut(text, [(x["first"], x["last"]) for x in at]) if at and text else (text, 0)
                texts.append(left)
                total.append(sentence_count(text) if text else 0)
                gone.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["row", "left", "n_sentences", "n_removed"])

    added = ("n_sentences", "n_removed")
    kept = [F.col("left").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    return both.mapInArrow(work, schema).select(*kept, *added)


def sentence_count(text: str) -> int:
    return sum(sum(w[-1] in ".!?" for w in words) + (words[-1][-1] not in ".!?") for words in map(str.split, text.splitlines()) if words)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
