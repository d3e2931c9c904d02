"""Language ID by multilingual mixture inference.

Training counts hashed byte n-grams (lengths 3 and 4 of the lower-cased text) of labelled documents for
each language, on at most ``TRAIN_DOCS`` documents of a language, those with the smallest hashes of
(doc_id, text). A document is then a mixture: expectation-maximisation finds the proportions of the languages
that make its n-grams likeliest. The language set is chosen by penalised likelihood: starting with the
best single language, a language joins while it raises the log-likelihood by more than the penalty,
log(n) / 2 for its one more proportion times ``PENALTY`` for n-grams that overlap. The prediction is the
language with the largest proportion in the chosen set, and that proportion is the score.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text where nothing
could be learned. Null labels teach nothing. Repeated rows are predicted alike; ties go to the language
first in code-point order. A very long text is one histogram of BUCKETS counts at most. Columns of any name
pass through ``keep_rows`` untouched; the others are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm._common import packed, small_batches, table, unpacked

BUCKETS = 1 << 15
TRAIN_DOCS = 2000
PENALTY = 4.0
ROUNDS = 12
UNKNOWN = "und"
#: Documents are chosen for training by a hash of this many values.
HASHES = 1 << 63
_OTHER = re.compile(r"[\W\d_]+")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and how often each occurs; runs of other than letters are one space."""
    data = np.frombuffer((" " + _OTHER.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    three = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)
    four = three[:-1] * np.uint32(0x27D4EB2F) + data[3:] * np.uint32(0x165667B1) + np.uint32(0x5BD1E995)
    h = np.concatenate((three, four))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    seen = np.bincount(h, minlength=BUCKETS) if len(h) > 4096 else None
    if seen is not None:
        at = np.flatnonzero(seen)
        return at, seen[at]
    return np.unique(h, return_counts=True)


def hash_share(train_docs: int, n: int) -> int:
    """The hash up to which about twice ``train_docs`` of ``n`` documents lie: never none, however many there are."""
    return HASHES - 1 if n <= 2 * train_docs else max(1, 2 * train_docs * HASHES // n)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, n-gram probabilities by language); BUCKETS numbers for each language reach the driver."""
    small_batches(docs.sparkSession)
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    labelled = labelled.withColumn("h", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(HASHES - 1)))
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # A share of the hashes that holds twice as many documents of each language as wanted; the smallest of them are taken.
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(hash_share(train_docs, n)))]) if totals else F.create_map(F.lit(""), F.lit(0))
    near = labelled.where(F.col("h") <= F.element_at(share, F.col("lang")))
    chosen = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("nth") <= train_docs)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, n = gram_counts(text)
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
        for lang, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n])], ["lang", "counts"])

    parts = chosen.select("lang", "text").mapInArrow(count, "lang string, counts array<long>")
    summed = parts.select("lang", F.posexplode("counts").alias("bucket", "n")).where("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("grams")).collect()
    found.sort(key=lambda r: r["lang"].encode("utf-8"))
    model = np.full((len(found), BUCKETS), 0.5)
    for i, r in enumerate(found):
        for g in r["grams"]:
            model[i, g["bucket"]] += g["n"]
    return [r["lang"] for r in found], model / model.sum(axis=1, keepdims=True) if found else model


def mixture(likelihoods: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns' languages by EM, and the log-likelihood they reach."""
    k = likelihoods.shape[1]
    share = np.full(k, 1.0 / k)
    total = counts.sum()
    for _ in range(rounds):
        share = share * (likelihoods.T @ (counts / (likelihoods @ share))) / total
    return share, float(counts @ np.log(likelihoods @ share))


def identify(text: str | None, model: np.ndarray) -> tuple[int, float]:
    """Index of the dominant language (-1: none) and its proportion in the chosen language set."""
    if text is None or not len(model) or not any(map(str.isalpha, text)):
        return -1, 0.0
    at, counts = gram_counts(text)
    p, counts = np.ascontiguousarray(model[:, at].T), counts.astype(float)
    single = counts @ np.log(p)
    chosen, best = [int(single.argmax())], float(single.max())
    if len(model) == 1:
        return chosen[0], 1.0
    share, _ = mixture(p, counts)
    shares = np.array([1.0])
    penalty = PENALTY * 0.5 * np.log(max(counts.sum(), 2.0))
    for lang in map(int, np.argsort(-share, kind="stable")):
        if lang in chosen:
            continue
        found, value = mixture(p[:, [*chosen, lang]], counts)
        if value - best <= penalty:
            break
        chosen, best, shares = [*chosen, lang], value, found
    top = max(range(len(chosen)), key=lambda i: (round(shares[i], 12), -chosen[i]))
    return chosen[top], float(min(1.0, shares[top]))


def predict(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """``rows`` with lang_pred and score in place of their last column, which is the text."""
    small_batches(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast((languages, model))
    names = rows.columns[:-1]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches):
        languages, model = held.value
        for b in batches:
            found = [identify(t, model) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([languages[i] if i >= 0 else UNKNOWN for i, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*names, "lang_pred", "score"])

    return rows.mapInArrow(work, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def keep_rows(docs: DataFrame, least: float = 0.34) -> DataFrame:
    """The rows of ``docs`` with a language: rejected are ``und`` and texts in which none reaches ``least``.

    Where nothing could be learned, nothing is rejected.
    """
    languages, model = train(docs.where(~held_out(F.col("doc_id"))))
    if not languages:
        return docs
    found = predict(packed(docs).select("row", "text"), languages, model)
    return unpacked(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, model = train(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), languages, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
