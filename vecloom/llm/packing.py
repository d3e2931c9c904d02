"""Packing by shortest-pack-first over the length histogram.

Only documents over SEQUENCE tokens are cut, into full sequences and what remains. The histogram of piece lengths (at most 2048 rows) goes to the
driver, where lengths are placed longest first, each into the packs with the fewest tokens that still
have room; packs of the same content are one pattern with a count, so the work does not grow with
the number of documents. Pieces then get a rank within their length and meet the pattern slots by
rank: slots are ranges of ranks, some thousands whatever the corpus size.

Padding fills a sequence up to SEQUENCE tokens unless its length is a power of two; ``padding`` reports it.

Cases: a null text has only the end token. Repeated rows are documents of their own; a null doc_id is
carried through. Ties: pieces of one length are ranked by doc_id, start and checksum; identical rows may
swap places. A very long text is encoded whole. Other columns are ignored, whatever their names. An empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm._common import bucketed_rank, small_batches, table
from vecloom.session import materialize

SEQUENCE = 2048
END = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class ByteBpe:
    """Ids of the tokenizers file ``byte_bpe_50k.json`` from its rank file, as little-endian bytes.

    The rank file holds the same vocabulary; its coder gives the same ids (held so by tests) several
    times faster.
    """

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})

    def encode(self, text: str) -> bytes:
        return self.coder.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


_coders: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(rank_file: str | None = None, pattern: str | None = None) -> ByteBpe:
    """The worker's coder; without arguments, of the installed vocabulary files."""
    if rank_file is None:
        import public_tokenizers

        rank_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    if (rank_file, pattern) not in _coders:
        _coders[rank_file, pattern] = ByteBpe(rank_file, pattern)
    return _coders[rank_file, pattern]


def cut_lengths(tokens: int, sequence: int = SEQUENCE) -> list[int]:
    """Full sequences, then the rest."""
    full, rest = divmod(tokens, sequence)
    return [sequence] * full + [rest] * (rest > 0)


def token_pieces(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every row."""
    small_batches(docs.sparkSession)
    end = END.to_bytes(4, "little")

    def cut(batches):
        coder = byte_bpe(rank_file, pattern)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview((coder.encode(text) if text else b"") + end)
                start, tokens = 0, len(ids) // 4
                for n in cut_lengths(tokens):
                    rows.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), tokens))
                    start += n
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack_histogram(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (count, [(length, times), ...]): lengths longest first, shortest packs first."""
    open_packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by tokens so far
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fill = min((f for f in open_packs if f + length <= sequence), default=None)
            if fill is None:
                fit = sequence // length
                for times in {fit: left // fit, left % fit: 1}.items():
                    if times[0] and times[1]:
                        open_packs[times[0] * length].append((times[1], ((length, times[0]),)))
                break
            count, pattern = open_packs[fill].pop()
            if not open_packs[fill]:
                del open_packs[fill]
            used = min(count, left)
            if count > used:
                open_packs[fill].append((count - used, pattern))
            last = pattern[-1]
            grown = (*pattern[:-1], (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
            open_packs[fill + length].append((used, grown))
            left -= used
    return [(count, list(pattern)) for fill in sorted(open_packs, reverse=True) for count, pattern in open_packs[fill]]


def padding(patterns: list[tuple[int, list[tuple[int, int]]]], sequence: int = SEQUENCE) -> int:
    """Padding tokens of these patterns."""
    fills = [(count, sum(length * times for length, times in pattern)) for count, pattern in patterns]
    return sum(count * (sequence - fill) for count, fill in fills if fill & (fill - 1))


def pattern_slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """A row for each (pattern, length): which ranks of the length it takes, and where they go."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence_id = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, taken[length], times, sequence_id, offset))
            taken[length] += count * times
            offset += length * times
        sequence_id += count
    return pd.DataFrame(rows, columns=["length", "first", "times", "sequence_id", "offset"]).sort_values(["length", "first"])


def pack(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    pieces = materialize(token_pieces(docs, rank_file, pattern), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = pattern_slots(pack_histogram(histogram))
    key = (slots["length"].to_numpy(np.int64) << 44) + slots["first"].to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast((key, *(slots[c].to_numpy(np.int64) for c in ("first", "times", "sequence_id", "offset"))))
    ranked = bucketed_rank(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "_rank", sum(histogram.values()))

    def place(batches):
        key, first, times, sequence_id, offset = held.value
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["_rank"].to_numpy(np.int64)
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            n = rank - first[at]
            out = pdf.drop(columns="_rank")
            out["sequence_id"] = sequence_id[at] + n // times[at]
            out["offset"] = offset[at] + n % times[at] * length
            yield out

    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
