"""Secret scans: fixed patterns, and random strings told from identifiers by character Markov models.

Two second-order character models are trained from labelled samples: random strings (drawn over the
alphabets of keys) and ordinary tokens (identifiers joined from a word list in the usual spellings, long
words of several languages, numbers, dates and rules). Candidates are the longest runs of ``ALPHABET`` of
``SHORTEST`` characters or more; one is reported when its log-likelihood ratio per character under the two
models exceeds ``THRESHOLD`` and no pattern's span touches it. Nothing else decides.

Cases: a null text is empty and has no spans. Offsets count code points, ends are exclusive. Ties: spans with
one start are ordered by kind. Repeated rows are scanned alike. A very long text is scanned whole, in linear
time. Other columns are ignored, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm._common import small_batches, table

KINDS = ("assign", "access", "hex", "random")
# Fixed patterns; a match of assign counts by its second group.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A quick look for what every assign match holds.
_SIGN = re.compile(r"(?:word|sswd|cret|oken|ikey|_key)[\"']?\x20*[:=]", re.IGNORECASE | re.ASCII)
#: Fewest characters of a candidate: below, the ratio of a few triples says too little.
SHORTEST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Log-likelihood ratio in nats a character from which a token counts as random: of held-out random strings
#: 3 in 20,000 score less; rare words and names of uncommon spelling can score more.
THRESHOLD = 1.0
#: Labelled samples drawn for each model; a documented bound, not a share of the corpus.
SAMPLES = 6000
# Ordinary words of identifiers, from which labelled negatives are joined.
WORDS = (
    "account active address amount array attribute author balance batch block body buffer build button byte cache "
    "call category cell center change channel char check child class client code color column command comment common "
    "compare config connect content context control copy count create current customer data date default delete "
    "description detail device directory display document domain double download edit element email enable encode end "
    "entry error event example execute export extension factory feature field file filter final first flag float folder "
    "font footer format frame function global graph group handle handler hash header height hidden history host hour "
    "image import index info init inner input insert instance integer interface internal invoice item iterator job join "
    "key label language last layer layout left length level library limit line link list load local location lock log "
    "main manager map mask master match max memory menu message method min minute mode model module month mouse name "
    "network next node normal note number object offset option order origin output owner package page panel parameter "
    "parent parse part path pattern payment person phone pixel player point pointer position post previous price print "
    "process product profile project property provider public query queue range rate read record region register remote "
    "render report request reset resource response result return right role root row rule sample scale scene schema "
    "score screen script search second section segment select sequence server service session setting shape sheet size "
    "sort source space spec stack start state static status step stop store stream string style submit sum support table "
    "target task template test text thread time title total track transfer tree trigger type unit update upload user "
    "value variable vector version video view visible width window word worker wrapper write year zone"
).split()

# Ordinary words and endings of prose in several languages, from which long words are joined.
PROSE = (
    "the and that with from this have which would there their about other under over after first people because through "
    "being little should without another nation tion ment ness able ing ed er ation ism ist ity ful less ance ence "
    "der die das und ein eine nicht mit sich auch auf werden aus haben nach wie wir zur zum durch kein keit heit ung lich "
    "isch schaft chen bar sam ver be ge ent zer ab an auf ein haupt bund land staat arbeit zeit stadt wirtschaft recht schule "
    "le la les des que une dans pour pas plus par sur avec sont cette mais comme tout fait elle ement eux euse ique aire eur "
    "oire ance tre re con par el los las por una para como pero sus este entre cuando muy sin sobre tambien hasta donde cion "
    "idad mente ador ando iendo oso il di che non per del una sono della piu nel alla anche zione mento ista are ere ire"
).split()


def long_words(rng: random.Random, n: int) -> list[str]:
    out = []
    for _ in range(n):
        text = "".join(rng.choices(PROSE, k=rng.randint(4, 10)))
        out.append((text, text.title(), text.upper())[rng.choices((0, 1, 2), (6, 3, 1))[0]])
    return out


def numbers(rng: random.Random, n: int) -> list[str]:
    """Digits, dates, times, amounts and rules of one repeated sign."""
    digits = lambda low, high: "".join(rng.choices(ALPHABET[52:62], k=rng.randint(low, high)))
    out = []
    for _ in range(n):
        style = rng.randrange(4)
        if style == 0:
            out.append(digits(16, 40))
        elif style == 1:
            out.append("-".join(digits(2, 6) for _ in range(rng.randint(3, 8))))
        elif style == 2:
            out.append(rng.choice("-=_/+") * rng.randint(20, 80))
        else:
            out.append(f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}-{rng.randint(0, 59):02d}-{rng.randint(0, 59):02d}Z")
    return out


def random_strings(rng: random.Random, n: int) -> list[str]:
    kinds = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + "0123456789")
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randint(20, 64))) for _ in range(n)]


def identifiers(rng: random.Random, n: int) -> list[str]:
    out = []
    for _ in range(n):
        words = rng.choices(WORDS, k=rng.randint(2, 7))
        style = rng.randrange(6)
        if style == 0:
            text = words[0] + "".join(w.title() for w in words[1:])
        elif style == 1:
            text = "".join(w.title() for w in words)
        else:
            text = ("_", "-", "/", "_")[style - 2].join(words)
            text = text.upper() if style == 5 else text
        number = rng.choice(("", "", str(rng.randint(0, 99)), f"_{rng.randint(1990, 2030)}", f"-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", "0" * rng.randint(3, 12)))
        out.append(text + number)
    return out


class MarkovRatio:
    """log P(token | random) - log P(token | identifier), a character, by second-order models."""

    def __init__(self, positives: list[str], negatives: list[str]):
        self.code = np.full(256, len(ALPHABET), np.int64)
        self.code[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
        self.ratio = self._model(positives) - self._model(negatives)

    def _codes(self, token: str) -> np.ndarray:
        return self.code[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]

    def _model(self, samples: list[str]) -> np.ndarray:
        n = len(ALPHABET) + 1
        pair, triple = np.full((n, n), 0.2), np.zeros((n, n, n))
        for s in samples:
            c = self._codes(s)
            np.add.at(pair, (c[:-1], c[1:]), 1)
            np.add.at(triple, (c[:-2], c[1:-1], c[2:]), 1)
        backoff = pair / pair.sum(axis=1, keepdims=True)
        return np.log((triple + 8 * backoff[None]) / (triple.sum(axis=2, keepdims=True) + 8))

    def score(self, token: str) -> float:
        c = self._codes(token)
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean()) if len(c) > 2 else 0.0


def train(seed: int = 11, samples: int = SAMPLES) -> MarkovRatio:
    rng = random.Random(seed)
    ordinary = identifiers(rng, samples) + long_words(rng, samples) + numbers(rng, samples // 4)
    return MarkovRatio(random_strings(rng, samples), ordinary)


_trained: list[MarkovRatio] = []


def model() -> MarkovRatio:
    """The worker's model: a function of the seed alone, so all workers agree."""
    if not _trained:
        _trained.append(train())
    return _trained[0]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if _SIGN.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], ratio: MarkovRatio) -> list[tuple[int, int, int]]:
    """(start, 3, end) of candidates that the models call random and no base span touches."""
    out, i, ends = [], 0, 0  # base spans that start before a candidate ends, and where the furthest of them ends
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while i < len(base) and base[i][0] < e:
            ends = max(ends, base[i][2])
            i += 1
        if ends <= s and ratio.score(m[0]) > THRESHOLD:
            out.append((s, 3, e))
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every row of ``docs``."""
    small_batches(docs.sparkSession)

    def work(batches):
        ratio = model()
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                more = random_spans(text or "", base, ratio)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + more)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds_ = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds_, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask``; overlapping spans become one."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(text: str | None, ratio: MarkovRatio) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        out, done = [], 0
        for s, _, e in sorted(base + random_spans(text, base, ratio)):
            if e <= done:
                continue
            if s >= done:
                out += [text[done:s], mask]
            done = e
        return "".join(out) + text[done:]

    def work(batches):
        ratio = model()
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([clean(t, ratio) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(work, docs.schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
