"""WARC archives with a two-level capture index.

Records are written as they are read, by Spark's text sink: a row is a record's header and block, and
the line separator is the record's end, so each part file is a plain WARC file in any store that Spark
can write. The index is built from the archives as they were written: lines (key, page, file, offset,
length, type) sorted by reversed-host URL key over all files, in compressed blocks of BLOCK_LINES, and
a sparse directory with the first and last key of each block. A lookup binary-searches the directory,
then the block, and reads byte ranges of the archives.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is a
response; the others revisit it and have no payload of their own.

Cases: a null html is an empty payload; a null url has the empty key. Control characters in a URL are
percent-encoded. Rows repeated under one page_id with one payload have the same type; a null page_id
is never referred to while the payload has another, and its records are responses. Payloads are equal
when SHA-1, SHA-256 and length are. Ties: captures of one key are ordered by file and offset. A very long
page is one record, held whole by a worker. Other columns are ignored, whatever their names. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm._common import BoundedFilter, small_batches, table
from vecloom.session import fresh_path, materialize

RECORD_END = "\r\n\r\n"
#: Bytes of payload a file holds on average; files are split by their number of records.
FILE_BYTES = 16 << 20
BLOCK_LINES = 1000
#: Bytes of archives that one task reads back on average.
TASK_BYTES = 64 << 20
#: Most directory entries that a lookup broadcasts; beyond, keys meet the decoded lines by a join.
DIRECTORY_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"

_URL = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)")
ENTRY = "key string, page_id long, file string, offset long, length long, type string, refers_to long"
BLOCK = "block string, first_key string, last_key string, lines long, data binary"


def _lines(rows: list) -> pa.RecordBatch:
    """Index lines as a batch of ENTRY."""
    cols = list(zip(*rows, strict=True)) or [()] * 7
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "page_id", "file", "offset", "length", "type", "refers_to"])


def url_key(url: str | None) -> str:
    """The host's labels reversed, then the rest: ``org,example,www)/path?query``."""
    m = _URL.match(url or "")
    if not m:
        return (url or "").lower()
    host = ",".join(reversed(m[2].lower().split(".")))
    port = "" if m[3] in (None, {"http": "80", "https": "443"}.get(m[1].lower())) else f":{m[3]}"
    return f"{host}{port}){m[4] or '/'}"


def target_uri(url: str | None) -> str:
    """The URL as its record says it: control characters and blanks percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, page: str | None, refers_to: int | None) -> str:
    """A record without its end: a response, or a revisit of the page ``refers_to``."""
    payload = (page or "").encode("utf-8")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block_bytes = len(http) + (len(payload) if refers_to is None else 0)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target_uri(url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block_bytes}"]
    return "\r\n".join(lines) + RECORD_END + http + ((page or "") if refers_to is None else "")


def read_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload, and where the next record starts."""
    split = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at:split].decode("utf-8").split("\r\n")[1:])
    start, size = split + 4, int(fields["Content-Length"])
    block = data[start : start + size]
    return fields, block[block.index(b"\r\n\r\n") + 4 :], start + size + len(RECORD_END)


def page_of(urn: str | None) -> int | None:
    value = urn.removeprefix("<urn:x-page:").removesuffix(">") if urn else ""
    return int(value) if value else None


class Archive:
    """Archives and their index, all under one path in the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.spark, self.path = spark, str(self._files.makeQualified(at).toString())
        path = self.path  # with its scheme, which decides how read() reads
        self.records, self.blocks = f"{path}/records", f"{path}/blocks"

    @classmethod
    def write(cls, pages: DataFrame, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> Archive:
        """Write a record for each row of ``pages`` (page_id, url, html) and index them."""
        spark = pages.sparkSession
        small_batches(spark)
        found = cls(spark, fresh_path(spark, "warc"))
        body = F.coalesce(F.col("html").cast("string"), F.lit(""))
        raw = body.cast("binary")
        tag = F.struct(F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"), F.octet_length(body).alias("n"))
        keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), tag.alias("tag"))
        seen = materialize(keyed.select("page_id", "tag"), "payloads")
        total = seen.agg(F.sum("tag.n")).first()[0] or 0
        groups = seen.groupBy("tag").agg(F.max("page_id").alias("held"), F.count("*").alias("rows"), F.min("page_id").alias("low"))
        groups = groups.where((F.col("rows") > 1) & (F.col("tag.n") >= least_bytes) & F.col("held").isNotNull() & (F.col("low") < F.col("held")))
        refers = seen.join(groups.select("tag", "held"), "tag").where("page_id < held").select(F.col("page_id").alias("_pid"), F.col("tag.sha256").alias("_sha"), "held").distinct()
        refers = materialize(refers, "revisits")
        # Only pages that may be revisits travel to their reference.
        tested = BoundedFilter(refers, "_pid", refers.count()).split(keyed, "page_id")
        alone = tested.where("NOT _maybe").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
        on = (F.col("p.page_id") == F.col("r._pid")) & (F.col("p.tag.sha256") == F.col("r._sha"))
        met = tested.where("_maybe").alias("p").join(refers.alias("r"), on, "left").select("p.page_id", "p.url", "p.html", F.col("r.held").alias("refers_to"))
        marked = alone.unionByName(met)

        def records(batches):
            for b in batches:
                page_id, url, page, refers_to = (c.to_pylist() for c in b.columns)
                yield pa.RecordBatch.from_arrays([pa.array(map(record, page_id, url, page, refers_to), pa.string())], ["value"])

        rows = seen.count()
        each = max(1, rows * file_bytes // max(total, 1))  # records of average size that fill a file
        marked.mapInArrow(records, "value string").write.option("lineSep", RECORD_END).option("maxRecordsPerFile", each).text(found.records)
        found.build_index()
        return found

    def build_index(self) -> None:
        """Read the archives as they are and write their lines, sorted, in compressed blocks."""

        def scan(batches):
            for b in batches:
                for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data, at, lines = data.as_buffer().to_pybytes(), 0, []
                    while at < len(data):
                        fields, _, after = read_record(data, at)
                        lines.append((url_key(fields["WARC-Target-URI"]), page_of(fields["WARC-Record-ID"]), file, at, after - at, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To"))))
                        at = after
                    yield _lines(lines)

        def pack(batches):
            from pyspark import TaskContext

            held, n = [], 0

            def block():
                part = TaskContext.get().partitionId()
                data = zlib.compress("\n".join(map(json.dumps, held)).encode())
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((f"{part}-{n}", pa.string()), (held[0][0], pa.string()), (held[-1][0], pa.string()), (len(held), pa.int64()), (data, pa.binary()))], ["block", "first_key", "last_key", "lines", "data"])

            for b in batches:
                for line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append(line)
                    if len(held) == BLOCK_LINES:
                        yield block()
                        held, n = [], n + 1
            if held:
                yield block()

        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(self.records).select("path", "content")
        lines = materialize(files.mapInArrow(scan, ENTRY), "lines")
        ordered = lines.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
        ordered.mapInArrow(pack, BLOCK).write.parquet(self.blocks)

    def index(self) -> DataFrame:
        return self.spark.read.schema(BLOCK).parquet(self.blocks)

    def directory(self) -> DataFrame:
        """One row a block: first_key, last_key, block."""
        return self.index().select("first_key", "last_key", "block")

    def entries(self, blocks: DataFrame | None = None) -> DataFrame:
        """The index lines of all blocks, or of these."""

        def decode(batches):
            for b in batches:
                for data in b.column(0).to_pylist():
                    yield _lines(list(map(json.loads, zlib.decompress(data).decode().split("\n"))))

        return (self.index() if blocks is None else blocks).select("data").mapInArrow(decode, ENTRY)

    def lookup(self, urls: DataFrame, limit: int = DIRECTORY_ROWS) -> DataFrame:
        """Index lines of the captures of ``urls`` (url).

        Each key is binary-searched in the sparse directory; only the blocks found are decoded. A directory of more
        than ``limit`` entries is not broadcast: keys meet the decoded lines by a join, with the same result.
        """
        small_batches(self.spark)
        key_of = lambda batches: (pa.RecordBatch.from_arrays([pa.array([url_key(target_uri(u)) for u in b.column(0).to_pylist()], pa.string())], ["key"]) for b in batches)
        keys = urls.select(F.col("url").cast("string").alias("url")).mapInArrow(key_of, "key string").distinct()
        if self.index().count() > limit:
            return self.entries().join(keys, "key", "left_semi")
        rows = sorted((r["first_key"], r["last_key"], r["block"]) for r in self.directory().toLocalIterator())
        held = self.spark.sparkContext.broadcast(([r[0] for r in rows], rows))

        def search(batches):
            firsts, rows = held.value
            for b in batches:
                out = []
                for key in b.column(0).to_pylist():
                    i = bisect.bisect_right(firsts, key) - 1
                    while i >= 0 and rows[i][1] >= key:  # a key may fill several blocks in a row
                        out.append((key, rows[i][2]))
                        i -= 1
                cols = list(zip(*out, strict=True)) or [()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["key", "block"])

        wanted = keys.mapInArrow(search, "key string, block string").select("block").distinct()
        blocks = self.index().join(wanted, "block", "left_semi")
        return self.entries(blocks).join(keys, "key", "left_semi")

    def read(self, entries: DataFrame) -> DataFrame:
        """page_id, type, refers_to, digest (as the record says), payload of index lines, by range reads of the archives."""
        schema = "page_id long, type string, refers_to long, digest string, payload binary"

        def parsed(data: bytes):
            fields, payload, _ = read_record(data)
            return page_of(fields["WARC-Record-ID"]), fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload

        def out(rows):
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["page_id", "type", "refers_to", "digest", "payload"])

        def ranges(batches):
            files: dict = {}
            for b in batches:
                rows = []
                for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if file not in files:
                        for f in files.values():
                            f.close()
                        store, path = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", file))
                        files = {file: store.open_input_file(path)}
                    rows.append(parsed(files[file].read_at(length, offset)))
                yield out(rows)

        def slices(batches):
            for b in batches:
                for data, places in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    data = data.as_buffer()
                    yield out([parsed(data.slice(p["offset"], p["length"]).to_pybytes()) for p in places])

        picked = entries.select("file", "offset", "length")
        if self.records.split(":", 1)[0] in ("file", "hdfs", "s3", "gs"):
            # Lines come in the order of keys: dealt by file, each archive is opened by one task and read forwards.
            bytes_ = self._files.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(self.records)).getLength()
            parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), bytes_ // TASK_BYTES + 1)
            return picked.repartition(parts, "file").sortWithinPartitions("file", "offset").mapInArrow(ranges, schema)
        places = picked.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("places"))  # of one file: bounded by its size
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(self.records)
        return files.join(places, files["path"] == places["file"]).select("content", "places").mapInArrow(slices, schema)


def captures(archive: Archive, urls: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture of ``urls`` (url).

    Their keys are searched in the directory; index lines of the blocks found lead to the records. A revisit has the
    bytes of its response, which may stand under another URL: name it among ``urls``, or its bytes are null.
    """

    def measure(batches):
        for b in batches:
            sizes = [len(x.as_buffer()) if t == "response" else None for x, t in zip(b.column(4), b.column(1).to_pylist(), strict=True)]
            digests = [payload_digest(x.as_buffer()) if n is not None else said for x, n, said in zip(b.column(4), sizes, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), b.column(1), b.column(2)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    read = archive.read(archive.lookup(urls)).mapInArrow(measure, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    read = materialize(read, "captures")
    # One page_id may stand on several pages: a revisit meets the response of its digest.
    held = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("_held"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    same = (F.col("refers_to") == F.col("_held")) & (F.col("payload_digest") == F.col("_digest"))
    again = read.where("record_type = 'revisit'").drop("payload_bytes").join(held, same, "left")
    again = again.select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return read.where("record_type = 'response'").unionByName(again)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return captures(Archive.write(pages), pages)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS held FROM pages),
b AS (SELECT *, unhex(sha1(html))::BIT::VARCHAR AS bits FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, i * 5 + j + 1, 1)::INT * (16 >> j)))::INT, 1)), '') AS payload_digest,
CASE WHEN page_id = held THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = held THEN NULL ELSE held END AS refers_to FROM b
"""
