"""WARC archives as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans partitions from the files' sizes (small files together), pushes predicates on record type and header columns down, and parses a
record's headers before anything else. A record that a predicate rejects, or whose payload isn't asked for, is passed over without its
payload being inflated or copied: in plain files by its Content-Length, in gzip members by the compressed length that this writer puts into the
member's extra field ("sl", two uint32: compressed and full length); members of other writers without it are inflated and thrown away.

Writing gives each task its own files of gzip members, one record each; the driver commits them by a manifest, so that files of failed
or repeated tasks are never read. A folder without a manifest is read by its *.warc and *.warc.gz files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from gridlogic.llm.common import checkpointed, join_dealt, ready, table, work_path

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, payload binary"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of files that one task reads; of a file before the writer begins the next; of rows in a batch.
SPLIT_BYTES, FILE_BYTES, BATCH_BYTES = 64 << 20, 256 << 20, 4 << 20
DATE = "1970-01-01T00:00:00Z"


def member(record: bytes, level: int = 5) -> bytes:
    """A gzip member whose extra field tells its own length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A response, or a revisit with the HTTP headers alone. Line ends cannot be in a header: they become spaces."""
    length = row["payload_length"] if row["payload"] is None else len(row["payload"])
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (length or 0)
    if row["record_type"] != "revisit":
        block += row["payload"] or b""
    lines = ["WARC/1.1", *(f"{name}: {re.sub(r'[\r\n]+', ' ', row[c])}" for c, name in HEADERS.items() if row[c] is not None)]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def manifest(store: fs.FileSystem, root: str) -> list | None:
    """[name, size] of each committed file; None without a manifest."""
    found = store.get_file_info([f"{root}/_manifest.json"])[0]
    if found.type != fs.FileType.File:
        return None
    with store.open_input_stream(found.path) as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite
        store, root = fs.FileSystem.from_uri(path)
        self.replaced = (manifest(store, root) or []) if overwrite else []

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        files, out, size = [], None, 0
        for batch in iterator:
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            for k in range(batch.num_rows):
                data = member(record({c: v[k].as_py() for c, v in columns.items()}))
                if out is None or size + len(data) > FILE_BYTES:
                    if out is not None:
                        out.close()
                        files[-1] = (files[-1][0], size)
                    files.append((f"{uuid.uuid4().hex}.warc.gz", 0))
                    out, size = store.open_output_stream(f"{root}/{files[-1][0]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files[-1] = (files[-1][0], size)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest names the files of earlier appends too; it is the one thing that tells which files count."""
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root)
        earlier = [] if self.overwrite else manifest(store, root) or []
        with store.open_output_stream(f"{root}/_manifest.json") as f:
            f.write(json.dumps([*earlier, *(list(x) for m in messages if m for x in m.files)]).encode())
        if self.overwrite:
            for name, _ in self.replaced:
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                store.delete_file(f"{root}/{name}")


@dataclass
class Files(InputPartition):
    names: list[str]


class Source:
    """Bytes of a plain or gzip file, record by record: head() first, then either rest() or skip()."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.left = file, size, 0, b""
        self.inflated = 0  # bytes of blocks that were decoded, for those who want to know

    def head(self) -> dict[str, str] | None:
        """Headers of the next record by lower-case name, with '' for the version; None at the end. A gzip member may hold any number of records."""
        while True:
            if self.left:
                self.data, self.left = self.left, b""
            elif self.at >= self.size:
                return None
            else:
                self._open()
            while (end := self.data.find(b"\r\n\r\n")) < 0 and (more := self._more()):
                self.data += more
            if end >= 0:
                break
            if self.data.strip():
                raise ValueError(f"a record's headers are cut off at {self.at}")
            if not self.packed:
                return None
            self._leave(b"")
        lines = re.sub(r"\r\n[ \t]+", " ", self.data[:end].decode("utf-8", "replace")).split("\r\n")
        lines = [x for x in lines if x]
        if not lines or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {self.at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.block, self.start = int(headers.get("content-length", 0)), end + 4
        return headers

    def _open(self) -> None:
        """Begin at a file's record, or at a gzip member."""
        self.file.seek(self.at)
        first = self.file.read(4096)
        self.packed = first[:2] == b"\x1f\x8b"
        self.length = None
        if self.packed:
            if first[3] & 4 and first[12:14] == b"sl":  # the length of a member of one record
                self.length = struct.unpack_from("<I", first, 16)[0]
            self.inflater = zlib.decompressobj(31)
            self.fed = len(first)
            self.data = self.inflater.decompress(first, 8192)
        else:
            self.data = first

    def _more(self) -> bytes:
        if not self.packed:
            return self.file.read(1 << 16)
        while True:
            data = self.inflater.unconsumed_tail
            if not data and not self.inflater.eof:
                data = self.file.read(1 << 16)
                self.fed += len(data)
                if not data:
                    return b""
            if self.inflater.eof:
                return b""
            if out := self.inflater.decompress(data, 1 << 16):
                return out

    def rest(self) -> bytes:
        """The record's block; the source then stands at the next record."""
        parts, n = [self.data[self.start :]], len(self.data) - self.start
        while n < self.block:
            more = self._more()
            if not more:
                raise ValueError(f"a record's block is cut off at {self.at}")
            parts.append(more)
            n += len(more)
        self.inflated += self.block
        out = b"".join(parts)
        self._leave(out[self.block :])
        return out[: self.block]

    def skip(self) -> None:
        """Past the record's block; where the member's length is known, or the file is plain, without reading it."""
        over = b""
        if self.packed and self.length is None:
            n, over = self.block - (len(self.data) - self.start), self.data[self.start + self.block :]
            while n > 0 and (more := self._more()):
                over = more[n:]
                n -= len(more)
        self._leave(over)

    def _leave(self, over: bytes) -> None:
        """Go on behind a record; over: what of its member was inflated behind its block. If more follows there, the next record is in the same member."""
        if not self.packed:
            self.at += self.start + self.block + 4
            return
        if self.length is None:
            over = over.lstrip(b"\r\n")
            while not over and (more := self._more()):
                over = more.lstrip(b"\r\n")
            if over:
                self.left = over
                return
            self.length = self.fed - len(self.inflater.unused_data)
        self.at += self.length


TESTS = {
    EqualTo: lambda f, v: v is not None and v == f.value,
    EqualNullSafe: lambda f, v: v == f.value,
    In: lambda f, v: v is not None and v in f.value,
    IsNull: lambda f, v: v is None,
    IsNotNull: lambda f, v: v is not None,
    StringStartsWith: lambda f, v: v is not None and v.startswith(f.value),
    StringEndsWith: lambda f, v: v is not None and v.endswith(f.value),
    StringContains: lambda f, v: v is not None and f.value in v,
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.with_payload = options["path"], options.get("payload", "true").lower() != "false"
        self.split_bytes, self.filters = int(options.get("splitbytes", SPLIT_BYTES)), []

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.path)
        if (files := manifest(store, root)) is None:
            info = store.get_file_info(fs.FileSelector(root, recursive=True))
            files = [(x.path[len(root) :].lstrip("/"), x.size) for x in info if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)]
        out, total = [], 0
        for name, size in sorted(files, key=lambda x: x[0]):
            if not out or total + size > self.split_bytes:
                out.append(Files([]))
                total = 0
            out[-1].names.append(name)
            total += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        total = 0
        for name in partition.names:
            with store.open_input_file(f"{root}/{name}") as file:
                for row in records(Source(file, file.size()), self.filters, self.with_payload):
                    rows.append(row)
                    total += 200 + len(row[-1] or b"")
                    if total > BATCH_BYTES:
                        yield as_batch(rows)
                        rows, total = [], 0
        yield as_batch(rows)


def records(source: Source, filters: list = (), with_payload: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA for the records that pass the filters. A response's payload must have its header's digest (ValueError otherwise)."""
    while (head := source.head()) is not None:
        row = {c: head.get(name.lower()) for c, name in HEADERS.items()}
        if not all(TESTS[type(f)](f, row[f.attribute[0]]) for f in filters):
            source.skip()
            continue
        http = head.get("content-type", "").startswith("application/http")
        if not with_payload and not http:
            source.skip()
            yield *row.values(), int(head.get("content-length", 0)), None
            continue
        if not with_payload:  # the HTTP headers that came along with the first bytes tell the length
            lead = source.data[source.start : source.start + 4096]
            source.skip()
            found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", lead.partition(b"\r\n\r\n")[0])
            yield *row.values(), int(found[1]) if found else None, None
            continue
        block = source.rest()
        lead, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        if row["record_type"] == "revisit":
            found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", lead)
            yield *row.values(), int(found[1]) if found else None, None
            continue
        if (row["payload_digest"] or "").startswith("sha1:") and digest(payload) != row["payload_digest"][5:]:
            raise ValueError(f"the payload of {row['record_id']} is damaged")
        yield *row.values(), len(payload), payload


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


class WarcDataSource(DataSource):
    """Options: path (a URI that all executors reach); payload=false leaves payloads undecoded (null); splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        store.create_dir(root)
        return WarcWriter(self.options["path"], overwrite)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of SCHEMA under a URI; filters on header columns reach the reader."""
    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(path)


def write_warc(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows of SCHEMA's columns (others are ignored) to a folder: append to what it holds, or overwrite that. One writer at a time."""
    ready(rows.sparkSession)
    rows.sparkSession.dataSource.register(WarcDataSource)
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    rows.select(*names).write.format("warc").mode(mode).option("path", path).save()


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows of SCHEMA for (page_id, url, html): of equal payloads of at least min_bytes bytes, the smallest page_id's is response and the others
    revisit it; smaller ones are all responses.

    A null html is an empty payload, a null url leaves its header out, a null page_id comes after all others (a group of nulls alone is all responses);
    rows with a group's smallest page_id are responses even if repeated. The first of a payload is a minimum, made in part before the shuffle, and
    payloads of a great many pages are dealt over tasks by their count.
    """
    own = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    first = checkpointed(own.where(F.col("payload_length") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"))
    both = join_dealt(own, first, ["sha1"], first.agg(F.sum("n")).first()[0] or 0, ["page_id", "url"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        page_urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.concat(F.lit("sha1:"), base32(F.col("sha1"))).alias("payload_digest"),
        F.when(again, page_urn(F.col("first"))).alias("refers_to"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_urn(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def page_of(urn):
    """The page_id that a URN was made of; null if that was none or no integer."""
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def base32(hexadecimal):
    """Upper-case base32 of 40 hexadecimal digits: eight numbers of 20 bits, each four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substr(hexadecimal, g * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    fours = F.transform(groups, lambda n: F.concat(*(F.substr(F.lit(letters), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0))))
    return F.array_join(fours, "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all of `pages` written as WARC and read back."""
    path = work_path(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    back = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))  # tested by the reader, on headers
    return back.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substr("payload_digest", F.lit(6)).alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )


ORACLE_SQL = """
WITH own AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), grouped AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY h) > 1 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM own
), told AS (
  SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS again, [('0x' || substr(h, 5 * g + 1, 5))::BIGINT FOR g IN range(0, 8)] AS parts FROM grouped
)
SELECT page_id, payload_bytes,
       array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31) + 1, 1) FOR s IN [15, 10, 5, 0]], '') FOR n IN parts], '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM told
"""
