"""WARC archives as a PySpark data source, and revisit records for repeated payloads.

Reading plans one partition per archive file. Filters on `record_type` and on the header columns are pushed
down: a record's header block is parsed first, and the payload of a record that does not match is neither
decoded nor, where its member tells its length, even decompressed.

Every record is a gzip member of its own. Its extra field `sl` holds the member's compressed and plain
length, so a reader can jump to the next one. Archives without it, with several records in a member or compressed
as a whole are read by decompressing.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from wardenframe.llm.common import fresh_path, saved, table

COLUMNS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_bytes": "X-Payload-Bytes",
    "content_type": "Content-Type",
    "record_date": "WARC-Date",
    "profile": "WARC-Profile",
}
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", payload binary"
#: Payloads from this size on are stored once.
LEAST_BYTES = 1000
ID_PREFIX = "<urn:page:"
#: Fixed value: profile of a revisit record whose payload is that of the record it refers to.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of one batch, at most, and bytes of payload after which a batch is handed on.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def open_folder(path: str):
    """(file system, path in it) of a folder that any scheme known to Arrow names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_bytes(headers: dict[str, str], payload: bytes) -> bytes:
    """One record: version, headers, empty line, payload, two line ends. Line ends in header values become blanks."""
    lines = [f"{n}: {' '.join(v.split())}" for n, v in headers.items()]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def gzip_member(plain: bytes) -> bytes:
    """`plain` as a gzip member with its own and the plain length in the extra field `sl`."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    whole = 12 + 12 + len(body) + 8
    head = struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, whole & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _parse_headers(block: bytes) -> dict[str, str]:
    """Headers by lower-case name; a line that begins with white space goes on with the one before. Of repeated names the last counts."""
    found: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] = f"{found[name]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class _Plain:
    """An archive that is not compressed."""

    def __init__(self, stream) -> None:
        self.stream, self.size, self.buffer = stream, stream.size(), bytearray()

    def fill(self, count: int) -> bool:
        """Have `count` bytes in the buffer; false where the archive ends before."""
        while len(self.buffer) < count:
            data = self.stream.read(max(1 << 14, min(count - len(self.buffer), 1 << 20)))
            if not data:
                return False
            self.buffer += data
        return True

    def skip(self, count: int, record: int) -> None:
        """Leave out `count` bytes; with its line ends the record that they are of has `record`."""
        held = min(count, len(self.buffer))
        del self.buffer[:held]
        if count > held:
            if self.stream.tell() + count - held > self.size:
                raise ValueError("archive ends inside a record")
            self.stream.seek(self.stream.tell() + count - held)


class _Packed(_Plain):
    """An archive of gzip members, of which each holds one record, several, or a part of one."""

    def __init__(self, stream) -> None:
        super().__init__(stream)
        self.unpack, self.after, self.plain = None, None, None

    def fill(self, count: int) -> bool:
        while len(self.buffer) < count:
            if self.unpack is None or self.unpack.eof:
                if self.unpack is not None:
                    self.stream.seek(self.stream.tell() - len(self.unpack.unused_data))
                if not self._open():
                    return False
                continue
            data = self.stream.read(1 << 14 if not self.buffer else 1 << 18)
            if not data:
                raise ValueError("archive ends inside a compressed record")
            self.buffer += self.unpack.decompress(data)
        return True

    def _open(self) -> bool:
        """Begin the member at the stream's position, if there is one."""
        start, fresh = self.stream.tell(), not self.buffer
        head = self.stream.read(24)
        if not head.strip(b"\0"):
            self.unpack = None
            return False
        self.unpack, self.after = zlib.decompressobj(31), None
        if fresh and len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            length, self.plain = struct.unpack("<II", head[16:24])
            self.after = start + length
        self.buffer += self.unpack.decompress(head)
        return True

    def skip(self, count: int, record: int) -> None:
        # A member that holds just this record, and tells its length, is jumped over.
        if self.after is not None and self.plain == record & 0xFFFFFFFF and len(self.buffer) < count:
            if self.after > self.size:
                raise ValueError("archive ends inside a compressed record")
            self.buffer.clear()
            self.stream.seek(self.after)
            self.unpack = self.after = None
            return
        self.after = None
        while count:
            if not self.fill(1):
                raise ValueError("archive ends inside a record")
            held = min(count, len(self.buffer))
            del self.buffer[:held]
            count -= held


def read_records(stream, wanted, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers with lower-case names, payload) of the records whose headers `wanted` accepts; payload None if not asked for.

    Archives may be compressed as a whole, by record or not at all. One that ends inside a record, and a record that
    does not tell its length, are errors.
    """
    packed = stream.read(2) == b"\x1f\x8b"
    stream.seek(0)
    source = (_Packed if packed else _Plain)(stream)
    while True:
        while source.fill(1) and source.buffer[:1] in (b"\r", b"\n"):  # what is left of the line ends after a record
            del source.buffer[:1]
            source.after = None
        if not source.fill(1):
            return
        seen = 0
        while (end := source.buffer.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
            seen = len(source.buffer)
            if not source.fill(seen + 1):
                if not source.buffer.strip(b"\0\r\n "):
                    return
                raise ValueError("archive ends inside the headers of a record")
        headers = _parse_headers(bytes(source.buffer[:end]))
        if not headers.get("content-length", "").isdigit():
            raise ValueError(f"record {headers.get('warc-record-id')} does not tell its length")
        length = int(headers["content-length"])
        if wanted(headers):
            payload = None
            if payloads:
                if not source.fill(end + 4 + length):
                    raise ValueError("archive ends inside a record")
                payload = bytes(source.buffer[end + 4: end + 4 + length])
            yield headers, payload
        source.skip(end + 4 + length, end + 4 + length + 4)


def http_body(block: bytes) -> bytes:
    """What follows the headers of an HTTP message, as it was sent."""
    head, ends, body = block.partition(b"\r\n\r\n")
    return body if ends and head.startswith(b"HTTP/") else block


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """One partition per file; header predicates are tested before a payload is read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.payloads = options["path"], options.get("payloads", "true").lower() == "true"
        self.equal: dict[str, list[str]] = {}
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0]
            if len(f.attribute) == 1 and name in COLUMNS and isinstance(f, (EqualTo, In)):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.equal[name] = [v for v in values if v in self.equal.get(name, values)]
            elif len(f.attribute) == 1 and name in COLUMNS and isinstance(f, IsNotNull):
                self.present.append(name)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = open_folder(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        return [_File(f.path) for f in sorted(found, key=lambda f: -(f.size or 0)) if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))]

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(COLUMNS[n].lower()) in values for n, values in self.equal.items()) and all(COLUMNS[n].lower() in headers for n in self.present)

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition is None or not getattr(partition, "path", None):
            return
        system, _ = open_folder(self.path)
        names, rows, held = [n.lower() for n in COLUMNS.values()], [], 0
        with system.open_input_file(partition.path) as stream:
            for headers, payload in read_records(stream, self.wanted, self.payloads):
                payload = http_body(payload) if payload and headers.get("content-type", "").startswith("application/http") else payload
                rows.append((*[headers.get(n) for n in names], payload))
                held += len(payload or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:-1]], pa.array(columns[-1], pa.binary())], names=[*COLUMNS, "payload"])


@dataclass
class _Written(WriterCommitMessage):
    path: str


class WarcWriter(DataSourceArrowWriter):
    """One archive per task and attempt; those of failed or repeated attempts are deleted at the commit."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.attempt = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcWritten:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        path = f"{root}/part-{task.partitionId():05d}-{self.attempt}-{task.taskAttemptId()}.warc.gz"
        with system.open_output_stream(path, compression=None) as out:
            for batch in iterator:
                headers = [(COLUMNS[n], batch.column(n)) for n in batch.schema.names if n in COLUMNS]
                for row, payload in enumerate(batch.column("payload")):
                    found = {name: column[row].as_py() for name, column in headers}
                    out.write(gzip_member(record_bytes({n: v for n, v in found.items() if v is not None}, payload.as_py() or b"")))
        return _Written(path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, root = open_folder(self.path)
        kept = {m.path for m in messages if m is not None}
        system.create_dir(root, recursive=True)
        for f in system.get_file_info(fs.FileSelector(root)):
            if f.is_file and self.attempt in f.base_name and f.path not in kept:
                system.delete_file(f.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.commit([])


WarcWritten = WriterCommitMessage


class WarcDataSource(DataSource):
    """`spark.read.format("warc").load(folder)`; option `payloads=false` reads headers alone."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, and let its filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_records(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", least: int = LEAST_BYTES, date: str | None = None) -> DataFrame:
    """Records of the columns in `SCHEMA`, one per page: a payload of `least` bytes or more is held by one page.

    Of equal payloads the page with the largest key holds it as `response`, the others are `revisit` records
    without payload that refer to it. Null html is an empty payload; a page with a null key is a `response`
    of its own; rows that repeat the largest key are responses all. No other column is read. `date` is that of all
    records, as `2024-01-31T12:00:00Z`; without it, the time of writing.
    """
    written = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(source), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumns({"size": F.length("body"), "digest": F.sha1("body")})
    large = (F.col("size") >= least) & F.col("id").isNotNull()
    # Written, so that the join is one of two plain shuffles and the rows of an often repeated payload can be split.
    holders = saved(rows.filter(large).groupBy(F.col("digest").alias("group")).agg(F.max("id").alias("holder")), "holders")
    # Small payloads get a group of their own, so that the join has no hot key for them.
    grouped = rows.withColumn("group", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.col("digest")))))
    joined = grouped.join(holders, "group", "left")
    revisit = F.coalesce(F.col("holder") != F.col("id"), F.lit(False))
    name = lambda c: F.concat(F.lit(ID_PREFIX), c.cast("string"), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name(F.col("id")).alias("record_id"), F.col("url").alias("target_uri"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), F.when(revisit, name(F.col("holder"))).alias("refers_to"),
        F.col("size").cast("string").alias("payload_bytes"), F.lit("text/html; charset=utf-8").alias("content_type"),
        written.alias("record_date"), F.when(revisit, SAME_PAYLOAD).alias("profile"), F.when(~revisit, F.col("body")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back: responses by their payloads, revisits by their headers."""
    path = fresh_path(spark, "warc")
    write_archives(archive_records(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    page = F.when(F.col("record_id").isNotNull(), number("record_id")).cast("long").alias("page_id")
    responses = read_archives(spark, path).filter("record_type = 'response'").select(
        page, F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_archives(spark, path, payloads=False).filter("record_type = 'revisit'").select(
        page, F.col("payload_bytes").cast("long"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


OP8_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS holder FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to FROM g
"""
