"""WARC archives as a Spark data source, and operator 1.

``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``
after ``register(spark)``.

Writing: every task writes its own files under fresh names, so a repeated or
speculative attempt never touches another's; the driver's commit lists the files of
the attempts that counted in ``_files-*.json``, and readers open only those. Each
record is one gzip member whose header carries its lengths in the "sl" extra field.

Reading: files are packed into partitions by size. Predicates on the header columns
are pushed into the reader. Of every record the reader inflates the header block
first; where the predicates reject it, or no payload is wanted, it seeks to the next
record by the stored length and never inflates the rest. Archives from elsewhere
(plain, or gzip without the extra field) are read as well, by Content-Length or by
inflating.

Defined cases: a null payload is written as an empty one. A null page_id gives the
record id ``<urn:page:>`` and comes back null. Rows that repeat a page_id all become
records. An empty table gives a folder without files, which reads as no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from wavecrest.llm._scratch import Scratch

READ_SCHEMA = "record_id string, record_type string, target_uri string, record_date string, refers_to string, payload_digest string, payload_bytes long, content_type string, payload binary"
#: What a frame must hold to be written.
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
HEADER_OF = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "record_date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "payload_bytes": "x-payload-length",
    "content_type": "content-type",
}
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 64 << 10


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def pack_record(row: dict, date: str, level: int) -> bytes:
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date)]
    if row["target_uri"] is not None:
        head.append(("WARC-Target-URI", row["target_uri"]))
    if row["refers_to"] is not None:
        head.append(("WARC-Refers-To", row["refers_to"]))
    if revisit:
        head.append(("WARC-Profile", REVISIT_PROFILE))
    head += [("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("X-Payload-Length", str(row["payload_bytes"])), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {_header_value(v)}\r\n" for k, v in head) + "\r\n"
    raw = text.encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if size >= 1 << 32 or len(raw) >= 1 << 32:
        return zlib.compress(raw, level, 31)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date", "2020-01-01T00:00:00Z")
        self.level = int(options.get("level", "4"))
        self.file_bytes = int(options.get("filebytes", str(64 << 20)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = pafs.FileSystem.from_uri(self.path)
        done, out, name, size = Written(), None, "", 0
        try:
            for batch in iterator:
                at = [batch.schema.get_field_index(c) for c in WRITE_COLUMNS]
                for i in range(batch.num_rows):
                    if out is None:
                        store.create_dir(folder, recursive=True)
                        name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    record = pack_record({c: batch.column(k)[i].as_py() for c, k in zip(WRITE_COLUMNS, at, strict=True)}, self.date, self.level)
                    out.write(record)
                    size += len(record)
                    if size >= self.file_bytes:
                        out.close()
                        done.files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                done.files.append((name, size))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = pafs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in _manifests(store, folder):
                store.delete_file(old)
        files = [x for m in messages if m for x in m.files]
        with store.open_output_stream(f"{folder}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = pafs.FileSystem.from_uri(self.path)
        for name, _ in [x for m in messages if m for x in m.files]:
            store.delete_file(f"{folder}/{name}")


def _manifests(store: pafs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith("_files-") and x.base_name.endswith(".json"))


def _archives(store: pafs.FileSystem, folder: str) -> list[tuple[str, int]]:
    """What commits list, or else every archive below the folder; a single file stands for itself."""
    info = store.get_file_info(folder)
    if info.type == pafs.FileType.File:
        return [(folder, info.size)]
    if made := _manifests(store, folder):
        return [(f"{folder}/{name}", size) for m in made for name, size in json.loads(store.open_input_stream(m).read())]
    found = store.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
    return sorted((x.path, x.size) for x in found if x.path.endswith((".warc", ".warc.gz")))


class WarcFiles(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def _accepts(kind: str, want, value) -> bool:
    if kind == "is":
        return value is not None and value == want
    if kind == "same":
        return value == want
    if kind == "in":
        return value is not None and value in want
    if kind == "starts":
        return value is not None and value.startswith(want)
    return (value is None) == (kind == "null")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "bytes").lower()
        if self.payload not in ("bytes", "verify", "skip"):
            raise ValueError("payload must be bytes, verify or skip")
        self.partition_bytes = int(options.get("partitionbytes", str(32 << 20)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADER_OF or column == "payload_bytes":
                # archives from elsewhere don't state payload_bytes; it is known only once the payload is read
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "is", f.value))
            elif isinstance(f, EqualNullSafe):
                self.tests.append((column, "same", f.value))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNull):
                self.tests.append((column, "null", None))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "set", None))
            else:
                yield f

    def partitions(self) -> list[WarcFiles]:
        store, folder = pafs.FileSystem.from_uri(self.path)
        bins: list[WarcFiles] = []
        room = 0
        for name, size in _archives(store, folder):
            if not bins or room < size:
                bins.append(WarcFiles([]))
                room = self.partition_bytes
            bins[-1].files.append(name)
            room -= size
        return bins or [WarcFiles([])]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in HEADER_OF] + [("payload", pa.binary())])
        rows: list[tuple] = []
        held = 0
        for name in partition.files:
            with store.open_input_file(name) as file:
                for head, body in (records_gz if name.endswith(".gz") else records_plain)(file):
                    row = dict(zip(HEADER_OF, (head.get(h) for h in HEADER_OF.values()), strict=True))
                    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] is not None else None
                    if row["payload_digest"] is not None:
                        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
                    if not all(_accepts(kind, want, row[column]) for column, kind, want in self.tests):
                        continue
                    payload = None
                    if self.payload != "skip" and row["record_type"] != "revisit":
                        payload = _payload(head, body())
                        if row["payload_digest"] is not None and base32_sha1(payload) != row["payload_digest"]:
                            raise ValueError(f"{name}: the payload of {row['record_id']} does not match its digest")
                        if row["payload_bytes"] is None:
                            row["payload_bytes"] = len(payload)
                        if row["payload_bytes"] != len(payload):
                            raise ValueError(f"{name}: the payload of {row['record_id']} has another length than its header says")
                        payload = payload if self.payload == "bytes" else None
                    rows.append((*row.values(), payload))
                    held += len(payload or b"") + 512
                    if held >= 4 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _payload(head: dict, block: bytes) -> bytes:
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def parse_head(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (x.partition(":") for x in lines[1:] if x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def records_plain(file) -> Iterator[tuple[dict, object]]:
    """(headers, function that reads the block) of each record; unread blocks are skipped by a seek."""
    at, end = 0, file.size()
    while at < end:
        file.seek(at)
        text = b""
        while b"\r\n\r\n" not in text:
            more = file.read(4096)
            if not more:
                if text.strip():
                    raise ValueError("a record's header is cut off")
                return
            text += more
        lead = len(text) - len(text.lstrip(b"\r\n"))
        text = text[lead:].partition(b"\r\n\r\n")[0]
        head = parse_head(text)
        start, size = at + lead + len(text) + 4, int(head["content-length"])
        if start + size > end:
            raise ValueError("a record's block is cut off")

        def body(start=start, size=size) -> bytes:
            file.seek(start)
            return file.read(size)

        yield head, body
        at = start + size + 4


def records_gz(file) -> Iterator[tuple[dict, object]]:
    at, end = 0, file.size()
    while at < end:
        file.seek(at)
        first = file.read(4096)
        length = None
        if first[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip member")
        if first[3] & 4 and first[12:16] == b"sl\x08\0":
            length = struct.unpack("<I", first[16:20])[0]
        if length is None:
            # archives from elsewhere: a member may hold several records, or a part of one
            file.seek(at)
            yield from _records_inflated(gzip.GzipFile(fileobj=file))
            return
        inflate = zlib.decompressobj(31)
        text = inflate.decompress(first, CHUNK)
        while b"\r\n\r\n" not in text:
            more = inflate.unconsumed_tail or file.read(CHUNK)
            if not more or inflate.eof:
                raise ValueError("a record's header is cut off")
            text += inflate.decompress(more, CHUNK)
        raw, _, rest = text.partition(b"\r\n\r\n")
        head = parse_head(raw)
        got = [rest]

        def drain(inflate=inflate, got=got) -> None:
            while not inflate.eof:
                more = inflate.unconsumed_tail or file.read(CHUNK)
                if not more:
                    raise ValueError("a record is cut off")
                got.append(inflate.decompress(more))

        def body(head=head, got=got, drain=drain) -> bytes:
            drain()
            return b"".join(got)[: int(head["content-length"])]

        yield head, body
        at += length


def _records_inflated(stream) -> Iterator[tuple[dict, object]]:
    """The records of all members from here on; one block is held at a time."""
    text = b""
    try:
        while True:
            text = text.lstrip(b"\r\n")
            while b"\r\n\r\n" not in text:
                more = stream.read(4096)
                if not more:
                    if text.strip():
                        raise ValueError("a record's header is cut off")
                    return
                text = (text + more).lstrip(b"\r\n")
            raw, _, text = text.partition(b"\r\n\r\n")
            head = parse_head(raw)
            size = int(head["content-length"])
            block, text = text[:size], text[size:]
            block += stream.read(size - len(block))
            if len(block) < size:
                raise ValueError("a record is cut off")
            yield head, lambda block=block: block
    except EOFError as e:
        raise ValueError("a record is cut off") from e


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if missing := set(WRITE_COLUMNS) - set(schema.fieldNames()):
            raise ValueError(f"columns missing: {sorted(missing)}")
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits, in Spark: each 5 hex digits make 4 base32 digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def digits(group: Column) -> Column:
        value = F.conv(F.substring(hexed, group * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(alphabet, F.shiftright(value, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), digits), "")


def as_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Rows ready to be written: of equal payloads of at least min_bytes the largest id is the response.

    Which id is the largest is found on digests alone, and written for digests of two
    and more rows. One shuffle by digest then carries the payloads; the other side has
    one row for each digest and is a plain shuffle too, so where one payload makes up
    much of the table adaptive execution splits its partition.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("target_uri"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    first = base.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("digest").alias("first_digest")).agg(F.max("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    first = Scratch(pages.sparkSession, "warc-first").cut(first.drop("n"), "first")
    joined = base.join(first, F.col("digest") == F.col("first_digest"), "left")
    revisit = F.col("first_digest").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return joined.select(
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, urn(F.col("first_id"))).alias("refers_to"),
        base32_of_hex(F.col("digest")).alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame, folder: str, **options) -> None:
    register(pages.sparkSession)
    columns = {k: options.pop(k) for k in ("id_col", "uri_col", "payload_col", "min_bytes") if k in options}
    as_records(pages, **columns).write.format("warc").options(**options).mode("append").save(folder)


def read_archive(spark: SparkSession, folder: str, payload: str = "bytes") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(folder)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive in the shared folder and read back, each response checked against its digest."""
    folder = Scratch(spark, "warc").path("archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_archive(spark, folder, payload="verify").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to")
    )


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY sha1(b)) AS first_id FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((instr('0123456789abcdef', substr(h, ((5 * i) // 4 + 1)::INT, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, ((5 * i) // 4 + 2)::INT, 1)) - 1)
      // (CASE (5 * i) % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)) % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
