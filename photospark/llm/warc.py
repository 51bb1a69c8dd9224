"""Web archives in Zstandard-compressed WARC: written from a table of pages, read back record by record.

An archive is a leading skippable frame with a dictionary (itself a frame or
plain), then one frame per record. The reader walks the frames by their block
headers, so it never searches or copies the rest of an archive, decodes one
record at a time and checks version, header fields, lengths and digests.
Payloads that occur again are written once and revisited.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photospark.llm.scratch import keep, scratch_path, small

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 100
#: Bytes of records in an archive (one record if it is longer).
ARCHIVE_BYTES = 32 << 20
#: Dictionary: its size, bytes of each record and of all records it is trained on (records of the archive itself).
DICTIONARY_BYTES = 16 << 10
SAMPLE_RECORD = 8 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
#: Payloads with more copies than this, and than this share of all copies, are joined by broadcast: at most 1 / share of them.
HOT_ROWS = 100_000
HOT_SHARE = 1e-4

RECORDS = ("archive string, position bigint, record_type string, record_id string, target_uri string, page_id bigint, payload_bytes bigint, "
           "payload_digest string, refers_to bigint, payload binary, error string")


class Record(NamedTuple):
    """One record of an archive; ``error`` says what is wrong with it, the other fields then hold what could be read."""

    position: int
    kind: str | None = None
    fields: dict[str, str] = {}
    payload: bytes | None = None
    payload_bytes: int | None = None
    error: str | None = None


def _header(pairs: list[tuple[str, str]]) -> bytes:
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs) + b"\r\n"


def record_bytes(kind: str, record_id: str, block: bytes, more: list[tuple[str, str]], content_type: str = "application/http;msgtype=response") -> bytes:
    """A record: version, header fields, the block and its end."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *more, ("Content-Type", content_type),
              ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    """A header value: control characters and spaces percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive of these records; without a dictionary if there are too few of them to train one."""
    import zstandard

    samples, left = [], SAMPLE_BYTES
    for r in records:
        if left <= 0:
            break
        samples.append(r[: min(SAMPLE_RECORD, left)])
        left -= len(samples[-1])
    lead, dictionary = b"", None
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        pass
    if dictionary is not None:
        body = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
    # one compressor for all frames keeps the digested dictionary
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return lead + b"".join(map(packer.compress, records))


def frame_size(data: memoryview) -> int:
    """Bytes of the frame that ``data`` starts with, from its block headers; ValueError if it is not whole."""
    import zstandard

    try:
        at = zstandard.frame_header_size(bytes(data[:18]))
        checksum = zstandard.get_frame_parameters(bytes(data[:18])).has_checksum
    except zstandard.ZstdError as error:
        raise ValueError(f"frame header: {error}") from None
    while True:
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("frame has a reserved block")
        at += 3 + (1 if kind == 1 else size)
        if last:
            at += 4 * checksum
            if at > len(data):
                raise ValueError("frame is cut off")
            return at


def parse(position: int, data: bytes) -> Record:
    """A decoded record, checked: version, fields, block length, nothing after the record, digests, payload length."""
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].split(b"\r\n")
    if end < 0 or not lines[0].startswith(b"WARC/1."):
        return Record(position, error="no version line or no end of header")
    fields: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        try:
            text = line.decode()
        except UnicodeDecodeError:
            return Record(position, error="header field is not UTF-8")
        if text[:1] in (" ", "\t") and name:
            fields[name] += " " + text.strip()
            continue
        key, colon, value = text.partition(":")
        if not colon or not key.strip():
            return Record(position, fields=fields, error=f"header field without a name: {text[:80]}")
        name = key.strip().lower()
        fields[name] = value.strip()
    kind = fields.get("warc-type")
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        return Record(position, kind, fields, error="header lacks " + ", ".join(missing))
    if not (fields["content-length"].isascii() and fields["content-length"].isdigit()):
        return Record(position, kind, fields, error="Content-Length is no number")
    size = int(fields["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) < size or data[end + 4 + size :] != b"\r\n\r\n":
        return Record(position, kind, fields, error=f"block of {len(data) - end - 8} bytes, Content-Length {size}")
    told = fields.get("warc-block-digest")
    if told and told.startswith("sha256:") and told[7:] != hashlib.sha256(block).hexdigest():
        return Record(position, kind, fields, error="block digest differs")
    if kind not in ("response", "revisit"):
        return Record(position, kind, fields, block, len(block))
    head, _, payload = block.partition(b"\r\n\r\n")
    length = None
    if not fields.get("content-type", "").startswith("application/http"):
        head, payload = b"", block
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"content-length" and value.strip().isdigit():
            length = int(value)
    if kind == "revisit":
        return Record(position, kind, fields, None, length, None if "warc-refers-to" in fields else "revisit refers to nothing")
    error = None
    if length is not None and length != len(payload):
        error = f"payload of {len(payload)} bytes, its Content-Length is {length}"
    told = fields.get("warc-payload-digest")
    if told and told.startswith("sha256:") and told[7:] != hashlib.sha256(payload).hexdigest():
        error = "payload digest differs"
    return Record(position, kind, fields, payload, len(payload), error)


def records_of(data: memoryview) -> Iterator[Record]:
    """The records of an archive in order; a frame that is not whole ends it with an error."""
    import zstandard

    at, dictionary = 0, None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        if 8 + size > len(data):
            yield Record(0, error="dictionary frame is cut off")
            return
        body = bytes(data[8 : 8 + size])
        try:
            if body[:4] == struct.pack("<I", FRAME_MAGIC):
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            dictionary = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT)
            unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
            unpacker.decompress(zstandard.ZstdCompressor(dict_data=dictionary).compress(b"-"))
        except zstandard.ZstdError as error:
            yield Record(0, error=f"dictionary: {error}")
            return
        at = 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic in SKIPPABLE:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if at > len(data):
                yield Record(at, error="skippable frame is cut off")
            continue
        try:
            size = frame_size(data[at:])
        except ValueError as error:
            yield Record(at, error=str(error))
            return
        frame = data[at : at + size]
        try:
            known = zstandard.frame_content_size(frame) >= 0
            body = unpacker.decompress(frame) if known else unpacker.decompressobj().decompress(frame)
        except zstandard.ZstdError as error:
            yield Record(at, error=f"frame: {error}")
        else:
            yield parse(at, body)
        at += size


def _placed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload of every row with ``row``, unique to it: its place in the files it is read from.

    What is not a plain Parquet table is written to the shared folder first.
    """
    def rows(df: DataFrame) -> DataFrame:
        url = df["url"].cast("string") if "url" in df.columns else F.lit(None).cast("string")
        return df.select(
            df["page_id"].cast("bigint").alias("page_id"), url.alias("url"), F.encode(F.coalesce(df["html"], F.lit("")), "UTF-8").alias("payload"),
            F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias("row"))

    own = pages.select([c for c in ("page_id", "url", "html") if c in pages.columns])
    plain = pages._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation"
    try:
        return rows(pages if plain else keep(own, "pages"))
    except AnalysisException:
        return rows(keep(own, "pages"))


def roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Every page with ``first``: null if it is written whole, else the row (missing, page_id, row) whose payload it repeats.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the first by
    (page_id, place in the table) is written whole, rows without id last.
    Payloads with very many copies are few by definition and joined by
    broadcast; no other payload can fill a task of the shuffle.
    """
    rows = _placed(pages).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    place = F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "row")
    repeated = F.octet_length("payload") >= least_bytes
    copies = keep(
        rows.filter(repeated).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")).filter("copies > 1"), "copies")
    many = max(HOT_ROWS, int((copies.agg(F.sum("copies")).first()[0] or 0) * HOT_SHARE))
    hot = copies.filter(F.col("copies") > many).select("digest", F.col("first").alias("hot"))
    rest = copies.filter(F.col("copies") <= many).select(F.col("digest").alias("key"), F.col("first").alias("cold"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    spread = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.unhex(F.sha2("row", 256)))
    rows = rows.withColumn("key", spread).join(small(rest), "key", "left")
    first = F.coalesce("hot", "cold")
    return rows.select("page_id", "url", "payload", "digest", "row", F.when(first["row"] != F.col("row"), first).alias("first"))


def _uuid(row) -> F.Column:
    h = F.md5(row)
    return F.concat(F.lit("<urn:uuid:"), *[p for a, n in ((1, 8), (9, 4), (13, 4), (17, 4)) for p in (F.substring(h, a, n), F.lit("-"))],
                    F.substring(h, 21, 12), F.lit(">"))


def _written(row: dict) -> bytes:
    """The record of one page."""
    payload, digest = row["payload"], row["digest"].hex()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", _uri(row["url"]))] if row["url"] else []
    fields += [("X-Page-Id", str(row["page_id"]))] if row["page_id"] is not None else []
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if row["first_id"] is None:
        return record_bytes("response", row["id"], head + payload, fields)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["first_id"])]
    fields += [("X-Refers-To-Page-Id", str(row["first_page"]))] if row["first_page"] is not None else []
    return record_bytes("revisit", row["id"], head, fields)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, archive_size: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into archives in ``folder``; returns name, records, bytes of each.

    A null html is an empty payload, a missing url or id leaves its field out.
    The folder is a URI that executors can write to. A task writes its archives
    under names of its own attempt, complete before they are named; only those
    of finished tasks are in the returned table, which is what readers go by.
    Writes while it is built.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        held: list[bytes] = []
        count = size = 0

        def out() -> pa.RecordBatch:
            nonlocal held, count, size
            name = f"pages-{task}-{count:04d}.warc.zst"
            info = record_bytes("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"format: WARC file version 1.1\r\n", [("WARC-Filename", name)], "application/warc-fields")
            data = archive_bytes([info, *held])
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/.{name}.part") as file:
                file.write(data)
            store.move(f"{base}/.{name}.part", f"{base}/{name}")
            row = pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})
            held, count, size = [], count + 1, 0
            return row

        for batch in batches:
            for at in range(batch.num_rows):
                record = _written({name: batch.column(k)[at].as_py() for k, name in enumerate(batch.schema.names)})
                if held and size + len(record) > archive_size:
                    yield out()
                held.append(record)
                size += len(record)
        if held:
            yield out()

    rows = roles(pages, least_bytes).select(
        "page_id", "url", "payload", "digest", _uuid(F.col("row")).alias("id"), _uuid(F.col("first.row")).alias("first_id"),
        F.col("first.page_id").alias("first_page"))
    return keep(rows.mapInArrow(write, "name string, records bigint, bytes bigint"), "archives")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payload: bool = True) -> DataFrame:
    """The records of the ``*.warc.zst`` files in ``folder``, or of those that ``manifest`` names.

    archive (file name), position (first byte of the frame), record_type,
    record_id, target_uri, page_id, payload_bytes, payload_digest (bare hex, both
    of the full payload, as computed for a response and as told by a revisit),
    refers_to (page of the response), payload (null for revisits and unless asked
    for), error (null if the record is sound). A broken record does not end an
    archive unless its frame is cut off. Files are read by Spark, so any store
    that Spark reads will do; one archive is held at a time.
    """
    if manifest is not None and manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    if manifest is not None:
        files = files.join(small(manifest.select("name")), "name", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def number(text: str | None) -> int | None:
            return int(text) if text is not None and text.lstrip("-").isdigit() else None

        def rows(name: str, part: list[Record]) -> pa.RecordBatch:
            told = [r.fields.get("warc-payload-digest", "") for r in part]
            return pa.RecordBatch.from_pydict({
                "archive": pa.array([name] * len(part), pa.string()), "position": pa.array([r.position for r in part], pa.int64()),
                "record_type": pa.array([r.kind for r in part], pa.string()), "record_id": pa.array([r.fields.get("warc-record-id") for r in part], pa.string()),
                "target_uri": pa.array([r.fields.get("warc-target-uri") for r in part], pa.string()),
                "page_id": pa.array([number(r.fields.get("x-page-id")) for r in part], pa.int64()),
                "payload_bytes": pa.array([r.payload_bytes for r in part], pa.int64()),
                "payload_digest": pa.array([hashlib.sha256(r.payload).hexdigest() if r.payload is not None else t.removeprefix("sha256:") or None
                                            for r, t in zip(part, told, strict=True)], pa.string()),
                "refers_to": pa.array([number(r.fields.get("x-refers-to-page-id")) for r in part], pa.int64()),
                "payload": pa.array([r.payload if payload else None for r in part], pa.binary()), "error": pa.array([r.error for r in part], pa.string()),
            })

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, size = [], 0
                for r in records_of(memoryview(content.as_buffer())):
                    part.append(r)
                    size += len(r.payload or b"")
                    if len(part) >= 1000 or size > 8 << 20:
                        yield rows(name, part)
                        part, size = [], 0
                if part:
                    yield rows(name, part)

    return files.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """The page records of ``pages`` after writing them to archives in the shared folder and reading these back."""
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder, manifest, payload=False).filter(F.col("record_type").isin("response", "revisit") | F.col("error").isNotNull())
