"""WARC archives with one Zstandard frame per record and a dictionary in the leading skippable frame.

An archive is: a skippable frame (magic 0x184D2A5D) with the dictionary, itself compressed or not; then frames, each of
which holds one whole WARC record. Both ends are here: ``write_archives`` packs a table of pages into archives of bounded
size, ``read_archives`` and ``read_files`` decode them frame by frame, and check every header and length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import kept, new_folder, slices

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bounds of what a dictionary is trained on: records, bytes of each, and its own size.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 256, 16_384, 32_768
ARCHIVE_BYTES = 32 << 20

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("error", pa.string()),
    ]
)
#: Over how many tasks the records of one payload are dealt.
SALTS = 64


class WarcError(ValueError):
    """An archive or record that breaks the format."""


# -- records


def _id(page_id) -> str:
    return f"<urn:pages:{'' if page_id is None else page_id}>"


def encode_record(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if record_type == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "%\r\n" or ord(c) < 32 else c for c in url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes, what: str) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    found = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{what}: malformed header line")
        found[name.lower()] = value.strip()
    return first, found


def _length(headers: dict[str, str], what: str) -> int:
    if not (value := headers.get("content-length", "")).isdecimal():
        raise WarcError(f"{what}: no valid Content-Length")
    return int(value)


def _page(value: str) -> int | None:
    if not (value.startswith("<urn:pages:") and value.endswith(">")):
        raise WarcError("record id is not one of pages")
    number = value[len("<urn:pages:") : -1]
    return int(number) if number else None


def decode_record(data: bytes) -> dict | None:
    """One record's row (see RECORD), None for kinds other than response and revisit. Raises WarcError."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("record: no end of headers")
    version, h = _headers(head, "record")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("record: unknown version")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(h):
        raise WarcError(f"record: lacks {', '.join(sorted(missing))}")
    n = _length(h, "record")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("record: its length is not Content-Length")
    if h["warc-type"] not in ("response", "revisit"):
        return None
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("response: no end of headers")
    status, inner = _headers(http, "response")
    if not status.startswith("HTTP/"):
        raise WarcError("response: no status line")
    size = _length(inner, "response")
    kind, _, value = h.get("warc-payload-digest", "").partition(":")
    if kind != "sha1":
        raise WarcError("record: no sha1 payload digest")
    try:
        digest = base64.b32decode(value).hex()
    except ValueError as e:
        raise WarcError("record: malformed digest") from e
    row = {
        "page_id": _page(h["warc-record-id"]),
        "url": h.get("warc-target-uri"),
        "record_type": h["warc-type"],
        "refers_to": None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None,
        "error": None,
    }
    if row["url"] is not None:
        from urllib.parse import unquote

        row["url"] = unquote(row["url"])
    if h["warc-type"] == "revisit":
        if h.get("warc-profile") != PROFILE or payload:
            raise WarcError("revisit: unknown profile or a payload")
        row["refers_to"] = _page(h.get("warc-refers-to", ""))
    else:
        if len(payload) != size:
            raise WarcError("response: its length is not Content-Length")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("response: its payload has another digest")
        row["payload"] = payload
    return row


# -- archives


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from the first records of an archive; empty where they are too few to train one."""
    some = [s[:TRAIN_BYTES] for s in samples[:TRAIN_RECORDS]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, some)) // 8), some, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _first(dictionary: bytes) -> tuple[bytes, zstandard.ZstdCompressor]:
    if not dictionary:
        return b"", zstandard.ZstdCompressor(level=3, write_checksum=True)
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body, zstandard.ZstdCompressor(
        level=3,
        dict_data=zstandard.ZstdCompressionDict(dictionary),
        write_checksum=True,
    )


def encode_archives(records: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES) -> Iterator[tuple[bytes, int]]:
    """(archive, number of records), each of about ``archive_bytes`` of records before compression."""
    waiting: list[bytes] = []
    size = 0

    def done() -> tuple[bytes, int]:
        start, packer = _first(train_dictionary(waiting))
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:" + str(uuid.uuid4()).encode() + b">\r\nWARC-Date: " + DATE.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
        return start + b"".join(map(packer.compress, [info, *waiting])), len(waiting)

    for r in records:
        waiting.append(r)
        size += len(r)
        if size >= archive_bytes:
            yield done()
            waiting, size = [], 0
    if waiting:
        yield done()


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    try:
        head = zstandard.frame_header_size(data[at : at + 18])
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    except zstandard.ZstdError as e:
        raise WarcError("archive: malformed frame") from e
    at += head
    while True:
        if at + 3 > len(data):
            raise WarcError("archive: cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise WarcError("archive: cut off")
    return at


def decode_archive(content: bytes) -> Iterator[bytes | WarcError]:
    """The records of an archive, one for each frame. After what breaks the archive an error comes, and no more."""
    data, at, unpacker = memoryview(content), 0, zstandard.ZstdDecompressor()
    try:
        while at < len(data):
            if at + 8 > len(data):
                raise WarcError("archive: cut off")
            magic, n = struct.unpack_from("<II", data, at)
            if magic == DICTIONARY_MAGIC and at == 0:
                if 8 + n > len(data):
                    raise WarcError("archive: its dictionary is cut off")
                body = bytes(data[8 : 8 + n])
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
                at = 8 + n
            elif 0x184D2A50 <= magic <= 0x184D2A5F:
                at += 8 + n
            elif magic == FRAME_MAGIC:
                end = _frame_end(data, at)
                yield unpacker.decompressobj().decompress(data[at:end])
                at = end
            else:
                raise WarcError("archive: neither a frame nor a skippable one")
    except (WarcError, zstandard.ZstdError) as e:
        yield e if isinstance(e, WarcError) else WarcError(f"archive: {e}")


def _rows(content: bytes) -> Iterator[dict]:
    for record in decode_archive(content):
        try:
            if isinstance(record, WarcError):
                raise record
            if row := decode_record(record):
                yield row
        except (WarcError, UnicodeDecodeError) as e:
            yield {"error": str(e)}


def _frames(contents: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for content in contents:
        rows, size = [], 0
        for row in _rows(content):
            rows.append(row)
            size += len(row.get("payload") or b"")
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


# -- tables


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to): who is a response, who revisits it.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response; repeated rows of it are responses
    too. Without any page_id all are. A null page_id counts as the smallest. A null html is the empty payload.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    columns = ["page_id", "url", "payload", "digest"]
    # only payloads that come again meet in a join, by parts of each; of them one row is known, whatever their number
    firsts = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.where(large).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(firsts, ["digest", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    small = rows.where(~large).select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return small.union(
        joined.select(*columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))
    )


def write_archives(records: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``records`` (see plan_records) as *.warc.zst; returns (path, n_records, n_bytes) of the archives written.

    ``folder`` lies in a store that all executors share (default: a new one in the shared folder). A task that is run
    again writes files of new names; the list has those of the tasks that counted.
    """
    folder = folder or new_folder(records.sparkSession, "warc")

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def encoded():
            for b in slices(batches):
                for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to"))):
                    yield encode_record(*row)

        for archive, n in encode_archives(encoded(), archive_bytes):
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(archive)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [len(archive)]})

    return kept(records.mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records (see RECORD) of the archives at ``archives(path, ...)``, each read by one task; a path listed twice is
    read twice. A broken record or archive is a row with an error and nulls. No archives: no rows. The path is not null."""

    def run(batches):
        from pyarrow import fs

        def contents():
            for b in batches:
                for path in b.column("path").to_pylist():
                    store, inside = fs.FileSystem.from_uri(path)
                    with store.open_input_stream(inside, compression=None) as f:
                        yield f.read()

        yield from _frames(contents())

    return archives.select("path").repartition(max(1, archives.count()), F.col("path")).mapInArrow(run, RECORD)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of all *.warc.zst files at ``path``, by Spark's own reader. What is not valid is a row with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(lambda batches: _frames(c for b in batches for c in b.column("content").to_pylist()), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all of ``pages(page_id, url, html, ...)`` and read it back; a broken record fails the query.

    One row for each row of pages, repeated ones too; a null html is the empty payload, null ids and urls stay null, texts
    of any length are whole, ties of equal payloads go by page_id (see plan_records). An empty table gives no rows. Other
    columns are not looked at.
    """
    got = read_archives(write_archives(plan_records(pages)))
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("payload_bytes"))
    return got.select("page_id", "url", sound.cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
