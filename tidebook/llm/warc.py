"""WARC archives compressed with a dictionary per archive.

An archive is a leading skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built
from the archive's own records, then one independent Zstandard frame per record. Tasks write archives
to the shared folder and return a manifest row for each; only archives in the manifest count, so the
files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import cut, fresh_folder, place_of

DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEAST_REVISIT = 100
SALTS = 32
_CHUNK = 64 << 10


def _header(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record: a response with its payload, or a revisit that keeps only the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread evenly over the archive, up to SAMPLE_BYTES of them. Archives with
    too little to train on use the records themselves as raw content."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive."""
    words = dictionary(records)
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words))
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(words)), words, *map(packer.compress, records)])


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, read from a file object one frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    left = b""
    while left or (left := stream.read(_CHUNK)):
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if not left and not (left := stream.read(_CHUNK)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(left))
            left = b"" if not frame.eof else frame.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of (page_id, url, html) as a record below ``folder``; the manifest (file, records,
    raw_bytes, archive_bytes) of the archives written, itself kept in the shared folder.

    A null html is an empty payload. Rows with equal payloads of LEAST_REVISIT bytes or more are
    revisits of the row with the smallest page_id; rows that repeat that page_id are responses too, and
    so are rows with a null page_id. No rows give no archives. Copies of one payload are dealt over SALTS
    tasks, payloads too small for revisits over all of them.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    mark = F.xxhash64("page_id")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = rows.withColumn("salt", F.when(F.col("size") >= LEAST_REVISIT, F.pmod(mark, F.lit(SALTS))).otherwise(mark).cast("long"))
    ready = salted.join(firsts, ["digest", "salt"], "left").select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, path = place_of(folder)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.warc.zst", archive(held)
            with disk.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([len(data)], pa.int64())], names=["file", "records", "raw_bytes", "archive_bytes"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, n, digest, refers, again = (x.as_py() for x in row)
                held.append(record(page_id, url, payload or b"", digest, n, refers, again))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    place_of(folder)[0].create_dir(place_of(folder)[1], recursive=True)
    return cut(ready.mapInArrow(run, "file string, records long, raw_bytes long, archive_bytes long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, file) of every record in the
    archives of the manifest. A response's digest is taken from its payload and held against its header;
    a revisit's digest and size are those it states for the full payload."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, path = place_of(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with disk.open_input_stream(f"{path}/{name}") as stream:
                    for data in frames(stream):
                        fields, http, payload = parse(data)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(http["Content-Length"])
                        if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload is not what its header states")
                        refers = _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                        rows.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], refers, name))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    each = manifest.select("file").repartition(max(1, manifest.count()))
    return each.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all rows of (page_id, url, html) to archives in a new shared folder and read them back."""
    folder = fresh_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
