"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

``write`` turns rows into archives of bounded size, each a value of a binary column, so that Spark's own writers and
readers carry them to and from any store; ``read`` works on that column or on ``binaryFile`` input alike. The reader
finds each frame's end from its block headers, decodes it alone, and validates the WARC and HTTP headers, the lengths
and the digest; a faulty record comes back with ``valid`` false and the reason, and the records after it are still read.

Edge cases: a null payload is empty. Of equal payloads the row with the smallest non-null id is the response; if it is
repeated, each repeat is one, and if all ids are null, all are. Line breaks in a url are percent-encoded, a null url is
left out. An empty table gives no archive, and an archive without records no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemark.llm.common import labelled_sample
from tastemark.session import cut

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES = 4 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ARCHIVES = "archive string, content binary"
_ARCHIVES_ARROW = pa.schema([("archive", pa.string()), ("content", pa.binary())])
_RECORDS = "archive string, position long, id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, valid boolean, error string"
_RECORDS_ARROW = pa.schema([
    ("archive", pa.string()), ("position", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("valid", pa.bool_()), ("error", pa.string()),
])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(rows: DataFrame, payload_col: str, id_col: str, size: int = 16 << 10, samples: int = 400, max_chars: int = 4000) -> bytes:
    """Compression dictionary from a bounded sample; raw text where there is too little to train on."""
    one = rows.select(F.col(id_col).alias("id"), F.col(payload_col).alias("text"), F.lit("x").alias("label"))
    texts = [t.encode("utf-8", "replace") for _, t in labelled_sample(one, "label", samples, 909, max_chars, "id")]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def _uri(ident: int | None) -> str:
    return f"<urn:page:{'' if ident is None else ident}>"


def record(ident: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) holds the HTTP headers alone."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP.format(len(payload)).encode() + (payload if refers_to is None else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(ident)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(write_content_size=True).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def frame_end(data: bytes | memoryview, at: int) -> int:
    """End of the Zstandard or skippable frame that begins at ``at``, from its block headers."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic == FRAME:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
        last = 0
        while not last:
            if end + 3 > len(data):
                raise ValueError("frame cut short")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    else:
        raise ValueError("no frame here")
    if end > len(data):
        raise ValueError("frame cut short")
    return end


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header without colon")
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _ident(uri: str) -> int | None:
    value = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def parse(raw: bytes, with_payload: bool = True) -> dict:
    """Fields of one decoded record; raises ValueError where headers, lengths or digest are wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    h = _headers(fields)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"no {name}")
    if len(rest) != int(h["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("wrong record length")
    http, gap, body = rest[:-4].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    length = int(_headers(http.partition(b"\r\n")[2]).get("content-length", "-1"))
    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "response":
        if length != len(body):
            raise ValueError("wrong payload length")
        if said != digest(body):
            raise ValueError("wrong payload digest")
    elif h["warc-type"] != "revisit" or body or "warc-refers-to" not in h or length < 0:
        raise ValueError("neither a response nor a proper revisit")
    refers = _ident(h["warc-refers-to"]) if h["warc-type"] == "revisit" else None
    return {"id": _ident(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload_bytes": length, "payload_digest": said, "refers_to": refers, "payload": body if with_payload and h["warc-type"] == "response" else None}


def read_archive(name: str, data: bytes, with_payload: bool = True) -> Iterator[dict]:
    """Records of one archive, one frame at a time."""
    at, view = 0, memoryview(data)
    decoder = zstandard.ZstdDecompressor()
    if int.from_bytes(data[:4], "little") == SKIPPABLE:
        at = frame_end(view, 0)
        dictionary = data[8:at]
        if int.from_bytes(dictionary[:4], "little") == FRAME:
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    while at < len(data):
        row = {"archive": name, "position": at, "valid": False}
        try:
            end = frame_end(view, at)
        except (ValueError, IndexError) as e:
            yield row | {"error": str(e)}
            return  # without the end of a frame the next one cannot be found
        try:
            yield row | parse(decoder.decompressobj().decompress(view[at:end]), with_payload) | {"valid": True}
        except (ValueError, zstandard.ZstdError) as e:
            yield row | {"error": str(e)}
        at = end


def write(rows: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", dictionary: bytes | None = None) -> DataFrame:
    """Archives (archive, content), one record per row; payloads of at least ``least_bytes`` are stored once."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    if dictionary is None:
        dictionary = train_dictionary(rows, payload_col, id_col)
    large = F.octet_length("payload") >= least_bytes
    firsts = cut(base.filter(large).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first"))
    joined = base.join(firsts, "sha", "left")
    refers = F.when(large & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    ready = joined.select("id", "url", "payload", refers.alias("refers_to"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = dictionary_frame(dictionary)
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
        part, number, held, size = TaskContext.get().partitionId(), 0, [head], len(head)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"archive": f"part-{part:06d}-{number:05d}.warc.zst", "content": b"".join(held)}], _ARCHIVES_ARROW)

        for batch in batches:
            for ident, url, body, refers_to in zip(*batch.columns, strict=True):
                frame = press.compress(record(ident.as_py(), url.as_py(), body.as_py(), refers_to.as_py(), date))
                held.append(frame)
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, held, size = number + 1, [head], len(head)
        if len(held) > 1:
            yield close()

    return ready.mapInArrow(archives, _ARCHIVES)


def read(archives: DataFrame, with_payload: bool = True, name_col: str = "archive", content_col: str = "content") -> DataFrame:
    """Records of archives given as (name, content) rows; for ``binaryFile`` input the name is ``path``."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                held, size = [], 0
                for row in read_archive(name.as_py(), content.as_py(), with_payload):
                    held.append(row)
                    size += 300 + len(row.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, _RECORDS_ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _RECORDS_ARROW)

    return archives.select(name_col, content_col).mapInArrow(records, _RECORDS)
