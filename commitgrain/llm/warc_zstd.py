"""WARC archives compressed record by record with Zstandard and a dictionary.

Every archive file starts with a skippable frame that holds the dictionary;
after it, each record is one frame. Writing goes task by task into files of
bounded size in a shared folder; reading gives one row a record, each frame
decoded on its own and its headers and lengths checked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitgrain.llm._common import columns, new_path, stored

#: Fixed values of the formats: magic numbers and the profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of payload in a file, about; bytes that a dictionary is trained on.
FILE_BYTES = 16 << 20
SAMPLE_BYTES, PIECE, DICTIONARY_BYTES = 1 << 20, 1 << 12, 16 << 10
RECORD = ("archive string, offset long, record_id string, record_type string, refers_to string, target_uri string, "
          "payload_digest string, content_length long, payload_bytes long, payload binary, error string")


class BadArchive(ValueError):
    """A frame, header or length that does not hold."""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def encode_record(kind: str, record_id: str, uri: str, digest: bytes, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record over an HTTP response. A revisit keeps the HTTP
    header, whose Content-Length is the full payload's, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2024-01-01T00:00:00Z",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def frames(content: memoryview) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of each data frame of an archive."""
    at, decoder, first = 0, zstandard.ZstdDecompressor(), True
    while at < len(content):
        if len(content) - at < 8:
            raise BadArchive(f"{len(content) - at} bytes left over at {at}")
        magic, size = struct.unpack_from("<II", content, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(content):
                raise BadArchive(f"skippable frame at {at} is cut off")
            if magic == DICTIONARY_FRAME and first:
                raw = bytes(content[at + 8 : at + 8 + size])
                if raw[:4] == FRAME:
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at, first = at + 8 + size, False
            continue
        one, out, begin = decoder.decompressobj(), [], at
        try:
            while not one.eof:
                if at >= len(content):
                    raise BadArchive(f"frame at {begin} is cut off")
                piece = content[at : at + (1 << 14)]
                out.append(one.decompress(piece))
                at += len(piece) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise BadArchive(f"frame at {begin}: {e}") from e
        first = False
        yield begin, b"".join(out)


def _fields(lines: list[bytes], what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise BadArchive(f"{what} header line without a name")
        out[name.strip().lower()] = value.strip()
    return out


def decode_record(raw: bytes) -> dict:
    """The fields of one record; raises BadArchive where it breaks the rules."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise BadArchive("no WARC version line")
    h = _fields(lines[1:], "WARC")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise BadArchive(f"header without {sorted(missing)[0]}")
    if not h["content-length"].isdigit():
        raise BadArchive("Content-Length is no number")
    length = int(h["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length {length}, but the block has {len(rest) - 4} bytes")
    block = rest[:length]
    out = {"record_id": h["warc-record-id"].strip("<>"), "record_type": h["warc-type"], "content_length": length,
           "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, "target_uri": h.get("warc-target-uri"),
           "payload_digest": None, "payload_bytes": length, "payload": block}
    if h.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        declared = _fields(http.split(b"\r\n")[1:], "HTTP").get("content-length")
        if out["record_type"] == "revisit":
            payload, out["payload_bytes"] = None, int(declared) if declared and declared.isdigit() else None
        elif declared is not None and declared != str(len(payload)):
            raise BadArchive("HTTP Content-Length differs from the payload")
        else:
            out["payload_bytes"] = len(payload)
        out["payload"] = payload
    if digest := h.get("warc-payload-digest"):
        kind, _, value = digest.partition(":")
        if kind.lower() == "sha1":
            found = base64.b32decode(value) if len(value) == 32 else bytes.fromhex(value)
            out["payload_digest"] = found.hex()
            if out["record_type"] != "revisit" and hashlib.sha1(out["payload"]).digest() != found:
                raise BadArchive("payload digest differs")
    return out


def make_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on pieces of records from all over the file, SAMPLE_BYTES at
    most; where they are too few to learn from, the pieces themselves."""
    share = max(PIECE, SAMPLE_BYTES // len(records))
    pieces, total = [], 0
    for r in records[:: max(1, len(records) * PIECE // SAMPLE_BYTES)]:
        pieces += [r[i : i + PIECE] for i in range(0, min(len(r), share), PIECE)]
        total += min(len(r), share)
        if total >= SAMPLE_BYTES:
            break
    if len(pieces) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, pieces)
        except zstandard.ZstdError:  # too little in common to learn from
            pass
    return zstandard.ZstdCompressionDict(b"".join(pieces)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_file(fs, folder: str, records: list[bytes], place: str) -> tuple[str, int]:
    """One archive file, named by its place and content, and under a hidden
    name until it is whole. The place is the task's partition and the file's
    number in it: equal content elsewhere is a file of its own, and a task
    that is run again writes the same names."""
    dictionary = make_dictionary(records)
    maker = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
    body = [dictionary_frame(dictionary.as_bytes()), *(maker.compress(r) for r in records)]
    name = f"part-{place}-{hashlib.sha256(b''.join(body)).hexdigest()[:32]}.warc.zst"
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        for x in body:
            f.write(x)
    fs.move(draft, f"{folder}/{name}")
    return name, len(records)


def _writer(uri: str):
    def run(batches):
        from pyarrow import fs as pafs

        fs, folder = pafs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)
        records, size, done = [], 0, []
        part = TaskContext.get().partitionId()
        for batch in batches:
            for page_id, url, html, sha1, refers in zip(*(batch.column(i) for i in range(5))):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                of = refers.as_py()
                records.append(encode_record("response" if of is None else "revisit", f"urn:page:{page_id.as_py()}", url.as_py() or "", bytes.fromhex(sha1.as_py()), payload,
                                             None if of is None else f"urn:page:{of}"))
                size += len(payload) + 512
                if size >= FILE_BYTES:
                    done.append(write_file(fs, folder, records, f"{part:05d}-{len(done):05d}"))
                    records, size = [], 0
        if records:
            done.append(write_file(fs, folder, records, f"{part:05d}-{len(done):05d}"))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["archive", "records"]), preserve_index=False)
    return run


def decide(pages: DataFrame, key: str, url: str, html: str, least: int = 1000) -> DataFrame:
    """page_id, url, html, sha1, refers_to: of equal payloads of `least` bytes
    or more, all but the one with the largest id refer to that one."""
    base = columns(pages, key, url, html).toDF("page_id", "url", "html")
    base = base.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("html"))
    base = base.select("page_id", "url", "html", F.sha1("html").alias("sha1"), F.sha2("html", 256).alias("same"), F.length("html").alias("size"))
    groups = (base.select("page_id", "same", "size").filter(F.col("size") >= least).groupBy("same")
              .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", "last"))
    refers = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return base.join(groups, "same", "left").select("page_id", "url", "html", "sha1", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """Write one record a row under path; returns (archive, records).

    Null html is an empty payload, null url an empty one; control characters
    and spaces in a url are percent-encoded. Rows that repeat an id write a
    record each. An empty table writes no file. path is a URI that pyarrow's
    file systems reach from every task.
    """
    return decide(pages, key, url, html, least).mapInArrow(_writer(path), "archive string, records long")


def _reader(with_payload: bool, strict: bool):
    names = [c.split()[0] for c in RECORD.split(", ")]
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in RECORD.split(", ")])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size, path = [], 0, path.as_py()
                stream = frames(memoryview(content.as_buffer()))
                while True:
                    row = dict.fromkeys(names) | {"archive": path}
                    try:
                        row["offset"], raw = next(stream)
                        row |= decode_record(raw)
                    except StopIteration:
                        break
                    except BadArchive as e:
                        if strict:
                            raise
                        row["error"] = str(e)
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def read_archives(spark: SparkSession, path: str, *, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """One row a record of all *.warc.zst below path.

    Spark's own reader fetches the files, so any store will do; a task holds
    one file at a time. Strict reading fails at the first bad frame, header or
    length; otherwise such a record becomes a row with its error, and what
    follows a broken frame in that file is not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_reader(with_payload, strict), RECORD)


def page_number(record_id):
    return F.expr(f"try_cast(substring_index({record_id}, ':', -1) AS long)")


def pages_through_archives(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write all pages and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    manifest = stored(write_archives(pages, path, **options), "warc-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    # a task that was run twice may have left a second file; the manifest lists those that count
    back = read_archives(spark, path, with_payload=False).withColumn("archive", F.substring_index("archive", "/", -1))
    back = back.join(manifest.select("archive"), "archive", "left_semi")
    return back.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))
