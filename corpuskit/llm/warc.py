"""WARC archives whose records are compressed one by one against a shared Zstandard dictionary.

An archive is: a skippable frame that holds the dictionary, then one Zstandard
frame per WARC record, so any record can be read alone.  The dictionary is
trained on a bounded sample of the records to be archived.  Spark's text sink
commits the files (so a lost task leaves nothing behind): each row is a frame
plus the header of a one-byte skippable frame, and the sink's line separator is
that byte.

Records with equal payloads of at least ``min_bytes`` bytes: the one with the
largest ``page_id`` is the response, all others are revisits that refer to it.
Only digests are grouped (partial maxima); the join back splits a hot digest by
AQE.

Defined results: a null html is an empty payload, a null url an empty target; a
null ``page_id`` never is a group's largest, and if all ids of a group are null
all are responses; rows that repeat the largest ``page_id`` are all responses;
an empty table writes no archive and reads back as no rows.  Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.common import shared_path

#: Frame magic numbers of the Zstandard and WARC-Zstandard formats (fixed values).
DICT_MAGIC, SKIP_MAGIC = 0x184D2A5D, 0x184D2A50
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
#: The skippable frame of one byte that follows each row; the byte is the sink's line separator.
ROW_END = struct.pack("<II", SKIP_MAGIC, 1)
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def warc_record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head (with the full length) but not the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """A row of ``RECORD`` from one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:"))

    def page(field):
        number = fields[field][len("<urn:page:"):-1] if field in fields else ""
        return int(number) if number else None

    return page("WARC-Record-ID"), fields["WARC-Target-URI"], length, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], page("WARC-Refers-To"), payload


def build_dictionary(pages: DataFrame, n_pages: int, sample_records: int, sample_bytes: int, size: int) -> bytes:
    """Dictionary from at most ``sample_records`` records (by hash order) of ``sample_bytes`` payload bytes.

    About four times as many hashes are ordered alone, below a threshold; then the payloads of those records are
    cut in their tasks.
    """
    import zstandard

    share = min(1.0, 4 * sample_records / max(n_pages, 1))
    few = pages.withColumn("h", F.xxhash64("digest", "page_id")).filter(F.shiftrightunsigned("h", 32) <= int(share * 2**32))
    order = F.shiftrightunsigned("h", 1)
    hashes = [r[0] for r in few.select(order.alias("o")).orderBy("o").limit(sample_records).collect()]
    if not hashes:
        return b""
    chosen = few.filter(order <= hashes[-1]).select("page_id", "url", F.substring("payload", 1, sample_bytes).alias("payload"))
    rows = sorted(chosen.limit(2 * sample_records).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))[:sample_records]
    samples = [warc_record(r["page_id"], r["url"], bytes(r["payload"]), None) for r in rows]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too alike for training: their bytes serve as they are
        return b"".join(samples)[-size:]


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 3, archive_bytes: int = 64 << 20,
               sample_records: int = 1000, sample_bytes: int = 32 << 10, dict_size: int = 64 << 10) -> None:
    """Archive ``pages(page_id, url, html)`` below ``path``, in files of about ``archive_bytes`` of payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = p.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND last IS NOT NULL").drop("n")
    total, n_pages = p.agg(F.coalesce(F.sum(F.length("payload")), F.lit(0)), F.count(F.lit(1))).first()
    dictionary = build_dictionary(p, n_pages, sample_records, sample_bytes, dict_size)
    head = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""

    def frames(batches):
        import zstandard

        how = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        first = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = [how.compress(warc_record(r["page_id"], r["url"], r["payload"], r["refers_to"])) + ROW_END for r in batch.slice(at, 256).to_pylist()]
                if first and out:
                    out[0], first = head + out[0], False
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    rows = p.join(groups, "digest", "left").select("page_id", "url", "payload", refers).repartition(max(1, -(-total // archive_bytes)))
    rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.text(path, lineSep="\n")


def read_frames(content: bytes):
    """The bytes of each frame of an archive, with its dictionary applied; skippable frames are passed over."""
    import zstandard

    at, how, view = 0, zstandard.ZstdDecompressor(), memoryview(content)
    while at < len(content):
        magic, size = struct.unpack_from("<II", content, at)
        if magic in SKIPPABLE:
            if magic == DICT_MAGIC:
                how = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8:at + 8 + size])))
            at += 8 + size
            continue
        frame, out = how.decompressobj(), []
        while not frame.eof:
            out.append(frame.decompress(view[at:at + 8192]))
            at += min(8192, len(content) - at) - len(frame.unused_data)
        yield b"".join(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``RECORD`` from the archives below ``path``; a revisit has no payload bytes of its own."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in read_frames(content.as_py()):
                    rows.append(parse_record(record))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return files.select("content").mapInArrow(records, RECORD)


def archive_pages(pages: DataFrame, **how) -> DataFrame:
    """Write the archives into the shared folder and read them back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, **how)
    return read_warc(spark, path)
