"""Operator 10: WARC archives by way of a table of chunks.

Writing: each payload gets its digest (SHA-1, base32); of equal payloads the
record of the largest id is a response, the others are revisits of it, without
payload.  A response is cut into chunk rows (record id, chunk number) of at
most ``chunk`` characters, and each row becomes a WARC record of its own: the
first a ``response``, the others ``continuation`` records, which the format
offers for oversized records (segment number, origin, total length).  Spark's
text writer, with CRLF CRLF between records, makes gzip files of them.

Reading: each file is one stream; its lines up to CRLF CRLF pass through a
reader that follows Content-Length and yields a chunk row at a time, and the
running digest and size of the record go along from chunk to chunk, so no
record is held whole.

Cases: a null payload is an empty one; a null url is written without a target;
ids are written as they are and must not repeat or be null (rows of a null id
fail); payloads shorter than ``least`` bytes are all responses; equal payloads
are found by digest and size; an empty table gives an empty archive, which
reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm._arrow import column, tidy

CHUNK = 1 << 20
CRLF = "\r\n"
SEPARATOR = CRLF + CRLF
_HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{SEPARATOR}"
#: Digits of base 32 as Spark writes them and as RFC 4648 does.
_DIGITS, _RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(text: Column) -> Column:
    """SHA-1 in base 32, from Spark's functions alone: 5 hex digits are 4."""
    digits = F.sha1(text.cast("binary"))
    fours = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*fours)), _DIGITS, _RFC4648)


def roles(pages: DataFrame, least: int = 0, key: str = "page_id", url: str = "url",
          payload: str = "html") -> DataFrame:
    """id, url, payload, size, digest, refers_to (null for a response)."""
    text = F.coalesce(column(pages, payload), F.lit(""))
    rows = (pages.select(column(pages, key).alias("id"), column(pages, url).alias("url"), text.alias("payload"))
            .withColumn("size", F.octet_length("payload").cast("long"))
            .withColumn("digest", base32_sha1(F.col("payload"))))
    rows = rows.withColumn("id", F.coalesce("id", F.raise_error(F.lit("a record without an id")).cast("long")))
    groups = (rows.where(F.col("size") >= least).groupBy("digest", "size")
              .agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("digest", "size", "response"))
    return (rows.join(groups, ["digest", "size"], "left")
            .withColumn("refers_to", F.when(F.col("id") != F.col("response"), F.col("response")))
            .drop("response"))


def chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table: a row for each chunk of a response, one for a revisit."""
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(""))
    n = F.greatest(F.lit(1), F.ceil(F.char_length(body) / F.lit(chunk))).cast("int")
    return (records.withColumn("chunks", n)
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("part", F.when(F.col("chunks") == 1, body).otherwise(
                F.substring(body, F.col("chunk") * chunk + 1, F.lit(chunk))))
            .drop("payload"))


def _urn(number: Column, segment: Column | None = None) -> Column:
    name = F.concat(F.lit("<urn:record:"), number.cast("string"))
    return F.concat(name, F.lit(">") if segment is None else F.concat(F.lit(":"), segment.cast("string"), F.lit(">")))


def record_text(rows: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The chunk table's rows as text of WARC records."""
    first, revisit = F.col("chunk") == 0, F.col("refers_to").isNotNull()
    several, last = F.col("chunks") > 1, F.col("chunk") == F.col("chunks") - 1
    block = F.concat(F.when(first, F.lit(_HTTP)).otherwise(F.lit("")), F.col("part"))

    def field(name: str, value: Column, when: Column | None = None) -> Column:
        line = F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        return line if when is None else F.when(when, line).otherwise(F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).when(first, F.lit("response")).otherwise(F.lit("continuation"))),
        field("WARC-Record-ID", F.when(first, _urn(F.col("id"))).otherwise(_urn(F.col("id"), F.col("chunk")))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", ""), F.col("url").isNotNull()),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        field("WARC-Refers-To", _urn(F.col("refers_to")), revisit),
        field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), revisit),
        field("WARC-Payload-Length", F.col("size").cast("string"), revisit),
        field("WARC-Segment-Number", (F.col("chunk") + 1).cast("string"), several),
        field("WARC-Segment-Origin-ID", _urn(F.col("id")), ~first),
        field("WARC-Segment-Total-Length", (F.col("size") + len(_HTTP)).cast("string"), several & last),
        field("Content-Type", F.lit("application/http; msgtype=response"), first),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(SEPARATOR))
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK, **columns: str) -> None:
    """Writes the pages' records as gzip WARC files under ``path``."""
    (record_text(chunks(roles(pages, least, **columns), chunk))
     .write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path))


class _Reader:
    """Takes the pieces between CRLF CRLF, which may lie within a block too;
    yields (headers, block) once a record's Content-Length is reached."""

    def __init__(self):
        self.headers: dict[bytes, bytes] | None = None
        self.stream = bytearray()

    def feed(self, piece: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
        self.stream += piece
        self.stream += b"\r\n\r\n"
        while True:
            if self.headers is None:
                while self.stream[:2] == b"\r\n":
                    del self.stream[:2]
                end = self.stream.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = bytes(self.stream[:end]).split(b"\r\n")
                if not lines[0].startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                self.headers = dict(line.split(b": ", 1) for line in lines[1:])
                del self.stream[:end + 4]
            size = int(self.headers[b"Content-Length"])
            if len(self.stream) < size:
                return
            block, headers = bytes(self.stream[:size]), self.headers
            del self.stream[:size]
            self.headers = None
            yield headers, block

    def open(self) -> bool:
        """Whether a record has begun and not ended."""
        return self.headers is not None or bool(self.stream.strip(b"\r\n"))


def _number(urn: bytes) -> int:
    return int(urn.decode().removeprefix("<urn:record:").removesuffix(">"))


READ_SCHEMA = ("id long, chunk int, last boolean, type string, url string, refers_to long, "
               "payload binary, size long, digest string")


def read_chunks(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The chunk table of an archive: id, chunk, last, type, url, refers_to,
    payload (this chunk's), and the record's size and digest so far; those of
    a revisit are its headers'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, state = _Reader(), None
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for piece in batch.column(0).cast(pa.binary()):
                for headers, block in reader.feed(piece.as_py()):
                    row, state = _chunk_row(headers, block, state, with_payload)
                    rows.append(row)
                    held += len(block)
                if held > CHUNK << 3:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
        if reader.open():
            raise ValueError("an archive ends within a record")

    pieces = spark.read.option("lineSep", SEPARATOR).schema("value string").text(path)
    return pieces.mapInArrow(tidy(run), READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.binary(),
             pa.int64(), pa.string()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _chunk_row(headers: dict[bytes, bytes], block: bytes, state, with_payload: bool):
    kind = headers[b"WARC-Type"].decode()
    url = headers.get(b"WARC-Target-URI")
    url = None if url is None else url.decode()
    if kind == "revisit":
        return ((_number(headers[b"WARC-Record-ID"]), 0, True, kind, url, _number(headers[b"WARC-Refers-To"]),
                 b"", int(headers[b"WARC-Payload-Length"]),
                 headers[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")), None)
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        state = [_number(headers[b"WARC-Record-ID"]), 0, hashlib.sha1(), 0]
    else:
        payload = block
        if state is None or state[0] != _number(headers[b"WARC-Segment-Origin-ID"]):
            raise ValueError("a continuation record without its origin before it")
        state[1] += 1
    state[2].update(payload)
    state[3] += len(payload)
    last = b"WARC-Segment-Number" not in headers or b"WARC-Segment-Total-Length" in headers
    row = (state[0], state[1], last, "response", url, None, payload if with_payload else b"", state[3],
           base64.b32encode(state[2].digest()).decode())
    return row, (None if last else state)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: its last chunk's size and digest."""
    return (read_chunks(spark, path, with_payload=False).where("last")
            .select("id", "url", "type", "refers_to", "size", "digest"))
