"""WARC archives with revisit resolution.

Payload digests are computed where the rows are; only headers (digest and page) are shuffled, and only digests that
occur more than once are joined back to the pages. Archives are written by Spark's text writer, with the two CRLF that
end each record as its line separator, so any file system and the usual commit of tasks serve; each file begins with a
warcinfo record. They are read back as a stream of pieces in file order, cut by Content-Length; revisits are then joined
to the responses they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import re
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, fresh_path, keyed, light, stage, table

END = "\r\n\r\n"
MIN_BYTES = 0
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SPECIFICATION = "http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: four characters for every five hex digits."""
    h = F.sha1(payload)
    bits = lambda i: F.conv(F.substring(h, i * 5 + 1, 5), 16, 10).cast("int")
    char = lambda n: F.substring(F.lit(_BASE32), n + 1, F.lit(1))
    return F.concat(*[char(F.shiftright(bits(i), s).bitwiseAND(F.lit(31))) for i in range(8) for s in (15, 10, 5, 0)])


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages (with a row key) with payload, payload_digest, payload_bytes, refers_to, first (the response's row key) and
    first_url.

    Of equal payloads of min_bytes or more, the row with the smallest page_id answers, null ids last and one of the
    rows that repeat."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(KEY, "page_id", "url", body.alias("payload"))
    rows = rows.withColumns({"payload_digest": base32_sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")})
    heads = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", KEY, "url")).alias("first"))
    again = stage(heads.where("n > 1").select("payload_digest", F.col("first.page_id").alias("first_page"), F.col(f"first.{KEY}").alias("first"), F.col("first.url").alias("first_url")), "again")
    out = rows.join(light(again), "payload_digest", "left")
    revisit = F.coalesce((F.col("first") != F.col(KEY)) & (F.col("payload_bytes") >= min_bytes), F.lit(False))
    return out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_page"))).withColumn("first", F.when(revisit, F.col("first")))


def _uri(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("urn:none")), "[\\x00-\\x20\\x7f]+", "%20")


def _uuid(key: Column) -> Column:
    h = F.concat(F.lpad(F.lower(F.hex(key)), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit("record"), key))), 16, "0"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def records(resolved: DataFrame, date: str) -> DataFrame:
    """(value): each record without the two CRLF behind it; the first of a partition has a warcinfo record before it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    is_new = F.col("record_type") == "response"
    block = F.when(is_new, F.concat(http, F.col("payload"))).otherwise(http)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _uuid(F.col(KEY))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(is_new, "").otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _uuid(F.col("first"))), line("WARC-Refers-To-Target-URI", _uri(F.col("first_url"))), line("WARC-Refers-To-Date", F.lit(date)), line("X-Refers-To-Page", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    about = f"software: skein\r\nformat: WARC File Format 1.1\r\nconformsTo: {SPECIFICATION}\r\n"
    info = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit("warcinfo")), line("WARC-Record-ID", _uuid(F.xxhash64(F.lit("warcinfo"), KEY))), line("WARC-Date", F.lit(date)),
        F.lit(f"Content-Type: application/warc-fields\r\nContent-Length: {len(about)}{END}{about}{END}"),
    )
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return resolved.select(F.concat(F.when(first, info).otherwise(""), head, block).alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str | None = None) -> None:
    """Write deduplicated gzip archives to a folder, each partition one file; their date is now unless it is given."""
    records(resolve(pages, min_bytes), date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


class Parser:
    """Cuts records out of a stream of pieces, by Content-Length."""

    def __init__(self) -> None:
        self.held, self.size, self.need = [], 0, 1

    def feed(self, piece: bytes):
        self.held.append(piece)
        self.size += len(piece)
        while self.size >= self.need:
            data = b"".join(self.held)
            self.held, self.need = [data], self.size + 1
            at = data.find(b"\r\n\r\n")
            if at < 0:
                return
            length = int(re.search(rb"(?im)^Content-Length: *([0-9]+)", data[:at])[1])
            if len(data) < at + 8 + length:
                self.need = at + 8 + length
                return
            yield dict(x.split(b": ", 1) for x in data[:at].split(b"\r\n")[1:]), data[at + 4 : at + 4 + length]
            self.held = [data[at + 8 + length :]]
            self.size, self.need = len(self.held[0]), 1
            if not self.size:
                return


def read(spark, path: str) -> DataFrame:
    """(record_id, page_id, record_type, digest, payload_bytes, refers, refers_to) of each record; a response's digest
    and length are those of its payload, a revisit's come from its header and its original."""

    def run(frames):
        parser, path_now = Parser(), None
        for frame in frames:
            rows = []
            for path, piece in zip(frame["path"], frame["value"], strict=True):
                if path != path_now:  # pieces of a file come in order; files are not mixed
                    parser, path_now = Parser(), path
                for head, block in parser.feed(piece.encode() + b"\r\n\r\n"):
                    if head[b"WARC-Type"] == b"warcinfo":
                        continue
                    kind, body = head[b"WARC-Type"].decode(), block.partition(b"\r\n\r\n")[2]
                    new = kind == "response"
                    rows.append((head[b"WARC-Record-ID"].decode(), int(head[b"X-Page-ID"]) if head[b"X-Page-ID"] else None, kind, base64.b32encode(hashlib.sha1(body).digest()).decode() if new else head[b"WARC-Payload-Digest"].decode()[5:], len(body) if new else None, None if new else head[b"WARC-Refers-To"].decode(), int(head[b"X-Refers-To-Page"]) if head.get(b"X-Refers-To-Page") else None))
            yield pd.DataFrame(rows, columns=["record_id", "page_id", "record_type", "payload_digest", "payload_bytes", "refers", "refers_to"], dtype=object).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    pieces = spark.read.option("lineSep", END).text(path).select(F.input_file_name().alias("path"), "value")
    return pieces.mapInPandas(run, "record_id string, page_id long, record_type string, payload_digest string, payload_bytes long, refers string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write archives for pages, read them back, and give each page its payload's length and digest, the record's type
    and the page it refers to.

    A null html is an empty payload. Rows may repeat; each is a record. An empty table gives no rows. Columns besides
    page_id, url and html are not read."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(keyed(pages.select("page_id", "url", "html")), path, min_bytes)
    back = stage(read(spark, path), "records")
    revisits = back.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers", "refers_to")
    wanted = stage(revisits.select(F.col("refers").alias("record_id")).distinct(), "wanted")
    originals = back.join(wanted, "record_id", "left_semi").select(F.col("record_id").alias("refers"), "payload_bytes", F.col("payload_digest").alias("original"))
    resolved = revisits.join(originals, "refers").where("payload_digest = original")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return back.where("record_type = 'response'").select(*columns).union(resolved.select(*columns))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))
