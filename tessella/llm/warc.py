"""WARC archives with revisit records for payloads that occur before.

1. Payload digests are computed where pages are read; per digest the smallest page_id is aggregated.
2. Pages join that by digest (a hot digest's pages are split by the adaptive skew join) and are written as records: the
   first page of a payload as a response with it, others as revisits with fresh headers that refer to the response.
   Archives are gzip files of WARC/1.1 records in the shared folder, as many as the join has partitions.
3. Archives are read back line by line, in whatever size they are, and parsed by Content-Length. A response's length and
   digest come from its block, and must be what its header says; a revisit's come from the response that it refers to, by a
   join on record id and payload digest. A revisit without its response is an error.

An archive has at most RECORDS records. It is one gzip member, as Spark's text writer makes it, not one a record.

Defined cases: null html is the empty payload, null page_id is written as such and is never referred to while another page
has the payload; rows that repeat a page in full are all responses if the page is the first; rows that repeat a page_id
with other payloads are records of the same id, told apart by digest; an empty table gives no rows; null url is an empty
header; a very long payload is held as the one value that it is; further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.storage import new_path

#: Payloads of fewer bytes are always written as responses.
LEAST_BYTES = 0
#: Records of an archive at most.
RECORDS = 10_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _b32(sha1: Column) -> Column:
    """Bare upper-case base32 of 20 bytes: 32 letters of five bits, from four groups of five bytes."""
    hexed = F.hex(sha1)
    groups = [F.conv(F.substring(hexed, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    letter = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (n + 1).cast("int"), F.lit(1))
    return F.concat(*[letter(F.shiftright(g, 35 - 5 * k).bitwiseAND(31)) for g in groups for k in range(8)])


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One column, value: each page's record but for its last line feed."""
    clean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digested = clean.withColumn("sha1", F.unhex(F.sha1("html")))
    least = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    firsts = digested.groupBy("sha1").agg(F.min(least).alias("first")).select("sha1", F.col("first.page_id").alias("first_id"))
    length = F.octet_length("html")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id")) & (length >= least_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    digest = F.concat(F.lit("sha1:"), _b32(F.col("sha1")))
    url = F.regexp_replace("url", r"[\r\n]+", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", digest),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("first_id"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, 0).otherwise(length).cast("string")),
        F.lit("\r\n"),
    )
    # the writer of lines ends each with the last of a record's four closing bytes
    return digested.join(firsts, "sha1").select(F.concat(head, F.when(revisit, "").otherwise(F.col("html")), F.lit("\r\n\r")).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    records(pages, least_bytes).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


class _Lines:
    """Reads bytes from an archive's lines as they come."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches, self.held, self.at = batches, b"", 0

    def _more(self) -> bool:
        for batch in self.batches:
            if batch.num_rows:
                lines = batch.column(0).cast(pa.large_binary()).to_pylist()
                self.held, self.at = self.held[self.at :] + b"\n".join(lines) + b"\n", 0
                return True
        return False

    def line(self) -> bytes | None:
        """Up to the next line feed; None at the end."""
        begin = self.at
        while (end := self.held.find(b"\n", begin)) < 0:
            left = len(self.held) - self.at
            if not self._more():
                return None
            begin = left
        out, self.at = self.held[self.at : end].removesuffix(b"\r"), end + 1
        return out

    def block(self, n: int) -> bytes:
        parts, missing = [], n
        while missing:
            got = self.held[self.at : self.at + missing]
            parts.append(got)
            self.at += len(got)
            missing -= len(got)
            if missing and not self._more():
                raise ValueError("the archive ends within a record")
        return b"".join(parts)


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each record, from batches of an archive's lines."""
    read = _Lines(batches)
    while (first := read.line()) is not None:
        if first != b"WARC/1.1":
            raise ValueError(f"no record begins here: {first[:40]!r}")
        headers = {}
        while line := read.line():
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        block = read.block(int(headers["Content-Length"]))
        if read.block(4) != b"\r\n\r\n":
            raise ValueError("the record has no end")
        yield headers, block


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "refers_to", "bytes", "digest"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 3 + [pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows: list[tuple] = []
    for h, block in parsed(batches):
        response, said = h["WARC-Type"] == "response", h["WARC-Payload-Digest"].removeprefix("sha1:")
        if response and base64.b32encode(hashlib.sha1(block).digest()).decode() != said:
            raise ValueError(f"{h['WARC-Record-ID']} does not have the payload that its header names")
        rows.append((h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Refers-To"), len(block) if response else None, said))
        if len(rows) >= 10_000:
            yield out(rows)
            rows = []
    if rows:
        yield out(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, refers_to, the payload's digest, and of responses the block's bytes.

    A gzip file is read by one task from its first line to its last, and a task's files one after the other."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.mapInArrow(_read_back, "record_id string, record_type string, refers_to string, bytes long, digest string")


def resolved(read: DataFrame) -> DataFrame:
    """Each record's page, with length and digest of its full payload."""
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    responses = read.where("record_type = 'response'")
    # a response's id and digest have one row, unless the input repeats the page in full
    known = responses.groupBy(F.col("record_id").alias("refers_to"), "digest").agg(F.first("bytes").alias("found"))
    revisits = read.where("record_type = 'revisit'").drop("bytes").join(known, ["refers_to", "digest"], "left")
    missing = F.raise_error(F.concat(F.lit("no response for "), F.col("record_id"))).cast("long")
    revisits = revisits.select("record_id", "record_type", "refers_to", F.coalesce("found", missing).alias("bytes"), "digest")
    return responses.unionByName(revisits).select(page("record_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def op6_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolved(read_archives(spark, path))


QUERIES = {"op6_revisit_resolution": op6_revisit_resolution}
SQL = {
    "op6_revisit_resolution": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY 1),
        d AS (SELECT page_id, first_id, strlen(h) AS n, list_transform(generate_series(0, 3), lambda g: ('0x' || substr(sha1(h), 1 + 10 * g, 10))::BIGINT) AS g FROM p JOIN f USING (h))
        SELECT page_id, n AS payload_bytes,
               list_reduce(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((g[1 + k // 8] >> (35 - 5 * (k % 8))) & 31) + 1)::BIGINT, 1)), lambda a, b: a || b) AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d"""
}
