"""WARC archives with an index first: writing, and reading by coalesced byte ranges.

Writers deal the pages over tasks; each task appends gzip members (one a record) to files of
bounded size under the given folder and returns one index row a record: page_id, archive,
offset, length, url, digest. The index is written as a table before anything reads it, so a
task that runs again leaves at most files to which no index row points.

A reader takes any selection of the index, sorts it by archive and offset, merges ranges
that lie close together into one read of bounded size, and parses the records out of it.

Defined results: a null html is an empty payload; a null url leaves out the target header;
of equal payloads of ``least`` bytes or more the one of smallest page_id is the response and
pages of larger (or null) ids are revisits, so rows that repeat the smallest id are
responses too; an empty table gives an empty index; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import NOBODY, fresh_path, id_or_nobody, materialize, null_again

INDEX = "page_id long, archive string, offset long, length long, url string, digest string"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2024-01-01T00:00:00Z"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if refers_to is None else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}')}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "WARC/1.1\r\n".encode() + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The parts of one record; raises if its payload doesn't match its digest."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, refers_to = head["WARC-Payload-Digest"].removeprefix("sha256:"), head.get("WARC-Refers-To-Page-ID")
    if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    page_id = head.get("WARC-Page-ID")
    return {
        "page_id": None if page_id is None else int(page_id),
        "url": head.get("WARC-Target-URI"),
        "payload": payload if refers_to is None else None,
        "payload_bytes": int(head["WARC-Payload-Length"]),
        "payload_digest": digest,
        "record_type": head["WARC-Type"],
        "refers_to": None if refers_to is None else int(refers_to),
    }


def write_warc(pages: DataFrame, folder: str | None = None, *, least: int = 100, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write a record per page; the index, one row a record, as a table already written."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    digest = F.sha2("payload", 256)
    # equal payloads: only digests are grouped, and only those that occur twice are joined
    same = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy(digest.alias("same"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 AND first_id IS NOT NULL")
        .select("same", "first_id")
    )
    rows = rows.withColumn("digest", digest).join(same, F.col("digest") == F.col("same"), "left")
    again = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(again, F.col("first_id")).alias("refers_to"))
    rows = rows.withColumns({c: id_or_nobody(c) for c in ("page_id", "refers_to")})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for f in frames:
                index = []
                for page_id, url, payload, d, refers_to in f.itertuples(index=False):
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    ids = [None if x == NOBODY else int(x) for x in (page_id, refers_to)]
                    member = gzip.compress(record(ids[0], url, bytes(payload), d, ids[1]), 1, mtime=0)
                    out.write(member)
                    index.append((page_id, f"{folder}/{name}", at, len(member), url, d))
                    at += len(member)
                yield pd.DataFrame(index, columns=["page_id", "archive", "offset", "length", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    return materialize(null_again(rows.mapInPandas(write, INDEX), "page_id"), "warc-index")


def read_warc(index: DataFrame, *, gap: int = 64 << 10, span: int = 8 << 20) -> DataFrame:
    """The records to which the rows of ``index`` point: one row for each, payload null for revisits.

    Neighbours at most ``gap`` bytes apart are read at once, up to ``span`` bytes or one record.
    """
    by = Window.partitionBy("archive").orderBy("offset")
    end = F.col("offset") + F.col("length")
    part = F.floor(F.col("offset") / span)
    ranges = (
        index.select("archive", "offset", "length", "page_id")
        .withColumn("cut", ((F.lag(part).over(by) != part) | (F.col("offset") - F.lag(end).over(by) > gap)).cast("int"))
        .withColumn("piece", F.sum(F.coalesce("cut", F.lit(1))).over(by))
        .groupBy("archive", "piece")
        .agg(F.min("offset").alias("first"), F.max(end).alias("last"), F.sort_array(F.collect_list(F.struct("offset", "length", "page_id"))).alias("records"))
        .select("archive", "first", "last", "records")
    )
    # a range is little to shuffle but much to read, so tasks go by the bytes to read
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = ranges.repartition(max(1, -(-size // (2 * span))), "archive", "first")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for archive, first, last, records in f.itertuples(index=False):
                fs, path = pyarrow.fs.FileSystem.from_uri(archive)
                with fs.open_input_file(path) as source:
                    data = source.read_at(int(last - first), int(first))
                rows = []
                for x in records:
                    at = x["offset"] - first
                    got = parse(zlib.decompress(data[at : at + x["length"]], wbits=31))
                    if got["page_id"] != x["page_id"]:
                        raise ValueError(f"the index takes {x['page_id']} for {got['page_id']}")
                    rows.append(got)
                ids = {c: pd.array([r[c] for r in rows], "Int64") for c in ("page_id", "refers_to")}
                yield pd.DataFrame(rows).assign(**ids)

    return ranges.mapInPandas(read, RECORDS)


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > f THEN f END AS refers_to
FROM q
"""
