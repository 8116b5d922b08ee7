"""WARC archives: written with an index, read by coalesced byte ranges.

Writing returns the index first: a row for each record with archive, offset,
length, URL and digest, staged as a table of its own. A read selects index rows,
sorts them by archive and offset and fetches neighbours in one byte range.
Archives are gzip members, one a record, in a folder of the shared storage. A
task writes files of names of its own, which only the index of the attempt that
was committed refers to; so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, stage

#: Payloads below this size are always written whole.
REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
#: Ranges are joined over gaps of so many bytes, up to a size.
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20
#: Bytes of archives that a task reads, about.
READ_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _name(page_id) -> str:
    return f"<urn:x-page:{'' if pd.isna(page_id) else int(page_id)}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str = DATE) -> bytes:
    """One record, before compression. A revisit has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; payload is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda s: int(s[12:-1]) if s and s[12:-1] else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields.get("WARC-Refers-To")),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write a record for each row of ``pages`` and return the index, staged.

    Of rows with equal payloads (UTF-8 html, null: empty) of at least
    ``revisit_bytes``, those with the smallest page_id become responses (one,
    unless page_ids repeat) and others revisits of it. Rows without page_id
    revisit if any row with one has their payload. A null url leaves the field
    out; control characters and spaces in urls are percent-encoded in the record
    and kept in the index. An empty table gives an empty index; other columns
    are not looked at.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    thin = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = thin.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    rows = thin.join(first.hint("shuffle_hash"), "digest", "left").select("page_id", "url", "payload", "digest", "first")

    def write(it: Iterator[pd.DataFrame]):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        try:
            for pdf in it:
                index = []
                for r in pdf.itertuples(index=False):
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    revisit = not pd.isna(r.first) and (pd.isna(r.page_id) or r.page_id != r.first)
                    raw = record(r.page_id, r.url, bytes(r.payload), r.digest, r.first, revisit, date)
                    z = zlib.compressobj(5, zlib.DEFLATED, 31)
                    body = z.compress(raw) + z.flush()
                    out.write(body)
                    index.append((f"{folder}/{name}", offset, len(body), None if pd.isna(r.page_id) else int(r.page_id), r.url, r.digest, "revisit" if revisit else "response"))
                    offset += len(body)
                yield pd.DataFrame(index, columns=["archive", "offset", "length", "page_id", "url", "digest", "record_type"]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return stage(rows.mapInPandas(write, INDEX), "warc-index")


def ranges(rows: pd.DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> Iterator[tuple[str, int, int, list]]:
    """Byte ranges (archive, from, to, records) that cover sorted index rows."""
    archive, start, end, records = None, 0, 0, []
    for name, offset, length in zip(rows["archive"], rows["offset"], rows["length"], strict=True):
        if name != archive or offset - end > gap or offset + length - start > most:
            if records:
                yield archive, start, end, records
            archive, start, records = name, offset, []
        end = offset + length
        records.append((offset, length))
    if records:
        yield archive, start, end, records


def read_records(selected: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the selected index rows. Response digests are computed anew from the payload that was read; ``payloads`` False leaves payloads out of the result."""

    def read(it: Iterator[pd.DataFrame]):
        name, file = "", None
        try:
            for pdf in it:
                for archive, a, z, records in ranges(pdf, gap, most):
                    if name != archive:
                        if file is not None:
                            file.close()
                        fs, path = pafs.FileSystem.from_uri(archive)
                        name, file = archive, fs.open_input_file(path)
                    body = file.read_at(z - a, a)
                    rows = [parse(zlib.decompress(body[o - a : o - a + n], 31)) for o, n in records]
                    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})
                    yield out if payloads else out.assign(payload=None)
        finally:
            if file is not None:
                file.close()

    # By the bytes that are read, not by those of the index; a number that is asked for stays.
    chosen = selected.select("archive", "offset", "length")
    parts = max(selected.sparkSession.sparkContext.defaultParallelism, -(-(chosen.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    slot = F.floor(F.col("offset") / F.lit(most))
    return chosen.repartition(parts, "archive", slot).sortWithinPartitions("archive", "offset").mapInPandas(read, RECORDS)
