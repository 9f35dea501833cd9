"""WARC archives: written with an index, read by coalesced byte ranges.

Writing: records of equal payloads are found on digests alone. A payload's pages are dealt to 64 parts by page, which are
added up before they meet and joined part by part, so a hot payload is no hot task. Then pages and the narrow list of revisits go through
one shuffle together, and each task streams its part into one archive of gzip members and lists offset,
length, URL and digest of each record: the index. Reading starts from index rows: sorted by file and
offset, neighbouring ranges are read at once, and each member is unpacked and checked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import bounded_batches, fresh_folder, salted_totals, table, written

#: Payloads of at least so many bytes are stored once.
MIN_BYTES = 0
#: Ranges at most so far apart are read together, up to so many bytes at once.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
LEVEL = 4
#: Parts to which the pages of one payload are dealt.
SALTS = 64
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id bigint, url string, digest string, record_type string, file string, offset bigint, length bigint"
RECORD = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to bigint, payload binary"
)
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [(n, _ARROW[t]) for n, t in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], schema=pa.schema(fields))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, nth: int = 0) -> str:
    return f"<urn:brindle:page:{page_id}{f':{nth}' if nth else ''}>"


def page_of(record: str) -> int | None:
    page = record.strip("<>").split(":")[3]
    return None if page == "None" else int(page)


def build_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, nth: int
) -> bytes:
    """One record; a revisit has the header of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, nth)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", "%0A", url))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict[str, Any]:
    """The fields of :data:`RECORD` of one record; raises if a stored payload doesn't have its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    named = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = named["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"{named['WARC-Record-ID']}: the payload doesn't match its digest")
    return {
        "page_id": page_of(named["WARC-Record-ID"]),
        "url": named.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": named["WARC-Type"],
        "refers_to": page_of(named["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, k, refers_to) for pages whose payload an earlier page has; k: the payload's SHA-256."""
    keyed = pages.select("page_id", F.sha2("html", 256).alias("k"), F.octet_length("html").alias("n"))
    keyed = keyed.where(F.col("n") >= min_bytes).groupBy("page_id", "k").agg(F.count("*").alias("rows"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    least, total = F.min("page_id").alias("refers_to"), F.sum("rows").alias("total")
    first = salted_totals(keyed, ["k"], "salt", [least, total], [F.min("refers_to").alias("refers_to"), F.sum("total").alias("total")]).where("total > 1")
    return keyed.join(first.drop("total"), ["k", "salt"]).select("page_id", "k", "refers_to")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); returns the index.

    Of rows with equal payloads of at least ``min_bytes`` the one with the smallest page_id is a response and
    the others revisit it. Rows equal in page_id and payload: the first is the response. Null html:
    an empty payload. Very long ones: one record, held once. A null page_id counts as the largest; a null url: no header for
    it. An empty table: no archive. Other columns are ignored.
    """
    pages = bounded_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = pages.select(
        "page_id", F.sha2("html", 256).alias("k"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("bigint").alias("refers_to")
    )
    known = revisits(pages, min_bytes).select(
        "page_id", "k", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to"
    )
    both = known.unionByName(rows).repartition("page_id", "k").sortWithinPartitions("page_id", "k", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        file = f"pages-{TaskContext.get().partitionId():05d}.warc.gz"
        tmp = f"{root}/_{file}-{uuid.uuid4().hex}"
        out, at = None, 0
        last: tuple | None = None  # page_id and payload that stand next
        target: int | None = None
        repeated, nth = False, 0
        for batch in batches:
            listed = []
            for page_id, k, kind, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (page_id, k) != last:
                    last, repeated, nth = (page_id, k), False, 0
                if kind == 0:
                    repeated, target = True, refers_to
                    continue
                payload = html.encode()
                digest = sha1_base32(payload)
                # in a group of copies only the first row of the smallest page stays a response
                revisit = repeated and (target != page_id or nth > 0)
                packer = zlib.compressobj(LEVEL, wbits=31)
                raw = packer.compress(build_record(page_id, url, payload, digest, target, revisit, nth)) + packer.flush()
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(tmp)
                out.write(raw)
                listed.append((page_id, url, digest, "revisit" if revisit else "response", file, at, len(raw)))
                at += len(raw)
                nth += 1
            if listed:
                yield _batch(listed, INDEX)
        if out is not None:
            out.close()
            fs.move(tmp, f"{root}/{file}")

    return written(both.mapInArrow(write, INDEX), "warc-index")


def coalesced(ranges: Iterable[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) ranges in groups that are read at once."""
    group: list[tuple[int, int]] = []
    for at, n in ranges:
        if group and (at - sum(group[-1]) > gap or at + n - group[0][0] > most):
            yield group
            group = []
        group.append((at, n))
    if group:
        yield group


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows, as :data:`RECORD`. Each task takes a stretch of the sorted index, so
    a file that holds more records is read by more tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            wanted: dict[str, list[tuple[int, int]]] = {}
            for file, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted.setdefault(file, []).append((at, n))
            for file, ranges in wanted.items():
                with fs.open_input_file(f"{root}/{file}") as f:
                    for group in coalesced(ranges):
                        start = group[0][0]
                        f.seek(start)
                        raw = memoryview(f.read(sum(group[-1]) - start))
                        found = [parse_record(zlib.decompress(raw[a - start : a - start + n], wbits=31)) for a, n in group]
                        yield _batch([tuple(r.values()) for r in found], RECORD)

    files = max(1, index.select("file").distinct().count())
    spread = index.select("file", "offset", "length").repartitionByRange(files, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(read, RECORD)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC archives and read back."""
    folder = fresh_folder(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder).drop("url", "payload")
