"""WARC archives with segmented records, and their reassembly.

The writer makes a response record per page whose HTTP body uses chunked transfer coding; a block beyond the segment size
goes on in continuation records. A payload that an earlier page has is a revisit record without a body. Records are gzip
members of archives of a few MB, written as rows of a table in the shared folder. The reader parses archives wherever they
lie, groups segments by the identifier of the record that they began in, orders them by number, holds the sum of their
lengths against the total that the last one states, decodes the chunks and verifies the payload's digest.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemill.llm.common import join_hot, materialize, slices

#: Payloads below this size are never revisits; bytes of a record's block; of an HTTP chunk; of an archive, about.
REVISIT_FROM, SEGMENT, CHUNK, ARCHIVE = 100, 4096, 1500, 4 << 20
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


#: A page's row, null identifiers included: the columns at and lost, and the payload's digest.
ROW = ["at", "lost", "digest"]


def identified(pages: DataFrame) -> DataFrame:
    """page_id, url, body of the pages, with the columns of ROW."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    return own.withColumns({"at": F.coalesce("page_id", F.lit(0)), "lost": F.col("page_id").isNull(), "digest": F.sha2("body", 256)})


def roles(pages: DataFrame) -> DataFrame:
    """Of the pages (page_id, body, and the columns of ROW) that are revisits: ROW, refers_to, and how many rows there are."""
    rows = materialize(pages.where(F.length("body") >= REVISIT_FROM).groupBy(*ROW, "page_id").agg(F.count("*").alias("rows")))
    first = materialize(rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.sum("rows").alias("pages"), F.count("*").alias("n")).where("pages > 1 and refers_to is not null"))
    later = join_hot(rows, first.select("digest", "refers_to"), ["digest"], first.select("digest", "n"))
    return later.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(*ROW, "refers_to", "rows")


def record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def transfer_chunks(body: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p := body[i : i + size]), p) for i in range(0, len(body), size)) + b"0\r\n\r\n"


def decode_chunks(data: bytes) -> bytes:
    """The body of chunked transfer coding; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0], 16)
        if n < 0 or end + 2 + n > len(data):
            raise ValueError("a chunk goes beyond the block")
        if not n:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        if data[(at := end + 2 + n) : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        at += 2


def page_name(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{digest[:32]}"


def page_records(page_id: int | None, url: str | None, body: bytes, refers_to: int | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of a page: one, or a first segment and its continuations."""
    digest = hashlib.sha256(body).hexdigest()
    name, target = page_name(page_id, digest), [("WARC-Target-URI", re.sub(r"\s", "%20", url or "about:blank")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        fields = [*target, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{page_name(refers_to, digest)}>")]
        return [record("revisit", name, fields, HEAD + b"\r\n")]
    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + transfer_chunks(body)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return [record("response", name, target, block)]
    out = [record("response", name, [*target, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        out.append(record("continuation", f"{name}:{k}", [("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(k)), *total], part))
    return out


def write_archives(pages: DataFrame, path: str | None = None, segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """A table of archives: name, records and content (a whole .warc.gz file)."""
    own = identified(pages)
    later = materialize(roles(own))
    dealt = join_hot(own, later.drop("rows"), ROW, later.select(*ROW, F.col("rows").alias("n")), "left").select("page_id", "url", "body", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        info = gzip.compress(record("warcinfo", f"urn:info:{task}", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), 1, mtime=0)
        held, size = [info], len(info)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:05d}.warc.gz"]), pa.array([len(held)], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["name", "records", "content"])

        for batch in batches:
            for part in slices(batch, "body"):
                for r in part.to_pylist():
                    for data in page_records(r["page_id"], r["url"], r["body"], r["refers_to"], segment):
                        member = gzip.compress(data, 5, mtime=0)
                        if size + len(member) > archive and len(held) > 1:
                            yield row()
                            held, size, number = [info], len(info), number + 1
                        held.append(member)
                        size += len(member)
        if len(held) > 1:
            yield row()

    return materialize(dealt.mapInArrow(run, "name string, records int, content binary"), path, "uncompressed")


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a record does not begin where it should")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a .warc.gz file, member by member."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, data, pos = zlib.decompressobj(31), [], at
        while not unpack.eof:
            piece = view[pos : pos + 65_536]
            if not piece:
                raise ValueError("an archive ends inside a member")
            data.append(unpack.decompress(piece))
            pos += len(piece)
        pos -= len(unpack.unused_data)
        yield from records_of(b"".join(data))
        at = pos


SEGMENTS = "origin string, number int, total bigint, type string, digest string, refers_to string, copies bigint, block binary"


def segments(archives: DataFrame) -> DataFrame:
    """All response, revisit and continuation records of a table with the column content; equal ones of an archive are one
    row with their number as copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column(0).to_pylist():
                count: dict[tuple, int] = {}
                for f, block in parse(content):
                    if (kind := f["warc-type"]) in ("response", "revisit", "continuation"):
                        total = f.get("warc-segment-total-length")
                        row = ((f["warc-record-id"] if kind != "continuation" else f["warc-segment-origin-id"]).strip("<>"), int(f.get("warc-segment-number", 1)), None if total is None else int(total), kind, f.get("warc-payload-digest", "").removeprefix("sha256:") or None, f.get("warc-refers-to", "").strip("<>") or None, block)
                        count[row] = count.get(row, 0) + 1
                if count:
                    rows = [(*r[:-1], n, r[-1]) for r, n in count.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SEGMENTS.split(", ")])

    return archives.select("content").mapInArrow(run, SEGMENTS)


RECORDS = "origin string, type string, digest string, refers_to string, payload binary, fault string, copies bigint"


@dataclass
class Parts:
    """The segments of one origin, each number once, and how often its first segment is there."""

    by: dict[int, dict] = field(default_factory=dict)
    times: int = 0

    def add(self, part: dict) -> None:
        if part["type"] != "continuation":
            self.times += part["copies"]
        if part["number"] not in self.by:
            self.by[part["number"]] = part

    def record(self) -> tuple:
        """The origin's record, with a fault if it is broken."""
        by = self.by
        first, last, payload, fault = by.get(1), by[max(by)], None, None
        if first is None or first["type"] == "continuation":
            fault = "the first segment is missing"
        elif sorted(by) != list(range(1, len(by) + 1)):
            fault = "a segment is missing"
        else:
            block = b"".join(by[k]["block"] for k in sorted(by))
            if (len(by) > 1 and last["total"] is None) or (last["total"] is not None and last["total"] != len(block)):
                fault = "the total length differs"
            elif first["type"] == "response":
                try:
                    head, body = block.split(b"\r\n\r\n", 1)
                    payload = decode_chunks(body) if re.search(rb"\r\ntransfer-encoding:\s*chunked", head, re.IGNORECASE) else body
                    if first["digest"] and hashlib.sha256(payload).hexdigest() != first["digest"]:
                        payload, fault = None, "the digest differs"
                except ValueError as e:
                    payload, fault = None, str(e)
        first = first or by[min(by)]
        return first["origin"], first["type"], first["digest"], first["refers_to"], payload, fault, max(1, self.times)


def reassemble(found: DataFrame) -> DataFrame:
    """Whole records from segments(): origin, type, digest, refers_to, payload (of responses), fault (null if whole), and
    copies, how often the record is there. A task holds one record's segments at a time, whatever their copies."""
    dealt = found.repartition("origin").sortWithinPartitions("origin", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.string()] * 4 + [pa.binary(), pa.string(), pa.int64()], [c.split()[0] for c in RECORDS.split(", ")]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        held, origin = Parts(), None
        for batch in batches:
            for part in slices(batch, "block"):
                rows = []
                for r in part.to_pylist():
                    if held.by and origin != r["origin"]:
                        rows.append(held.record())
                        held = Parts()
                    origin = r["origin"]
                    held.add(r)
                if rows:
                    yield batch_of(rows)
        if held.by:
            yield batch_of([held.record()])

    return dealt.mapInArrow(run, RECORDS)


def archive_and_read(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and fault of every page, from what the archives hold.

    A null html is an empty payload. Of equal payloads of 100 bytes or more the smallest page_id is the response; rows that
    repeat it, and rows of payloads that have null ids only, are responses too. Repeated rows are read back as often as
    they were written; an empty table gives no rows.
    """
    whole = materialize(reassemble(segments(write_archives(pages, segment=segment))).select("type", "digest", "fault", "copies", F.length("payload").cast("bigint").alias("n"), F.nullif(F.split("origin", ":")[2], F.lit("null")).cast("bigint").alias("page_id"), F.nullif(F.split("refers_to", ":")[2], F.lit("null")).cast("bigint").alias("refers_to")))
    full = whole.where("type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.max("n").alias("full"))
    later = whole.where("type = 'revisit'")
    revisits = join_hot(later.where("refers_to is not null"), full, ["refers_to", "digest"], later.groupBy("refers_to", "digest").agg(F.count("*").alias("n")), "left")
    columns = ["page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "fault"]
    every = whole.where("type <> 'revisit'").select(*columns, "copies").unionByName(revisits.withColumn("n", F.col("full")).select(*columns, "copies"))
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies", "copy")


SQL = f"""
WITH own AS (
  SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
named AS (SELECT *, sha256(body) AS payload_digest FROM own),
placed AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM named),
judged AS (SELECT *, payload_bytes >= {REVISIT_FROM} AND least IS NOT NULL AND page_id IS DISTINCT FROM least AS later FROM placed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN later THEN least END AS refers_to, CAST(NULL AS VARCHAR) AS fault
FROM judged
"""
