"""WARC archives with duplicate payloads resolved to revisit records.

Headers, never payloads, are shuffled by payload digest: the smallest id of each digest is the response, and the others
become revisits that refer to it. A digest's minimum is summed map-side, and the join back to the headers is one that
adaptive execution splits, so a payload that a third of the pages share isn't one task's work. Archives are then written
with fresh headers (WARC/1.1, one gzip member a record, and a CDX-like index beside each), a response with its payload,
a revisit with the profile identical-payload-digest and no payload.

Reading does the reverse: each file is parsed, payloads are measured and hashed anew, and the headers of revisits are
joined to those of their responses by digest, which gives a revisit the length that its payload has.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from ._common import materialize, new_path

FILE_BYTES = 16 << 20
_PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, kind: str) -> str:
    """The same for the same page and content, so a task that runs again writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{payload_digest}:{kind}')}>"


def _clean(value: str) -> str:
    return re.sub(r"[\r\n\x00]+", " ", value).strip()


def render(kind: str, page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, refers_url: str | None, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    block = payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, payload_digest, kind)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "text/html; charset=utf-8")]
    if page_id is not None:
        head.append(("WARC-Source-ID", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, payload_digest, "response")), ("WARC-Refers-To-Date", date)]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", _clean(refers_url)))
    head.append(("Content-Length", str(len(block))))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(data: bytes, places: list[tuple[int, int]] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive, gzip member by member; ValueError if damaged.

    With `places`, the offsets and lengths of an index, only those members are read. Without, members are found by
    decompressing, a piece at a time, so that what is left over at a member's end is short.
    """
    view, at = memoryview(data), 0
    todo = iter(places) if places is not None else None
    while at < len(data) if todo is None else (place := next(todo, None)) is not None:
        member, parts = zlib.decompressobj(31), []
        if todo is not None:
            at = place[0]
        end = len(data) if todo is None else at + place[1]
        while at < end and not member.eof:
            piece = view[at : min(at + _PIECE, end)]
            parts.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        if not member.eof or todo is not None and at != end:
            raise ValueError("a record is cut off")
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = rest[: int(fields["content-length"])]
        if f"sha1:{digest(block)}" != fields["warc-block-digest"]:
            raise ValueError("a block's digest does not match")
        yield fields, block


def places(index: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each record, from the lines of an archive's index."""
    return [(int(a), int(b)) for a, b in (line.rsplit(" ", 2)[1:] for line in index.decode().split("\n") if line)]


def resolved(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`pages` as (page_id, url, payload, sha, refers_to, refers_url): refers_to is null for responses.

    Rows that repeat an id and a payload: all but one are revisits of that id. Rows without id refer to the smallest id
    of their payload if there is one, and are responses otherwise.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    heads = materialize(rows.select("page_id", "url", "sha", F.octet_length("payload").alias("size")), "heads").filter(F.col("size") >= least)
    first = heads.filter("page_id is not null").groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    # only digests that recur, or that rows without id have, have anything to resolve
    nameless = heads.filter("page_id is null").select("sha").distinct().withColumn("nameless", F.lit(True))
    first = first.join(nameless, "sha", "left").filter("n > 1 or nameless").select("sha", F.col("first.page_id").alias("to"), F.col("first.url").alias("to_url"))
    # one exchange of payloads, by a key that is never null, which the join and the writing share
    key = F.coalesce(F.col("page_id"), F.xxhash64("url")).alias("key")  # rows without id are dealt by their urls
    revisits = heads.join(first, "sha").groupBy(key, "sha").agg(F.max("to").alias("refers_to"), F.max("to_url").alias("refers_url"))
    return rows.select("*", key).repartition("key", "sha").join(revisits, ["key", "sha"], "left").select("page_id", "url", "payload", "sha", "refers_to", "refers_url", "key")


def write_archives(pages: DataFrame, folder: str, least: int = 0, **columns: str) -> DataFrame:
    """Write archives of `pages` to the folder; a written table (file) of their names, one for each 16 MB or task."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held, index, size, names, seen = TaskContext.get().partitionId(), 0, [], [], 0, [], None

        def close():
            nonlocal nth, held, index, size
            name = f"part-{part:06d}-{nth:05d}.warc.gz"
            files.write(folder, name, held)
            files.write(folder, f"{name}.cdx", ["".join(index).encode()])
            names.append(name)
            nth, held, index, size = nth + 1, [], [], 0

        for batch in batches:
            for page, url, payload, sha, to, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = base64.b32encode(bytes.fromhex(sha)).decode()
                # rows are sorted by id and digest: the first with the response's id is the response
                original = to is None or page == to and seen != (page, sha)
                seen = (page, sha)
                record = render("response" if original else "revisit", page, url, payload, key, None if original else to, None if original else to_url)
                index.append(f"{'' if url is None else _clean(url)} {page} {key} {'response' if original else 'revisit'} {size} {len(record)}\n")
                held.append(record)
                size += len(record)
                if size >= FILE_BYTES:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["file"])

    rows = resolved(pages, least, **columns)
    rows = rows.sortWithinPartitions("key", "sha", "url").drop("key")
    return materialize(rows.mapInArrow(write, "file string"), "files")


def read_archives(spark: SparkSession, folder: str, made: DataFrame, text: bool = False) -> DataFrame:
    """Per record of the files (file) of `made`: page_id, payload_bytes, payload_digest, record_type, refers_to (and html of responses, if asked)."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string" + ", html string" * text
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.int64(), pa.int64(), *[pa.string()] * (4 + text)]
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_id", "html"][: len(fields)]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                for head, block in parse(files.read(folder, name), places(files.read(folder, f"{name}.cdx"))):
                    page = head.get("warc-source-id")
                    kind, key = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest(block) != key:
                        raise ValueError("a payload's digest does not match")
                    out.append((None if page is None else int(page), len(block) if kind == "response" else None, key, kind, head["warc-record-id"], head.get("warc-refers-to"), block.decode() if text and kind == "response" else None)[: len(fields)])
                    if len(out) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names=columns)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names=columns)

    todo = made.select("file").repartition(max(1, min(made.count(), 4096)), "file")
    found = materialize(todo.mapInArrow(read, schema), "records")
    # revisits and their responses meet by digest and record id; a response is one row
    originals = found.filter("record_type = 'response'").select("payload_digest", F.col("record_id").alias("refers_id"), F.col("page_id").alias("to"), F.col("payload_bytes").alias("size")).distinct()
    visits = found.filter("record_type = 'revisit'").join(originals, ["payload_digest", "refers_id"], "left")
    keep = ["html"] * text
    visits = visits.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", F.col("to").alias("refers_to"), *keep)
    own = found.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), *keep)
    return own.unionByName(visits)


def archived(pages: DataFrame, least: int = 0, **columns: str) -> DataFrame:
    """Write `pages` as archives in the shared folder and return what the archives hold.

    Payloads of fewer than `least` bytes are all responses. Defined results: a null html is an empty payload; null urls
    have no target header; of rows that repeat an id and a payload one is the response and the others revisit it; rows
    without id refer to their payload's smallest id if there is one; an empty table gives no files and no rows; other
    columns are ignored.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder, least, **columns))


#: Five hexadecimal digits of a SHA-1 are four characters of base32.
_BASE32_SQL = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(sha, {i}, 5) as bigint) >> {k}) & 31), 1)" for i in range(1, 41, 5) for k in (15, 10, 5, 0))
ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
f as (select *, min(page_id) over (partition by html) as first_id from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, {_BASE32_SQL} as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from f
"""
