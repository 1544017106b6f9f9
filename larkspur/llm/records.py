"""Length-delimited binary token records with masked checksums and a separate offset index.

File format (all numbers little-endian), record after record, as in the public TFRecord framing:

    uint64 length | uint32 masked CRC-32C of the length's 8 bytes | data | uint32 masked CRC-32C of the data

The data of a record is `int64 doc_id | uint8 flags (1: doc_id is null) | uint8 bytes per id | ids`. Beside each
`part-NNNNN.rec` stands `part-NNNNN.idx` with a uint64 offset for each record and the file's length at last, so records
can be read in any order. Files hold ascending doc_id (nulls first; ties by the text's hash) and follow each other.

Defined results: a null or empty text is a record of the end id only; repeated rows are repeated records; an empty
table gives no files and an empty result; other columns of the input are ignored. A very long text is one long record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from ._common import materialize, new_path, text_hash, utf8
from .encode import encoder

#: Content of one file and, at most, of what a task holds while it writes or reads.
FILE_BYTES = 16 << 20
_HEAD = 10
_BLOCK = 512


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables for eight bytes at a time, and those that carry a register over a block of zero bytes."""
    t = np.zeros((8, 256), np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> 8) ^ t[0][t[k - 1] & 0xFF]
    over = np.zeros((4, 256), np.uint32)
    for k in range(4):
        c = (np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).astype(np.uint32)
        for _ in range(_BLOCK):
            c = (c >> 8) ^ t[0][c & 0xFF]
        over[k] = c
    return t, over


_T, _OVER = _tables()


def crc32c(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of buf[start:start + size] for each, computed for all together block by block."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    blocks = np.maximum(1, -(-sizes // _BLOCK))
    first = np.cumsum(blocks) - blocks
    reg = np.empty(int(blocks.sum()), np.uint32)
    step = 4096  # blocks at a time
    owner = np.repeat(np.arange(n), blocks)
    nth = np.arange(len(owner)) - first[owner]
    pad = blocks * _BLOCK - sizes  # zero bytes in front leave an empty register empty
    for a in range(0, len(owner), step):
        o, k = owner[a : a + step], nth[a : a + step]
        begin = starts[o] - pad[o] + k * _BLOCK
        at = begin[:, None] + np.arange(_BLOCK)
        rel = at - starts[o][:, None]
        data = np.where(rel >= 0, buf[np.clip(at, 0, len(buf) - 1)] if len(buf) else 0, 0).astype(np.uint8)
        data ^= np.where((rel >= 0) & (rel < np.minimum(4, sizes[o])[:, None]), 0xFF, 0).astype(np.uint8)
        c = np.zeros(len(o), np.uint32)
        for j in range(0, _BLOCK, 8):
            b = data[:, j : j + 8]
            c = _T[7][b[:, 0] ^ (c & 0xFF)] ^ _T[6][b[:, 1] ^ ((c >> 8) & 0xFF)] ^ _T[5][b[:, 2] ^ ((c >> 16) & 0xFF)] ^ _T[4][b[:, 3] ^ (c >> 24)] ^ _T[3][b[:, 4]] ^ _T[2][b[:, 5]] ^ _T[1][b[:, 6]] ^ _T[0][b[:, 7]]
        reg[a : a + step] = c
    out, live, k = np.zeros(n, np.uint32), np.arange(n), 0
    while len(live):
        c = out[live]
        out[live] = _OVER[0][c & 0xFF] ^ _OVER[1][(c >> 8) & 0xFF] ^ _OVER[2][(c >> 16) & 0xFF] ^ _OVER[3][c >> 24] ^ reg[first[live] + k]
        k += 1
        live = live[blocks[live] > k]
    short = np.flatnonzero(sizes < 4)  # the first register's ones reach past the data
    for i in short:
        c = 0xFFFFFFFF
        for b in buf[starts[i] : starts[i] + sizes[i]]:
            c = (c >> 8) ^ int(_T[0][(c ^ int(b)) & 0xFF])
        out[i] = c
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def pack(doc_ids: list[int | None], ids: np.ndarray, offsets: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """(framed records, their offsets and the end) for ids[offsets[i]:offsets[i + 1]]."""
    n = len(doc_ids)
    if width == 2 and len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("an id above 65,535 needs width 4")
    sizes = _HEAD + np.diff(offsets) * width
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(sizes + 16, out=begin[1:])
    out = np.zeros(int(begin[-1]), np.uint8)
    body = ids.astype("<u2" if width == 2 else "<u4").view(np.uint8)
    lengths = np.ascontiguousarray(sizes.astype("<u8")).view(np.uint8).reshape(n, 8)
    out[begin[:-1, None] + np.arange(8)] = lengths
    head = np.zeros((n, _HEAD), np.uint8)
    head[:, :8] = np.array([x or 0 for x in doc_ids], "<i8").view(np.uint8).reshape(n, 8)
    head[:, 8] = [x is None for x in doc_ids]
    head[:, 9] = width
    out[begin[:-1, None] + 12 + np.arange(_HEAD)] = head
    for i in range(n):
        out[begin[i] + 12 + _HEAD : begin[i + 1] - 4] = body[offsets[i] * width : offsets[i + 1] * width]
    four = np.arange(4)
    sums = masked(crc32c(lengths.reshape(-1), np.arange(n) * 8, np.full(n, 8)))
    out[begin[:-1, None] + 8 + four] = sums.astype("<u4").view(np.uint8).reshape(n, 4)
    sums = masked(crc32c(out, begin[:-1] + 12, sizes))
    out[begin[1:, None] - 4 + four] = sums.astype("<u4").view(np.uint8).reshape(n, 4)
    return out.tobytes(), begin


def unpack(data: bytes, index: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids as uint32) of each record, in file order or that of the offsets given; ValueError if one is damaged."""
    buf = np.frombuffer(data, np.uint8)
    if index is None:
        found, at = [], 0
        while at < len(buf):
            found.append(at)
            at += 16 + int.from_bytes(data[at : at + 8], "little")
        index = np.array(found, np.int64)
    index = np.asarray(index, np.int64)
    n, word = len(index), np.arange(4)
    u4 = lambda at: np.ascontiguousarray(buf[at[:, None] + word]).view("<u4").reshape(-1)
    if n and index.max() + 16 > len(buf):
        raise ValueError("a record is cut off")
    if not (masked(crc32c(buf, index, np.full(n, 8))) == u4(index + 8)).all():
        raise ValueError("a length's checksum does not match")
    sizes = np.array([int.from_bytes(data[i : i + 8], "little") for i in index], np.int64)
    if n and (index + 16 + sizes).max() > len(buf):
        raise ValueError("a record is cut off")
    if not (masked(crc32c(buf, index + 12, sizes)) == u4(index + 12 + sizes)).all():
        raise ValueError("a record's checksum does not match")
    for i, size in zip(index, sizes, strict=True):
        doc = None if data[i + 20] else int.from_bytes(data[i + 12 : i + 20], "little", signed=True)
        yield doc, np.frombuffer(data, "<u2" if data[i + 21] == 2 else "<u4", (size - _HEAD) // data[i + 21], i + 12 + _HEAD).astype(np.uint32)


def write_records(docs: DataFrame, folder: str, vocabulary: str, spaces: str, end: int, width: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and write them in ascending id order; a written table (file, part, nth, records, ids) of the files.

    The texts are dealt by ranges of id, text hash and place in the input, so files of later tasks hold later ids, and
    rows of one id, or without any, are no single task's. `width` is 2 or 4 bytes an id; ids that don't fit are an error.
    """
    if width not in (2, 4):
        raise ValueError("width: 2 or 4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, nth = encoder(vocabulary, spaces), TaskContext.get().partitionId(), 0
        held, size, n, total, names = [], 0, 0, 0, []
        places: list[np.ndarray] = []

        def close():
            nonlocal held, size, n, total, places, nth
            name = f"part-{part:06d}-{nth:05d}"
            files.write(folder, f"{name}.rec", held)
            files.write(folder, f"{name}.idx", [np.append(np.concatenate(places), size).astype("<u8").tobytes()])
            names.append((name, part, nth, n, total))
            held, size, n, total, places, nth = [], 0, 0, 0, [], nth + 1

        for batch in batches:
            buf, offsets = utf8(batch.column(1))
            who = batch.column(0).to_pylist()
            for a in range(0, len(who), 500):
                b = min(a + 500, len(who))
                ids, o = enc.encode_many(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end)
                data, begin = pack(who[a:b], ids, o, width)
                held.append(data)
                places.append(begin[:-1] + size)
                size, n, total = size + len(data), n + b - a, total + len(ids)
                if size >= FILE_BYTES:
                    close()
        if n:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "part", "nth", "records", "ids"), x, strict=True)) for x in names], schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("nth", pa.int32()), ("records", pa.int64()), ("ids", pa.int64())]))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_hash(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "text")
    return materialize(rows.mapInArrow(write, "file string, part int, nth int, records long, ids long"), "manifest")


def read_records(spark: SparkSession, folder: str, made: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of the files in the table of write_records."""
    # a file's start: the ids of the tasks before (one row a task), and of the task's own files before
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    tasks = made.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(ahead.orderBy("part")), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("ids").over(ahead.partitionBy("part").orderBy("nth")), F.lit(0)).alias("inner")
    todo = made.select("file", "part", inner).join(tasks, "part").select("file", (F.col("base") + F.col("inner")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = np.frombuffer(files.read(folder, f"{name}.idx"), "<u8").astype(np.int64)
                out: list[tuple] = []
                for doc, ids in unpack(files.read(folder, f"{name}.rec"), index[:-1]):
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    todo = todo.repartition(max(1, min(made.count(), 4096)), "file")
    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, vocabulary: str, spaces: str, end: int) -> DataFrame:
    """Write the records of `docs` to the shared folder and return what the files hold."""
    spark = docs.sparkSession
    folder = new_path(spark, "records")
    return read_records(spark, folder, write_records(docs, folder, vocabulary, spaces, end))
