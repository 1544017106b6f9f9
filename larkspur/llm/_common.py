"""Shared folder, Arrow text buffers and group streaming used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Settings of a write: shuffle files go as soon as their query has ended, and Arrow batches of long texts stay small.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
#: Bytes of text that one numpy pass works on; arrays are some 60 times that.
CHUNK_BYTES = 1 << 20
_own: list[str] = []
_lock = threading.Lock()
_writing: dict[int, list] = {}  # session -> [writes that run, the settings before them]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master, as in tests, may leave it unset: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local($|\[)", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="larkspur-"))
        atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), ignore_errors=True)
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """_SETTINGS hold while any write of this session runs; the last one puts back what there was."""
    with _lock:
        held = _writing.setdefault(id(spark), [0, {k: spark.conf.get(k, None) for k in _SETTINGS}])
        held[0] += 1
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                for k, v in _writing.pop(id(spark))[1].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here and a lost executor loses nothing.

    The shuffle files behind the written table go at once; else they stay until the driver happens to collect garbage.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with _settings(spark):
        # planned anew, as the setting is read when a query is planned
        df.select("*").write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more. One that can't be deleted stays; that harms nothing."""
    for t in tables:
        with contextlib.suppress(OSError, ValueError):
            files.remove(t._written)


def text_hash(col: Column) -> Column:
    """64 bits of a text, for telling apart rows that repeat an id; null counts as empty."""
    return F.xxhash64(F.coalesce(col, F.lit("")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column without copying; a null is an empty value."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of values that hold at most `most` bytes, or one longer value."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal key columns, from batches that are sorted by them. Holds one group and one batch."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        last = tuple(c[-1] for c in cols)
        at = 0
        for cut in np.flatnonzero(change):
            if cut > at:
                rest.append(batch.slice(at, cut - at))
            if rest:
                yield pa.Table.from_batches(rest)
            rest, at = [], int(cut)
        rest.append(batch.slice(at))
    if rest:
        yield pa.Table.from_batches(rest)


def block_tasks(members: DataFrame, keys: list[str], id_col: str, block: int) -> DataFrame:
    """Split each group of `keys` with two members or more into pairs of blocks of about `block` members.

    Adds blk (the row's own block), bi <= bj (the pair of blocks that one task compares). A row is repeated once for
    each block of its group, so a hot group becomes many tasks of at most about two blocks; counts are pre-aggregated.
    """
    counted = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    rows = members.join(counted, keys).withColumn("_nb", F.ceil(F.col("_m") / block).cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.col("_nb")).cast("int"))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    rows = rows.withColumn("bi", F.least("blk", "_j")).withColumn("bj", F.greatest("blk", "_j"))
    return rows.drop("_m", "_nb", "_j")


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each row of a symmetric boolean matrix reaches."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new
