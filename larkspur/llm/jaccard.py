"""N-gram Jaccard self-join: MinHash banding, shuffle on band hashes, verification on full n-gram sets.

A text's words are its runs of other bytes than ASCII white space; its set is that of its five-word shingles (64-bit
hashes; a text of one to four words has one shingle, all of it). Two documents are linked when the Jaccard similarity of
their full sets is at least the threshold.

1. `signatures` computes, in one pass, a key of the word sequence and the band hashes; texts of equal words form a class.
2. Classes, one row each, are dealt by (band, hash). Groups of one are dropped, and of several bands with the same
   members only the first is kept. A large group is split into blocks, and pairs of blocks are tasks of bounded size.
3. The texts of the classes in some group, and only those, are joined to their tasks and turned into full sets.
4. A task multiplies the shingle incidence matrix of its blocks, counts the links of each class and returns at most one
   edge a class (a spanning forest): pairs are never rows. A pair is counted in the first band that it shares.
5. Components of these edges give each document its group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import block_tasks, chunks, groups, materialize, mix64, roots, text_hash, utf8
from .graph import components
from .words import hashes, spans

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Classes in one block; a task compares two blocks at most.
BLOCK = 128

_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> int:
    """The fewest bands of `rows` rows by which a pair at the threshold is found with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word and the end)."""
    starts, ends = spans(~_GAP[buf], offsets)
    return hashes(buf, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, first: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order, index of each text's first shingle and the end)."""
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.zeros(len(first), np.int64)
    np.cumsum(size, out=out[1:])
    at = np.repeat(first[:-1] - out[:-1], size) + np.arange(out[-1])
    length = np.minimum(np.repeat(count, size), n)
    padded = np.append(words, np.zeros(n, np.uint64))
    h = length.astype(np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(k < length, padded[at + k], np.uint64(k + 1))
        h ^= h >> np.uint64(29)
    return mix64(h), out


def _minima(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """k minima for each text under k permutations of the hashes; texts without shingles get all ones."""
    rng = np.random.default_rng(20240229)
    odd, plus = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)
    has = np.flatnonzero(np.diff(first))
    out = np.full((len(first) - 1, k), np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(has):
        lead = (h ^ (h >> np.uint64(31))).copy()
        for i in range(k):
            out[has, i] = np.minimum.reduceat(lead * odd[i] + plus[i], first[has])
    return out


def signatures(docs: DataFrame, bands: int, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, k1, k2, bands): text hash, key of the word sequence (null without words), band hashes as bytes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            for a, b in chunks(offsets):
                words, first = word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                count = np.diff(first)
                place = (np.arange(len(words)) - np.repeat(first[:-1], count)).astype(np.uint64)
                keys, has = np.zeros((2, b - a), np.uint64), np.flatnonzero(count)
                for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
                    if len(has):
                        keys[k, has] = np.add.reduceat(mix64(words ^ mix64(place * np.uint64(salt) + np.uint64(k + 1))), first[has])
                h, at = shingles(words, first)
                low = _minima(h, at, bands * rows)
                sig = np.empty((b - a, bands), np.uint64)
                for band in range(bands):
                    x = np.full(b - a, np.uint64(band + 1))
                    for r in range(rows):
                        x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + low[:, band * rows + r])
                    sig[:, band] = x
                none = count == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(k.view(np.int64), mask=none) for k in keys), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "h", "k1", "k2", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("h"), F.col(text).alias("text")).mapInArrow(sign, "doc_id long, h long, k1 long, k2 long, bands binary")


def _verify(threshold: float):
    """Count the links of each class in a task's pair of blocks."""

    def one(t: pa.Table) -> pa.RecordBatch | None:
        m = t.num_rows
        band, bi, bj = (t.column(k)[0].as_py() for k in ("band", "bi", "bj"))
        rep, k1, n, blk = (t.column(k).to_numpy() for k in ("rep", "k1", "n", "blk"))
        order = np.argsort(rep, kind="stable")
        rep, k1, n, blk = rep[order], k1[order], n[order], blk[order]
        sig = np.stack([np.frombuffer(t.column("bands")[int(i)].as_py(), np.uint64) for i in order])
        sets = [np.frombuffer(t.column("grams")[int(i)].as_py(), np.uint64) for i in order]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(m), sizes)
        _, of, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = many[of] > 1
        owner, of = owner[shared], np.unique(of[shared], return_inverse=True)[1]
        inter = np.zeros((m, m))
        width, order = 4096, np.argsort(of, kind="stable")
        owner, of = owner[order], of[order]
        for low in range(0, int(of[-1]) + 1 if len(of) else 0, width):
            a, b = np.searchsorted(of, (low, low + width))
            grid = np.zeros((m, width), np.float32)
            grid[owner[a:b], of[a:b] - low] = 1
            inter += grid @ grid.T
        linked = inter >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-9
        linked &= (blk[:, None] != blk[None, :]) if bi != bj else ~np.eye(m, dtype=bool)
        for k in range(band):
            linked &= sig[:, None, k] != sig[None, :, k]
        if not linked.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(k1), pa.array(linked @ n), pa.array(rep[roots(linked)])], names=["rep", "k1", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["band", "hash", "bi", "bj"]):
            if (out := one(t)) is not None:
                yield out

    return run


def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, class_id, n_links, group_id) for each row of `docs`.

    class_id is the smallest doc_id with the same words; n_links the number of other rows linked directly (copies are);
    group_id the smallest doc_id reachable by links; h the hash of the text (xxhash64), to tell rows apart.

    Defined results: a text that is null, empty or white space has no words and links with nothing; rows that repeat are
    documents of their own that are copies; rows without doc_id count as copies but name no class: a class of such rows
    only has a null class_id and isn't compared; a very long text is hashed whole; an empty table gives no rows; other columns are ignored.
    """
    bands = choose_bands(threshold, recall, rows)
    signed = materialize(signatures(docs, bands, rows, doc_id, text), "signatures")
    classes = signed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h")).alias("none_first"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("first"), F.count(F.lit(1)).alias("n"), F.min("bands").alias("bands"))
    classes = materialize(classes.select("k1", "k2", F.col("first.doc_id").alias("rep"), F.col("first.h").alias("rep_h"), "n", "bands"), "classes")

    hexed = F.hex("bands")
    buckets = classes.filter("rep is not null").select("rep", "rep_h", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring(hexed, i * 16 + 1, 16))).alias("band", "word"))
    buckets = buckets.select("rep", "rep_h", "band", F.xxhash64("word").alias("hash"))
    # groups of several bands with the same members: only the first band of them has new pairs
    shapes = buckets.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("m"), F.sum(F.pmod(F.xxhash64("rep", "rep_h"), F.lit(1 << 40))).alias("s1"), F.min(F.xxhash64("rep_h", "rep")).alias("s2"), F.max(F.xxhash64("rep_h", "rep")).alias("s3")).filter("m > 1")
    kept = shapes.groupBy("m", "s1", "s2", "s3").agg(F.min(F.struct("band", "hash")).alias("x")).select("x.band", "x.hash")
    tasks = block_tasks(buckets.join(kept, ["band", "hash"]), ["band", "hash"], "rep", block)
    todo = tasks.groupBy("rep", "rep_h").agg(F.collect_list(F.struct("band", "hash", "blk", "bi", "bj")).alias("tasks"))
    todo = todo.join(classes.select("rep", "rep_h", "k1", "k2", "n", "bands"), ["rep", "rep_h"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(0))
            for a, b in chunks(offsets):
                h, at = shingles(*word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                part = batch.slice(a, b - a)
                tables = part.column(4)
                parents = tables.value_parent_indices().to_numpy() if hasattr(tables, "value_parent_indices") else np.repeat(np.arange(b - a), tables.value_lengths().to_numpy())
                grams = [np.unique(h[at[i] : at[i + 1]]).tobytes() for i in range(b - a)]
                flat = tables.flatten()
                for c in range(0, len(parents), 256):
                    p = parents[c : c + 256]
                    x = flat.slice(c, len(p))
                    yield pa.RecordBatch.from_arrays([*(x.field(k) for k in range(5)), part.column(1).take(pa.array(p)), part.column(2).take(pa.array(p)), part.column(3).take(pa.array(p)), part.column(5).take(pa.array(p)), pa.array([grams[i] for i in p], pa.binary())], names=["band", "hash", "blk", "bi", "bj", "rep", "n", "bands", "k1", "grams"])

    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).withColumn("rep_h", text_hash(F.col("text")))
    # rows that repeat an id and a text are in n already: one of them stands for the class
    full = texts.join(todo, ["rep", "rep_h"]).dropDuplicates(["rep", "rep_h"]).select("text", "rep", "n", "bands", "tasks", "k1")
    full = full.mapInArrow(sets, "band int, hash long, blk int, bi int, bj int, rep long, n long, bands binary, k1 long, grams binary")
    by = ["band", "hash", "bi", "bj"]
    full = full.repartition(*by).sortWithinPartitions(*by, "rep")
    links = materialize(full.mapInArrow(_verify(threshold), "rep long, k1 long, links long, root long"), "links")

    # an id may stand for several texts: links belong to a class, that is an id and a key of its words
    counted = links.groupBy("rep", "k1").agg(F.sum("links").alias("links"))
    reached = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    result = classes.join(counted, ["rep", "k1"], "left").join(reached.withColumnRenamed("id", "rep"), "rep", "left")
    result = result.select("k1", "k2", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("group_id"))
    out = signed.select("doc_id", "h", "k1", "k2").join(result, ["k1", "k2"], "left")
    alone = F.col("k1").isNull()
    return out.select("doc_id", "h", F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without all but one of each near-duplicate group, that with the smallest doc_id.

    Rows that repeat an id and a text become one row. Texts without words, and classes without any doc_id, stay. Columns
    keep their names and values, whatever they are called; nulls, empty and very long texts are as in `jaccard_groups`,
    and an empty table gives no rows.
    """
    names = list(docs.columns)
    own = [f"_c{i}" for i in range(len(names))]
    who, what = own[names.index(doc_id)], own[names.index(text)]
    rows = docs.toDF(*own)
    found = jaccard_groups(rows.select(F.col(who).alias("doc_id"), F.col(what).alias("text")), **options)
    gone = found.filter("group_id is not null and doc_id is not null and doc_id <> group_id").select("doc_id", "h").union(found.filter("doc_id is null and group_id is not null").select("doc_id", "h")).distinct()
    gone = materialize(gone, "gone").select(F.col("doc_id").alias("_d"), F.col("h").alias("_g"))
    rows = rows.withColumn("_h", text_hash(F.col(what)))
    rows = rows.join(gone, F.col(who).cast("long").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")), "left_anti")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(who, "_h").orderBy(F.lit(1))))
    return rows.filter("_n = 1").select(*(F.col(k).alias(c) for k, c in zip(own, names, strict=True)))


#: All pairs at the threshold, without hashes: candidates share one of the rarest shingles of their sets (prefix filter).
ORACLE_SQL = rf"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
t as (select r, doc_id, w, array_to_string(w, ' ') as t from d),
class as (select t, min(doc_id) as rep, count(*) as n, any_value(w) as w from t where len(w) > 0 group by t),
word as (select rep, len(w) as m, unnest(w) as x, generate_subscripts(w, 1) as i from class where len(w) >= {WORDS}),
gram as (select rep, m, i, concat_ws(' ', x, {", ".join(f"lead(x, {k}) over o" for k in range(1, WORDS))}) as g from word window o as (partition by rep order by i)),
shingle as (select distinct rep, g from gram where i <= m - {WORDS - 1} union all select rep, t from class where len(w) < {WORDS}),
ranked as (select rep, g, count(*) over (partition by rep) as s, f from shingle join (select g, count(*) as f from shingle group by g) using (g)),
prefix as (select rep, g, s from (select *, row_number() over (partition by rep order by f, g) as p from ranked) where p <= s - ceil({THRESHOLD} * s - 1e-9) + 1),
pair as (select distinct a.rep as a, b.rep as b, a.s as sa, b.s as sb from prefix a join prefix b on a.g = b.g and a.rep < b.rep where least(a.s, b.s) >= {THRESHOLD} * greatest(a.s, b.s) - 1e-9),
shared as (select a, b, sa, sb, count(*) as k from pair join shingle x on x.rep = a join shingle y on y.rep = b and y.g = x.g group by all),
half as (select a, b from shared where k >= {THRESHOLD} * (sa + sb - k) - 1e-9),
link as (select a, b from half union all select b, a from half),
reach(id, node) as (select rep, rep from class union select id, b from reach join link on node = a),
found as (select id, min(node) as group_id from reach group by id),
links as (select a, sum(n) as n from link join class on b = rep group by a)
select t.doc_id, coalesce(rep, t.doc_id) as class_id, cast(coalesce(class.n - 1, 0) + coalesce(links.n, 0) as bigint) as n_links, coalesce(group_id, t.doc_id) as group_id
from t left join class on t.t = class.t and len(t.w) > 0 left join links on a = rep left join found on id = rep
"""
