"""Suffix-array deduplication by bucket-pointer refinement: remove every byte of a string that also starts elsewhere.

A byte goes if a string of LENGTH bytes that covers it also starts at another place of the corpus, the same text
included. Sorting every suffix of the corpus would move many times its size, so suffixes are dealt out exactly:

1. Of the SEED-byte grams of each LENGTH-byte window the one with the least hash is its anchor (leftmost of ties), so
   equal windows have equal anchors at equal places. Anchors are some LENGTH / 2 bytes apart. Those whose gram occurs
   once in the corpus are dropped: their windows are unique.
2. The window starts of an anchor are cut into slices of at most WIDTH starts by their distance to the anchor. All
   windows of a slice contain a common core. Slices of one core and content are a class; one of them stands for it, and
   carries whether the class has several.
3. The classes of a core (of some 270 bytes at least) meet in one task, which sorts their suffixes by bucket-pointer
   refinement (`refined`) and keeps the starts whose LENGTH bytes recur, in another class or in several members of one.
   (The only class of a core has nothing to refine: it recurs if it has several members.) A core with more than MOST
   classes is cut to single windows, which are counted by content instead: exact for groups of any size.
4. What was found for a class holds for its members; their intervals are joined to the texts, merged and cut out.

Equal contents are recognised by 128-bit BLAKE2b in step 2 (and for cores above MOST), by the bytes themselves in step 3;
different cores of one hash do no harm, since cores are told apart by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, drop, groups, materialize, mix64, text_hash, utf8
from .jaccard import word_hashes
from .words import hashes

LENGTH, SEED, WIDTH, MOST = 400, 32, 128, 20_000
#: Suffixes in one sort of the refinement, and words of the shortest run that `shared_words` reports.
STEP, WORDS = 1 << 17, 51
#: Bytes that one numpy pass hashes: its arrays stay in the processor's cache.
PASS = 1 << 17
_PLACE = np.uint64((1 << 24) - 1)


def _grams(buf: np.ndarray, unit: int = 1) -> np.ndarray:
    """Hash of the SEED bytes from each place, a multiple of `unit`, that has them."""
    n = (len(buf) - SEED) // unit + 1
    if len(buf) < SEED:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(buf).tobytes()
    h = np.zeros(n, np.uint64)
    for k in range(0, SEED, 8):
        h += np.ndarray((n,), "<u8", raw, k, (unit,)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x51ED270B)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return mix64(h)


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, unit: int = 1) -> tuple[np.ndarray, ...]:
    """(text, gram hash, place, first window start, last window start) of each anchor; places count in `buf`.

    Texts are whole symbols of `unit` bytes, and so is `length`; windows and grams start where symbols do.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for a, b in chunks(offsets, PASS):
        base, part = offsets[a], buf[offsets[a] : offsets[b]]
        ends = offsets[a + 1 : b + 1] - base
        span = (length - SEED) // unit + 1  # grams in a window
        for low in range(0, max(1, len(part) - length + 1), 1 << 23):  # places fit 24 bits
            piece = part[low : low + (1 << 23) + length - unit]
            n = (len(piece) - length) // unit + 1
            if len(piece) < length:
                continue
            g = _grams(piece, unit)
            key = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
            pad = -len(key) % span
            grid = np.append(key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, span)
            fore = np.minimum.accumulate(grid, 1).reshape(-1)
            back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
            at = (np.minimum(back[:n], fore[span - 1 : span - 1 + n]) & _PLACE).astype(np.int64)
            starts = np.arange(n)
            text = np.searchsorted(ends, starts * unit + low, "right")
            whole = starts * unit + low + length <= ends[np.minimum(text, len(ends) - 1)]
            starts, at, text = starts[whole], at[whole], text[whole]
            if not len(starts):
                continue
            new = np.ones(len(starts), bool)
            new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts)) - 1
            found.append((text[first] + a, g[at[first]], at[first] * unit + low + base, starts[first] * unit + low + base, starts[last] * unit + low + base))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def refined(text: np.ndarray, close: np.ndarray, length: int, todo: np.ndarray, kind: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes `todo` in order, pointer of each place, its first 8 bytes as a number).

    Bucket-pointer refinement of the suffixes at the places `todo`, each of which ends at close[place]. Suffixes begin in
    buckets of equal kind and equal 8-byte gram; a pointer is the place of its bucket. A bucket of depth d (its suffixes
    share d bytes, or end before) is refined by sorting on the pointers found d bytes later, and the parts are refined in
    turn, before any other bucket, until they hold one suffix or share `length` bytes. New pointers are in force at once:
    every later sort reads them, so a part's depth is d and the depth that the bucket pointed to has reached by then.
    `STEP` suffixes, in whole buckets, are sorted by one call.

    known: 0, or the bytes from a place on that all places of its kind share; such places are a bucket as they are.
    """
    n = len(text)
    eight = np.zeros(n, np.uint64)
    if n >= 8:
        eight[: n - 7] = np.ndarray((n - 7,), ">u8", np.ascontiguousarray(text).tobytes(), 0, (1,))
    for i in range(max(0, n - 7), n):
        eight[i] = int.from_bytes(text[i:].tobytes().ljust(8, b"\0"), "big")
    short = todo[close[todo] - todo < 8]
    eight[short] &= ~np.uint64(0) << (np.uint64(8) * (8 - (close[short] - short)).astype(np.uint64))
    order = todo[np.lexsort((eight[todo], kind[todo]))]
    pointer, deep = np.zeros(n, np.int64), np.full(n, 8)
    free = np.flatnonzero(known)
    pointer[free], deep[free] = n + 1 + kind[free], known[free]
    new = np.append(True, (eight[order][1:] != eight[order][:-1]) | (kind[order][1:] != kind[order][:-1]))[: len(order)]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    pointer[order] = np.repeat(start, size) + 1
    stack: list[tuple[np.ndarray, np.ndarray]] = []

    def put(start: np.ndarray, size: np.ndarray) -> None:
        block = np.cumsum(size) // STEP
        cuts = np.flatnonzero(np.diff(block)) + 1
        stack.extend(reversed(list(zip(np.split(start, cuts), np.split(size, cuts), strict=True))))

    put(start[size > 1], size[size > 1])
    while stack:
        start, size = stack.pop()
        total = int(size.sum())
        if not total:
            continue
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)
        who = order[at]
        later = who + deep[who]
        over = later >= close[who]  # it has ended: before all others
        later[over] = 0
        key = np.repeat(np.arange(len(start)), size) << 32 | np.where(over, 0, pointer[later])
        gain = np.where(over, length, deep[later])
        rank = np.argsort(key, kind="stable")
        who, key = who[rank], key[rank]
        order[at] = who
        part = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(part, total))
        pointer[who] = np.repeat(at[part], size) + 1
        deep[who] += gain[rank]
        more = (size > 1) & (deep[who[part]] < length)
        put(at[part[more]], size[more])
    return order, pointer, eight


def duplicate_starts(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, several: np.ndarray | None = None, owner: np.ndarray | None = None, unit: int = 1, lead: np.ndarray | None = None) -> np.ndarray:
    """Whether each place of `text` starts a `length`-byte string that starts elsewhere in it too; `ends` closes each piece.

    Suffixes that begin equally are neighbours in the order of `refined`. Of neighbours with different pointers, which
    may still share `length` bytes, the bytes are compared. Pieces marked in `several` recur outside the text too. With
    `owner` (a number for each piece) a string counts only if pieces of two owners, or one marked, hold it.

    With `lead` (bytes from the first start to the anchor) for each piece, which is a slice then, equal strings are known
    to have equal cores at one distance: these two are a suffix's kind, and the core isn't sorted.
    """
    n = len(text)
    twice = np.zeros(n, bool)
    if not n:
        return twice
    size = np.diff(np.append(0, ends))
    piece = np.repeat(np.arange(len(ends)), size)
    close, inside = ends[piece], np.arange(n) - (ends - size)[piece]
    kind, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if lead is not None:
        near = lead // _width(length) * _width(length)
        far = np.minimum(near + _width(length) - unit, length - SEED)
        raw, ids = text.tobytes(), {}
        core = [ids.setdefault(raw[x:y], len(ids)) for x, y in zip((ends - size + lead - near).tolist(), (ends - size + lead - far + length).tolist(), strict=True)]
        kind = (np.array(core) * 4 * length + lead + 2 * length)[piece] - inside
        top = (lead - far + length)[piece]
        known = np.where((inside > (lead - near)[piece]) & (inside < top), top - inside, 0)
    order, pointer, eight = refined(text, close, length, np.flatnonzero((inside % unit == 0) & (known == 0)), kind, known)
    live = order[order + length <= close[order]]
    if not len(live):
        return twice
    apart = np.append(True, (pointer[live[1:]] != pointer[live[:-1]]) | (kind[live[1:]] != kind[live[:-1]]))
    asked = np.flatnonzero(apart[1:] & (kind[live[1:]] == kind[live[:-1]]))
    for k in (length - 8, *range(0, length - 8, 8)):
        asked = asked[eight[live[asked] + k] == eight[live[asked + 1] + k]]
    apart[asked + 1] = False
    first = np.flatnonzero(apart)
    size = np.diff(np.append(first, len(live)))
    if owner is None:
        found = size > 1
    else:
        own = owner[piece[live]]
        found = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    if several is not None:
        found |= np.maximum.reduceat(several[piece[live]], first)
    twice[live] = np.repeat(found, size)
    return twice


def merge(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of [start, end) rows, sorted."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


def _width(length: int) -> int:
    """Distances to the anchor in one slice: all, if windows are short."""
    return WIDTH if length > 2 * WIDTH else length


def _ranges(length: int, unit: int = 1) -> list[tuple[int, int]]:
    top, width = length - SEED, _width(length)
    return [(a, min(a + width - unit, top)) for a in range(0, top + 1, width)]


def repeated_spans(rows: DataFrame, length: int = LENGTH, most: int = MOST, across: bool = False, unit: int = 1) -> tuple[DataFrame, DataFrame]:
    """((doc_id, h, text) of rows that may repeat something, (doc_id, h, spans) with the byte intervals that repeat).

    rows: (doc_id long, h long, text string or binary); a text is known by doc_id and h. With `across` only strings of two texts or more count. Symbols are of `unit` bytes.
    """
    if length < 4 * SEED:
        raise ValueError(f"length: at least {4 * SEED}")
    kind = rows.schema["text"].dataType.simpleString()
    rows = rows.filter(F.octet_length("text") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            which, gram, place, _, _ = anchors(buf, offsets, length, unit)
            pick = pa.array(which)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(gram.view(np.int64)), pa.array((place - offsets[which]).astype(np.int32))], names=["doc_id", "h", "gram", "place"])

    seen = materialize(rows.mapInArrow(find, "doc_id long, h long, gram long, place int"), "anchors")
    # written down, so that both sides of the join are plain exchanges and a gram that many texts share is split
    shared = materialize(seen.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "shared")
    todo = seen.join(shared, "gram", "left_semi").groupBy("doc_id", "h").agg(F.collect_set("place").alias("places"))
    cuts = _ranges(length, unit)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: a text (start null), and each of its slices."""
        for batch in (b.slice(x, y - x) for b in batches for x, y in chunks(utf8(b.column(2))[1])):
            buf, offsets = utf8(batch.column(2))
            which, _, place, low, high = anchors(buf, offsets, length, unit)
            lists = batch.column(3)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            wanted = np.repeat(offsets[:-1], np.diff(at)) + lists.flatten().to_numpy()
            mine = np.isin(place, wanted)
            which, place, low, high = which[mine], place[mine], low[mine], high[mine]
            cut = [(np.maximum(low, place - far), np.minimum(high, place - near), near, far) for near, far in cuts]
            some = [np.flatnonzero(a <= b) for a, b, _, _ in cut]
            i = np.concatenate([which[k] for k in some])
            a, b, p = (np.concatenate(x) for x in zip(*((c[0][k], c[1][k], place[k]) for c, k in zip(cut, some, strict=True)), strict=True))
            core = np.concatenate([hashes(buf, place[k] - near, place[k] - far + length) ^ np.uint64(near) for (_, _, near, far), k in zip(cut, some, strict=True)]) if len(i) else np.zeros(0, np.uint64)
            raw = buf.tobytes()
            for c in range(0, len(i), 4096):
                part = slice(c, c + 4096)
                pick = pa.array(i[part])
                body = [hashlib.blake2b(raw[x:y], digest_size=16, salt=z.to_bytes(4, "little")).digest() for x, y, z in zip(a[part].tolist(), (b[part] + length).tolist(), (p - a)[part].tolist(), strict=True)]
                numbers = [(a - offsets[i])[part], ((b - a) // unit + 1)[part], (p - a)[part]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.nulls(len(pick), batch.column(2).type), pa.array(core[part].view(np.int64)), pa.array(body, pa.binary()), *(pa.array(x.astype(np.int32)) for x in numbers)], names=names)
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *none], names=names)

    names = ["doc_id", "h", "text", "core", "body", "start", "starts", "lead"]
    todo = todo.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "places")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
    joined = rows.join(todo, on).select("doc_id", "h", "text", "places")
    both = materialize(joined.mapInArrow(slices, f"doc_id long, h long, text {kind}, core long, body binary, start int, starts int, lead int"), "slices")
    drop(seen, shared)
    texts = both.filter("start is null").select("doc_id", "h", "text")
    parts = both.filter("start is not null").drop("text")

    # a class is one content of a slice, and one of its members stands for it
    who = F.struct("doc_id", "h")
    several = F.min(who) != F.max(who) if across else F.count(F.lit(1)) > 1
    classes = materialize(parts.groupBy("core", "body").agg(several.alias("several"), F.min(F.struct("doc_id", "h", "start", "starts", "lead")).alias("one")), "classes")
    cores = classes.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    meet = classes.join(cores, "core").select("core", "body", "several", (F.col("kinds") > most).alias("hot"), "one.*")
    asked = meet.groupBy("doc_id", "h").agg(F.collect_list(F.struct("core", "body", "several", "hot", "start", "starts", "lead")).alias("slices"))
    asked = asked.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "slices")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            raw, lists = buf.tobytes(), batch.column(4)
            owners = batch.column(3).to_pylist()
            out, size = [], 0
            for i in range(batch.num_rows):
                for x in lists[i].as_py():
                    at = int(offsets[i]) + x["start"]
                    if x["hot"]:  # a row for each window, known by 128 bits of its content
                        out += [(x["core"], x["body"], x["several"], owners[i], k, hashlib.blake2b(raw[at + k * unit : at + k * unit + length], digest_size=16).digest(), True) for k in range(x["starts"])]
                        size += 64 * x["starts"]
                    else:
                        bytes_ = (x["starts"] - 1) * unit + length
                        out.append((x["core"], x["body"], x["several"], owners[i], x["lead"], raw[at : at + bytes_], False))
                        size += bytes_
                    if size > 1 << 22:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["core", "body", "several", "owner", "place", "bytes", "hot"])

    own = F.xxhash64("doc_id", "h").alias("owner")
    fetched = texts.join(asked, on).select("doc_id", "h", "text", own, "slices").mapInArrow(fetch, "core long, body binary, several boolean, owner long, place int, bytes binary, hot boolean")
    fetched = materialize(fetched, "fetched")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for t in groups(batches, ["core"]):
            held.append(t)
            size += t.nbytes
            if size > 1 << 20:
                yield from sorted_slices(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield from sorted_slices(pa.concat_tables(held))

    def sorted_slices(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        # a text whose row repeats gave its slices more than once
        t = t.take(pa.array(np.sort(np.unique(np.array(t.column("body").to_pylist(), "S16"), return_index=True)[1])))
        buf, offsets = utf8(t.column("bytes").combine_chunks())
        twice = duplicate_starts(buf, offsets[1:], length, t.column("several").to_numpy(), t.column("owner").to_numpy() if across else None, unit, t.column("place").to_numpy().astype(np.int64))
        edge = np.diff(np.concatenate([[0], twice[::unit].astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1) * unit, np.flatnonzero(edge == -1) * unit
        if len(a):
            which = np.searchsorted(offsets, a, "right") - 1  # a slice's last length - 1 places start nothing, so no run crosses
            pick = pa.array(which)
            cols = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (t.column("core"), t.column("body"))]
            yield pa.RecordBatch.from_arrays([*(x.take(pick) for x in cols), pa.array(((a - offsets[which]) // unit).astype(np.int32)), pa.array(((b - offsets[which]) // unit).astype(np.int32))], names=["core", "body", "low", "high"])

    usual = fetched.filter("not hot").drop("hot").repartition("core").sortWithinPartitions("core")
    found = usual.mapInArrow(sort, "core long, body binary, low int, high int")
    hot = fetched.filter("hot").withColumnRenamed("bytes", "window").dropDuplicates(["core", "body", "place"])
    held_by_many = F.max("several") | ((F.min("owner") != F.max("owner")) if across else (F.count(F.lit(1)) > 1))
    many = hot.groupBy("window").agg(held_by_many.alias("yes")).filter("yes")
    found = found.union(hot.join(many, "window", "left_semi").select("core", "body", F.col("place").alias("low"), (F.col("place") + 1).alias("high")))
    # a core of one class has nothing to refine: its windows are as many as its members
    alone = classes.join(cores, "core", "left_anti").filter("several").select("core", "body", F.lit(0).alias("low"), F.col("one.starts").alias("high"))
    found = found.union(alone)
    # what holds for a class holds for each of its members
    found = materialize(found.groupBy("core", "body").agg(F.collect_list(F.struct("low", "high")).alias("runs")), "runs")
    drop(classes, fetched)
    runs = parts.join(found, ["core", "body"]).select("doc_id", "h", F.explode(F.transform("runs", lambda r: F.struct((F.col("start") + r["low"] * unit).alias("a"), (F.col("start") + (r["high"] - 1) * unit + length).alias("b")))).alias("x"))
    return texts, runs.groupBy("doc_id", "h").agg(F.collect_set("x").alias("spans"))


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("h"), F.col(text).alias("text"))


def shared_words(docs: DataFrame, words: int = WORDS, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, n_shared_words): words within runs of `words` words or more that another text holds too; texts without any are left out.

    The same method over words in place of bytes: each word of a text (a run of other bytes than ASCII white space) is
    written as 32 bits of its hash, so white space between words doesn't matter, and runs of equal bytes are runs of equal
    words. Rows are documents here: those that repeat id and text are one.
    """
    unit = 4

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            for a, b in chunks(offsets, PASS):
                h, first = word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw = (h >> np.uint64(32)).astype("<u4").tobytes()
                bodies = pa.array([raw[unit * i : unit * j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), bodies], names=["doc_id", "h", "text"])

    rows = _identified(docs, doc_id, text).mapInArrow(stream, "doc_id long, h long, text binary")
    _, spans = repeated_spans(rows, unit * words, most, across=True, unit=unit)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ab = np.stack([values.field(k).to_numpy() for k in (0, 1)], 1).astype(np.int64)
            n = []
            for i in range(batch.num_rows):
                runs = merge(ab[at[i] : at[i + 1]])
                n.append(int((runs[:, 1] - runs[:, 0]).sum()) // unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "h", "n_shared_words"])

    return spans.select("doc_id", "h", "spans").mapInArrow(count, "doc_id long, h long, n_shared_words long")


def cut_repeats(docs: DataFrame, length: int = LENGTH, most: int = MOST, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, words: int | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the remaining bytes, if asked).

    With `words`, also n_shared_words and shares_passage: the words in runs of so many or more that another document
    holds as well, and whether there are any. What is removed doesn't depend on them.

    Defined results: a null or empty text has 0 bytes and the SHA-256 of nothing; a text of fewer bytes than `length`
    loses nothing; a very long text is worked on in strides of 8 MB that overlap by a window, with the same results; rows
    that repeat are texts of their own, so both lose what they share; an empty table gives no rows; other columns are
    ignored.
    """
    passages = None
    if words is not None:
        passages = materialize(shared_words(docs, words, most, doc_id, text), "passages")
        passages = passages.select(F.col("doc_id").alias("_p"), F.col("h").alias("_g"), "n_shared_words")
    texts, spans = repeated_spans(_identified(docs, doc_id, text), length, most)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = utf8(batch.column(2))
            raw, lists = buf.tobytes(), batch.column(3)
            values, parents = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ab = np.stack([values.field(k).to_numpy() for k in (0, 1)], 1).astype(np.int64)
            out = []
            for i in range(batch.num_rows):
                runs, at, end, kept = merge(ab[parents[i] : parents[i + 1]]), int(offsets[i]), int(offsets[i + 1]), []
                for a, b in runs.tolist():
                    kept.append(raw[at : int(offsets[i]) + a])
                    at = int(offsets[i]) + b
                kept.append(raw[at:end])
                rest = b"".join(kept)
                out.append((int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            c = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.binary())], names=["_d", "_h", "n_removed", "n_spans", "sha", "rest"])

    spans = spans.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "spans")
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
    changed = texts.join(spans, on).select("doc_id", "h", "text", "spans").mapInArrow(cut, "_d long, _h long, n_removed long, n_spans long, sha string, rest binary").dropDuplicates(["_d", "_h"])
    if not with_text:
        changed = changed.drop("rest")
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("h"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("own"), *([whole.alias("all")] if with_text else []))
    rows, more = rows.join(changed, on, "left"), []
    if passages is not None:
        rows = rows.join(passages, F.col("doc_id").eqNullSafe(F.col("_p")) & (F.col("h") == F.col("_g")), "left")
        more = [F.coalesce("n_shared_words", F.lit(0).cast("long")).alias("n_shared_words"), F.col("n_shared_words").isNotNull().alias("shares_passage")]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"), *more, *([F.coalesce("rest", "all").alias("kept")] if with_text else []))
