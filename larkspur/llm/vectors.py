"""Embedding near-deduplication: spherical k-means cells, blocked cosines inside cells, one representative a group.

Vectors of equal label are compared by cosine in double precision. Equal vectors form one class first, so a vector that
recurs is compared once. A class is at home in the cell of its nearest centre, and is a guest in every other cell so
close that a partner at the threshold may live there: unit vectors x at home in a and y at home in b with cosine t are
at most d = sqrt(2 - 2 t) apart, and both lie on their own side of the plane that halves the centres of a and b, so one
of them is within d / 2 of it. Guests are those within d / 2, which loses no pair whatever the centres are.

Cells are recursive: the vectors of one label and length are the first cell, and a cell that holds too many is split by
centres of its own, so cells stay small at any size of the input. The argument above holds inside a cell too, for its
guests as well. Centres are fitted in tasks on a bounded sample of their cell (`sample` rows, by a hash of the id); every
vector is assigned, and nothing comes to the driver. A cell whose sample says that a split would not halve the pairs stays
whole. Cells are compared in blocks and pairs of blocks, so one of any size is many bounded tasks; tasks return counts and
a spanning forest, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import block_tasks, drop, groups, materialize, roots
from .graph import components

THRESHOLD, BLOCK = 0.98, 512
#: Rows that one cell's centres are fitted on, rows that a cell should hold, most centres of one cell, most levels of cells.
SAMPLE, CELL, CELLS, DEPTH = 20_000, 2_000, 512, 6
#: Rows of a cell that are dealt by one group of a task; a cell is split if at most this share of its pairs is left, and
#: into so many cells that this many rows are left in one on average.
SLICE, WORTH, FEW = 4_096, 0.5, 16
#: What names a cell, and the columns of rows in cells: a cell's name and path, the row's home and cells on each level.
BY, COLUMNS = ["label", "dim", "cell"], ["rep", "label", "n", "k", "dim", "cell", "path", "homes", "within", "x"]
_SLACK = 1e-9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k unit centres for unit rows x: farthest-first from a seeded row, then Lloyd rounds by cosine."""
    k = min(k, len(x))
    start = np.random.default_rng(seed).integers(len(x)) if len(x) else 0
    centres, near = [x[start]], x @ x[start]
    for _ in range(k - 1):
        i = int(near.argmin())
        centres.append(x[i])
        near = np.maximum(near, x @ x[i])
    c = np.array(centres)
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return np.unique(c, axis=0)  # equal centres would halve nothing


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat double values, offsets) of a list column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values, column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()


def _guests(x: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each unit row, whether it belongs to each cell: at home or as a guest)."""
    gap = np.linalg.norm(centres[:, None] - centres[None, :], axis=2)
    near = x @ centres.T
    home = near.argmax(1)
    inside = (near[np.arange(len(x)), home][:, None] - near) / np.maximum(gap[home], 1e-300) <= margin + _SLACK
    inside[np.arange(len(x)), home] = True
    return home, inside


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    values, offsets = _rows(column.combine_chunks())
    return values.reshape(len(offsets) - 1, -1)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the unit vector, on which all later steps work."""
    for batch in batches:
        values, offsets = _rows(batch.column(5))
        dims, x = np.diff(offsets), np.empty_like(values)
        for dim in np.unique(dims):
            at = offsets[:-1][dims == dim][:, None] + np.arange(dim)
            x[at] = values[at] / np.linalg.norm(values[at], axis=1, keepdims=True)
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x))], names=["rep", "label", "n", "k", "dim", "x"])


def _fit(margin: float, sample: int, cell: int, cells: int):
    """Centres of each group that gets cheaper by a split, from its sample: (label, dim, cell, m, centres)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, BY):
            x, m = _matrix(t.column("x").slice(0, sample)), t.column("m")[0].as_py()
            k, most, best = math.ceil(m / cell), max(2, min(cells, m // FEW)), None
            while True:
                k = min(k, most)
                centres = spherical_kmeans(x, k)
                left = (_guests(x, centres, margin)[1].mean(0) ** 2).sum()  # pairs to compare, against one cell
                cost = left * m / 2 + k  # cosines a row: with its partners and with the centres
                if best is None or cost < best[0]:
                    best = cost, left, centres
                if k == most:
                    break
                k *= 4
            if best[1] <= WORTH:
                centres = best[2]
                yield pa.RecordBatch.from_arrays([*(t.column(c).slice(0, 1).combine_chunks() for c in (*BY, "m")), pa.array([centres.tobytes()], pa.binary())], names=[*BY, "m", "centres"])

    return run


def _deal(margin: float):
    """Deal the rows of each slice of a cell to their home cell inside it and to those that they are guests in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, [*BY, "slice"]):
            kind = t.column("centres").is_valid().to_numpy()
            centres = np.frombuffer(t.column("centres")[int(kind.argmax())].as_py()).reshape(-1, t.column("dim")[0].as_py())
            t = t.filter(pa.array(~kind))
            if not t.num_rows:
                continue
            home, inside = _guests(_matrix(t.column("x")), centres, margin)
            row, to = np.nonzero(inside)
            ends = np.append(0, np.cumsum(inside.sum(1)))
            for a in range(0, len(row), 1024):
                r, c = row[a : a + 1024], to[a : a + 1024]
                x = t.take(pa.array(r))
                add = lambda name, new, kind: pa.array([old + [n] for old, n in zip(x.column(name).to_pylist(), new, strict=True)], pa.list_(kind))
                within = add("within", [to[ends[i] : ends[i + 1]].tolist() for i in r], pa.list_(pa.int32()))
                name = pa.array([f"{old}/{n}" for old, n in zip(x.column("cell").to_pylist(), c, strict=True)])
                cols = {k: x.column(k).combine_chunks() for k in COLUMNS} | {"cell": name, "path": add("path", c.tolist(), pa.int32()), "homes": add("homes", home[r].tolist(), pa.int32()), "within": within}
                yield pa.RecordBatch.from_arrays([cols[k] for k in COLUMNS], names=list(COLUMNS))

    return run


def _split(rows: DataFrame, depth: int, margin: float, sample: int, cell: int, cells: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(rows of cells that stay, rows of the cells inside those that don't, the centres), or None if all stay.

    Cells of more than 2 `cell` rows get centres of their own, fitted in tasks on at most `sample` rows each; their number
    is the one of m / cell, 4 m / cell, 16 m / cell ... with the fewest cosines on the sample. A cell is split if that
    halves the pairs at least. A cell of any size is dealt in slices, each with a copy of its centres.
    """
    sizes = rows.groupBy(*BY).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 2 * cell)
    drawn = rows.join(sizes, BY).withColumn("o", F.pmod(F.xxhash64("rep", "k", F.lit(depth)), F.lit(1 << 40)))
    drawn = drawn.filter(F.col("o") * F.col("m") <= F.lit(float(1 << 40)) * sample).select(*BY, "m", "o", "rep", "k", "x")
    # by another key than the join's: an exchange by the same one is left out, and adaptive execution may then change the
    # join below and its partitions, so that a cell would be in several tasks
    drawn = drawn.withColumn("name", F.concat_ws("|", *BY))
    fitted = drawn.repartition("name").sortWithinPartitions(*BY, "o", "rep", "k").drop("name").mapInArrow(_fit(margin, sample, cell, cells), "label string, dim int, cell string, m long, centres binary")
    fitted = materialize(fitted, "centres")
    if fitted.isEmpty():
        return None
    pieces = fitted.withColumn("slices", F.ceil(F.col("m") / SLICE).cast("int"))
    copies = pieces.select(*BY, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "centres")
    dealt = rows.join(pieces.select(*BY, "slices"), BY).withColumn("slice", F.pmod(F.xxhash64("rep", "k", F.lit(23)), F.col("slices")).cast("int")).drop("slices")
    dealt = dealt.unionByName(copies, allowMissingColumns=True)
    by = [*BY, "slice"]
    inner = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_deal(margin), rows.schema)
    return rows.join(fitted.select(*BY), BY, "left_anti").select(*COLUMNS), materialize(inner, "cells"), fitted


def _verify(threshold: float):
    def one(t: pa.Table) -> pa.RecordBatch | None:
        rep, number, n, blk = (t.column(c).to_numpy() for c in ("rep", "k", "n", "blk"))
        bi, bj, path = (t.column(k)[0].as_py() for k in ("bi", "bj", "path"))
        order = np.argsort(rep, kind="stable")
        rep, number, n, blk = rep[order], number[order], n[order], blk[order]
        x = _matrix(t.column("x"))[order]
        linked = x @ x.T >= threshold
        for i, j in np.argwhere(np.abs(x @ x.T - threshold) < 1e-12):  # at the very edge by the plain formula
            linked[i, j] = float(np.dot(x[i], x[j])) >= threshold
        linked |= linked.T
        linked &= (blk[:, None] != blk[None, :]) if bi != bj else ~np.eye(len(rep), dtype=bool)
        for level, cell in enumerate(path):
            home = _matrix(t.column("homes"))[order, level].astype(np.int64)
            at_home = home == cell
            linked &= at_home[:, None] | at_home[None, :]
            # a pair of two homes that are guests of each other meets in both: it counts in the smaller cell
            for i in np.flatnonzero((home < cell) & linked.any(1)):
                for j in np.flatnonzero(linked[i]):
                    if home[i] in t.column("within")[int(order[j])].as_py()[level]:
                        linked[i, j] = linked[j, i] = False
        if not linked.any():
            return None
        label = pa.array([t.column("label")[0].as_py()] * len(rep), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(rep), label, pa.array(number), pa.array(linked @ n), pa.array(rep[roots(linked)])], names=["rep", "label", "k", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["label", "dim", "cell", "bi", "bj"]):
            if (out := one(t)) is not None:
                yield out

    return run


def _label(vectors: DataFrame, name: str) -> Column:
    """A label of any type as text; equal labels have equal texts."""
    c, kind = F.col(name), vectors.select(name).dtypes[0][1]
    return F.hex(c) if kind == "binary" else (c + F.lit(0).cast(kind)).cast("string") if kind in ("float", "double") else c.cast("string")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, cell: int = CELL, cells: int = CELLS, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id reachable by links), kept (vec_id = component_id).

    Defined results: vectors that are null, empty, zero or hold a null, NaN or infinity, and rows without label or
    vec_id, link with nothing and are their own component; labels may be of any type; vectors of different lengths aren't compared; rows that
    repeat are vectors of their own, linked with each other, and have equal results; an empty table gives no rows;
    other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold: above 0, 1 at most")
    spark = vectors.sparkSession
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), _label(vectors, label).alias("label"), v.alias("v"))
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    # -0.0 and 0.0 are one value; the text form of a double is exact
    usable = usable.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("key", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))
    classes = materialize(usable.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).withColumn("k", F.xxhash64("key")), "classes")

    margin = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    # divided by its largest entry first, so no square overflows or vanishes
    unit = F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y))))
    rows_of = classes.select("rep", "label", "n", "k", F.size("v").alias("dim"), unit.alias("v")).mapInArrow(_unit, "rep long, label string, n long, k long, dim int, x array<double>")
    start = {"cell": F.lit(""), "path": F.array().cast("array<int>"), "homes": F.array().cast("array<int>"), "within": F.array().cast("array<array<int>>")}
    at = materialize(rows_of.withColumns(start).select(*COLUMNS), "cells")
    dealt, written = [], [at]
    for depth in range(DEPTH):
        if (parts := _split(at, depth, margin, sample, cell, cells)) is None:
            break
        dealt.append(parts[0])
        at = parts[1]
        written += parts[1:]
    for stay in dealt:
        at = at.unionByName(stay)
    tasks = block_tasks(at, BY, "rep", block)
    by = [*BY, "bi", "bj"]
    links = materialize(tasks.repartition(*by).sortWithinPartitions(*by, "rep").mapInArrow(_verify(threshold), "rep long, label string, k long, links long, root long"), "links")
    drop(*written)

    # an id may stand for several vectors: links belong to a class, known by id, label and a number of its vector
    counted = links.groupBy("rep", "label", "k").agg(F.sum("links").alias("links"))
    # a vec_id that stands for several classes joins them only through its own rows, so ids are the nodes
    edges = links.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(usable.join(classes.filter("n > 1").select("label", "key", "rep"), ["label", "key"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b")).filter("a <> b"))
    reached = components(edges)
    own = usable.select("vec_id", "label", "key").join(classes.select("label", "key", "rep", "n", "k").join(counted, ["rep", "label", "k"], "left").drop("k"), ["label", "key"])
    own = own.select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rest = rows.filter(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = own.union(rest).join(reached.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: All pairs of a label; closures of links are as large as groups are, so it is for small tables.
ORACLE_SQL = f"""
with recursive v as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
fine as (select *, list_max(list_transform(e, lambda x: abs(x))) as top from v where vec_id is not null and label is not null and len(e) > 0
  and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
scaled as (select r, vec_id, label, list_transform(e, lambda x: x / top) as e from fine),
unit as (select r, vec_id, label, len(e) as dim, list_transform(e, lambda x: x / n) as e from (select *, sqrt(list_dot_product(e, e)) as n from scaled)),
link as (select a.r, a.vec_id as a, b.vec_id as b from unit a join unit b on a.label = b.label and a.dim = b.dim and a.r <> b.r where list_dot_product(a.e, b.e) >= {THRESHOLD}),
reach(id, node) as (select vec_id, vec_id from v where vec_id is not null union select id, b from reach join link on node = a),
component as (select id, min(node) as c from reach group by id),
links as (select r, count(*) as n from link group by r)
select v.vec_id, cast(coalesce(links.n, 0) as bigint) as n_links, component.c as component_id, coalesce(v.vec_id = component.c, true) as kept
from v left join links on v.r = links.r left join component on v.vec_id = component.id
"""
