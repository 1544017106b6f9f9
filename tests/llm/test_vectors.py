import numpy as np
import pytest

from larkspur.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cell int, home int, n int"


def brute(rows, t=0.98):
    fine = []
    for _, e, lab, *_ in rows:
        v = None
        if e is not None and lab is not None and len(e) and all(x is not None for x in e):
            a = np.array(e, np.float32).astype(float)
            if np.isfinite(a).all() and (a != 0).any():
                v = a / np.abs(a).max()
                v = v / np.linalg.norm(v)
        fine.append(v)
    n, comp = [0] * len(rows), {r[0]: r[0] for r in rows if r[0] is not None}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if fine[i] is not None and fine[j] is not None and None not in (rows[i][0], rows[j][0]) and rows[i][2] == rows[j][2] and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= t]
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    for _ in rows:
        for i, j in pairs:
            a, b = rows[i][0], rows[j][0]
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted(((r[0] is None, r[0] or 0), k, comp.get(r[0]), r[0] is None or comp[r[0]] == r[0]) for r, k in zip(rows, n, strict=True))


def fixture():
    r = np.random.default_rng(1)
    rows, i = [], 0
    for label in (1, 2):
        for c in range(12):
            base = r.normal(size=16)
            for _ in range(r.integers(1, 9)):
                v = base + r.normal(size=16) * r.choice([0.02, 0.05, 0.07])
                rows.append((i, (v * r.choice([1.0, 30.0])).astype(np.float32).tolist(), label, "x", 1, 2, 3))
                i += 1
    base = r.normal(size=16).astype(np.float32).tolist()
    rows += [(i + k, base, 1 + k % 2, "x", 1, 2, 3) for k in range(20)]
    i += 20
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-38] * 16, [3e38] * 16]
    rows += [(i + k, e, 1, None, None, None, None) for k, e in enumerate(odd)]
    i += len(odd)
    rows += [(i, base, None, "x", 1, 2, 3), (None, base, 1, "x", 1, 2, 3), rows[0], rows[5]]
    return rows


@pytest.mark.parametrize("options", [{}, {"cell": 3, "block": 8}, {"cell": 8, "cells": 5, "sample": 10}])
def test_matches_brute_force(spark, options):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, **options).collect())
    want = brute(rows)
    assert sum(w[1] for w in want) > 100
    assert got == want


@pytest.mark.parametrize("adaptive", ["10MB", "-1"])
def test_cells_inside_cells(spark, monkeypatch, adaptive):
    """Joins planned by sort and merge, and changed to broadcasts while they run or not, as on large tables."""
    r = np.random.default_rng(5)
    tops = r.normal(size=(4, 24)) * 3
    rows = []
    for i in range(1500):
        base = tops[i % 4] + np.random.default_rng(i % 150).normal(size=24)
        rows.append((i, (base + r.normal(size=24) * 0.1).tolist(), int(i % 10 == 0), "x", 1, 2, 3))
    levels = []
    split = vectors._split

    def watched(*a):
        if (parts := split(*a)) is not None:
            levels.append(max(len(x.path) for x in parts[1].select("path").collect()))
        return parts

    monkeypatch.setattr(vectors, "_split", watched)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": adaptive, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        got = sorted(((False, x.vec_id), x.n_links, x.component_id, x.kept) for x in vectors.near_duplicates(df, cell=30, cells=4, block=16).collect())
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert levels[:2] == [1, 2]
    want = brute(rows)
    assert sum(w[1] for w in want) > 1000
    assert got == want


def test_ids_of_several_vectors_and_text_labels(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.001], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], "b"), (5, [1.0, 0.0], None)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        vectors.near_duplicates(spark.createDataFrame([], SCHEMA), threshold=0)
