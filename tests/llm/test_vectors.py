"""Nearest neighbours and hard negatives against brute force, on vectors with ties, copies, nulls and odd lengths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helicase.llm import kmeans_tree, negatives, queries, tiles

NAN, INF = float("nan"), float("inf")
CLASH = ", ".join(f"{c} string" for c in ("v", "tile", "leaf", "score", "rank", "query", "angles", "norm", "cell", "near", "anchor", "positives", "leaves"))


def vectors(seed, n, d=6):
    """(id, vector, label): small whole and broken numbers, so that scores tie; a third of the rows are copies of one vector."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = np.round(r.normal(size=d) * 2) / 2 if i % 3 else np.full(d, 0.5)
        out.append((int(i), [float(v) for v in x], int(r.integers(0, 3))))
    odd = [
        (None, [1.0] * d, 1), (1000, None, 1), (1100, [1.0, None], 1), (1200, [NAN] * d, 1), (1300, [INF, 1.0], 0), (1400, [0.0] * d, 0), (1500, [2.0, 1.0], 0), (1600, [], 1),
        (0, [0.5] * d, 2), (100, [3.0] * d, 1), (100, [3.0] * d, 1), (1700, [1e4] * d, None), (1800, [-0.0, 0.5], 2),
    ]
    return out + odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 13) for r in rows], f"id bigint, vector array<double>, label int, {CLASH}").repartition(4)


def usable(rows, zero):
    good = lambda x: x is not None and all(v is not None and np.isfinite(v) for v in x) and (zero or any(x))
    own = {(i, tuple(x), label) for i, x, label in rows if i is not None and good(x)}
    width = max([len(x) for _, x, _ in own], default=0)
    return sorted((i, x + (0.0,) * (width - len(x)), label) for i, x, label in own if True)


def mined(rows, every, scale, low, high):
    own = [(i, [int(np.floor(scale * v)) for v in x], label) for i, x, label in usable([r for r in rows if r[2] is not None], True)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in own:
        if a[0] % every:
            continue
        s = sorted(((-dot(a[1], b[1]), b[0], b[2]) for b in own if b[0] != a[0]))
        for p in [x for x in s if x[2] == a[2]][:5]:
            fit = [x for x in s if x[2] != a[2] and low * -p[0] <= 100 * -x[0] <= high * -p[0]][:10]
            out += [(a[0], p[1], k + 1, n[1], -p[0], -n[0]) for k, n in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("scale, size", [(256.0, 8192), (256.0, 40), (1e8, 8192)])
def test_hard_negatives(spark, monkeypatch, scale, size):
    rows = vectors(int(size), 240)
    monkeypatch.setattr(negatives, "TILE", size)
    monkeypatch.setattr(negatives, "WINDOW", 8)
    got = negatives.mine(frame(spark, rows), F.col("id") % 20 == 0, scale)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 20, scale, 30, 90)
    assert negatives.mine(frame(spark, []), F.col("id") % 20 == 0).count() == 0


def test_bounds_hold_and_skip():
    """No score lies outside its window's bounds, and clusters that are far away are not scored."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(4, 16))
    x = np.floor(256 * np.concatenate([c + 0.05 * r.normal(size=(200, 16)) for c in centres]))
    refs = negatives.references(x, 16)
    norm = np.linalg.norm(x, axis=1)
    angles = np.arccos(np.clip(x / norm[:, None] @ refs.T, -1, 1))
    import pyarrow as pa

    t = pa.table({"id": np.arange(800), "label": np.zeros(800, int), "norm": norm, "cell": angles.argmin(1), "near": angles.min(1), "v": tiles.lists(x, pa.float64()), "angles": tiles.lists(angles, pa.float64())})
    side = negatives._Side(t)
    skipped = 0
    for window in side.windows():
        low, high = negatives.bounds(side, side, window)
        s = x @ x[window].T
        assert (s >= low[:, None]).all() and (s <= high[:, None]).all()
        skipped += (high < 0.7 * norm**2).sum()
    assert skipped > 1000


@pytest.mark.parametrize("size", [8192, 50])
def test_neighbours_on_small_tables(spark, monkeypatch, size):
    """With a recall of 1 the search is exact: ties, copies, nulls, zero vectors and repeated ids."""
    rows = vectors(3, 300)
    monkeypatch.setattr(kmeans_tree, "TILE", size)
    got = kmeans_tree.Index(frame(spark, rows).drop("label")).search(F.col("id") % 20 == 0, 12, 1.01)
    own = sorted({(i, x) for i, x, _ in usable(rows, False)})
    dot = lambda a, b: float(np.dot(a, b))
    want = []
    for i, x in own:
        if i % 20 == 0:
            best = sorted((-dot(x, y), j) for j, y in own if j != i)[:12]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_all_candidates_if_there_are_few(spark, n):
    rows = [(20 * i, [1.0, float(i)], 0) for i in range(n)]
    got = kmeans_tree.Index(frame(spark, rows).drop("label")).search(F.col("id") % 20 == 0, 12, 0.9).collect()
    assert len(got) == n * (n - 1)


def test_recall_of_the_query(spark):
    """Recall against brute force over the whole table, true scores, and fewer rows scored than there are."""
    path = "/root/testdata/sf0.1"
    got = queries.op11_kmeans_tree(spark, path).toPandas()
    table = pd.read_parquet(f"{path}/embeddings.parquet")
    x, ids = np.stack(table.embedding.values).astype(float), table.vec_id.values
    asked = np.flatnonzero(ids % 20 == 0)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    true = {ids[i]: set(ids[t]) for i, t in zip(asked, np.argsort(-s, axis=1)[:, :20])}
    hits = [v in true[q] for q, v in zip(got.query_id, got.vec_id)]
    assert len(got) == 20 * len(asked) and np.mean(hits) >= 0.93
    at = {i: k for k, i in enumerate(ids)}
    for q, v, score in zip(got.query_id[:200], got.vec_id, got.score):
        assert abs((x[at[q]] * x[at[v]]).sum() - score) < 1e-12
    index = kmeans_tree.Index(spark.read.parquet(f"{path}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    assert index.sizes.sum() == len(ids) and index.calibrated(20, 0.5) < index.tree.n_leaves / 2
