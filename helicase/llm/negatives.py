"""Hard-negative mining by angular triangle filtering.

Every vector stores its angles to a few reference directions. By the triangle inequality on the sphere, the angle between two
vectors lies between |s - t| and min(s + t, 2 pi - s - t) for each reference, s and t being their angles to it. The vectors
of a tile stand in order of label, nearest reference and angle; for windows of neighbours the least and largest angles and
norms bound all cosines and, times norms and rounded outwards, all scores with an anchor. Only windows whose bounds overlap
what an anchor still needs are scored, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helicase.llm import tiles
from helicase.llm.common import ship, staged

ship(__name__)

#: Reference directions, fitted on about FIT_ROWS rows; they decide what is skipped, never what is returned.
REFERENCES, FIT_ROWS = 16, 4096
#: Rows of a tile of candidates, of a tile of anchors, and of a window.
TILE, ANCHORS, WINDOW = 8192, 4096, 128
#: What rounding can add to an angle (near 0 and pi, a cosine determines it to 1e-8 only) and to a score, as a share of the norms.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9


def references(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Up to k unit vectors, means of the sample's directions around them."""
    norm = np.linalg.norm(sample, axis=1)
    unit = sample[norm > 0] / norm[norm > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1] or 1)
    out = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)]
    for _ in range(rounds):
        near = (unit @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, unit)
        size = np.linalg.norm(sums, axis=1)
        out = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], out)
    return out


def prepared(rows: DataFrame, scale: float) -> DataFrame:
    """Written rows (id, label, v, norm, angles, cell, near, key): v is floor(scale * x), key tells rows of one id apart.

    Rows with a null id, label or vector, or a component that is null or not finite (scaled neither) are left out; repeated rows count once.
    """
    scaled = lambda x: x.cast("double") * scale
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & tiles.valid("vector")).dropDuplicates(["id", "label", "vector"])
    rows = rows.filter(F.forall("vector", lambda x: F.abs(scaled(x)) < F.lit(float("inf"))))
    v = F.transform("vector", lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))  # large doubles are whole
    rows = staged(rows.select("id", "label", v.alias("v"), F.xxhash64("id", "label", "vector").alias("key")), "negatives-rows")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width, share = max(facts["width"] or 0, 1), 1.5 * FIT_ROWS / max(facts["n"], 1)
    sample = rows.filter(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20)).select("key", "v").orderBy("key").limit(2 * FIT_ROWS).toArrow()
    refs = references(tiles.matrix(sample["v"], width), REFERENCES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in tiles.steps(b.num_rows, 512):
                part = b.slice(at.start, at.stop - at.start)
                x = tiles.matrix(part.column("v"), width)
                largest = np.abs(x).max(1, initial=0)
                norm = largest * np.linalg.norm(x / np.where(largest > 0, largest, 1)[:, None], axis=1)
                angles = np.arccos(np.clip((x / np.where(norm > 0, norm, 1)[:, None]) @ refs.T, -1, 1))
                cell = angles.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), tiles.lists(x, pa.float64()), part.column("key"), pa.array(norm), tiles.lists(angles, pa.float64()), pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(x)), cell])],
                    ["id", "label", "v", "key", "norm", "angles", "cell", "near"],
                )

    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, v array<double>, key bigint, norm double, angles array<double>, cell int, near double"
    return staged(rows.mapInArrow(run, schema), "negatives-angles")


class _Side:
    """A tile's rows: candidates in order of their windows (label, cell, angle), ties by id."""

    def __init__(self, t: pa.Table):
        take = lambda c: t[c].to_numpy()
        self.id, self.label, self.norm = take("id"), np.asarray(t["label"].to_pylist(), object), take("norm")
        self.v, self.angles = tiles.matrix(t["v"]), tiles.matrix(t["angles"])
        self.table, self.cell, self.near = t, take("cell"), take("near")

    def windows(self) -> Iterator[np.ndarray]:
        """Numbers of the rows of each window."""
        kinds = np.unique(self.label.astype(str), return_inverse=True)[1]
        order = np.lexsort((self.id, self.near, self.cell, kinds))
        cuts = np.flatnonzero(np.diff(kinds[order])) + 1
        for run in np.split(order, cuts):
            for i in range(0, len(run), WINDOW):
                yield run[i : i + WINDOW]


def bounds(anchors: _Side, rows: _Side, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, what no score with a row of the window is below or above."""
    s, t = anchors.angles, rows.angles[window]
    lo, hi = t.min(0), t.max(0)
    least = np.maximum(np.maximum(lo - s, s - hi).max(1) - ANGLE_SLACK, 0)
    most = np.minimum(np.minimum(s + hi, 2 * np.pi - s - lo).min(1) + ANGLE_SLACK, np.pi)
    short, long = rows.norm[window].min(), rows.norm[window].max()
    slack = SCORE_SLACK * anchors.norm * long + 1
    down, up = np.cos(most), np.cos(least)
    return np.where(down < 0, down * long, down * short) * anchors.norm - slack, np.where(up > 0, up * long, up * short) * anchors.norm + slack


def scores(a: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products: of doubles where these are exact (100 times a sum is below 2^53), else of Python's integers."""
    if bound * 128 < 2.0**53:
        return a @ x.T
    whole = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    return whole(a) @ whole(x).T


def _scored(anchors: _Side, rows: _Side, which: list[tuple[np.ndarray, np.ndarray]], of: np.ndarray, columns: np.ndarray, bound: float) -> np.ndarray:
    """Scores of the anchors `of` with all `columns` (rows in order of id); minus infinity where no window asked for them."""
    place = np.full(len(rows.id), -1)
    place[columns] = np.arange(len(columns))
    out = np.full((len(of), len(columns)), -np.inf, float if bound * 128 < 2.0**53 else object)
    for window, asked in which:
        some = np.flatnonzero(asked[of])
        if len(some):
            out[np.ix_(some, place[window])] = scores(anchors.v[of[some]], rows.v[window], bound)
    return out


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"anchor": [], "key": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            a, x = _Side(left), _Side(right)
            bound = float(a.norm.max() * x.norm.max())
            plans: dict = {}
            for window in x.windows():
                plans.setdefault(x.label[window[0]], []).append((window, *bounds(a, x, window)))
            for label, plan in plans.items():
                own = a.label == label
                if not own.any():
                    continue
                sure = np.full(len(own), -np.inf)  # at least k rows besides the anchor itself score as much
                for window, low, _ in plan:
                    if len(window) > k:
                        sure = np.maximum(sure, low)
                which = [(window, own & (high >= sure)) for window, _, high in plan]
                columns = np.concatenate([w for w, asked in which if asked.any()] or [np.zeros(0, int)])
                columns = columns[np.argsort(x.id[columns], kind="stable")]
                of = np.flatnonzero(own)
                for at in tiles.steps(len(of), len(columns)):
                    s = _scored(a, x, which, of[at], columns, bound)
                    s[a.id[of[at], None] == x.id[None, columns]] = -np.inf
                    r, c = np.nonzero(tiles.first(s, k))
                    found["anchor"] += a.id[of[at]][r].tolist()
                    found["key"] += a.table["key"].to_numpy()[of[at]][r].tolist()
                    found["id"] += x.id[columns[c]].tolist()
                    found["score"] += [int(v) for v in s[r, c]]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    return run


def _negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"anchor": [], "key": [], "slot": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            a, x = _Side(left), _Side(right)
            bound = float(a.norm.max() * x.norm.max())
            positive = left["positives"].to_pylist()
            most = max(map(len, positive))
            at_least, at_most = np.full((len(positive), most), np.inf), np.full((len(positive), most), -np.inf)
            of_slot = np.zeros((len(positive), most), object)
            for i, p in enumerate(positive):
                of_slot[i, : len(p)] = p
                at_least[i, : len(p)], at_most[i, : len(p)] = [low * v / 100 for v in p], [high * v / 100 for v in p]
            which = []
            for window in x.windows():
                down, up = bounds(a, x, window)
                overlap = ((at_least - 1 <= up[:, None]) & (at_most + 1 >= down[:, None]) & (at_least <= at_most)).any(1)
                which.append((window, overlap & (a.label != x.label[window[0]])))
            columns = np.concatenate([w for w, asked in which if asked.any()] or [np.zeros(0, int)])
            columns = columns[np.argsort(x.id[columns], kind="stable")]
            key = a.table["key"].to_numpy()
            for at in tiles.steps(len(positive), len(columns)):
                of = np.arange(len(positive))[at]
                s = _scored(a, x, which, of, columns, bound)
                s[a.id[of, None] == x.id[None, columns]] = -np.inf
                hundred = s * 100
                for slot in range(most):
                    p = of_slot[of, slot].astype(float if bound * 128 < 2.0**53 else object)[:, None]
                    there = np.array([len(positive[i]) > slot for i in of])[:, None]
                    r, c = np.nonzero(tiles.first(np.where(there & (low * p <= hundred) & (hundred <= high * p), s, -np.inf), k))
                    found["anchor"] += a.id[of][r].tolist()
                    found["key"] += key[of][r].tolist()
                    found["slot"] += [slot] * len(r)
                    found["id"] += x.id[columns[c]].tolist()
                    found["score"] += [int(v) for v in s[r, c]]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    return run


def mine(rows: DataFrame, anchors: Column, scale: float = 256.0, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives of the anchors in `rows` (id, label, vector): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), a score is the integer inner product. An anchor's positives are its first
    `n_positives` rows of its label with another id; of each, the first `n_negatives` rows of other labels with low * positive
    score <= 100 * score <= high * positive score are returned. Higher scores come first, then smaller ids. Fewer are returned
    if there are no more; an anchor alone in its label and an empty table give none. Rows with a null id, label or vector or a
    null or non-finite component take no part; repeated rows count once; different rows with one id are each a row, but never each other's
    positive or negative. Shorter vectors end in zeros; zero vectors score 0. A score that doesn't fit a long is an error.
    """
    every = prepared(rows, scale)
    candidates = tiles.dealt(every, TILE, "label", "cell", "near", "id", "key")
    asking = staged(every.filter(anchors), "negatives-anchors")
    asking = tiles.dealt(asking, ANCHORS, "label", "cell", "near", "id", "key")
    found = tiles.products(asking, candidates, _positives(n_positives), "anchor bigint, key bigint, id bigint, score bigint")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", best("anchor", "key")).filter(F.col("rank") <= n_positives)
    lists = found.groupBy("anchor", "key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    lists = staged(lists.select(F.col("anchor").alias("id"), "key", "p"), "negatives-positives")
    with_positives = asking.join(lists.select("id", "key", F.transform("p", lambda x: x["score"]).alias("positives")), ["id", "key"])
    found = tiles.products(with_positives, candidates, _negatives(n_negatives, low, high), "anchor bigint, key bigint, slot bigint, id bigint, score bigint")
    found = found.withColumn("rank", best("anchor", "key", "slot")).filter(F.col("rank") <= n_negatives)
    out = found.join(lists.select(F.col("id").alias("anchor"), "key", "p"), ["anchor", "key"]).withColumn("p", F.expr("element_at(p, cast(slot as int) + 1)"))
    return out.select(F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


#: The hard negatives of `embeddings` in SQL, every anchor against all rows.
SQL = """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, embedding
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.id) QUALIFY rank <= 10
"""
