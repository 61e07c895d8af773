"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are put into bins. In turn, each feature's shallow tree (a few steps over its bins) is fitted to what the
model still gets wrong and added to that feature's lookup table; then the same is done for the pairs of features that
explain most of the rest. A score is the sum of looked-up values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import common
from helicase.llm.common import ship, staged

ship(__name__)

FEATURES = (
    "log_chars log_words word_length word_length_spread upper lower digit blank newline stop comma mark symbol other line_length line_spread "
    "distinct_words top_word distinct_pairs distinct_shingles top_line symbol_words upper_words short_words byte_entropy sentence_length"
).split()

#: Labelled rows the model is fitted on at most (chosen by a hash of their id).
FIT_ROWS = 20_000
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES = 24, 120, 6, 40, 0.12, 4


def _classes() -> np.ndarray:
    """Kind of each byte: 0 upper, 1 lower, 2 digit, 3 blank, 4 newline, 5 stop, 6 comma, 7 mark, 8 symbol, 9 other."""
    kind = np.full(256, 9)
    kind[:128] = 8
    for chars, k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0), ("abcdefghijklmnopqrstuvwxyz", 1), ("0123456789", 2), (" \t", 3), ("\n\r\v\f", 4), (".", 5), (",", 6), ("!?:;", 7)):
        kind[[ord(c) for c in chars]] = k
    return kind


def _top_share(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values over all, and the most frequent one's share, for each text."""
    o, _, times = common.distinct(owner, hashes)
    total = np.maximum(np.bincount(owner, minlength=n), 1)
    most = np.zeros(n)
    np.maximum.at(most, o, times)
    return np.bincount(o, minlength=n) / total, most / total


def features_of(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    data, at = common.text_bytes(column)
    out = np.zeros((len(at) - 1, len(FEATURES)), np.float32)
    kinds = _classes()
    for i, j in common.slices(at):
        raw, begin = data[at[i] : at[j]], at[i : j + 1] - at[i]
        n, size = j - i, np.diff(begin)
        who = np.repeat(np.arange(n), size)
        kind = kinds[raw]
        share = np.bincount(who * 10 + kind, minlength=n * 10).reshape(n, 10) / np.maximum(size, 1)[:, None]
        byte = np.bincount(who * 256 + raw, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
        entropy = -(byte * np.log2(np.where(byte > 0, byte, 1))).sum(1)
        low = common.lowered(raw)
        owner, starts, lengths, hashes = common.words(low, begin)
        words = np.maximum(np.bincount(owner, minlength=n), 1)
        mean = np.bincount(owner, lengths, minlength=n) / words
        spread = np.sqrt(np.maximum(np.bincount(owner, lengths.astype(float) ** 2, minlength=n) / words - mean**2, 0))
        tail = kind[starts + lengths - 1] if len(starts) else starts
        head = kind[starts] if len(starts) else starts
        line = np.cumsum(kind == 4) + who  # another number for each line of each text
        new = np.ones(len(raw), bool)
        new[1:] = line[1:] != line[:-1]
        line_at = np.flatnonzero(new)
        line_of, line_size = who[line_at] if len(raw) else line_at, np.diff(np.append(line_at, len(raw)))
        lines = np.maximum(np.bincount(line_of, minlength=n), 1)
        line_mean = np.bincount(line_of, line_size, minlength=n) / lines
        line_spread = np.sqrt(np.maximum(np.bincount(line_of, line_size.astype(float) ** 2, minlength=n) / lines - line_mean**2, 0))
        text_line = line[starts] if len(starts) else starts
        p_owner, pairs = common.shingles(owner, hashes, n, 2)
        s_owner, fives = common.shingles(owner, hashes, n, 5)
        d_words, top_word = _top_share(owner, hashes, n)
        d_pairs, _ = _top_share(p_owner, pairs, n)
        d_fives, _ = _top_share(s_owner, fives, n)
        first_of_line = np.ones(len(starts), bool)
        first_of_line[1:] = text_line[1:] != text_line[:-1]
        heads = np.flatnonzero(first_of_line)
        sums = np.add.reduceat(hashes * np.uint64(3) + np.uint64(1), heads) if len(heads) else hashes[:0]
        _, top_line = _top_share(owner[heads], sums, n)
        per_word = lambda mask: np.bincount(owner[mask], minlength=n) / words  # noqa: E731, B023
        stops = np.bincount(owner[(tail == 5) | (tail == 7)], minlength=n) + 1
        columns = [
            np.log1p(size), np.log1p(words), mean, spread, *share.T, line_mean, line_spread, d_words, top_word, d_pairs, d_fives, top_line,
            per_word((tail == 8) | (head == 8)), per_word((head == 0) & (tail == 0)), per_word(lengths <= 2), entropy, words / stops,
        ]
        out[i:j] = np.where((size > 0)[:, None], np.stack(columns, 1), 0)
    return out


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and `features` of every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features_of(b.column("text"))
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, features array<float>")


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def logit(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for k in range(len(self.edges)):
            out += self.tables[k, b[:, k]]
        for (p, q), table in zip(self.pairs, self.pair_tables):
            out += table[b[:, p], b[:, q]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(self.bins(x))))


def _steps(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A tree over ordered bins: splits that gain most, then each leaf's value."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(cuts) <= leaves:
        best = max(((worth(a, m) + worth(m, b) - worth(a, b), m) for a, b in zip(cuts, cuts[1:]) for m in range(a + 1, b)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The tree of depth two over a pair's bins (one cut of each) that gains most."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quarter(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        right, down = c[:-1, -1:] - a, c[-1:, :-1] - a
        return [a, right, down, c[-1, -1] - a - right - down]

    gains = sum(x**2 / (y + 1.0) for x, y in zip(quarter(cg), quarter(ch)))
    i, j = np.unravel_index(np.argmax(gains), gains.shape)
    out = np.zeros_like(g)
    for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Without rows, every score is a half; with one label only, close to it."""
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(k)]
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    m = Model(float(np.log(rate / (1 - rate))), edges, np.zeros((k, BINS + 1)), [], np.zeros((0, BINS + 1, BINS + 1)))
    if not len(x):
        return m
    b = m.bins(x)
    logit = np.full(len(x), m.base)

    def wrong() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(k):
            g, h = wrong()
            step = RATE * _steps(np.bincount(b[:, i], g, BINS + 1), np.bincount(b[:, i], h, BINS + 1), LEAVES)
            m.tables[i] += step
            logit += step[b[:, i]]
    g, h = wrong()

    def square(p: int, q: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, p] * (BINS + 1) + b[:, q], w, (BINS + 1) ** 2).reshape(BINS + 1, BINS + 1)

    gain = {(p, q): _quadrants(square(p, q, g), square(p, q, h))[0] for p in range(k) for q in range(p + 1, k)}
    m.pairs = sorted(gain, key=lambda c: -gain[c])[:PAIRS]
    m.pair_tables = np.zeros((len(m.pairs), BINS + 1, BINS + 1))
    for _ in range(PAIR_ROUNDS):
        for n, (p, q) in enumerate(m.pairs):
            g, h = wrong()
            step = RATE * _quadrants(square(p, q, g), square(p, q, h))[1]
            m.pair_tables[n] += step
            logit += step[b[:, p], b[:, q]]
    return m


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, rows: int = FIT_ROWS) -> Model:
    """Fitted on the documents of at most `rows` labelled ids, chosen by a hash of doc_id among those `learn_from` holds for.

    Several labels of one id count as their rounded mean, several documents of one id as the first by features; null ids and
    labels teach nothing. Without labelled documents every score is a half.
    """
    known = labels.filter("quality is not null and doc_id is not null").filter(F.lit(True) if learn_from is None else learn_from)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    known = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "quality-labels")
    some = with_features(docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id"))
    some = some.groupBy("doc_id").agg(F.min("features").alias("features")).join(F.broadcast(known), "doc_id")
    some = some.orderBy("doc_id").limit(rows).select("features", "y").toPandas()
    x = np.stack(some["features"]).astype(np.float32) if len(some) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, some["y"].to_numpy(float))


def scorer(model: Model):
    """A column function: `score` of a text, 0 to 1 and high for quality 1."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(common.in_parts(texts, lambda part: shared.value.score(features_of(part))))

    return run


def score(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """doc_id and `score` of every row of `docs` (doc_id, text).

    The whole text counts. Null texts are empty; empty texts are scored as the features' zeros say; repeated rows
    get equal scores; an empty table gives none. Nothing but the text is looked at, so other columns don't matter.
    """
    return docs.select("doc_id", scorer(train(docs, labels, learn_from))("text").alias("score"))


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, whose score is `least` or more."""
    return docs.filter(scorer(train(docs, labels))("text") >= least)
