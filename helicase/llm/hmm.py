"""Hidden Markov language model.

Latent states emit classes of words, and a class emits its words in proportion to their counts in the corpus; a class is a
hash of the word, and there are more of them with more different words. Every Baum-Welch round runs over all training
texts, its counts summed over partitions, until the likelihood hardly rises; the likelihood of a text is computed exactly by the scaled forward recursion.
Pieces of a long text are walked side by side, from the forward and backward values that the products of their steps give for their edges.

Texts are staged once, as blocks of word numbers with the words (as 64-bit hashes) that occur in the block. Corpus
counts cross the network as one row for each word of a block.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helicase.llm import common
from helicase.llm.common import ship, staged

ship(__name__)

STATES = 6
#: Classes of words at least, a power of two; one more holds the end of a text.
CLASSES = 1 << 14
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Tokens whose forward values are held at once, unless one text has more.
PART_TOKENS = 100_000
#: Tokens of a text that are walked in one go; longer texts are cut into pieces that are walked side by side.
SEGMENT = 1536
#: Steps after which forward values are scaled anew; emissions are shares of the largest, so they stay far from underflow.
RESCALE = 16
#: Baum-Welch ends when PATIENCE rounds in turn gain less than LEAST_GAIN of log-likelihood (natural) a token.
LEAST_GAIN, PATIENCE = 1e-3, 2
SMOOTHING = 0.5


def _packed(x: np.ndarray) -> bytes:
    """An array's bytes, compressed, behind their number."""
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind)


def n_classes(types: int) -> int:
    """Classes for so many different words: the power of two from 16 times their root, so that a model fits a task."""
    return max(CLASSES, 1 << math.ceil(math.log2(16 * math.sqrt(max(types, 1)))))


def blocks_of(docs: DataFrame, held: Column) -> DataFrame:
    """Blocks of texts: ids, held-out flags, word counts, the distinct words with their counts in training texts, and the words' numbers.

    The arrays are little-endian; `words` is compressed.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            data, at = common.text_bytes(b.column("text"))
            held_out = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in common.slices(at, BLOCK_BYTES):
                found, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for p, q in common.slices(at[i : j + 1]):
                    lo, hi = at[i + p], at[i + q]
                    owner, _, _, words = common.words(common.lowered(data[lo:hi]), at[i + p : i + q + 1] - lo)
                    found.append(words)
                    count.append(np.bincount(owner, minlength=q - p))
                n = np.concatenate(count)
                vocabulary, numbers = np.unique(np.concatenate(found), return_inverse=True)
                teaches = np.repeat(~held_out[i:j], n)
                trained = np.bincount(numbers[teaches], minlength=len(vocabulary))
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([number], pa.int64()), "doc_id": pa.array([b.column("doc_id").slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([held_out[i:j].tobytes()], pa.binary()), "n": pa.array([n.astype("<i8").tobytes()], pa.binary()),
                    "vocabulary": pa.array([vocabulary.astype("<u8").tobytes()], pa.binary()), "trained": pa.array([trained.astype("<i8").tobytes()], pa.binary()),
                    "words": pa.array([_packed(numbers.astype("<u4"))], pa.binary()),
                })
                number += 1

    schema = "block bigint, doc_id array<bigint>, held binary, n binary, vocabulary binary, trained binary, words binary"
    return staged(rows.mapInArrow(run, schema), "hmm-blocks")


class _Rows:
    """Stretches of tokens side by side, longest first: entry `first[t] + r` is token t of the r-th longest, its class in `kind`.

    Values by state lie step by step, those of a step state by state: `steps(values, k)` gives each step's, a row for each state.
    """

    def __init__(self, begin: np.ndarray, size: np.ndarray, classes: np.ndarray):
        steps = int(size[0]) if len(size) else 0
        self.size = size
        self.at_step = np.searchsorted(-size, -np.arange(steps), "left")
        self.first = np.concatenate([[0], np.cumsum(self.at_step)]).astype(np.int64)
        step = np.repeat(np.arange(steps), self.at_step)
        self.row = np.arange(self.first[-1]) - self.first[step]
        self.kind = classes[begin[self.row] + step]
        #: steps where the number of rows changes: in between they form one block
        self.turns = np.concatenate([[0], np.flatnonzero(np.diff(self.at_step)) + 1, [steps]]).tolist() if steps else [0]

    def runs(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Steps of equally many rows: first step and the one behind the last, first entry and the one behind the last, rows."""
        for t, u in zip(self.turns[:-1], self.turns[1:]):
            yield t, u, int(self.first[t]), int(self.first[u]), int(self.at_step[t])

    def indices(self, states: int, classes: int) -> np.ndarray:
        """Where each entry's emissions stand in a table with a row for each state."""
        out = np.empty(states * len(self.kind), np.int64)
        offset = (np.arange(states) * classes)[:, None]
        for t, u, lo, hi, n in self.runs():
            np.add(self.kind[lo:hi].reshape(u - t, 1, n), offset, out=out[states * lo : states * hi].reshape(u - t, states, n))
        return out

    def steps(self, values: np.ndarray, states: int) -> list[np.ndarray]:
        return [values[states * lo : states * hi].reshape(states, hi - lo) for lo, hi in itertools.pairwise(self.first.tolist())]


class _Texts(_Rows):
    """Texts side by side, ends included as class `end`; one of more than SEGMENT tokens is cut into pieces, so that no text makes many steps of few rows.

    `text` and `nth` tell each row's text and the number of its piece there; `chains` are the rows of each text of several pieces, in order.
    """

    def __init__(self, n: np.ndarray, classes: np.ndarray, end: int = CLASSES):
        length = np.asarray(n, np.int64) + 1
        stop = np.cumsum(length)
        full = np.full(length.sum(), end, np.int64)
        inner = np.ones(len(full), bool)
        inner[stop - 1] = False
        full[inner] = classes
        pieces = -(-length // SEGMENT)
        text = np.repeat(np.arange(len(length)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(length[text] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        self.texts, self.text, self.nth = len(length), text[order], nth[order]
        begin = ((stop - length)[text] + nth * SEGMENT)[order]
        super().__init__(begin, size[order], full)
        long = np.flatnonzero(pieces[self.text] > 1)
        self.long_rows, self.long = long, _Rows(begin[long], size[order][long], full)
        by_text = long[np.lexsort((self.nth[long], self.text[long]))]
        self.chains = np.split(by_text, np.flatnonzero(np.diff(self.text[by_text])) + 1) if len(long) else []
        self.place = np.zeros(len(order), np.int64)
        self.place[long] = np.arange(len(long))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # a row for each class

    @cached_property
    def scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """Emissions, a row for each state, as shares of the class's largest, and the logarithm of that."""
        top = self.emit.max(1)
        return np.ascontiguousarray((self.emit / top[:, None]).T), np.log(top)

    def passages(self, x: _Rows, starts: np.ndarray) -> np.ndarray:
        """What each stretch does to forward values, but for a factor: [j, i, r] from state i in front of stretch r to its last state j, or from its own first state where `starts`."""
        k = len(self.start)
        e = x.steps(np.take(self.scaled[0], x.indices(k, len(self.emit))), k)
        out = np.empty((k, k, len(starts)))
        turned = np.ascontiguousarray(self.move.T)
        now = np.where(starts, np.eye(k)[:, :, None], turned[:, :, None]) * e[0][:, None]
        for t in range(1, len(e)):
            n = e[t].shape[1]
            if n < now.shape[2]:
                out[:, :, n : now.shape[2]] = now[:, :, n:]
                now = now[:, :, :n]
            now = np.dot(turned, now.reshape(k, -1)).reshape(k, k, n)
            now *= e[t][:, None]
            if t % RESCALE == 0:
                now /= now.sum((0, 1))
        out[:, :, : now.shape[2]] = now
        return out

    def edges(self, x: _Texts) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the forward values in front of it (of pieces that go on a text) and the backward values at its end."""
        k, n = len(self.start), len(x.text)
        before, after = np.zeros((k, n)), np.ones((k, n))
        if x.chains:
            through = self.passages(x.long, x.nth[x.long_rows] == 0)
            for rows in x.chains:
                own = [through[:, :, x.place[r]] for r in rows]
                v = self.start
                for r, p in zip(rows[1:], own):
                    v = p @ v
                    before[:, r] = v = v / v.sum()
                v = np.ones(k)
                for r, p in zip(rows[-2::-1], own[:0:-1]):
                    v = v @ p
                    after[:, r] = v = v / v.sum()
        return before, after

    def forward(self, x: _Texts, before: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Forward values of all tokens, the scaled emissions that made them, these by steps, and each row's log-likelihood but for its classes' largest emissions."""
        k = len(self.start)
        turned = np.ascontiguousarray(self.move.T)
        w = np.take(self.scaled[0], at)
        a, likely = np.empty_like(w), np.zeros(len(x.text))
        last = np.empty(len(x.text))
        values, given = x.steps(a, k), x.steps(w, k)
        for t, (now, e) in enumerate(zip(values, given)):
            n = now.shape[1]
            if t == 0:
                now[:] = np.where(x.nth == 0, self.start[:, None], turned @ before)
            else:
                then = values[t - 1]
                if then.shape[1] > n:
                    last[n : then.shape[1]] = then[:, n:].sum(0)
                    then = np.ascontiguousarray(then[:, :n])
                np.dot(turned, then, out=now)
            now *= e
            if t % RESCALE == 0:
                s = now.sum(0)
                now /= s
                e /= s
                likely[:n] += np.log(s)
        last[: values[-1].shape[1]] = values[-1].sum(0)
        return a, w, given, likely + np.log(last)

    def log10(self, x: _Texts) -> np.ndarray:
        """log10 of the probability of each text's classes, in the texts' own order."""
        at = x.indices(len(self.start), len(self.emit))
        likely = self.forward(x, self.edges(x)[0], at)[3] + np.bincount(x.row, self.scaled[1][x.kind], len(x.text))
        return np.bincount(x.text, likely, x.texts) / math.log(10)

    def counts(self, x: _Texts) -> np.ndarray:
        """Expected starts, moves and emissions of one Baum-Welch step, in one row of numbers."""
        return self.step(x)[:-2]

    def step(self, x: _Texts) -> np.ndarray:
        """`counts`, and then the texts' log-likelihood (natural) and their number of tokens."""
        k, n = len(self.start), len(self.emit)
        if not len(x.kind):
            return np.zeros(k + k * k + k * n + 2)
        at = x.indices(k, n)
        before, after = self.edges(x)
        a, w, given, likely = self.forward(x, before, at)
        later = np.empty_like(a)
        values = x.steps(later, k)
        values[-1][:] = after[:, : values[-1].shape[1]]
        for t in range(len(values) - 1, 0, -1):
            own, now, then = given[t], values[t], values[t - 1]
            own *= now
            here = own.shape[1]
            if then.shape[1] == here:
                np.dot(self.move, own, out=then)
            else:
                then[:, :here] = np.dot(self.move, own)
                then[:, here:] = after[:, here : then.shape[1]]
        given[0] *= values[0]
        later *= a
        moves = np.zeros((k, k))
        for t, u, lo, hi, rows in x.runs():
            of_run = lambda v: v[k * lo : k * hi].reshape(u - t, k, rows)  # noqa: E731, B023
            likes, onward = of_run(later), of_run(w)
            each = likes.sum(1, keepdims=True)
            likes /= each
            onward /= each
            if t:
                moves += a[k * x.first[t - 1] : k * lo].reshape(k, -1)[:, :rows] @ onward[0].T
            moves += np.tensordot(of_run(a)[:-1], onward[1:], ([0, 2], [0, 2]))
        goes_on = x.nth > 0
        moves += before[:, goes_on] @ given[0][:, goes_on].T
        emitted = np.bincount(at, later, k * n)
        likelihood = likely.sum() + emitted.reshape(k, n).sum(0) @ self.scaled[1]
        return np.concatenate([values[0][:, ~goes_on].sum(1), (self.move * moves).ravel(), emitted, [likelihood, len(x.kind)]])

    @staticmethod
    def of(counts: np.ndarray, more: np.ndarray, k: int = STATES) -> Model:
        """The model of summed counts, with `more` added to each state's emissions."""
        start, move, emit = counts[:k] + 1, counts[k : k + k * k].reshape(k, k) + 1, counts[k + k * k :].reshape(k, -1)
        emit = emit + more
        return Model(start / start.sum(), move / move.sum(1)[:, None], (emit / emit.sum(1)[:, None]).T.copy())


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Held-out flags, word counts, words and word numbers of a block."""
    return (
        np.frombuffer(row["held"], bool), np.frombuffer(row["n"], "<i8"), np.frombuffer(row["vocabulary"], "<u8"),
        _unpacked(row["words"], "<u4"),
    )


def _class(words: np.ndarray, classes: int) -> np.ndarray:
    return (words & np.uint64(classes - 1)).astype(np.int64)


def _parts(n: np.ndarray, classes: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, _Texts]]:
    """A block's texts in parts of similar lengths and limited size: their numbers, and the texts side by side."""
    order = np.argsort(-n, kind="stable")
    begin = np.concatenate([[0], np.cumsum(n)])
    part = np.cumsum(n[order] + 1) // PART_TOKENS
    for own in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(n) else ():
        k = n[own]
        at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        yield own, _Texts(k, classes[at], end)


def _training(row: dict, classes: int) -> Iterator[_Texts]:
    held, n, vocabulary, numbers = _unpack(row)
    for _, texts in _parts(n[~held], _class(vocabulary, classes)[numbers[np.repeat(~held, n)]], classes):
        yield texts


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0):
            own = _unpacked(x.as_py(), "float64")
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], ["counts"])


def train(blocks: DataFrame, tokens: np.ndarray, types: np.ndarray) -> tuple[Model, list[float]]:
    """Baum-Welch over all training texts from a random model that depends on the number of classes only, and the log-likelihood a token before each round.

    `tokens` and `types` are the classes' words in training texts, all and different ones. Each state adds SMOOTHING to its count
    of a class for every type and for one word that never occurred. How rows lie in files and blocks doesn't matter, but for rounding.
    """
    rng = np.random.default_rng(7)
    more = SMOOTHING * (types + 1.0)
    prior = (tokens + types + 1) / (tokens + types + 1).sum()
    stay = np.full((STATES, STATES), 0.1 / STATES) + np.eye(STATES) * 0.9
    m = Model(np.full(STATES, 1 / STATES), stay, prior[:, None] * rng.uniform(0.5, 1.5, (len(prior), STATES)))
    m.emit /= m.emit.sum(0)
    context = blocks.sparkSession.sparkContext
    # each task adds up many blocks, so the tables that cross the network don't grow in number with the input
    few = 3 * context.defaultParallelism
    texts = blocks.select("held", "n", "vocabulary", "words").coalesce(few)
    likelihoods: list[float] = []
    small = 0
    while small < PATIENCE:
        now = context.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, total = now.value, None  # noqa: B023
            for b in batches:
                for row in b.to_pylist():
                    for x in _training(row, len(model.emit) - 1):
                        own = model.step(x)
                        total = own if total is None else np.add(total, own, out=total)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], ["counts"])

        some = texts.mapInArrow(run, "counts binary").repartition(math.isqrt(few)).mapInArrow(_added, "counts binary")
        found = some.repartition(1).mapInArrow(_added, "counts binary").first()
        now.unpersist()
        if found is None:
            break
        total = _unpacked(found["counts"], "float64")
        likelihoods.append(total[-2] / total[-1])
        m = Model.of(total[:-2], more)
        small = small + 1 if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < LEAST_GAIN else 0
    return m, likelihoods


def score(docs: DataFrame, held: Column) -> DataFrame:
    """Scores of every row of `docs` (doc_id, text); the model learns from the rows that `held` doesn't hold for.

    doc_id, held_out, n_tokens, n_known (tokens that occur in training rows), train_tokens, base_score (log10 probability
    under add-one counts) and score (log10 probability under the model). A text is its words (lower-cased A-Z, between
    white space) and one end; null and empty texts have the end only. A null `held` counts as false. Repeated rows teach and
    score each for itself; without training rows every word is unknown; an empty table gives none. Words are known by
    64-bit hashes. Other columns don't matter.
    """
    blocks = blocks_of(docs, held)
    spark = docs.sparkSession

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                words, trained = np.frombuffer(row["vocabulary"], "<i8"), np.frombuffer(row["trained"], "<i8")
                for i in range(0, len(words), 100_000):
                    w = words[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(trained[i : i + 100_000]), pa.array(np.full(len(w), row["block"], np.int64)), pa.array(np.arange(i, i + len(w), dtype=np.int32))], ["word", "trained", "block", "number"])

    rows = blocks.select("block", "vocabulary", "trained").mapInArrow(words_of, "word bigint, trained bigint, block bigint, number int")
    rows = rows.withColumn("c", F.sum("trained").over(Window.partitionBy("word")))
    rows = staged(rows.withColumn("is_first", F.row_number().over(Window.partitionBy("word").orderBy("block")) == 1), "hmm-words")
    known = rows.filter("is_first and c > 0")
    classes = n_classes(known.count())
    found = known.groupBy(F.col("word").bitwiseAND(F.lit(classes - 1)).alias("class")).agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).toArrow()
    tokens, types = np.zeros(classes + 1, np.int64), np.zeros(classes + 1, np.int64)
    tokens[found["class"].to_numpy()], types[found["class"].to_numpy()] = found["tokens"].to_numpy(), found["types"].to_numpy()
    held_texts = F.length(F.regexp_replace(F.hex("held"), "00", ""))
    ends = int(blocks.agg(F.sum(F.size("doc_id") - held_texts / 2)).first()[0] or 0)
    tokens[classes], types[classes] = ends, int(ends > 0)
    n_all, v_all = int(tokens.sum()), int(types.sum())
    model, _ = train(blocks, tokens, types)
    # of a class's probability, a word it never had in training gets the share of one token
    given = spark.sparkContext.broadcast((model, tokens[:classes] + types[:classes] + 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m, of_class = given.value
        out = {"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []}
        for row in left.to_pylist():
            held_out, n, vocabulary, numbers = _unpack(row)
            c = np.zeros(len(vocabulary), np.int64)
            c[right["number"].to_numpy()] = right["c"].to_numpy()
            kind = _class(vocabulary, len(of_class))
            owner = np.repeat(np.arange(len(n)), n)
            per_text = lambda x: np.bincount(owner, x[numbers], len(n))  # noqa: E731, B023
            path = np.zeros(len(n))
            for i, texts in _parts(n, kind[numbers], len(of_class)):
                path[i] = m.log10(texts)
            base = per_text(np.log10((c + 1) / (n_all + v_all + 1))) + np.log10((ends + 1) / (n_all + v_all + 1))
            own = path + per_text(np.log10((c + 1) / of_class[kind]))
            out["doc_id"] += row["doc_id"]
            out["held_out"] += held_out.tolist()
            out["n_tokens"] += (n + 1).tolist()
            out["n_known"] += (per_text((c > 0).astype(float)).astype(np.int64) + (ends > 0)).tolist()
            out["train_tokens"] += [n_all] * len(n)
            out["base_score"] += base.tolist()
            out["score"] += own.tolist()
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    texts = blocks.select("block", "doc_id", "held", "n", "vocabulary", "words").groupBy("block")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.cogroup(rows.select("block", "number", "c").groupBy("block")).applyInArrow(run, schema)
