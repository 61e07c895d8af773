"""Best-fit packing of token sequences by exact complements.

Texts become token ids, cut into pieces of at most `size`. How pieces share sequences is decided on the counts of
pieces by length alone: at most `size` numbers. Longest first, a length takes from indexes of single lengths, of
pair sums and of triple sums what fills its gap exactly, as often as all of them are available; what has no
complement is packed best-fit. Pieces then find their place by their rank among those of their length.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helicase.llm.common import ship, staged

ship(__name__)

#: Chunks of text whose ids a task keeps at most.
CACHED = 150_000
#: Texts cut at once.
ROWS = 500


@functools.lru_cache(None)
def _encoding(path: str):
    """The byte-level BPE of a tokenizers file, and its special tokens."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or "ByteLevel" not in json.dumps(spec["pre_tokenizer"]):
        raise ValueError("a byte-level BPE is needed")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(of_char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), tuple(special)


class _Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A blank between two other characters always begins a token, so a text falls into chunks that are encoded alone,
    and a chunk that was seen before needs no encoding. Texts with other white space beside a blank go whole.
    """

    def __init__(self, path: str):
        self.encoding, self.special = _encoding(path)
        self.cache: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        for s in self.special:
            if s in text:
                return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()
        first, *rest = text.split(" ")
        if not rest:
            return self.plain(text)
        last = " " + rest.pop()
        if not first or first[-1].isspace() or len(last) == 1 or last[1].isspace():
            return self.plain(text)
        out = list(map(self.cache.get, rest))
        if None in out:
            if len(self.cache) > CACHED:
                self.cache = {}
            for i, ids in enumerate(out):
                if ids is None:
                    c = rest[i]
                    if not c or c[0].isspace() or c[-1].isspace():
                        return self.plain(text)
                    out[i] = self.cache[c] = self.plain(" " + c)
        return self.plain(first) + b"".join(out) + self.plain(last)


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, size: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of every row of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, part, rank[, ids].

    A null text is empty, so that its only token is `end_id`. The first piece takes what full pieces leave. `rank`
    counts the pieces of one length within a task, `part` is the task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint" + ", ids binary" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = _Encoder(tokenizer), defaultdict(int), TaskContext.get().partitionId()
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                owner, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
                for i, text in enumerate(batch.column("text")):
                    data = encode(text.as_py() or "") + end
                    n = len(data) // 4
                    at, k, to = 0, 0, (n - 1) % size + 1
                    while at < n:
                        own = data[4 * at : 4 * to]
                        owner.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(own))
                        rank.append(seen[to - at])
                        seen[to - at] += 1
                        if keep_ids:
                            ids.append(own)
                        at, k, to = to, k + 1, to + size
                out = {
                    "doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([part] * len(owner), pa.int32()),
                    "rank": pa.array(rank, pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {}))

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


#: Ways to use complements: pieces that a complement has at most, and the share of a sequence that its longest piece must have.
WAYS = [(depth, share) for depth in (3, 2, 1) for share in (0.0, 1 / 3, 1 / 2)] + [(0, 0.0)]


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences (lengths, longest first) and how many sequences have each; every piece is in one.

    Complements that are too eager use up the short pieces that best-fit needs later, so the plan is made in each of WAYS, on
    counts alone, and the one with the fewest sequences is taken; the last way is best-fit decreasing without complements.
    """
    return min((_plan(counts, size, depth, int(share * size)) for depth, share in WAYS), key=lambda groups: sum(n for _, n in groups))


def _plan(counts: dict[int, int], size: int, depth: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements of up to `depth` pieces for pieces longer than `least`, longest first; then best-fit."""
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    left: dict[int, int] = {}

    def enough(*lengths: int) -> int:
        return min(int(have[x]) // lengths.count(x) for x in set(lengths))

    def pair_for(gap: int, *held: int) -> tuple[int, int] | None:
        b = np.arange(gap - 1, (gap - 1) // 2, -1)
        for i in np.flatnonzero((have[b] > 0) & (have[gap - b] > 0)):
            if enough(*held, int(b[i]), gap - int(b[i])):
                return int(b[i]), gap - int(b[i])
        return None

    def complement(a: int) -> tuple[int, ...] | None:
        gap = size - a
        if gap == 0:
            return ()
        if depth and enough(a, gap):
            return (gap,)
        if depth > 1 and (pair := pair_for(gap, a)):
            return pair
        if depth < 3:
            return None
        there = (have > 0).astype(np.int64)
        sums = np.convolve(there, there)  # in how many ways two lengths give each sum
        for b in range(gap - 2, 0, -1):
            if have[b] and sums[gap - b] and enough(a, b) and (pair := pair_for(gap - b, a, b)):
                return (b, *pair)
        return None

    for a in range(size, 0, -1):
        while have[a]:
            rest = complement(a) if a > least else None
            if rest is None:
                left[a] = int(have[a])
                have[a] = 0
                break
            own = (a, *rest)
            n = enough(*own)
            out.append((own, n))
            for x in own:
                have[x] -= n
    return out + _best_fit(left, size)


def _best_fit(left: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each piece goes to the fullest sequence with room; sequences of equal content are handled together."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in sorted(left, reverse=True):
        n = left[length]
        for gap in sorted(room):
            while n and gap >= length and room[gap]:
                own, bins = next(iter(room[gap].items()))
                each = min(gap // length, -(-n // bins))
                whole = min(bins, n // each)
                if whole < bins:
                    room[gap][own] = bins - whole
                else:
                    del room[gap][own]
                at, to = room[gap - each * length], own + (length,) * each
                at[to] = at.get(to, 0) + whole
                n -= whole * each
        each = size // length
        for own, bins in (((length,) * each, n // each), ((length,) * (n % each), 1 if n % each else 0)):
            if bins:
                at = room[size - sum(own)]
                at[own] = at.get(own, 0) + bins
    return [x for at in room.values() for x in at.items()]


def _slots(groups: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which another place begins, the sequence of that rank, and the offset there."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for own, n in groups:
        offset = 0
        for length in own:
            found[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in found.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id, text) with their sequence_id and offset; `ids` (binary) with keep_ids.

    Empty and null texts have one piece, their end. Repeated rows and repeated or null doc_ids are packed each for
    itself; an empty table gives no rows. Longer texts are cut, never shortened. Other columns of `docs` don't matter.
    Only counts by length come to the driver, `size` numbers at most.
    """
    pieces = staged(pieces_of(docs, tokenizer, end_id, size, keep_ids), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(counts, size), size)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            length, rank = x["length"].to_numpy(), x["rank"].to_numpy()
            sequence, offset = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                begins, first, at = slots[int(k)]
                i = np.searchsorted(begins, rank[own], "right") - 1
                sequence[own], offset[own] = first[i] + rank[own] - begins[i], at[i]
            yield x.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = pieces.join(firsts, ["length", "part"]).select(*columns, (F.col("rank") + F.col("first")).alias("rank"))
    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInPandas(place, f"{kinds}, sequence_id bigint, offset bigint")
