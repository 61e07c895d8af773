"""Genome compression by references to earlier sequence.

Every position is described by the best earlier stretch that resembles it; a
greedy walk from the start of each chromosome then picks references or plain
bases. The walk only depends on the position it stands on, so it is computed as
jump functions of blocks that are composed level by level, and never runs
through a chromosome in one task.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from helicase.functions import dna
from helicase.functions.edit import delta
from helicase.operators.kmers import expanded
from helicase.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = 16
UNITS = 6
STRETCH = UNIT * UNITS
LONGEST = 8192
# Lengths grow by one up to here and double from there.
FINE = 128
# Cells of the cost tables that are filled together.
CELLS = 1 << 21
# Bases of a stretch, whose text is kept in one row.
BASES = 1 << 15
# Bytes of a reference: position, length, and flags.
OVERHEAD = 9
FAN = 64


def extend(target: str, source: str, longest: int) -> tuple[int, int]:
    """``(length, edits)`` of the longest tolerated match of two texts.

    Lengths grow by one up to 128 and double from there; the walk ends at the
    first length that needs more than one edit per 16 bases.
    """
    best, edits = UNIT, 0
    t = UNIT
    room = min(len(target), len(source), longest)
    while t <= room:
        if target[:t] == source[:t]:
            best, edits = t, 0
        else:
            n = len(delta(source[:t], target[:t]))
            if n > t // 16:
                break
            best, edits = t, n
        t = t + 1 if t < 128 else t * 2
    return best, edits


def next_length(t):
    """The length tried after ``t``."""
    return t + 1 if t < FINE else t * 2


def extend_many(targets: list[str], sources: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`extend` of many pairs of texts. The lengths up to 128 of all pairs share one table of costs a pair, filled for many pairs at a time."""
    best, edits = np.full(len(targets), UNIT, "int64"), np.zeros(len(targets), "int64")
    hard = []
    for i, (a, b) in enumerate(zip(targets, sources)):
        room = min(len(a), len(b), longest)
        if a[:room] == b[:room]:
            same = room
        else:
            same = next(n for n in range(room) if a[n] != b[n])
        t = UNIT
        if same >= t:
            best[i] = t = min(same, FINE)
            while next_length(t) <= same:
                best[i] = t = next_length(t)
            t = next_length(t)
        if t <= room:
            hard.append((i, t, room))
    far = {i: t for i, t, _ in hard if t > FINE}
    near = [x for x in hard if x[1] <= FINE]
    width = max((min(room, FINE) for _, _, room in near), default=0)
    step = max(CELLS // (width + 1) ** 2, 1)
    for n in range(0, len(near), step):
        part = near[n : n + step]
        i, first, room = (np.array(c) for c in zip(*part))
        letters = lambda texts: np.array([list(texts[k][:width].encode("utf-32-le")) + [0] * (4 * (width - len(texts[k][:width]))) for k in i], "u1").view("<u4")
        counted = _prefix_edits(letters(sources), letters(targets), first, np.minimum(room, FINE))
        for t, who, found in counted:
            best[i[who]], edits[i[who]] = t, found
        far |= {k: FINE * 2 for k, r in zip(i.tolist(), room.tolist()) if best[k] == FINE and r >= FINE * 2}
    t = min(far.values(), default=0)
    while far:
        now = [i for i, first in far.items() if first <= t]
        for i, n in zip(now, edits_at([targets[i] for i in now], [sources[i] for i in now], t).tolist()):
            if n > t // UNIT:
                del far[i]
            else:
                best[i], edits[i] = t, n
        t = next_length(t)
        far = {i: first for i, first in far.items() if t <= min(len(targets[i]), len(sources[i]), longest)}
    return best, edits


def edits_at(targets: list[str], sources: list[str], t: int) -> np.ndarray:
    """``len(delta(source[:t], target[:t]))`` of many pairs of texts of ``t`` letters or more, 0 for equal ones."""
    letters = lambda texts: np.array([np.frombuffer(x[:t].encode("utf-32-le"), "<u4") for x in texts]).reshape(-1, t)
    step = max(CELLS // t, 1)
    parts = [_edits(letters(sources[n : n + step]), letters(targets[n : n + step])) for n in range(0, len(targets), step)]
    return np.concatenate([np.zeros(0, "int64"), *parts])


def _edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits of whole pairs as :func:`_prefix_edits` counts them, holding one row of each table."""
    found = np.zeros(len(a), "int64")
    who = np.flatnonzero((a != b).any(axis=1))
    a, b, (n, t) = a[who], b[who], (len(who), a.shape[1])
    if not n:
        return found
    cost, edit = np.zeros((n, t), "int32"), np.tile(np.arange(t, dtype="int32"), (n, 1))
    ramp = 2 * np.arange(t, dtype="int32")
    costs, edits = np.zeros((n, t), "int32"), np.zeros((n, t), "int32")
    costs[:, 0], edits[:, 0] = cost[:, t - 1], edit[:, t - 1]
    for i in range(1, t):
        other = a[:, i - 1, None] != b[:, : t - 1]
        diag, down = cost[:, :-1] + np.where(other, 1, -1), cost[:, 1:] + 2
        line = np.concatenate([np.zeros((n, 1), "int32"), np.minimum(diag, down)], axis=1)
        line = np.minimum.accumulate(line - ramp, axis=1) + ramp
        right = line[:, :-1] + 2
        pair = diag <= np.minimum(down, right)
        own = np.where(pair, edit[:, :-1] + other, edit[:, 1:] + 1)
        start = np.full(n, i)
        edit = np.concatenate([start[:, None], _chain(~pair & (down >= right), own, start, 1)], axis=1)
        cost = line
        costs[:, i], edits[:, i] = cost[:, t - 1], edit[:, t - 1]
    found[who] = _ends(costs, edits, cost, edit, a, b)
    return found


def _ends(costs: np.ndarray, edits: np.ndarray, cost: np.ndarray, edit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits in the far corner of tables of t letters: of their last inner column (``costs``, ``edits``) and row (``cost``, ``edit``), t entries each."""
    n, t = a.shape
    ends = []
    # last column: going down is free; last row: going right is free and no edit
    for inner, count, other, free in ((costs, edits, a != b[:, t - 1 :], 1), (cost, edit, a[:, t - 1 :] != b, 0)):
        diag = inner[:, : t - 1] + np.where(other[:, : t - 1], 1, -1)
        across = inner[:, 1:t] + 2
        line = np.minimum.accumulate(np.concatenate([np.zeros((n, 1), diag.dtype), np.minimum(diag, across)], axis=1), axis=1)
        along = line[:, :-1]
        pair = diag <= np.minimum(across, along)
        moved = ~pair & ((along < across) if free else (along <= across))
        own = np.where(pair, count[:, : t - 1] + other[:, : t - 1], count[:, 1:t] + 1)
        begun = np.full(n, t)
        ends.append((line[:, -1], np.concatenate([begun[:, None], _chain(moved, own, begun, free)], axis=1)[:, -1]))
    other = a[:, t - 1] != b[:, t - 1]
    diag = cost[:, t - 1] + np.where(other, 1, -1)
    (down, below), (right, beside) = ends
    return np.where(diag <= np.minimum(down, right), edit[:, t - 1] + other, np.where(down < right, below + 1, beside))


def _chain(moved: np.ndarray, own: np.ndarray, start: np.ndarray, step: int) -> np.ndarray:
    """Counts along a row: ``own`` where a cell does not come from the cell before it, else that cell's count and ``step``; ``start`` precedes the row."""
    at = np.maximum.accumulate(np.where(moved, 0, np.arange(1, moved.shape[1] + 1)), axis=1)
    every = np.concatenate([start[:, None], own], axis=1)
    return np.take_along_axis(every, at, axis=1) + step * (np.arange(1, moved.shape[1] + 1) - at)


def _prefix_edits(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Number of edits in ``delta(a[:t], b[:t])`` of many pairs: yields (t, pairs, edits) from ``first`` on, for a pair while t <= last and edits are few.

    Cells inside a table are the same for all t; only a table's last row and column, where gaps are free, are its own.
    """
    n, w = a.shape
    cost, edit = np.zeros((n, w + 1, w + 1), "int16"), np.zeros((n, w + 1, w + 1), "int16")
    edit[:, 0, :] = edit[:, :, 0] = np.arange(w + 1)
    ramp = 2 * np.arange(w + 1, dtype="int16")
    for i in range(1, w + 1):
        other = a[:, i - 1, None] != b
        diag = cost[:, i - 1, :-1] + np.where(other, 1, -1).astype("int16")
        down = cost[:, i - 1, 1:] + np.int16(2)
        cost[:, i, 1:] = np.minimum(diag, down)
        cost[:, i] = np.minimum.accumulate(cost[:, i] - ramp, axis=1) + ramp
        right = cost[:, i, :-1] + np.int16(2)
        pair = diag <= np.minimum(down, right)
        own = np.where(pair, edit[:, i - 1, :-1] + other, edit[:, i - 1, 1:] + 1)
        edit[:, i, 1:] = _chain(~pair & (down >= right), own, edit[:, i, 0], 1)
    alive = np.ones(n, bool)
    for t in range(int(first.min()), int(last.max()) + 1):
        who = np.flatnonzero(alive & (first <= t) & (t <= last))
        if not len(who):
            continue
        c, e, x, y = cost[who, :t, :t], edit[who, :t, :t], a[who, :t], b[who, :t]
        found = _ends(c[:, :, t - 1], e[:, :, t - 1], c[:, t - 1], e[:, t - 1], x, y)
        found = np.where((x == y).all(axis=1), 0, found)
        few = found <= t // UNIT
        alive[who[~few]] = False
        yield t, who[few], found[few]


def extend_udf(longest: int):
    schema = T.StructType().add("length", T.IntegerType()).add("edits", T.IntegerType())

    @F.pandas_udf(schema)
    def run(target: pd.Series, source: pd.Series) -> pd.DataFrame:
        length, edits = extend_many(target.tolist(), source.tolist(), longest)
        return pd.DataFrame({"length": length, "edits": edits})

    return run


def edits_udf(t: int):
    @F.pandas_udf(T.LongType())
    def run(target: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series(edits_at(target.tolist(), source.tolist(), t))

    return run


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 (public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_ids(letters: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the ``length`` letters from each place on, or of those up to the end."""
    n = len(letters)
    part = _mix(np.concatenate([letters.astype("u8"), np.zeros(length, "u8")]) + np.uint64(0x9E3779B97F4A7C15))
    ids, taken, width = np.zeros(n, "u8"), 0, 1
    while width <= length:
        if length & width:
            ids = _mix(ids * np.uint64(0xD1342543DE82EF95) + part[taken : taken + n])
            taken += width
        width *= 2
        if width <= length:
            part = _mix(part[: len(part) - width // 2] * np.uint64(0x9FB21C651E98DF25) + part[width // 2 :])
    return ids


STRETCHES = "ref string, node long, text string, firsts array<int>, lasts array<int>, ahead array<long>, behind array<long>"


def stretches(chunks: DataFrame, size: int, longest: int) -> DataFrame:
    """The genome in rows of about ``BASES`` bases ``(ref, node, text, firsts, lasts, ahead, behind)``.

    ``text`` has what lies within ``longest`` bases on either side as well. Of the node's chunks in turn, ``firsts`` tells where
    in it they begin (their last copy: ``lasts``), null for a missing one. ``ahead`` has, for each base, a hash of the ``longest`` bases from there on,
    ``behind`` one of the ``longest`` - 16 bases in front.
    """
    per = max(BASES // size, 1)
    reach = 1 + -(-(longest - 1) // size)
    div = lambda c: F.call_function("div", c, F.lit(per))
    node = F.explode(F.sequence(div(F.greatest(F.col("chunk") - reach, F.lit(0))), div(F.col("chunk") + reach))).alias("node")
    rows = (
        chunks.where("chunk >= 0").select("ref", node, "chunk", "s").groupBy("ref", "node")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "s"))).alias("_p"))
        .select("ref", "node", F.array_join("_p.s", "").alias("text"), F.col("_p.chunk").alias("chunks"), F.transform("_p.s", F.length).alias("lengths"))
    )

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for ref, node, text, numbers, lengths in zip(pdf["ref"], pdf["node"], pdf["text"], pdf["chunks"], pdf["lengths"]):
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype("int64")
                own = np.arange(node * per, (node + 1) * per)
                first, last = np.searchsorted(numbers, own, "left"), np.searchsorted(numbers, own, "right") - 1
                known = last >= first
                if not known.any():
                    continue
                firsts, lasts = starts[first[known]], starts[last[known]]
                letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
                every = [np.append(text_ids(letters, longest), 0), np.append(text_ids(letters[::-1], max(longest - UNIT, 0))[::-1], 0)]
                # behind a place is what its predecessor reads backwards
                every[1] = np.concatenate([[0], every[1][:-1]]).astype("u8")
                rows = [np.zeros((per, size), "i8"), np.zeros((per, size), "i8")]
                for ids, at, to in zip(every, (firsts, lasts), rows):
                    to[known] = ids[np.minimum(at[:, None] + np.arange(size), len(letters))].view("i8")
                places = [[None] * per, [None] * per]
                for at, to in zip((firsts, lasts), places):
                    for c, x in zip(np.flatnonzero(known).tolist(), at.tolist()):
                        to[c] = x
                out.append((ref, node, text, *places, *(r.ravel() for r in rows)))
            yield pd.DataFrame(out, columns=["ref", "node", "text", "firsts", "lasts", "ahead", "behind"])

    return rows.mapInPandas(run, STRETCHES)


def best_references(chunks: DataFrame, size: int, order: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Best earlier match of the 16 bases at each position.

    ``order(ref, offset)`` places chromosomes in the concatenated genome.
    ``(ref, pos, at, reverse, length, edits)`` with 0-based ``pos`` in the
    chromosome and 0-based ``at`` in the genome. Earlier places that read the
    same for ``longest`` bases are alike, so only the first of them is a
    candidate: copies of a stretch do not multiply into pairs. Places carry
    ``FINE`` bases and are told apart by hashes of the others; only pairs that
    match beyond (:func:`_longer`) are given longer texts.
    """
    from helicase.sources.genome import with_overhang

    near = min(longest, FINE)
    ahead = with_overhang(chunks, size, near)
    back = with_overhang(
        chunks.select("ref", (-F.col("chunk") + (1 << 40)).alias("chunk"), F.reverse("s").alias("s")), size, near
    ).select("ref", (-F.col("chunk") + (1 << 40)).alias("chunk"), F.col("ext").alias("past"))
    at = ahead.join(back, ["ref", "chunk"]).join(order.select("ref", "offset"), "ref")
    i = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_i")
    rest = [F.lit(0).cast("long").alias(c) for c in ("_ahead", "_behind")]
    if longest > FINE:
        table = materialise(stretches(chunks, size, longest), "stretches")
        per = max(BASES // size, 1)
        ids = table.select("ref", "node", "ahead", "behind", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("_c"))
        cut = lambda c: F.slice(c, F.col("_c") * size + 1, F.lit(size)).alias(f"_{c}s")
        ids = ids.select("ref", (F.col("node") * per + F.col("_c")).alias("chunk"), cut("ahead"), cut("behind"))
        at = expanded(at).join(ids, ["ref", "chunk"]).select("ref", "chunk", "offset", "s", "ext", "past", "_aheads", "_behinds", i)
        rest = [F.get("_aheads", F.col("_i")).alias("_ahead"), F.get("_behinds", F.col("_i")).alias("_behind")]
    else:
        at = at.select("ref", "chunk", "offset", "s", "ext", "past", i)
    pos = F.col("chunk") * size + F.col("_i")
    here = F.substring(F.col("ext"), F.col("_i") + 1, F.lit(near))
    unit = F.substring(F.col("ext"), F.col("_i") + 1, F.lit(UNIT))
    # The reverse text of a place runs backwards from the end of its unit: the
    # unit's own bases, then what lies before it in the chunk and its predecessors.
    before = F.concat(F.reverse(F.left("s", F.col("_i"))), F.substring(F.col("past"), F.length("s") + 1, F.lit(near)))
    turned = F.translate(F.left(F.concat(F.reverse(unit), before), F.lit(near)), dna.BASES, dna.COMPLEMENT)
    places = at.where(F.length(unit) == UNIT).select(
        "ref", pos.alias("pos"), (pos + F.col("offset")).alias("at"), unit.alias("kmer"), here.alias("here"), turned.alias("turned"), *rest
    )
    other = dna.revcomp("kmer")
    side = lambda k, r, t, more: F.struct(k.alias("kmer"), F.lit(r).alias("reverse"), t.alias("text"), F.col(more).alias("more"))
    both = F.when(
        other != F.col("kmer"), F.array(side(F.col("kmer"), False, F.col("here"), "_ahead"), side(other, True, F.col("turned"), "_behind"))
    ).otherwise(F.array(side(F.col("kmer"), False, F.col("here"), "_ahead")))
    place = F.struct("at", F.col("ref").alias("_sref"), F.col("pos").alias("_spos")) if longest > FINE else F.struct("at")
    sources = (
        places.select(place.alias("_place"), F.inline(both)).groupBy("kmer", "reverse", "text", "more").agg(F.min("_place").alias("_place"))
        .select("kmer", "reverse", "text", "_place.*")
    )
    targets = places.select("ref", "pos", F.col("at").alias("_own"), "kmer", "here")
    found = (
        expanded(targets).join(sources, "kmer")
        .where(F.col("at") < F.col("_own"))
        .withColumn("_e", extend_udf(near)("here", "text"))
        .select("*", "_e.*").drop("_e", "here", "text", "kmer", "_own")
    )
    if longest > FINE:
        found = materialise(found, "references")
        pair = ["ref", "pos", "at", "reverse"]
        longer = _longer(found, table, size, longest).groupBy(*pair).agg(F.max(F.struct("length", "edits")).alias("_more"))
        best = lambda c: F.coalesce(f"_more.{c}", c).alias(c)
        found = expanded(found).join(longer, pair, "left").select(*pair, best("length"), best("edits"))
    return (
        found.groupBy("ref", "pos")
        .agg(F.min(F.struct((-F.col("length")).alias("l"), "edits", "at", "reverse")).alias("b"))
        .select("ref", "pos", "b.at", "b.reverse", (-F.col("b.l")).alias("length"), "b.edits")
    )


def _longer(found: DataFrame, table: DataFrame, size: int, longest: int) -> DataFrame:
    """The pairs of ``found`` that match for more than ``FINE`` bases, with a row for each doubled length.

    Each length fetches the texts of the pairs that are left from the stretches (``table``) of both places.
    """
    per = max(BASES // size, 1)
    out, rest, t = None, found.where(F.col("length") == FINE), 2 * FINE
    # Few bytes are much work here: tasks are not put together by their bytes.
    spark = found.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def joined(pairs, ref, pos, text, where):
        chunk = F.call_function("div", F.col(pos), F.lit(size))
        pairs = pairs.withColumn("_ref", F.col(ref)).withColumn("node", F.call_function("div", chunk, F.lit(per)))
        texts = table.select(F.col("ref").alias("_ref"), "node", F.col("text").alias("_text"), "firsts", "lasts")
        own, i = (chunk - F.col("node") * per).cast("int"), (F.col(pos) % size).cast("int")
        j = expanded(pairs.repartition(tasks, "_ref", "node")).join(texts, ["_ref", "node"]).withColumn("_a", F.get("firsts", own) + i).withColumn("_b", F.get("lasts", own) + i)
        return j.withColumn(text, where).where(F.length(text) == t).drop("_ref", "node", "_text", "firsts", "lasts", "_a", "_b")

    while out is None or t <= longest and not rest.isEmpty():
        ahead = F.substring(F.col("_text"), F.col("_a") + 1, F.lit(t))
        past = F.least(F.col("_b"), F.lit(t - UNIT))
        behind = F.concat(F.substring(F.col("_text"), F.col("_b") - past + 1, past), F.substring(F.col("_text"), F.col("_a") + 1, F.lit(UNIT)))
        turned = F.translate(F.reverse(behind), dna.BASES, dna.COMPLEMENT)
        pairs = joined(rest.drop("length", "edits"), "ref", "pos", "_t", ahead)
        pairs = joined(pairs, "_sref", "_spos", "_s", F.when(F.col("reverse"), turned).otherwise(ahead))
        pairs = pairs.select(*[c for c in found.columns if c not in ("length", "edits")], F.lit(t).alias("length"), edits_udf(t)("_t", "_s").cast("int").alias("edits"))
        rest = materialise(pairs.where((F.col("edits") <= t // UNIT) & F.lit(t <= longest)), "references")
        out = out.unionByName(rest) if out else rest
        t = next_length(t)
    return out


def reference_cost(skipped, edits):
    """Bytes for ``skipped`` plain bases followed by a reference."""
    return F.call_function("div", skipped, F.lit(4)) + OVERHEAD + edits


def jumps(best: DataFrame) -> DataFrame:
    """Where the greedy walk goes from a position, for positions that use a reference.

    A position looks at the six units of its next 96 bases and takes the one
    that saves most; all positions without a row emit 96 plain bases.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(UNITS - 1))).alias("_j")
    o = best.select("ref", "pos", "at", "reverse", "length", "edits", k).where(F.col("pos") >= F.col("_j") * UNIT)
    gain = F.call_function("div", F.col("length"), F.lit(4)) - OVERHEAD - F.col("edits")
    pick = (
        o.groupBy("ref", (F.col("pos") - F.col("_j") * UNIT).alias("pos"))
        .agg(F.max(F.struct(gain.alias("gain"), (-F.col("_j")).alias("j"), "at", "reverse", "length", "edits")).alias("b"))
        .select("ref", "pos", (-F.col("b.j") * UNIT).alias("skipped"), "b.at", "b.reverse", "b.length", "b.edits")
        .withColumn("cost", reference_cost(F.col("skipped"), F.col("edits")).cast("int"))
        .withColumn("step", F.col("skipped") + F.col("length"))
    )
    return pick.where(F.col("step") >= F.col("cost") * 4)


def _block_function(pdf: pd.DataFrame, block: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Exit (relative to the block's end) and cost for every entry below ``reach``."""
    step = np.full(block, STRETCH, "int64")
    cost = np.full(block, STRETCH // 4, "int64")
    known = pdf[pdf["step"].notna()]
    i = known["pos"].to_numpy("int64") % block
    step[i], cost[i] = known["step"].to_numpy("int64"), known["cost"].to_numpy("int64")
    leave, spent = np.zeros(block, "int64"), np.zeros(block, "int64")
    for p in range(block - 1, -1, -1):
        n = p + step[p]
        leave[p], spent[p] = (n - block, cost[p]) if n >= block else (leave[n], spent[n] + cost[p])
    return leave[:reach], spent[:reach]


LEVEL = "ref string, node long, exits array<long>, costs array<long>"


def encode(chunks: DataFrame, size: int, order: DataFrame, longest: int = LONGEST, block: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """The greedy encoding: ``(steps, totals)``.

    ``steps(ref, pos, skipped, at, reverse, length, edits, cost, step)`` lists what
    is emitted (``at`` is null for plain bases); ``totals(ref, bases, emitted,
    percent)`` sums it up. Blocks of positions become jump functions, 64 of which
    compose into one function of the next level until one is left per
    chromosome; entries are then handed back down, and each block walks its own
    part.
    """
    reach = STRETCH - UNIT + max(longest, UNIT)
    if block < reach:
        raise ValueError("a block must be longer than one step")
    jump = materialise(jumps(best_references(chunks, size, order, longest)), "jumps")
    from helicase.sources.genome import chromosomes

    sizes = materialise(chromosomes(chunks), "sizes")
    n_blocks = F.call_function("div", F.col("len") - 1, F.lit(block))
    frame = sizes.select("ref", "len", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks)).alias("node"))
    full = frame.join(jump.withColumn("node", F.call_function("div", F.col("pos"), F.lit(block))), ["ref", "node"], "left")

    def functions(pdf: pd.DataFrame) -> pd.DataFrame:
        leave, spent = _block_function(pdf, block, reach)
        return pd.DataFrame({"ref": [pdf["ref"].iloc[0]], "node": [pdf["node"].iloc[0]], "exits": [leave], "costs": [spent]})

    # The last block of a chromosome is walked separately: it ends early.
    levels = [materialise(full.groupBy("ref", "node").applyInPandas(functions, LEVEL), "level")]
    top = sizes.agg(F.max(n_blocks)).first()[0]
    while top > 0:
        levels.append(materialise(_compose(levels[-1]), "level"))
        top //= FAN
    entries = sizes.select("ref", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("entry"))
    for lower in reversed(levels[:-1]):
        entries = materialise(_hand_down(entries, lower), "entries")
    walk = full.join(entries, ["ref", "node"])
    steps = materialise(_walk(walk, block), "steps")
    totals = (
        steps.groupBy("ref")
        .agg(F.sum("cost").alias("emitted"), F.max(F.col("pos") + F.col("step")).alias("bases"))
        .withColumn("percent", F.col("emitted") * 100.0 / F.greatest(F.call_function("div", F.col("bases"), F.lit(4)), F.lit(1)))
    )
    return steps, totals


def _compose(level: DataFrame) -> DataFrame:
    """Jump functions of 64 neighbouring nodes, one after the other."""

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        pos = spent = None
        for exits, costs in zip(pdf["exits"], pdf["costs"]):
            exits, costs = np.asarray(exits, "int64"), np.asarray(costs, "int64")
            if pos is None:
                pos, spent = exits.copy(), costs.copy()
            else:
                spent, pos = spent + costs[pos], exits[pos]
        return pd.DataFrame({"ref": [pdf["ref"].iloc[0]], "node": [pdf["up"].iloc[0]], "exits": [pos], "costs": [spent]})

    up = F.call_function("div", F.col("node"), F.lit(FAN))
    return level.withColumn("up", up).groupBy("ref", "up").applyInPandas(compose, LEVEL)


def _hand_down(entries: DataFrame, lower: DataFrame) -> DataFrame:
    """Entry of every child node from the entry of its parent."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("child")
        at, out = int(pdf["entry"].iloc[0]), []
        for exits in pdf["exits"]:
            out.append(at)
            at = int(exits[at])
        return pd.DataFrame({"ref": pdf["ref"], "node": pdf["child"], "entry": out})

    child = lower.select("ref", F.col("node").alias("child"), F.call_function("div", F.col("node"), F.lit(FAN)).alias("node"), "exits")
    return child.join(entries, ["ref", "node"]).groupBy("ref", "node").applyInPandas(split, "ref string, node long, entry long")


STEPS = "ref string, pos long, skipped int, at long, reverse boolean, length int, edits int, cost long, step long"


def _walk(blocks: DataFrame, block: int) -> DataFrame:
    """The steps of every block from its entry on."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["node"].iloc[0]) * block
        end = min(base + block, int(pdf["len"].iloc[0]))
        known = {int(r.pos): r for r in pdf[pdf["step"].notna()].itertuples()}
        at, rows = base + int(pdf["entry"].iloc[0]), []
        while at < end:
            r = known.get(at)
            if r is None:
                rows.append((at, None, None, None, None, None, STRETCH // 4, STRETCH))
            else:
                rows.append((at, int(r.skipped), int(r.at), bool(r.reverse), int(r.length), int(r.edits), int(r.cost), int(r.step)))
            at += rows[-1][-1]
        out = pd.DataFrame(rows, columns=["pos", "skipped", "at", "reverse", "length", "edits", "cost", "step"], dtype=object)
        out.insert(0, "ref", pdf["ref"].iloc[0])
        return out

    return blocks.groupBy("ref", "node").applyInPandas(walk, STEPS)
