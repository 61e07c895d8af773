"""Arrow-batched helpers that count letters of many reads at once.

Texts are laid end to end as code points, so a batch is a few array operations
and no base is ever a row.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters of reads that are counted together.
LETTERS = 1 << 21
OWN_WEIGHT = 40


def letters(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code points, start, length)`` of texts laid end to end; null counts as empty."""
    texts = [t or "" for t in texts.to_pylist()]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.cumsum(size) - size, size


def spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each letter of rows with so many letters."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def pieces(batch, column: str):
    """The batch in slices whose texts have about ``LETTERS`` letters together."""
    ends = np.cumsum([len(t or "") for t in batch.column(column).to_pylist()])
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, done + LETTERS, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def mismatch_points(nucs: Column, qual: Column, ref: Column, qlimit: int, low: int) -> Column:
    """Sum over differing bases of 2 where quality exceeds ``qlimit``, else of ``low``."""

    @F.arrow_udf("int")
    def points(nucs: pa.Array, qual: pa.Array, ref: pa.Array) -> pa.Array:
        a, a0, an = letters(nucs)
        q, q0, qn = letters(qual)
        b, b0, bn = letters(ref)
        n = np.minimum(an, bn)
        row, i = spread(n)
        differ = a[a0[row] + i] != b[b0[row] + i]
        row, i = row[differ], i[differ]
        sure = np.zeros(len(row), bool)
        known = i < qn[row]
        sure[known] = q[q0[row[known]] + i[known]].astype(np.int64) - 33 > qlimit
        total = np.bincount(row, np.where(sure, 2, low), len(n)).astype(np.int32)
        missing = nucs.is_null().to_numpy(False) | qual.is_null().to_numpy(False) | ref.is_null().to_numpy(False)
        return pa.array(total, pa.int32(), mask=missing)

    return points(nucs, qual, ref)


def clear_indel(read: Column, ref: Column, where: Column, least: int) -> Column:
    """``(indel, amount)`` of :func:`helicase.functions.dna.with_indel`, which ``least`` letters have to follow."""

    @F.arrow_udf("indel int, amount int")
    def found(read: pa.Array, ref: pa.Array, where: pa.Array) -> pa.Array:
        indel, amount = np.zeros(len(read), np.int32), np.zeros(len(read), np.int32)
        tried = np.flatnonzero(where.fill_null(False).to_numpy(False) & ~read.is_null().to_numpy(False) & ~ref.is_null().to_numpy(False))
        x, x0, xn = letters(read.take(pa.array(tried)))
        y, y0, yn = letters(ref.take(pa.array(tried)))

        def differing(rows, a, b, n):
            """Differing letters per row of ``n`` letters from ``a`` of the read and ``b`` of the reference on."""
            row, i = spread(n)
            bad = x[(x0[rows] + a)[row] + i] != y[(y0[rows] + b)[row] + i]
            return row, i, bad

        every = np.arange(len(tried))
        prefix = np.minimum(xn, yn)
        row, i, bad = differing(every, 0, 0, prefix)
        np.minimum.at(prefix, row[bad], i[bad])
        rows = np.flatnonzero(prefix >= least)
        step = 1
        while len(rows := rows[xn[rows] // 10 >= step]):
            for ahead, behind, sign in ((step, 0, 1), (0, step, -1)):
                p = prefix[rows]
                n = np.minimum(xn[rows] - p - ahead, yn[rows] - p - behind)
                near = np.flatnonzero((n >= least) & (p + n > 10 * step))
                r, p, n = rows[near], p[near], n[near]
                # the letters right behind agree, and of all that follow one differs at most
                for many, allowed in ((lambda n: np.minimum(n, least), 0), (lambda n: n, 1)):
                    row, _, bad = differing(r, p + ahead, p + behind, many(n))
                    fits = np.bincount(row[bad], minlength=len(r)) <= allowed
                    r, p, n = r[fits], p[fits], n[fits]
                indel[tried[r]], amount[tried[r]] = sign * p, step
                rows = np.setdiff1d(rows, r)
            step += 1
        return pa.StructArray.from_arrays([pa.array(indel), pa.array(amount)], names=["indel", "amount"])

    return found(read, ref, where)


def depth_changes(qlimit: int, width: int):
    """For ``mapInArrow``: reads ``(ref, pos, nucs, qual, ref_bases)`` to summed changes of depth ``(ref, at, change)``.

    Depth goes up where matching bases of sufficient quality begin and down where they end; the first position of each
    bin of ``width`` positions that a read reaches counts from zero.
    """

    def run(batches):
        for batch in batches:
            for p in pieces(batch, "nucs"):
                names = p.column("ref").dictionary_encode()
                ref, pos = names.indices.to_numpy(False), p.column("pos").to_numpy(False)
                a, a0, an = letters(p.column("nucs"))
                q, q0, qn = letters(p.column("qual"))
                b, b0, bn = letters(p.column("ref_bases"))
                n = np.minimum(an, bn)
                kept = n > 0
                ref, pos, a0, q0, qn, b0, n = ref[kept], pos[kept], a0[kept], q0[kept], qn[kept], b0[kept], n[kept]
                # one place more than bases, where the last stretch ends
                row, i = spread(n + 1)
                good = np.zeros(len(row), bool)
                inner = np.flatnonzero((i < n[row]) & (i < qn[row]))
                r, j = row[inner], i[inner]
                good[inner] = (a[a0[r] + j] == b[b0[r] + j]) & (q[q0[r] + j].astype(np.int64) - 33 > qlimit)
                at = pos[row] + i
                opens = (at - 1) % width == 0
                before = np.zeros(len(row), bool)
                before[1:] = good[:-1]
                before[(i == 0) | opens] = False
                change = good.astype(np.int64) - before
                told = (change != 0) | opens
                # the bin in which a read starts is opened, too
                refs = np.concatenate([ref[row][told], ref])
                ats = np.concatenate([at[told], (pos - 1) // width * width + 1])
                changes = np.concatenate([change[told], np.zeros(len(pos), np.int64)])
                if not len(ats):
                    continue
                order = np.lexsort((ats, refs))
                refs, ats, changes = refs[order], ats[order], changes[order]
                first = np.flatnonzero(np.r_[True, (refs[1:] != refs[:-1]) | (ats[1:] != ats[:-1])])
                yield pa.RecordBatch.from_arrays(
                    [names.dictionary.take(pa.array(refs[first])), pa.array(ats[first], pa.int64()), pa.array(np.add.reduceat(changes, first), pa.int64())],
                    names=["ref", "at", "change"],
                )

    return run


def consensus(max_diff: int, order: str):
    """For ``mapInArrow``: texts and the reads found in them ``(text_id, n, nucs, qual)`` to ``(text_id, emit, next, depths)``.

    Rows come in order of ``(text_id, n)``; a text itself has ``n`` -1, a read the offset at which it begins. Reads with less
    than ``max_diff`` differing letters vote with their qualities. What a text holds meanwhile is its sums, however many reads it has.
    """
    code = np.full(256, -1, np.int64)
    code[[ord(c) for c in order]] = np.arange(len(order))
    width = len(order)

    def coded(flat):
        return np.where(flat < 256, code[np.minimum(flat, 255)], -1)

    def count(p, held):
        n = p.column("n").to_numpy(False).astype(np.int64)
        flat, start, size = letters(p.column("nucs"))
        qual, q0, qn = letters(p.column("qual"))
        own = n < 0
        slot = np.cumsum(own) - (held is None)
        ids, text, t0, tn = p.column("text_id").to_numpy(False)[own], flat, start[own], size[own]
        if held is not None:
            ids, text = np.r_[held[0], ids], np.concatenate([flat, held[1]])
            t0, tn = np.r_[len(flat), t0], np.r_[len(held[1]), tn]
        columns = tn * 3 // 2
        c0 = np.cumsum(columns) - columns
        # the texts' own letters
        r, i = spread(size[own])
        s = slot[own][r]
        base = coded(flat[start[own][r] + i])
        keys, weights = [((c0[s] + i) * width + base)[base >= 0]], [np.full(int((base >= 0).sum()), OWN_WEIGHT)]
        # reads
        reads = np.flatnonzero(~own)
        r, i = spread(size[reads])
        r = reads[r]
        s, c, x = slot[r], n[r] + i, flat[start[r] + i]
        laid = c < tn[s]
        differ = x[laid] != text[t0[s[laid]] + c[laid]]
        fits = np.bincount(r[laid][differ], minlength=len(n)) < max_diff
        base = coded(x)
        votes = fits[r] & (c < columns[s]) & (i < qn[r]) & (base >= 0)
        r, i, s, c, base = r[votes], i[votes], s[votes], c[votes], base[votes]
        keys.append((c0[s] + c) * width + base)
        weights.append(qual[q0[r] + i].astype(np.int64) - 33)
        sums = np.bincount(np.concatenate(keys), np.concatenate(weights), int(columns.sum()) * width).astype(float).reshape(-1, width)
        if held is not None:
            sums[: columns[0]] += held[2]
        return ids, text, t0, tn, columns, c0, sums

    def winners(ids, tn, columns, c0, sums):
        # the last of equal ones wins; without votes N
        best = width - 1 - np.argmax(sums[:, ::-1], axis=1)
        weight = sums[np.arange(len(sums)), best].astype(np.int64)
        whole = np.where(weight > 0, np.frombuffer(order.encode(), np.uint8)[best], ord("N")).astype(np.uint8).tobytes().decode()
        weight[weight < 0] = 0
        half = tn // 2
        r, i = spread(half)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([whole[c : c + h] for c, h in zip(c0, half)], pa.string()),
                pa.array([whole[c + h : c + min(h + t, k)] for c, h, t, k in zip(c0, half, tn, columns)], pa.string()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(half)], pa.int32()), pa.array(weight[c0[r] + i], pa.int64())),
            ],
            names=["text_id", "emit", "next", "depths"],
        )

    def run(batches):
        held = None
        for batch in batches:
            for p in pieces(batch, "nucs"):
                ids, text, t0, tn, columns, c0, sums = count(p, held)
                if len(ids) > 1:
                    yield winners(ids[:-1], tn[:-1], columns[:-1], c0[:-1], sums[: c0[-1]])
                held = ids[-1], text[t0[-1] : t0[-1] + tn[-1]].copy(), sums[c0[-1] :].copy()
        if held is not None:
            tn = np.array([len(held[1])])
            yield winners(np.array([held[0]]), tn, tn * 3 // 2, np.zeros(1, np.int64), held[2])

    return run
