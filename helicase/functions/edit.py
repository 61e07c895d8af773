"""Small alignment helpers applied batch-wise inside Spark tasks.

Dynamic programming over a pair of short strings has no built-in Spark
expression; mapping needs none of it.
"""

from __future__ import annotations

import sys
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Ship the helpers inside the tasks: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _struct(**fields) -> T.StructType:
    out = T.StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


_INT, _STR, _DBL = T.IntegerType(), T.StringType(), T.DoubleType()
SCRIPT = _struct(distance=_INT, script=_STR)
ALIGNED = _struct(score=_DBL, a_line=_STR, b_line=_STR)
NW = _struct(
    score=_DBL, a_line=_STR, b_line=_STR, marks=_STR,
    matches=_INT, mismatches=_INT, skews=_INT, inserts=_INT, deletes=_INT,
)
DELTA = T.ArrayType(_struct(pos=T.LongType(), base=_STR, action=_STR))


def edit_script(a: str, b: str) -> tuple[int, list[tuple[str, int, int]]]:
    """A shortest script that turns ``a`` into ``b``: distance and runs ``(op, offset, length)``.

    '=' and '-' offsets index ``a``; '+' offsets index ``b``. From a table of longest
    common subsequences of all suffixes; equal letters are kept, and ties drop
    letters of ``a`` first.
    """
    common = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            common[i, j] = common[i + 1, j + 1] + 1 if a[i] == b[j] else max(common[i + 1, j], common[i, j + 1])
    steps, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            steps.append(("=", i))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and common[i + 1, j] >= common[i, j + 1]:
            steps.append(("-", i))
            i += 1
        else:
            steps.append(("+", j))
            j += 1
    runs = [(op, own[0][1], len(own)) for op, own in ((op, list(g)) for op, g in groupby(steps, key=lambda x: x[0]))]
    return sum(n for op, _, n in runs if op != "="), runs


@F.pandas_udf(SCRIPT)
def edit_text(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Distance and a readable script such as ``=5 -2 =7 +1``."""
    rows = []
    for x, y in zip(a, b):
        d, runs = edit_script(x, y)
        rows.append((d, " ".join(f"{op}{length}" for op, _, length in runs)))
    return pd.DataFrame(rows, columns=SCRIPT.names)


def _cost_table(a: str, b: str, mismatch: float, gap: float, skew: float) -> np.ndarray:
    """Needleman-Wunsch costs; a match earns 1, gaps outside either string cost ``skew``.

    Rows are filled with one running minimum per row instead of a cell loop.
    """
    n, m = len(a), len(b)
    av, bv = np.frombuffer(a.encode("latin-1"), "u1"), np.frombuffer(b.encode("latin-1"), "u1")
    cost = np.zeros((n + 1, m + 1))
    cost[0] = skew * np.arange(m + 1)
    cost[:, 0] = skew * np.arange(n + 1)
    if not m:
        return cost
    down = np.full(m, gap)
    down[-1] = skew
    for i in range(1, n + 1):
        step = skew if i == n else gap
        best = np.minimum(cost[i - 1, 1:] + down, cost[i - 1, :-1] + np.where(bv == av[i - 1], -1.0, mismatch))
        ramp = step * np.arange(m + 1)
        cost[i] = np.minimum.accumulate(np.concatenate(([cost[i, 0]], best)) - ramp) + ramp
    return cost


def _moves(a: str, b: str, mismatch: float, gap: float, skew: float):
    """Trace-back from the far corner: yields (move, i, j, at_edge).

    Diagonal moves win ties, then gaps in ``a``'s favour only when cheaper.
    """
    cost = _cost_table(a, b, mismatch, gap, skew)
    n, m = len(a), len(b)
    i, j = n, m
    while i or j:
        diag = down = right = float("inf")
        if i:
            down = cost[i - 1, j] + (skew if j == m else gap)
        if j:
            right = cost[i, j - 1] + (skew if i == n else gap)
        if i and j:
            diag = cost[i - 1, j - 1] + (-1.0 if a[i - 1] == b[j - 1] else mismatch)
        if diag <= min(down, right):
            yield "pair", i, j, False
            i, j = i - 1, j - 1
        elif down < right:
            yield "a_only", i, j, j == m
            i -= 1
        else:
            yield "b_only", i, j, i == n
            j -= 1


def nw_align(a: str, b: str, mismatch=1.0, gap=2.0, skew=0.0):
    """``(score, a_line, b_line, marks, matches, mismatches, skews, inserts, deletes)``."""
    top, bottom, marks = [], [], []
    n = dict(match=0, mismatch=0, skew=0, insert=0, delete=0)
    for move, i, j, edge in _moves(a, b, mismatch, gap, skew):
        if move == "pair":
            same = a[i - 1] == b[j - 1]
            n["match" if same else "mismatch"] += 1
            top.append(a[i - 1]), bottom.append(b[j - 1]), marks.append("=" if same else "!")
            continue
        n["skew" if edge else ("delete" if move == "a_only" else "insert")] += 1
        top.append(a[i - 1] if move == "a_only" else " ")
        bottom.append(b[j - 1] if move == "b_only" else " ")
        marks.append(" ")
    score = float(_cost_table(a, b, mismatch, gap, skew)[len(a), len(b)])
    flip = lambda x: "".join(reversed(x))
    return (score, flip(top), flip(bottom), flip(marks), n["match"], n["mismatch"], n["skew"], n["insert"], n["delete"])


def nw_udf(mismatch: float = 1.0, gap: float = 2.0, skew: float = 0.0):
    """Global alignment of two string columns as one struct column."""

    @F.pandas_udf(NW)
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [nw_align(x, y, mismatch, gap, skew) for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=NW.names)

    return align


def delta(a: str, b: str, mismatch=1.0, gap=2.0, skew=0.0) -> list[tuple[int, str, str]]:
    """Edits ``(pos, base, action)`` that turn ``a`` into ``b``, last one first.

    Free trailing bases of ``b`` are not part of the delta; free trailing bases
    of ``a`` are deletions.
    """
    out = []
    for move, i, j, edge in _moves(a, b, mismatch, gap, skew):
        if move == "pair":
            if a[i - 1] != b[j - 1]:
                out.append((i - 1, b[j - 1], "Replace"))
        elif move == "a_only":
            out.append((i - 1, "", "Delete"))
        elif not edge:
            out.append((i - 1, b[j - 1], "Insert"))
    return out


@F.pandas_udf(DELTA)
def delta_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Batch form of :func:`delta`."""
    return pd.Series(
        [[dict(pos=p, base=c, action=w) for p, c, w in delta(x, y)] for x, y in zip(a, b)]
    )


def apply_delta(a: str, edits: list[tuple[int, str, str]]) -> str:
    """The target sequence; edits come last position first, so offsets stay valid."""
    s = list(a)
    for pos, base, action in edits:
        if action == "Replace":
            s[pos] = base
        elif action == "Delete":
            del s[pos]
        else:
            s.insert(pos + 1, base)
    return "".join(s)


def global_align(a: str, b: str, match=1, mismatch=-1, gap_open=0, gap_extend=-2):
    """Best-scoring global alignment with affine gaps: ``(score, a_line, b_line)``.

    A gap of length g costs ``gap_open + g * gap_extend``; ``gap_open=0`` gives
    linear gaps. Three-state recurrence of Gotoh (1982).
    """
    n, m = len(a), len(b)
    low = float("-inf")
    shape = (n + 1, m + 1)
    pair, in_a, in_b = np.full(shape, low), np.full(shape, low), np.full(shape, low)
    pair[0, 0] = 0
    in_b[1:, 0] = gap_open + gap_extend * np.arange(1, n + 1)
    in_a[0, 1:] = gap_open + gap_extend * np.arange(1, m + 1)
    av, bv = np.frombuffer(a.encode("latin-1"), "u1"), np.frombuffer(b.encode("latin-1"), "u1")
    ramp = gap_extend * np.arange(m + 1)
    for i in range(1, n + 1):
        best_up = np.maximum(np.maximum(pair[i - 1], in_a[i - 1]), in_b[i - 1])
        if m:
            pair[i, 1:] = best_up[:-1] + np.where(bv == av[i - 1], match, mismatch)
        in_b[i] = np.maximum(np.maximum(pair[i - 1], in_a[i - 1]) + gap_open, in_b[i - 1]) + gap_extend
        if m:
            start = np.maximum(pair[i], in_b[i]) + gap_open - ramp
            in_a[i, 1:] = np.maximum.accumulate(start)[:-1] + ramp[1:]
    i, j = n, m
    tables = {"p": pair, "a": in_a, "b": in_b}
    state = max("pba", key=lambda s: tables[s][n, m])
    score = tables[state][n, m]
    top, bottom = [], []
    while i or j:
        if state == "p":
            top.append(a[i - 1]), bottom.append(b[j - 1])
            i, j = i - 1, j - 1
            opened = {"p": 0, "a": 0, "b": 0}
        elif state == "b":
            top.append(a[i - 1]), bottom.append("-")
            i -= 1
            opened = {"p": gap_open, "a": gap_open, "b": 0}
        else:
            top.append("-"), bottom.append(b[j - 1])
            j -= 1
            opened = {"p": gap_open, "b": gap_open, "a": 0}
        state = max("pba", key=lambda s: tables[s][i, j] + opened[s])
    return float(score), "".join(reversed(top)), "".join(reversed(bottom))


def global_align_udf(match=1, mismatch=-1, gap_open=0, gap_extend=-2):
    """Batch form of :func:`global_align` as a struct column."""

    @F.pandas_udf(ALIGNED)
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [global_align(x, y, match, mismatch, gap_open, gap_extend) for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=ALIGNED.names)

    return align
