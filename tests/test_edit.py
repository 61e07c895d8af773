"""Alignment helpers against brute force."""

import random
from functools import lru_cache

from hypothesis import given, settings, strategies as st

from helicase.functions import edit

SEQ = st.text("ACG", max_size=10)


def indel_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] if x == y else 10**6))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(SEQ, SEQ)
def test_edit_script_is_shortest_and_correct(a, b):
    d, runs = edit.edit_script(a, b)
    out, i, j, cost = "", 0, 0, 0
    for op, off, n in runs:
        if op == "=":
            assert off == i
            out, i, j = out + a[i : i + n], i + n, j + n
        elif op == "-":
            assert off == i
            i, cost = i + n, cost + n
        else:
            assert off == j
            out, j, cost = out + b[off : off + n], j + n, cost + n
    assert (out, i) == (b, len(a))
    assert d == cost == indel_distance(a, b)
    assert all(x[0] != y[0] for x, y in zip(runs, runs[1:]))


def nw_brute(a, b, mis=1.0, gap=2.0, skew=0.0):
    @lru_cache(None)
    def cost(i, j):
        if not i or not j:
            return skew * (i + j)
        return min(
            cost(i - 1, j) + (skew if j == len(b) else gap),
            cost(i, j - 1) + (skew if i == len(a) else gap),
            cost(i - 1, j - 1) + (-1 if a[i - 1] == b[j - 1] else mis),
        )

    return cost(len(a), len(b))


@settings(max_examples=200, deadline=None)
@given(SEQ, SEQ)
def test_nw_score_and_lines(a, b):
    r = edit.nw_align(a, b)
    assert r[0] == nw_brute(a, b)
    assert r[1].replace(" ", "") == a and r[2].replace(" ", "") == b
    assert len(r[3]) == sum(r[4:])


@settings(max_examples=200, deadline=None)
@given(SEQ, SEQ)
def test_nw_with_skew_penalty(a, b):
    assert edit.nw_align(a, b, 1.0, 2.0, 0.5)[0] == nw_brute(a, b, 1.0, 2.0, 0.5)


def gotoh_brute(a, b, match, mis, go, ge):
    @lru_cache(None)
    def best(i, j, last):
        if not i and not j:
            return 0
        out = float("-inf")
        if i and j:
            out = max(out, best(i - 1, j - 1, "p") + (match if a[i - 1] == b[j - 1] else mis))
        return max(out, gap(i, j, last))

    @lru_cache(None)
    def gap(i, j, last):
        out = float("-inf")
        for n in range(1, i + 1):
            out = max(out, core(i - n, j, "b") + go + ge * n)
        for n in range(1, j + 1):
            out = max(out, core(i, j - n, "a") + go + ge * n)
        return out

    @lru_cache(None)
    def core(i, j, last):
        return best(i, j, last)

    return best(len(a), len(b), "")


@settings(max_examples=80, deadline=None)
@given(st.text("ACG", max_size=6), st.text("ACG", max_size=6), st.sampled_from([(1, -1, 0, -2), (2, -1, -3, -1)]))
def test_affine_score(a, b, p):
    score, top, bottom = edit.global_align(a, b, *p)
    assert score == gotoh_brute(a, b, *p)
    assert top.replace("-", "") == a and bottom.replace("-", "") == b and len(top) == len(bottom)
    match, mis, go, ge = p
    total, open_gap = 0, None
    for x, y in zip(top, bottom):
        if "-" in (x, y):
            side = x == "-"
            total += ge + (go if open_gap != side else 0)
            open_gap = side
        else:
            total, open_gap = total + (match if x == y else mis), None
    assert total == score


def test_delta_known_values():
    d = edit.delta
    assert d("ACGTTGCA", "ACGTTTCA") == [(5, "T", "Replace")]
    assert d("ACGTTGCA", "") == [(i, "", "Delete") for i in range(7, -1, -1)]
    assert d("AGCCTTTCCGGA", "AGCCTTTCCCGGA") == [(6, "C", "Insert")]
    assert d("AGCCTTTCCGGA", "AGCCTTTCCCGGGA") == [(8, "G", "Insert"), (6, "C", "Insert")]
    assert edit.apply_delta("AGCCTTTCCGGA", d("AGCCTTTCCGGA", "AGCCTTTCCCGGGA")) == "AGCCTTTCCCGGGA"


def test_nw_known_scores():
    pairs = [("ACGTTGCA", "ACGTTTCA"), ("ACGTTGCA", ""), ("AGCCTTTCCGGA", "AGCCTTTCCCGGA"), ("AGCCTTTCCGGA", "AGCCTTTCCCGGGA")]
    assert [edit.nw_align(*p)[0] for p in pairs] == [-6, 0, -10, -8]


REF = "ACGTACGGATCCTTAGCATGCAATCGGATTACAGGCATCGATTTGCAGCATCGGACTACGATCGCCGATATTCGA"


def clear_indel(read, ref):
    """The rule of dna.with_indel, spelt out."""
    p = 0
    while p < min(len(read), len(ref)) and read[p] == ref[p]:
        p += 1
    for amount in range(1, len(read) // 10 + 1):
        for sign, x, y in ((1, read[p + amount :], ref[p:]), (-1, read[p:], ref[p + amount :])):
            n = min(len(x), len(y))
            if p >= 11 and n >= 11 and x[:11] == y[:11] and p + n > 10 * amount and sum(c != e for c, e in zip(x, y)) <= 1:
                return sign * p, amount
    return 0, 0


def test_clear_indels(spark):
    from pyspark.sql import functions as F

    from helicase.functions import dna

    known = [
        (REF[:25] + REF[27:62], REF[:60], (-25, 2)),
        (REF[:30] + "TT" + REF[30:58], REF[:60], (30, 2)),
        (REF[:60], REF[:60], (0, 0)),
        (REF[:5] + REF[7:62], REF[:60], (0, 0)),  # too close to the start of the read to be sure of
    ]
    rng = random.Random(3)
    cases = [(a, b) for a, b, _ in known]
    for _ in range(300):
        g = "".join(rng.choice("ACG") for _ in range(70))
        at, n = rng.randrange(60), rng.randrange(1, 8)
        r = g[:at] + g[at + n :] if rng.random() < 0.5 else g[:at] + "".join(rng.choice("ACG") for _ in range(n)) + g[at:]
        r = list(r[: rng.randrange(5, 60)])
        for _ in range(rng.randrange(3)):
            r[rng.randrange(len(r))] = "T"
        cases.append(("".join(r), g[: len(r)]))
    df = spark.createDataFrame(cases + [(None, "A")], "read string, ref string")
    got = {(r.read, r.ref): (r.indel, r.amount) for r in dna.with_indel(df, "read", "ref", F.lit(True)).collect()}
    assert all(got[a, b] == w for a, b, w in known)
    assert got == {(a, b): clear_indel(a, b) for a, b in cases} | {(None, "A"): (0, 0)}
    assert sum(v != (0, 0) for v in got.values()) > 5


def test_many_extensions_are_those_of_single_pairs():
    from helicase.operators import selfref

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets, sources = [], []
    for n in range(120):
        a = text(rng.choice([5, 16, 17, 40, 64, 64])) if n % 5 else (text(3) * 40)[:64]
        a = text(300) if n % 40 == 7 else a
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([["A"], ["N"], [], [b[at], "C"]]) if len(b) > 1 else ["G"]
        targets.append(a)
        sources.append("".join(b) if n % 3 else a[: rng.randrange(len(a))] + text(64))
    for longest in (64, 300):
        length, edits = selfref.extend_many(targets, sources, longest)
        assert list(zip(length.tolist(), edits.tolist())) == [selfref.extend(a, b, longest) for a, b in zip(targets, sources)]
    assert len(selfref.extend_many([], [], 64)[0]) == 0


def test_edits_are_not_counted_pair_by_pair(monkeypatch):
    # Lengths up to 128 share one table for many pairs.
    from helicase.operators import selfref

    monkeypatch.setattr(selfref, "delta", None)
    length, edits = selfref.extend_many(["ACGT" * 16] * 3, ["ACGT" * 16, "ACGT" * 8 + "T" + "ACGT" * 8, "ACGT" * 4 + "G" * 48], 64)
    assert length.tolist()[:2] == [64, 64] and edits.tolist()[0] == 0 and edits.tolist()[1] > 0
