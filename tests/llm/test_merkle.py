"""Merkle manifests against a plain construction."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from helicase.llm import merkle


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def tree(leaves, arity):
    """Root and, of every leaf, the list of (slot, other digests)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i - i % arity : i - i % arity + arity]
            paths[leaf].append((i % arity, run[: i % arity] + run[i % arity + 1 :]))
            at[leaf] = i // arity
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def fold(leaf, path):
    for slot, others in path:
        leaf = h(*others[:slot], leaf, *others[slot:])
    return leaf


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def expected(rows, arity=2):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(((r[0] is not None, r[0] or 0, h(*map(field, r)), r) for r in rows if r[2] == lang), key=lambda x: x[:3])
        trees[lang] = (own, *tree([x[2] for x in own], arity))
    root, upper = tree([trees[x][1] for x in langs], arity)
    out = []
    for lang, above in zip(langs, upper):
        own, subroot, paths = trees[lang]
        for (_, _, leaf, r), path in zip(own, paths):
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            got = fold(h(*map(field, (*r[:3], r[3] + 1, r[4]))) if bad else leaf, path + above)
            out.append((r[0], leaf, subroot, root, h(*[x for _, o in path + above for x in o]), got, got == root))
    return sorted(out, key=repr)


TEXTS = ["", None, "é 漢字 🙂", "plain", "a" * 70_000]


def table(spark, rows):
    clash = "key string, idx int, n int, digest string, slot string, others string, leaf string, proof string, root string, level int"
    return spark.createDataFrame([(*r, *["x"] * 1, 1, 2, *["x"] * 6, 3) for r in rows], f"doc_id bigint, source string, lang string, n_chars int, text string, {clash}").repartition(5)


def some(n, seed, langs=("en", "en", "en", None, "", "de", "é", "=")):
    r = random.Random(seed)
    return [(r.choice([None, *range(-3, 400)]), r.choice(["web", None]), r.choice(langs), r.choice([None, 7, 2**31 - 1]), r.choice(TEXTS)) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 300])
def test_manifest_of_documents(spark, n):
    rows = some(n, n)
    rows += rows[:3]  # repeated rows are leaves of their own
    assert sorted((tuple(r) for r in merkle.digest(table(spark, rows)).collect()), key=repr) == expected(rows)


def test_no_documents(spark):
    out = merkle.digest(table(spark, []))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("arity", [2, 5])
def test_trees_of_any_arity_and_verification(spark, arity):
    rows = [(lang, i, h(lang, str(i))) for lang, n in (("a", 1), ("b", 2), ("c", 26), ("d", 31)) for i in range(n)]
    df = spark.createDataFrame(rows, "`group` string, id bigint, leaf string").repartition(4)
    out = merkle.verify(merkle.manifest(df, arity)).collect()
    own = {g: tree([r[2] for r in rows if r[0] == g], arity) for g in "abcd"}
    root, upper = tree([own[g][0] for g in "abcd"], arity)
    assert len(out) == len(rows)
    for r in out:
        path = own[r["group"]][1][r["id"]] + upper["abcd".index(r["group"])]
        assert (r["subroot"], r["root"], r["verified"]) == (own[r["group"]][0], root, True)
        assert [(s["slot"], [bytes(x).hex() for x in s["others"]]) for s in r["proof"]] == path
    moved = merkle.verify(merkle.manifest(df, arity).withColumn("leaf", F.sha2(F.col("leaf"), 256))).filter("verified").count()
    assert moved == 0
