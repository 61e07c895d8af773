"""The training-data operators against brute force, on small tables with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from helicase.llm import chat, decontaminate, hmm, html, jaccard, licenses, packing, quality, sharding, simhash
from helicase.llm.components import components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ["size", "set", "gram", "w", "at", "hash", "mask", "block", "held", "n", "score", "features", "piece", "start", "length", "part", "rank", "range", "guest", "id", "base", "found", "slot", "shard", "item", "fingerprint"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


BASE = prose(1, 60)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("alpha", "ALPHA")), (4, BASE + " tail"), (5, None), (6, ""), (7, " \n\t"), (7, " \n\t"), (8, "one two"), (9, "one two"), (10, prose(2, 9000)),
    (None, prose(3, 30)), (None, None), (11, prose(3, 30)), (12, "é ÉÉ ı x y 漢字 🙂🙂"), (12, "é ÉÉ ı x y 漢字 🙂🙂"), (13, prose(4, 70)), (14, prose(4, 70) + " x y z"), (-5, "word " * 40),
]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, *[None if k % 2 else "x" for k in range(len(CLASH))]) for i, t in TEXTS], schema).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def rows(df):
    return [tuple(r) for r in df.collect()]


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def blank_words(t):
    return [x for x in re.split(r"[ \t-\r]+", low(t)) if x]


# packing


def test_ids_are_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    odd_ones = ["a  b", " x y", "tail ", "a\n b c", "a \nb", "x\tz  e", "<|endoftext|> a b", "", "it's don't 's 're", " ", "a  b c", "a  b", "x\n"]
    texts = [x or "" for _, x in TEXTS] + odd_ones
    encode = packing._Encoder(TOKENIZER)
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encode(text), "<u4").tolist() == e.ids, text


@pytest.mark.parametrize("size", [32, 1024])
def test_packing_is_gapless_and_whole(odd, size):
    got = packing.pack(odd, TOKENIZER, 2, size, keep_ids=True).collect()
    encode = packing._Encoder(TOKENIZER)
    want = collections.Counter()
    for i, t in TEXTS:
        ids = np.frombuffer(encode(t or ""), "<u4").tolist() + [2]
        at, to, k = 0, (len(ids) - 1) % size + 1, 0
        while at < len(ids):
            own = np.array(ids[at:to], "<u4").tobytes()
            want[(i, k, at, to - at, zlib.crc32(own), own)] += 1
            at, to, k = to, to + size, k + 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size


def test_packing_of_nothing(empty):
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_plan_uses_all_pieces_and_few_sequences():
    r = np.random.default_rng(5)
    for n, size in ((1, 16), (50, 16), (500, 64), (20_000, 1024)):
        counts = collections.Counter(np.minimum(size, 1 + r.exponential(size / 3, n).astype(int)).tolist())
        used, sequences = collections.Counter(), 0
        for own, k in packing.plan(counts, size):
            assert sum(own) <= size and k > 0
            sequences += k
            for x in own:
                used[x] += k
        assert used == counts
        total = sum(k * v for k, v in counts.items())
        assert sequences <= max(-(-total // size) + 2, 1.02 * total / size) or n < 100


# quality


def test_quality_learns_on_one_part_and_holds_on_the_other(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = quality.score(docs, labels, ~held).join(labels, "doc_id").filter(held).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in got]) >= 0.9


def test_quality_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (10, 0, 0), (None, 1, 0), (13, None, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = rows(quality.score(odd, labels))
    assert sorted(map(str, (i for i, _ in got))) == sorted(str(i) for i, _ in TEXTS) and all(0 <= s <= 1 for _, s in got)
    assert {s for _, s in rows(quality.score(odd, labels.limit(0)))} == {0.5}
    assert quality.score(empty, labels).count() == 0 and quality.keep(odd, labels, 0.0).columns == odd.columns


def test_additive_scores_are_sums_of_tables():
    r = np.random.default_rng(0)
    x = r.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y)
    b = m.bins(x)
    by_hand = [m.base + sum(m.tables[k, b[i, k]] for k in range(4)) + sum(t[b[i, p], b[i, q]] for (p, q), t in zip(m.pairs, m.pair_tables)) for i in range(50)]
    assert np.allclose(m.logit(b[:50]), by_hand) and (0, 1) in m.pairs
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


# decontamination


def test_contaminated_documents_are_found_and_clean_ones_left(spark):
    items = {i: prose(100 + i, 12 + 3 * i) for i in range(8)} | {90: "too short", 91: None, 92: ""}
    docs, want = {}, set()
    for k in range(120):
        text, r = prose(1000 + k, 80).split(), random.Random(k)
        if k % 3 == 0:
            i = k % 8
            own = items[i].split()
            if k % 2:  # one word in eight replaced
                own = [w if (p + k) % 8 else "other" for p, w in enumerate(own)]
            at = r.randrange(80)
            text[at:at] = [w.upper() + "," if k % 4 == 0 else w for w in own]
            want.add((k, i))
        docs[k] = " ".join(text)
    docs[200] = "This is TOO - short, really"
    want.add((200, 90))
    table = [(k, t, "x") for k, t in docs.items()] + [(None, docs[0], "y"), (None, docs[0], "y"), (300, None, None), (301, "", None), (1, docs[1], "x")]
    df = spark.createDataFrame(table, "doc_id bigint, text string, hash string")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items.items()] + [(0, items[0], "z")], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.hits(df, bench).collect()}
    assert got == want | {(None, 0)}
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    bad = {i for i, _ in want}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [i for i, _, _ in table if i is not None and i not in bad]))
    assert decontaminate.hits(df.limit(0), bench).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == len(table)


def test_seeds_are_the_same_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b " + prose(7, 30)), (2, prose(8, 30))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, prose(7, 20))], "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = decontaminate.hits(df, bench)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [(r.doc_id, r.item_id, r.covered, r.first_word, r.last_word) for r in found.collect()] == [(1, 5, 20, 2, 21)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # windows cross the network with their own words and without the text
    sides = plan.split("Exchange hashpartitioning(mask")[1:]
    lists = [re.search(r"Project \[([^\n]*)\]\n", side + "\n").group(1) for side in sides if "Project" in side]
    assert len(sides) == 2 and any("slice(" in x for x in lists)
    assert not any(column.startswith("w#") for x in lists for column in x.split(", "))


# tool calls


def test_calls_link_in_order(spark):
    calls = [
        (1, "a", 1, "add", '{"y":2,"x":1}', []), (1, "b", 2, "add", '{"x":"1","z":0}', ["a"]), (1, "c", 3, "add", "{", ["a", "b"]), (1, "d", 4, "no", "{}", ["c", "gone"]),
        (1, "e", 5, "add", '{"x":1000,"y":1}', ["f"]), (1, "f", 6, "add", '{"x":1,"y":1}', ["e"]), (1, "g", 7, "add", '{"x":1,"y":1}', ["e", "a"]), (1, "a", 9, "add", "{}", []), (2, "a", 1, "add", None, None),
        (None, "a", 1, "add", "{}", []), (2, None, 1, "add", "{}", []), (3, "s", 1, "add", '{"x":1,"y":{"b":[1, 2],"a":"q\\"\\n"}}', ["s"]),
    ]
    calls += [(4, f"k{i}", i, "add", '{"x":1,"y":1}', [f"k{i - 1}"]) for i in range(40)]
    results = [(1, "a", 2, "3"), (1, "a", 3, "4"), (1, "z", 9, "lost"), (1, "b", 4, None), (4, "k0", 1, "é\n")]
    tools = [("add", "x", "integer", True, 0.0, 100.0), ("add", "y", "number", True, None, None)]
    df = chat.link(spark.createDataFrame(calls, chat.CALLS), spark.createDataFrame(results, chat.RESULTS), spark.createDataFrame(tools, chat.TOOLS))
    got = {(r.conv_id, r.call_id): r for r in df.collect()}
    seen = {k: (r.level, r.status, r.errors) for k, r in got.items()}
    assert seen[1, "a"] == (0, "ok", "") and got[1, "a"].n_calls == 2 and got[1, "a"].n_results == 2
    assert seen[1, "b"] == (1, "invalid", "missing:y,type:x,unknown:z")
    assert seen[1, "c"] == (2, "invalid", "json:arguments,missing:x,missing:y")
    assert seen[1, "d"] == (3, "invalid", "tool:no")
    assert seen[1, "e"][:2] == seen[1, "f"][:2] == seen[1, "g"][:2] == seen[3, "s"][:2] == (None, "cyclic")
    assert seen[1, "z"] == (None, "orphan", "") and seen[2, "a"][:2] == (0, "invalid")
    assert [seen[4, f"k{i}"][0] for i in range(40)] == list(range(40)) and seen[4, "k5"][1] == "unanswered"
    assert got[1, "a"].json == '{"arguments":{"x":1,"y":2},"id":"a","level":0,"name":"add","result":"3","status":"ok"}'
    assert '"arguments":{"x":1,"y":{"a":"q\\"\\n","b":[1,2]}}' in got[3, "s"].json
    assert len(got) == 9 + 40 + 1


def test_calls_are_read_from_texts(spark):
    text = 'Sure. <tool_call>{"id":"c1","name":"add","arguments":{"x":1},"after":["c0"]}</tool_call> and <tool_call>oops</tool_call>'
    messages = [(1, 0, "user", "<tool_call>{}</tool_call>"), (1, 1, "assistant", text), (1, 2, "tool", '<tool_result id="c1">two\nlines</tool_result>'), (2, 0, "assistant", None), (2, 1, None, "x")]
    calls, results = chat.parse(spark.createDataFrame(messages, "conv_id bigint, turn bigint, role string, text string"))
    got = sorted(rows(calls), key=str)
    assert (1, "c1", 1, "add", '{"x":1}', ["c0"]) in got and len(got) == 2 and got[1][3] is None
    assert rows(results) == [(1, "c1", 2, "two\nlines")]


# sharding


def test_shards_claim_slots_in_turn():
    shards, slots = ["a", "b", "c", "d"], 97
    owner = sharding.lookup_table(shards, slots)
    prefer = []
    for s in shards:
        at = int(hashlib.md5(f"{s}/offset".encode()).hexdigest()[:15], 16) % slots
        step = int(hashlib.md5(f"{s}/skip".encode()).hexdigest()[:15], 16) % (slots - 1) + 1
        prefer.append([(at + j * step) % slots for j in range(slots)])
    want = {}
    for turn in range(slots):
        s = turn % 4
        want[next(p for p in prefer[s] if p not in want)] = s
    assert owner == [want[i] for i in range(slots)]
    assert max(collections.Counter(owner).values()) - min(collections.Counter(owner).values()) <= 1
    fewer = sharding.lookup_table(shards[:3], slots)
    assert sum(a == b for a, b in zip(owner, fewer) if a < 3) > 0.7 * sum(a < 3 for a in owner)


def test_placement_keeps_rows(spark, odd, empty, tmp_path):
    from pyspark.sql import functions as F

    got = sharding.place(odd, F.col("doc_id"), ["a", "b", "c"], 101)
    table = sharding.lookup_table(["a", "b", "c"], 101)
    assert got.columns == [c for c in odd.columns if c not in ("slot", "shard")] + ["slot", "shard"]
    found = got.select("doc_id", "slot", "shard").collect()
    assert len(found) == len(TEXTS)
    for r in found:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101 and r.shard == "abc"[table[r.slot]]
    assert sharding.place(empty, F.col("doc_id"), ["a"], 2).count() == 0
    sharding.write_shards(got, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(TEXTS)
    for shards, slots in ((["a"], 4), (["a", "a"], 5), ([], 5), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


# language model


def test_forward_is_exact_and_counts_are_expected_values():
    r = np.random.default_rng(3)
    kinds = [7, 9, 7]
    emit = np.full((hmm.CLASSES + 1, 2), 1e-3)
    emit[[7, 9, hmm.CLASSES]] = r.uniform(0.1, 1, (3, 2))
    m = hmm.Model(np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]]), emit)
    x = hmm._Texts(np.array([0, 2, 1, 0]), np.array(kinds))
    full = [[hmm.CLASSES], [7, 9, hmm.CLASSES], [7, hmm.CLASSES], [hmm.CLASSES]]
    starts, moves, emitted = np.zeros(2), np.zeros((2, 2)), np.zeros((2, hmm.CLASSES + 1))
    for text, got in zip(full, m.log10(x)):
        paths = {s: m.start[s[0]] * math.prod(m.move[a, b] for a, b in zip(s, s[1:])) * math.prod(emit[k, a] for k, a in zip(text, s)) for s in itertools.product((0, 1), repeat=len(text))}
        total = sum(paths.values())
        assert abs(got - math.log10(total)) < 1e-9
        for s, p in paths.items():
            starts[s[0]] += p / total
            for a, b in zip(s, s[1:]):
                moves[a, b] += p / total
            for k, a in zip(text, s):
                emitted[a, k] += p / total
    assert np.allclose(m.counts(x), np.concatenate([starts, moves.ravel(), emitted.ravel()]))


def test_pieces_of_long_texts_count_like_whole_texts(monkeypatch):
    r = np.random.default_rng(5)
    n = np.array([0, 70, 9, 33, 8, 70])
    kinds = r.integers(0, 20, n.sum())
    m = hmm.Model(np.array([0.2, 0.3, 0.5]), r.dirichlet(np.ones(3), 3), r.uniform(1e-6, 1, (21, 3)))
    seen = []
    for size in (1000, 8, 1):
        monkeypatch.setattr(hmm, "SEGMENT", size)
        x = hmm._Texts(n, kinds, 20)
        assert len(x.at_step) == min(size, 71)
        seen.append((m.step(x), m.log10(x)))
    for counts, scores in seen[1:]:
        assert np.allclose(counts, seen[0][0], rtol=1e-9) and np.allclose(scores, seen[0][1], rtol=1e-12)
    assert abs(seen[0][0][-2] - seen[0][1].sum() * math.log(10)) < 1e-9 and seen[0][0][-1] == 196


def test_scores_of_all_rows(spark, odd, empty):
    from pyspark.sql import functions as F

    held = F.col("doc_id") % 2 == 0
    got = rows(hmm.score(odd, held))
    texts = [(i, blank_words(t) + [None], i is not None and i % 2 == 0) for i, t in TEXTS]
    c = collections.Counter(w for _, ws, h in texts if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws, h in texts]
    key = lambda x: (str(x[0]), x[2], x[5])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and g[6] < 0
    assert hmm.score(empty, held).count() == 0
    assert {r[3:5] for r in rows(hmm.score(odd, F.lit(True)))} == {(0, 0)}


def test_model_beats_counts_on_held_out_texts(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = hmm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).filter("held_out")
    r = got.agg(F.sum("score").alias("own"), F.sum("base_score").alias("base")).first()
    assert r.own > r.base


def test_model_does_not_depend_on_files(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen, train = [], hmm.train

    def kept(blocks, tokens, types):
        seen.append((blocks.count(), len(tokens), train(blocks, tokens, types)))
        return seen[-1][2]

    monkeypatch.setattr(hmm, "train", kept)
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices([f"{'ab'[i < 30]}{j}" for j in range(40)], k=30))) for i in range(60)], "doc_id bigint, text string")
    held = F.col("doc_id") % 7 == 2
    got = [sorted((r.doc_id, r.score) for r in hmm.score(d, held).collect()) for d in (docs.coalesce(1), docs.repartitionByRange(5, F.col("doc_id").desc()), docs.repartitionByRange(3, held))]
    assert [x[0] for x in seen] == [1, 5, 2]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for other in got[1:] for a, b in zip(got[0], other))
    for _, _, (_, likelihoods) in seen:
        assert len(likelihoods) > 3 and likelihoods[-1] > likelihoods[0] and likelihoods[-1] - likelihoods[-2] < hmm.LEAST_GAIN
    monkeypatch.setattr(hmm, "CLASSES", 64)
    assert hmm.n_classes(1) == 64 and hmm.n_classes(80) == 256 and hmm.n_classes(10**8) == 1 << 18
    assert len(sorted(hmm.score(docs, held).collect())) == 60 and seen[-1][1] == 257


# licences


def test_base_places_and_labels(spark):
    texts = [
        "Under the GNU General-Public License, and again gnu general public license v3.", "MIT License. mitlicense MIT\nLICENSE", "Licensed under CC BY-NC 4.0.", "cc by", "accc by", None, "", "é Apache license é",
        "Released under the MIT License.", "SPDX-License-Identifier: BSD-3-Clause", "the new bsd license", "nothing here", "This work is licensed under the GNU General Public License, version 3.", "mit 5 leuten", "x " * 30_000 + "mit license",
    ]
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x"), (None, texts[3], None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, base string")
    got = licenses.scan(df, ["doc_id"]).collect()
    assert len(got) == len(data)
    for r in got:
        text = texts[3] if r.doc_id is None else texts[r.doc_id] or ""
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        want = sorted((lab, i) for p, lab in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert r.n_words == len(w) and sorted((b.label, b.word) for b in r.base) == want
    labels = {r.doc_id: sorted({f.label for f in r.found}) for r in got if r.doc_id is not None}
    assert labels[0] == ["gpl"] and labels[2] == ["cc-by-nc"] and labels[9] == ["bsd"] and labels[10] == ["bsd"] and labels[11] == [] and labels[13] == []
    assert labels[12] == ["gpl"] and labels[8] == ["mit"]
    assert licenses.scan(df.limit(0), ["doc_id"]).count() == 0


def test_suppression_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()
    extra = ["Licensed under the Apache License, Version 2.0, or the GNU Lesser General Public License version 2.1 or MIT license; all rights reserved. Copyright 2020"]
    data = [(d.doc_id, d.text + "\n" + extra[0] * (d.doc_id % 3 == 0)) for d in docs]
    got = {r.doc_id: [(f.start, f.stop, f.rule) for f in r.found] for r in licenses.scan(spark.createDataFrame(data, "doc_id bigint, text string"), ["doc_id"]).collect()}
    rules = licenses.rules()
    assert len(rules) > 200
    for i, text in data:
        hits = [(m.start(), m.end(), k, p) for k, (_, key, pattern, p) in enumerate(rules) if key in text.lower() for m in re.finditer(pattern, text.lower())]
        order = lambda x: (x[0], -x[1], -x[3], x[2])
        keep = [a for a in hits if not any(b is not a and b[0] <= a[0] and a[1] <= b[1] and b[3] >= a[3] and order(b) < order(a) for b in hits)]
        assert sorted(got[i]) == sorted(x[:3] for x in keep)


# Jaccard join


def shingle_set(t):
    w = blank_words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(data):
    sets = [shingle_set(t) for _, t in data]
    up = list(range(len(data)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(data)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(data):
        least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(data)), key=str)


@pytest.mark.parametrize("few,block", [(48, 100_000), (2, 300)])
def test_groups_match_brute_force(spark, odd, empty, monkeypatch, few, block):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(odd).collect()), key=str)
    assert got == brute_components(TEXTS)
    data, r = list(TEXTS), random.Random(9)
    for k in range(120):  # a large group of near copies, linked through one another
        w = prose(50, 120).split()
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = f"new{r.randrange(9)}"
        data.append((100 + k, " ".join(w[: 120 - r.randrange(4)])))
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str) == brute_components(data)
    assert jaccard.join(empty).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (102, 102), (103, 100), (None, 5), (7, None), (0, 1)]
    got = dict(rows(components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] == got[103] != got[0] and got[102] == 102 and len(got) == 65


# pages


def test_main_text_of_layouts(spark):
    side = '<div class="sidebar"><p>Side, text, that, has, many, commas, and is long enough to count as text.</p></div>'
    para = "".join(f"<p>Sentence {i}, with words, and &lt;more&gt; words &amp; so on; long enough to be prose.</p>" for i in range(3))
    want = " ".join(f"Sentence {i}, with words, and <more> words & so on; long enough to be prose." for i in range(3))
    pages = {
        1: f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1>{para}</article><footer>foot</footer></body></html>",
        2: f"<body><div id=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>{side}<div class='post'><h1>Head</h1>{para}</div><div id='comments'><p>Nice, text, great, and so on, I like it, really.</p></div></body>",
        3: f"<p><div class=x><h1>Head</h1>{para}<script>var a='<p>no</p>';</script><form><p>Mail, please, now</p></form><!-- <p>no</p> --></div>",
        4: None, 5: "", 6: "just text", 7: "<<<>>&&#x41;&bogus;<p", 8: "<div>" * 3000 + "deep" + "</div>" * 3000, 9: "<script>only</script>",
    }
    df = spark.createDataFrame([(k, f"u{k}", h, "x") for k, h in pages.items()] + [(1, "u1", pages[1], None)], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(df, ["page_id", "url"]).collect()}
    for k in (1, 2, 3):
        assert got[k].text == "Head " + want
    assert got[4].text == got[5].text == got[9].text == "" and got[6].text == "just text" and got[8].text == "deep" and "A" in got[7].text
    assert all(r.n_chars == len(r.text) for r in got.values()) and html.extract(df.limit(0), ["page_id"]).count() == 0


@pytest.mark.parametrize(
    "opening, closing",
    [
        ("<div class='post-content has-sidebar'>", "</div>"), ("<div class='entry-content share-enabled'>", "</div>"), ("<div class='post no-footer with-comments'>", "</div>"),
        ("<div class='sidebar'>", "</div>"), ("<div id='search'>", "</div>"), ("<div id='page' class='menu-open'>", "</div>"),
    ],
)
def test_names_do_not_hide_the_article(opening, closing):
    para = "Some words of an article, with a comma and more to read than in any list of links."
    lines = ["The head", "First section", para, "Social impact", para, "Rail", para, "Discussion", para]
    inner = (
        f"<div class='article-header'><h1>{lines[0]}</h1></div><h2>{lines[1]}</h2><p>{para}</p><p class='notice'>Mind this, please.</p><h2 id='social-impact'>{lines[3]}</h2><p>{para}</p>"
        f"<section id='rail-transport'><h2>{lines[5]}</h2><p>{para}</p></section><section id='discussion'><h2>{lines[7]}</h2><p>{para}</p></section>"
    )
    around = "<div class='site-footer'><p>All rights, of this site, are with its owners, see below.</p></div>"
    menu = "<div class='menu'><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></div><div class='social'><a href=z>Follow us</a></div><div class='ad'>Buy this, and that.</div>"
    assert html.main_text(f"<html><body>{menu}{opening}{inner}{closing}{around}</body></html>") == " ".join(lines)
    inside = f"<article>{inner}{menu}<div id='comments'><p>{para}</p></div></article>"
    assert html.main_text(f"<html><body>{menu}{inside}{around}</body></html>") == " ".join(lines)


@pytest.mark.parametrize(
    "junk",
    [
        "<div class='notice'><p>{x}</p></div>", "<div class='alert'>{x}</div>", "<aside class='disclaimer'><p>{x}</p></aside>", "<p class='notice'>{x}</p>", "<p class='ad'>{x}</p>",
        "<p class='advertisement'>{x}</p>", "<h2 class='ad'>{x}</h2>", "<section class='reader-comments'><h3>Comments</h3><p>{x}</p></section>", "<div class='discussion'><p>{x}</p></div>",
        "<div class='responses'><p>{x}</p><p>{x}</p></div>", "<div class='announcement'><p>{x}</p></div>", "<ul class='user-replies'><li>{x}</li></ul>",
    ],
)
def test_notices_adverts_and_comments_go(junk):
    para = "Some words of an article, with a comma and more to read than in any list of links."
    junk = junk.replace("{x}", "Buy this, now, or say that you did not, dear reader.")
    for body in (f"<article><h1>Head</h1><p>{para}</p>{junk}<p>{para}</p></article>", f"<div class='post'><h1>Head</h1><p>{para}</p><p>{para}</p>{junk}</div>"):
        assert html.main_text(f"<html><body>{body}</body></html>") == f"Head {para} {para}"
    whole = f"<div class='notice'><h1>Head</h1><p>{para}</p><p>{para}</p></div>"  # what holds the larger part of the page stays
    assert html.main_text(f"<html><body>{whole}</body></html>") == f"Head {para} {para}"


def test_article_is_whole_beside_its_best_container():
    long = "Some words of an article, with a comma and more to read, than in any list of links there is. " * 4
    long, teaser = " ".join(long.split()), "A teaser, of another article, that is shorter than the post but long enough to have a fifth of its length, as teasers are."
    page = f"<body><div class=post><p>{long}</p><p>{long}</p><p>{long}</p></div><article><p>{teaser}</p><p>{teaser}</p></article></body>"
    assert html.main_text(page).startswith(" ".join([long] * 3))
    parts = f"<h1><a href=x>Head</a></h1><p>Short.</p>Loose <a href=y>text</a> here<div>By me</div><div class=x><p>{long}</p><p>{long}</p></div><h2>Code</h2><pre>a = 1</pre><ul><li>One<li>Two</ul>"
    parts += f"<table><tr><td>1</td></tr></table><section><h3>More</h3><p>Few.</p></section><ul><li><a href=a>Link</a><li><a href=b>Link</a></ul><p>End.</p>"
    want = f"Head Short. Loose text here By me {long} {long} Code a = 1 One Two 1 More Few. End."
    for opening, closing in (("<div id=all>", "</div>"), ("<body>", "</body>"), ("<div id=all><div class=y>", "</div></div>")):
        assert html.main_text(f"{opening}{parts}{closing}") == want
    assert html.main_text(f"<body><h1>Head</h1><article><p>{long}</p></article><p>Short.</p><div>Imprint</div></body>") == f"Head {long} Short."
    assert html.main_text(f"<body><div class=ad>{long}</div><article><h1>Head</h1><p>Few words.</p></article></body>") == "Head Few words."


def test_articles_of_the_given_pages(spark, sf_dir):
    from html import unescape

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br)>", inner))
        assert html.main_text(r.html) == " ".join(b for b in blocks if b)


# fingerprints


def brute_edited(data):
    order = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 2
        yield i, len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest(), t, t[: len(t) - m] + nxt[:m], nxt


@pytest.mark.parametrize("per_range", [2, 5000])
def test_edited_texts_and_fingerprints(odd, empty, monkeypatch, per_range):
    monkeypatch.setattr(simhash, "RANGE_ROWS", per_range)
    got = sorted(rows(simhash.edited_pairs(odd)), key=str)
    want = []
    for i, n, sha, text, edited, nxt in brute_edited(TEXTS):
        a, b, c = simhash.fingerprints(pa.array([text, edited, nxt])).tolist()
        want.append((i, n, sha, f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    assert got == sorted(want, key=str)
    assert simhash.edited_pairs(empty).count() == 0


def test_fingerprint_votes():
    text = "a b a b c"
    _, h = simhash.common.shingles(np.zeros(5, np.int64), simhash.common.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[3], 1, 2)
    votes = [sum((1 if (x >> k) & 1 else -1) * round(16 * (1 + math.log(n))) for x, n in collections.Counter(h.tolist()).items()) for k in range(64)]
    assert simhash.fingerprints(pa.array([text, "A b\ta B  c", None, ""])).tolist() == [sum(1 << k for k in range(64) if votes[k] > 0)] * 2 + [0, 0]


@pytest.mark.parametrize("radius", [1, 3])
def test_search_within_a_radius(spark, radius):
    r = random.Random(4)
    prints = [r.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    for x in prints[:20]:
        for n in (1, 2, 3, 4):
            prints.append(x ^ sum(1 << b for b in r.sample(range(64), n)))
    df = spark.createDataFrame([(f"{x:016x}", k) for k, x in enumerate(prints)] + [(f"{prints[0]:016x}", 999), (None, 1000)], "fingerprint string, doc_id bigint")
    got = {(q, f): d for q, f, d in rows(simhash.within(df, df, radius))}
    want = {(f"{a:016x}", f"{b:016x}"): (a ^ b).bit_count() for a in prints for b in prints if (a ^ b).bit_count() <= radius}
    assert got == want
    near = {x[1]: x[2] for x in rows(simhash.near_counts(df, radius, df["doc_id"] < 5).select("fingerprint", "doc_id", "n_near"))}
    assert near[0] == sum((prints[0] ^ x).bit_count() <= radius for x in prints + prints[:1]) and near[7] is None and len(near) == len(prints) + 2


# pipeline


def test_pipeline_stages_take_effect(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near duplicates", "decontamination", "packing"]
    kept = docs
    from helicase.llm.common import staged

    before = {r.doc_id: r.text for r in docs.collect()}
    good = staged(P.good_quality(spark, kept, sf_dir), "t")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and np.mean([(i in ids) == bool(q) for i, q in labels.items() if i in before]) > 0.9
    one = staged(P.one_of_each_group(spark, good, sf_dir), "t")
    groups = brute_components([(i, before[i]) for i in sorted(ids)])
    assert {r.doc_id for r in one.collect()} == {c for _, _, c in groups} and one.columns == docs.columns
    clean = staged(P.without_benchmark(spark, one, sf_dir), "t")
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert left == {r.doc_id for r in one.collect() if not any(i in norm(r.text) for i in items)} and clean.columns == docs.columns
    packs = P.packed(spark, clean, sf_dir).collect()
    assert {r.doc_id for r in packs} == left
    assert {r.doc_id for r in P.run(spark, sf_dir).select("doc_id").distinct().collect()} == left


def test_near_duplicate_stage_with_repeated_ids(spark, odd, sf_dir):
    import corpus_pipeline as P

    got = sorted((r.doc_id for r in P.one_of_each_group(spark, odd, sf_dir).collect()), key=str)
    assert got == sorted([1, 5, 6, 7, 8, 10, None, None, 11, 12, 13, -5], key=str)
