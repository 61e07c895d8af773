"""Merkle manifest of a table: one digest a row, a tree for each group, a tree of the groups' roots, and a proof for every row.

A level of a tree is a table of nodes (key, idx, n, digest): n nodes of group `key`, numbered from 0. Each level equijoins
its nodes with computed sibling numbers (idx XOR 1 in binary trees, slot offsets in wider ones); the rows of slot zero then
emit the parents. Proofs go down the same way: a node's proof is its siblings in front of its parent's proof. Every node is a
row of its own, found by (key, idx), so a hot group spreads like any other, and all levels together have about twice as
many rows as the table.

Numbers inside a group come from one sort by range over the whole table, the counts of (partition, key), and running sums of
those counts, so that no group is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helicase.llm.common import crc_of_id, numbered, staged


def digest_of(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _with_others(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes of one level with `slot` in their run and `others`, the digests of the run's other nodes from left to right."""
    slot = F.col("idx") % arity
    if arity == 2:
        other = nodes.select("key", F.col("idx").alias("other"), F.unhex("digest").alias("d"))
        paired = nodes.withColumn("other", F.col("idx").bitwiseXOR(F.lit(1))).join(other, ["key", "other"], "left").drop("other")
        return paired.withColumn("slot", slot.cast("int")).withColumn("others", F.when(F.col("d").isNull(), F.array().cast("array<binary>")).otherwise(F.array("d"))).drop("d")
    offsets = F.explode(F.sequence(F.lit(1), F.lit(arity - 1)))
    asked = nodes.select("key", "idx", offsets.alias("offset")).withColumn("other", F.expr(f"idx - idx % {arity} + (idx + offset) % {arity}"))
    other = nodes.select("key", F.col("idx").alias("other"), F.unhex("digest").alias("d"))
    found = asked.join(other, ["key", "other"]).groupBy("key", "idx").agg(F.sort_array(F.collect_list(F.struct("other", "d"))).alias("run"))
    found = found.select("key", "idx", F.transform("run", lambda x: x["d"]).alias("others"))
    joined = nodes.join(found, ["key", "idx"], "left").withColumn("slot", slot.cast("int"))
    return joined.withColumn("others", F.coalesce("others", F.array().cast("array<binary>")))


def _hex(digests: Column) -> Column:
    return F.transform(digests, lambda d: F.lower(F.hex(d)))


def _run(digest: Column, slot: Column, others: Column) -> Column:
    """The digest of a run of nodes."""
    texts = _hex(others)
    return F.sha2(F.concat(F.array_join(F.slice(texts, F.lit(1), slot), ""), digest, F.array_join(F.slice(texts, slot + 1, F.size(texts)), "")), 256)


def tree(leaves: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The written levels of all groups' trees, and their roots (key, digest, level).

    `leaves` are (key, idx, n, digest) and further columns, which only level 0 keeps; a level also has `slot` and `others`.
    A group ends at the level where it has one node. Without leaves there is no level.
    """
    levels: list[DataFrame] = []
    roots = leaves.filter("n = 1").select("key", "digest", F.lit(0).alias("level"))
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves
    while most > 0:
        levels.append(staged(_with_others(nodes, arity), f"{name}-{len(levels)}"))
        if most == 1:
            break
        up = levels[-1].filter("slot = 0 and n > 1")
        above = F.expr(f"cast(floor((n + {arity - 1}) / {arity}) as bigint)") if arity != 2 else F.expr("shiftright(n + 1, 1)")
        nodes = up.select("key", F.expr(f"idx div {arity}").alias("idx"), above.alias("n"), _run(F.col("digest"), F.col("slot"), F.col("others")).alias("digest"))
        roots = roots.unionByName(nodes.filter("n = 1").select("key", "digest", F.lit(len(levels)).alias("level")))
        most = (most + arity - 1) // arity
    return levels, staged(roots, f"{name}-roots")


STEP = "array<struct<slot:int,others:array<binary>>>"


def proofs(levels: list[DataFrame], roots: DataFrame, above: DataFrame, arity: int, name: str) -> DataFrame:
    """Level 0 with `proof`, the (slot, others) of every level up to the root, followed by the root's own proof in `above` (key, proof)."""
    tops = staged(roots.select("key", "level").join(above, "key"), f"{name}-tops")
    proof = None
    for level in range(len(levels) - 1, -1, -1):
        own = F.array(F.struct("slot", "others")).cast(STEP)
        keep = levels[0].columns if level == 0 else ["key", "idx"]
        ended = levels[level].filter("n = 1").join(tops.filter(F.col("level") == level).select("key", "proof"), "key").select(*keep, "proof")
        if proof is not None:
            below = levels[level].filter("n > 1").withColumn("up", F.expr(f"idx div {arity}"))
            parent = proof.select("key", F.col("idx").alias("up"), F.col("proof").alias("more"))
            ended = below.join(parent, ["key", "up"]).withColumn("proof", F.concat(own, "more")).select(*keep, "proof").unionByName(ended)
        proof = staged(ended, f"{name}-proof-{level}") if level and level % 6 == 0 else ended
    return proof


def folded(digest: Column, proof: Column) -> Column:
    """The root that a digest and its proof give."""
    return F.aggregate(proof, digest, lambda h, step: _run(h, step["slot"], step["others"]))


def manifest(rows: DataFrame, arity: int = 2) -> DataFrame:
    """`rows` (group, id, leaf) and any other columns, with subroot, root and proof.

    The leaves of a group ascend by id (null first), equal ids by leaf; groups ascend by their UTF-8 bytes, null first. A run of `arity`
    nodes gives their parent, the last run of a level may have fewer, one even; a lone leaf is its group's subroot and a lone
    subroot the root. Rows that agree in group, id and leaf are leaves of their own, in any order. No rows give none. The columns
    key, idx, n, digest, slot and others are taken.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))  # null in front, never equal to a name
    leaves = staged(rows.select(*rows.columns, key.alias("key"), F.col("leaf").alias("digest")), "merkle-leaves")
    leaves = staged(numbered(leaves, "key", "id", "leaf"), "merkle-numbered")
    levels, roots = tree(leaves, arity, "merkle")
    groups = roots.select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    top_levels, top = tree(staged(numbered(staged(groups, "merkle-groups"), "key", "name"), "merkle-subroots"), arity, "merkle-top")
    if not levels:
        return rows.select("*", F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(STEP).alias("proof")).limit(0)
    root = top.select("key", F.col("digest").alias("root"))
    of_groups = proofs(top_levels, top, top.select("key", F.array().cast(STEP).alias("proof")), arity, "merkle-top").join(root, "key")
    of_groups = staged(of_groups.select(F.col("name").alias("key"), F.col("digest").alias("subroot"), "root", "proof"), "merkle-of-groups")
    proved = proofs(levels, roots, of_groups.select("key", "proof"), arity, "merkle")
    return proved.join(of_groups.select("key", "subroot", "root"), "key").select(*rows.columns, "subroot", "root", "proof")


#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(docs: DataFrame) -> DataFrame:
    """Manifest of documents, one tree per lang, checked against a table where some rows were tampered with.

    Where 7 divides the CRC-32 of doc_id in decimal, the tampered row's n_chars is one more. doc_id, leaf, subroot, root, proof_sha256
    (digest of the siblings from the leaf to the root, left to right; of nothing if there are none), folded_root (from the tampered leaf
    and the original siblings) and verified (it equals root). A null doc_id or n_chars is never tampered with; null and empty texts
    differ. Other columns don't matter.
    """
    leaf = lambda n_chars: digest_of(*[field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS])
    tampered = F.coalesce(crc_of_id("doc_id") % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    own = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf(F.col("n_chars").cast("bigint") + 1)).alias("changed"))
    siblings = F.flatten(F.transform("proof", lambda x: _hex(x["others"])))
    rows = manifest(own).select("id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def verify(rows: DataFrame, leaf: str = "leaf", proof: str = "proof") -> DataFrame:
    """`rows` of a manifest with `verified`: whether the leaf and its proof give the root."""
    return rows.withColumn("verified", folded(F.col(leaf), F.col(proof)) == F.col("root"))


#: CRC-32 of a document's id in decimal, by the public polynomial.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

#: The manifest of `documents` in SQL.
SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, coalesce(crc, 1) % 7 = 0 AND n_chars IS NOT NULL AS tampered,
    CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail
  FROM (SELECT *, {crc} AS crc FROM documents)),
leaf AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS changed FROM f),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
nodes AS (
  SELECT lang, 0 AS level, idx, n, leaf AS h FROM numbered
  UNION ALL
  SELECT lang, level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2),
tree AS MATERIALIZED (SELECT * FROM nodes),
subroots AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, idx, n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, idx // 2),
top AS MATERIALIZED (SELECT * FROM upper),
climb AS (
  SELECT row_number() OVER () AS r, lang, 0 AS level, idx, n, '' AS proof, coalesce(changed, leaf) AS h FROM numbered
  UNION ALL
  SELECT r, c.lang, c.level + 1, c.idx // 2, (c.n + 1) // 2, proof || coalesce(t.h, ''),
    sha256(CASE WHEN c.idx % 2 = 1 THEN t.h || c.h ELSE c.h || coalesce(t.h, '') END)
  FROM climb c LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM c.lang AND t.level = c.level AND t.idx = xor(c.idx, 1) WHERE c.n > 1),
climbed AS MATERIALIZED (SELECT c.r, s.idx, s.n, proof, c.h, s.h AS subroot FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1),
rise AS (
  SELECT r, 0 AS level, idx, n, proof, h, subroot FROM climbed
  UNION ALL
  SELECT r, c.level + 1, c.idx // 2, (c.n + 1) // 2, proof || coalesce(t.h, ''),
    sha256(CASE WHEN c.idx % 2 = 1 THEN t.h || c.h ELSE c.h || coalesce(t.h, '') END), subroot
  FROM rise c LEFT JOIN top t ON t.level = c.level AND t.idx = xor(c.idx, 1) WHERE c.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x.h AS folded_root, x.h = root AS verified
FROM (SELECT row_number() OVER () AS r, doc_id, leaf FROM numbered) JOIN rise x USING (r), (SELECT h AS root FROM top WHERE n = 1) WHERE x.n = 1
""".replace("{crc}", _CRC)
