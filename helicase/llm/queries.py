"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from helicase.llm import chat, decontaminate, hmm, html, jaccard, kmeans_tree, licenses, merkle, negatives, packing, quality, sharding, simhash
from helicase.llm.common import crc_of_id, read

#: Production parameters.
SHARDS = [f"shard-{i:02d}" for i in range(16)]
SLOTS = 2039
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

TOOLS = [
    ("reply", "prompt", "string", True, 1.0, 400.0),
    ("reply", "turn", "integer", True, 0.0, 6.0),
    ("configure", "prompt", "string", True, 1.0, 400.0),
    ("configure", "turn", "integer", True, 0.0, 0.0),
]


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn that isn't the assistant's is a call that the next turn answers; calls in the texts' own markup count too."""
    messages = read(spark, sf_dir, "conversations")
    calls, results = chat.parse(messages)
    name_of = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    asked = messages.filter("role in ('user', 'system')").select(
        "conv_id", name_of(F.col("turn")).alias("call_id"), "turn", F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("prompt"))).alias("arguments"), F.array(name_of(F.col("turn") - 2)).alias("after"),
    )
    answered = messages.filter("role = 'assistant'").select("conv_id", name_of(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    tools = spark.createDataFrame(TOOLS, chat.TOOLS)
    return chat.link(calls.unionByName(asked), results.unionByName(answered), tools)


def op5_maglev(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, F.col("doc_id"), SHARDS, SLOTS)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(read(spark, sf_dir, "documents"), ["doc_id"])
    at = F.transform("base", lambda b: b["word"])
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    every = F.array_union(base, F.transform("found", lambda x: x["label"]))
    best = F.array_max(F.transform("found", lambda x: x["priority"]))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(every), ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0)) / 100.0, F.when(F.size("base") > 0, 0.6).otherwise(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {f.__name__: f for f in (op4_tool_calls, op5_maglev, op7_licenses, op9_main_text)}

SQL: dict[str, str] = {}

SQL["op5_maglev"] = f"""
WITH RECURSIVE names AS (SELECT i, printf('shard-%02d', i) AS n FROM range({len(SHARDS)}) t(i)),
k AS (SELECT i, n, ('0x' || substr(md5(n || '/offset'), 1, 15))::BIGINT % {SLOTS} AS o,
             ('0x' || substr(md5(n || '/skip'), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS step FROM names),
pref AS MATERIALIZED (SELECT i, n, [CAST((o + j * step) % {SLOTS} AS INTEGER) FOR j IN range({SLOTS})] AS p FROM k),
fill(turn, slot, shard, taken) AS (
  SELECT 0, p[1], n, set_bit(repeat('0', {SLOTS})::BIT, p[1], 1) FROM pref WHERE i = 0
  UNION ALL
  SELECT turn, slot, n, set_bit(taken, slot, 1) FROM (
    SELECT f.turn + 1 AS turn, list_filter(p, lambda x: get_bit(f.taken, x) = 0)[1] AS slot, n, f.taken
    FROM fill f JOIN pref ON i = (f.turn + 1) % {len(SHARDS)} WHERE f.turn + 1 < {SLOTS})),
owner AS (SELECT slot, shard FROM fill)
SELECT doc_id, slot, shard
FROM (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS INTEGER) AS slot FROM documents) JOIN owner USING (slot)
"""

SQL["op4_tool_calls"] = """
WITH calls AS (SELECT conv_id, 'call_' || turn AS call_id, turn, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, text AS prompt
               FROM conversations WHERE role IN ('user', 'system')),
one AS (SELECT conv_id, call_id, count(*) AS n_calls, arg_min(turn, (turn, name)) AS turn, arg_min(name, (turn, name)) AS name, arg_min(prompt, (turn, name)) AS prompt
        FROM calls GROUP BY ALL),
res AS (SELECT conv_id, 'call_' || (turn - 1) AS call_id, count(*) AS n_results, arg_min(text, turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL),
lev AS (SELECT conv_id, call_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM one),
lev2 AS (SELECT conv_id, call_id, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS INTEGER) AS level FROM lev),
j AS (SELECT conv_id, call_id, turn, level, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, name, prompt, content,
        list_sort(list_filter([CASE WHEN length(prompt) NOT BETWEEN 1 AND 400 THEN 'range:prompt' END,
            CASE WHEN turn > CASE name WHEN 'reply' THEN 6 ELSE 0 END THEN 'range:turn' END], lambda x: x IS NOT NULL)) AS e
      FROM one LEFT JOIN lev2 USING (conv_id, call_id) FULL JOIN res USING (conv_id, call_id)),
s AS (SELECT *, CASE WHEN n_calls = 0 THEN 'orphan' WHEN len(e) > 0 THEN 'invalid' WHEN n_results = 0 THEN 'unanswered' ELSE 'ok' END AS status FROM j)
SELECT conv_id, call_id, turn, level, status, n_calls, n_results, CASE WHEN n_calls = 0 THEN '' ELSE array_to_string(e, ',') END AS errors,
  CAST(json_object('arguments', CASE WHEN n_calls = 0 THEN json_object() ELSE json_object('prompt', prompt, 'turn', turn) END,
    'id', call_id, 'level', level, 'name', name, 'result', content, 'status', status) AS VARCHAR) AS json
FROM s
"""


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER, end_id=2, size=1024)


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_of_id("doc_id") % 3 == 1, F.lit(False))
    scored = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held)  # a label's row has the document's id
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES |= {f.__name__: f for f in (op1_best_fit, op2_quality_gam)}


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"), 3, F.col("doc_id") % 100 == 0)


QUERIES |= {"op10_simhash": op10_simhash}


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"), k=5, percent=80)


QUERIES |= {"op8_jaccard_join": op8_jaccard_join}


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"), crc_of_id("doc_id") % 7 == 2)


QUERIES |= {"op6_hidden_markov": op6_hidden_markov}


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "covered", "first_word", "last_word")


QUERIES |= {"op3_spaced_seeds": op3_spaced_seeds}


def _mask_rows() -> str:
    return " UNION ALL ".join(f"SELECT {m} AS mask, {[p for p, c in enumerate(mask) if c == '1']} AS places" for m, mask in enumerate(decontaminate.MASKS))


#: Items of fewer words than a mask are left out here; the given tables have none.
SQL["op3_spaced_seeds"] = rf"""
WITH masks AS ({_mask_rows()}),
d AS (SELECT DISTINCT doc_id, text, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
dk AS (SELECT doc_id, text, w, pos, mask, list_transform(places, lambda p: w[pos + p]) AS k FROM (SELECT *, unnest(range(1, len(w) - 8)) AS pos FROM d WHERE len(w) >= 10), masks),
ik AS (SELECT item_id, w AS item, ipos, mask, list_transform(places, lambda p: w[ipos + p]) AS k FROM (SELECT *, unnest(range(1, len(w) - 8)) AS ipos FROM i WHERE len(w) >= 10), masks),
hit AS (SELECT DISTINCT doc_id, text, w, pos, item_id, item, ipos FROM dk JOIN ik USING (mask, k)),
same AS (SELECT doc_id, text, item_id, len(item) AS n_words, ipos + q AS place, pos + q - 1 AS word_at, pos - ipos AS diagonal
         FROM (SELECT *, unnest(range(0, 10)) AS q FROM hit) WHERE w[pos + q] = item[ipos + q]),
near AS (SELECT *, grid, floor((diagonal + 32 * grid) / 64.0) AS cell FROM same, (SELECT unnest([0, 1]) AS grid)),
spot AS (SELECT doc_id, text, item_id, n_words, grid, cell, count(DISTINCT place) AS covered, min(word_at) AS low, max(word_at) AS high FROM near GROUP BY ALL)
SELECT doc_id, item_id, n_words::INT AS n_words, max(covered) AS covered, min(low)::BIGINT AS first_word, max(high)::BIGINT AS last_word
FROM spot WHERE covered >= 0.5 * n_words GROUP BY doc_id, text, item_id, n_words
"""

SQL["op8_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y, k = a.n AND k = b.n AS same FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT n.doc_id, n.n AS n_shingles, greatest((SELECT count(*) FROM link WHERE link.x = n.doc_id AND same), 1) AS n_equal, c.component_id
FROM n JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = n.doc_id
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(read(spark, sf_dir, "documents"))


QUERIES |= {"op12_merkle": op12_merkle}
SQL["op12_merkle"] = merkle.SQL


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.mine(rows, F.col("id") % 100 == 0)


QUERIES |= {"op13_hard_negatives": op13_hard_negatives}
SQL["op13_hard_negatives"] = negatives.SQL


def op11_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return kmeans_tree.Index(rows).search(F.col("id") % 20 == 0, k=20, recall=0.97)


QUERIES |= {"op11_kmeans_tree": op11_kmeans_tree}
