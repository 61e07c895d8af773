"""Benchmark decontamination by spaced-seed hashing.

A mask ignores fixed places of a window of words; the words it keeps are hashed. Windows of benchmark items and of documents
meet on (mask, hash), so a passage is found although words in it were replaced. Around the hits the words are compared,
and a document is contaminated by an item of which it holds enough words in place. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helicase.llm.common import staged

#: Places a mask keeps are 1. All masks have the same length, and each inner place is ignored by one of them at least.
MASKS = ("1101001101", "1010110011", "1110010011")
#: Windows of items that may be sent to every executor (some tens of MB); more are joined by a shuffle.
MAX_BROADCAST = 500_000


def words(text: Column) -> Column:
    """Letters and digits in lower case; everything else separates."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(w: Column, at: Column, short: list[int]) -> Column:
    """(mask, hash) pairs of the window that begins at `at`; masks of short items keep every word."""
    span = len(MASKS[0])
    pick = lambda places: F.xxhash64(*[F.get(w, at + p) for p in places])
    full = [F.struct(F.lit(m).alias("mask"), F.when(at + span <= F.size(w), pick([p for p, c in enumerate(mask) if c == "1"])).alias("hash")) for m, mask in enumerate(MASKS)]
    return F.array(*full, *[F.struct(F.lit(-n).alias("mask"), F.when(at + n <= F.size(w), pick(range(n))).alias("hash")) for n in short])


def hits(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, text_hash, item_id, n_words, covered, first_word, last_word: documents (doc_id, text) that hold an item (item_id, text).

    `covered` of the item's `n_words` words stand in the document in place, in windows whose masked words agree and which
    begin within the same 64 words; it is `share` of them at least. first_word and last_word bound the windows. An item
    of fewer words than a mask must occur whole; without words it is in nothing. Null and empty texts hold nothing.
    Repeated rows and items give one row. `text_hash` tells rows with one doc_id or none apart. Texts are never cut; other
    columns don't matter.
    """
    span = len(MASKS[0])
    items = benchmark.select("item_id", words(F.col("text")).alias("item")).filter("size(item) > 0").distinct()
    items = staged(items.withColumn("n_words", F.size("item")), "items")
    short = sorted(r[0] for r in items.filter(F.col("n_words") < span).select("n_words").distinct().collect())  # fewer than `span`
    place = items.select("item_id", "item", "n_words", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)))).alias("item_at"))
    seeds = place.select("item_id", "item_at", "n_words", "item", F.explode(_hashes(F.col("item"), F.col("item_at"), short)).alias("s"))
    # a short item's mask is for items of that length only
    seeds = seeds.filter("s.hash is not null").filter((F.col("s.mask") >= 0) | (-F.col("s.mask") == F.col("n_words")))
    seeds = staged(seeds.select(F.col("s.mask").alias("mask"), F.col("s.hash").alias("hash"), "item_id", "item_at"), "seeds")

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    least = min([span, *short])
    rows = rows.filter(F.size("w") >= least)
    at = rows.select("doc_id", "text_hash", "w", F.explode(F.sequence(F.lit(0), F.size("w") - least)).alias("at"))
    windows = at.select("doc_id", "text_hash", "w", "at", F.inline(_hashes(F.col("w"), F.col("at"), short)))
    # a window takes its own words along, never the text
    windows = windows.select("doc_id", "text_hash", "at", "mask", "hash", F.slice("w", F.col("at") + 1, span).alias("part"))
    met = windows.join(F.broadcast(seeds) if seeds.count() <= MAX_BROADCAST else seeds, ["mask", "hash"])
    met = met.select("doc_id", "text_hash", "item_id", "item_at", "at", "part").distinct()

    # the words in place around each hit
    both = met.join(items, "item_id").filter((F.col("n_words") >= span) | (F.col("item_at") == 0))
    same = both.select("doc_id", "text_hash", "item_id", "n_words", "at", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "item", F.posexplode("part").alias("p", "word"))
    same = same.filter(F.col("word") == F.get("item", F.col("item_at") + F.col("p")))
    near = F.explode(F.array(F.struct(F.lit(0).alias("grid"), F.floor(F.col("diagonal") / 64).alias("cell")), F.struct(F.lit(1).alias("grid"), F.floor((F.col("diagonal") + 32) / 64).alias("cell"))))
    near = same.select("doc_id", "text_hash", "item_id", "n_words", (F.col("item_at") + F.col("p")).alias("place"), (F.col("at") + F.col("p")).alias("word_at"), near.alias("near"))
    by = ["doc_id", "text_hash", "item_id", "n_words"]
    places = near.groupBy(*by, "near", "place").agg(F.min("word_at").alias("low"), F.max("word_at").alias("high"))
    spots = places.groupBy(*by, "near").agg(F.count("*").alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"))
    enough = spots.filter((F.col("covered") >= F.col("n_words") * share) & ((F.col("n_words") >= span) | (F.col("covered") == F.col("n_words"))))
    return enough.groupBy(*by).agg(F.max("covered").alias("covered"), F.min("low").cast("bigint").alias("first_word"), F.max("high").cast("bigint").alias("last_word"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """The rows of `docs` (all columns) that hold no item of `benchmark`."""
    bad = staged(hits(docs, benchmark, share).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__text"]), "left_anti")
