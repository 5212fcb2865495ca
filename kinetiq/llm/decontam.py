"""Benchmark passages in documents by spaced seeds, in DataFrame expressions only.

Words are runs of letters and digits, lower-cased. A document holds a passage of an item where, on one alignment of the
two, at least 13 of 16 words in a row agree (of an item with 12 to 15 words: four fifths of them, rounded up; of one with 5
to 11: all). Four fixed masks choose six of up to ten words each. Every way to substitute as many words as the rule allows
leaves one mask's places untouched somewhere in the window, so equal hashes of masked words find every such passage; which
was checked for all substitution patterns, and a test repeats it. An item of 5 to 11 words has one mask, all of its words,
and documents are hashed by those lengths that the benchmark has. Each hit is verified on the words around it.

Documents are never shuffled for this: positions are generated, hashed, looked up among the benchmark's seeds and verified
in one stage. The seeds are broadcast in blocks of at most ``BLOCK`` rows (a row is under 400 bytes); a benchmark of more
seeds takes more passes over the documents, as positions with the words around them are many times the documents' size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 5, 7, 8, 9), (0, 2, 3, 6, 7, 8), (0, 1, 2, 3, 4, 5))
WINDOW, MISSES, SHORT, SHORTEST = 16, 3, 12, 5
BACK = WINDOW - min(m[-1] + 1 for m in MASKS)  # how far before a hit its window may start
AROUND = range(-BACK, WINDOW)
BLOCK = 100_000


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(mask: int, places, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get("w", at + o) for o in places))


def _seeded(rows: DataFrame, whole: list[int]) -> DataFrame:
    """A row per word position and mask that fits: at, seed. ``rows`` has the word hashes as ``w``; ``whole`` are the
    lengths of short items, a mask each."""
    span = min([m[-1] + 1 for m in MASKS] + whole)
    rows = rows.filter(F.size("w") >= span).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - span)))
    masks = [*enumerate(MASKS), *((len(MASKS) + n, tuple(range(n))) for n in whole)]
    seeds = [F.when(F.col("at") + m[-1] < F.size("w"), _seed(k, m, F.col("at"))) for k, m in masks]
    return rows.withColumn("seed", F.explode(F.array(*seeds))).filter("seed is not null")


def need(n: Column) -> Column:
    """How many of the window's words have to agree, for an item of ``n`` words."""
    return F.when(n >= WINDOW, F.lit(WINDOW - MISSES)).when(n >= SHORT, F.ceil(n * 4 / 5).cast("int")).otherwise(n)


def _items(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("w"))
    return items.filter(F.col("item_id").isNotNull() & (F.size("w") >= SHORTEST))


def short_lengths(benchmark: DataFrame) -> list[int]:
    """The lengths under SHORT that items have: a few numbers."""
    return sorted(r["n"] for r in _items(benchmark).select(F.size("w").alias("n")).filter(F.col("n") < SHORT).distinct().collect())


def benchmark_seeds(benchmark: DataFrame, whole: list[int]) -> DataFrame:
    items, columns = _items(benchmark), ["item_id", "w", "at", "seed"]
    seeded = _seeded(items.filter(F.size("w") >= SHORT), []).select(*columns)
    if whole:  # a short item has the one seed of all its words
        own = F.coalesce(*(F.when(F.size("w") == n, _seed(len(MASKS) + n, range(n), F.lit(0))) for n in whole))
        short = items.filter(F.size("w") < SHORT).withColumn("at", F.lit(0)).withColumn("seed", own)
        seeded = seeded.union(short.select(*columns))
    around = F.array(*(F.get("w", F.col("at") + j) for j in AROUND))
    return seeded.select("seed", "item_id", need(F.size("w")).alias("need"), around.alias("around")).distinct()


def _agreement(best: str = "bits") -> Column:
    """The most agreeing words of any window, from a bit for each place around a hit."""
    ones = [F.bit_count(F.shiftright(best, s).bitwiseAND(F.lit((1 << WINDOW) - 1))) for s in range(BACK + 1)]
    return F.greatest(*ones)


def _hits(docs: DataFrame, seeds: DataFrame, whole: list[int]) -> DataFrame:
    places = _seeded(docs, whole)
    same = [
        F.when(F.get("w", F.col("at") + j) == F.get("around", F.lit(i)), F.lit(1 << i)).otherwise(F.lit(0))
        for i, j in enumerate(AROUND)
    ]
    # exploding the one value keeps the optimizer from writing its long expression into every use of it
    met = places.join(F.broadcast(seeds), "seed").withColumn("bits", F.explode(F.array(reduce(lambda a, b: a + b, same))))
    return met.withColumn("agree", _agreement()).filter("agree >= need").select("key", "doc_id", "item_id", "agree")


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, doc_id, item_id, agree), one row per document and item whose passage it holds."""
    whole = short_lengths(benchmark)
    seeds = cut(benchmark_seeds(benchmark, whole), "seeds")
    blocks = max(1, -(-seeds.count() // block))
    # the key of doc_id and text tells rows apart which share a doc_id (or have none)
    rows = docs.select(
        F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text").cast("string")).alias("w")
    )
    parts = [_hits(rows, seeds.filter(F.pmod("seed", F.lit(blocks)) == b), whole) for b in range(blocks)]
    hits = reduce(DataFrame.union, parts)
    return hits.groupBy("key", "doc_id", "item_id").agg(F.max("agree").alias("agree"))


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per document and benchmark item of which it holds a passage: doc_id, item_id, n_agree (words of 16).

    Documents without a passage have no row. Null and empty texts hold none. Equal rows give one row; rows that share a
    doc_id but not a text are judged alone and merged under the id with the larger n_agree. Items with a null id or fewer
    than 5 words are not searched for. Other columns are ignored; empty tables give no rows.
    """
    found = leaks(docs, benchmark, block)
    return found.groupBy("doc_id", "item_id").agg(F.max("agree").cast("int").alias("n_agree"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage.

    Null and empty texts hold none, so they stay; equal rows share their fate; rows that share a doc_id but not a text are
    judged alone; an empty table stays empty. Columns of any name are carried along unread.
    """
    found = leaks(docs, benchmark, block).select("key").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    return rows.join(found, "key", "left_anti").select("row.*")


#: The rule itself, on every alignment with an agreeing pair of words: no seeds.
ORACLE = """
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p
           FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)),
     b AS (SELECT item_id, n, unnest(w) AS word, generate_subscripts(w, 1) AS q
           FROM (SELECT item_id, w, len(w) AS n
                 FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark))
           WHERE n >= 5),
     m AS (SELECT doc_id, item_id, n, p - q AS diag, q,
                  count(*) OVER (PARTITION BY doc_id, item_id, p - q ORDER BY q RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS agree
           FROM d JOIN b USING (word))
SELECT doc_id, item_id, max(agree)::INTEGER AS n_agree FROM m
WHERE agree >= CASE WHEN n >= 16 THEN 13 WHEN n >= 12 THEN ceil(n * 4 / 5.0) ELSE n END
GROUP BY doc_id, item_id
"""
