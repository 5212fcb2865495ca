"""Near-duplicate documents by 64-bit SimHash fingerprints and deletion-variant signatures.

Two fingerprints that differ in at most four bits differ in at most one bit of one of three segments. Each segment of
each fingerprint is therefore indexed once per bit with that bit deleted (64 keys in all), keys are joined for equality
and every candidate pair is verified over all 64 bits, so no link is missed.

Copies share a fingerprint and are joined as one node, and nodes carry the component they are known to lie in: first
by keys whose equality already proves a link (60 equal bits). A key whose fingerprints all lie in one component can add
nothing and is dropped where it is counted; one with two or three fingerprints is verified there. A key with more (chance
meetings of a large table, or near copies) is refined: the other segments differ in at most four bits, so one of five
parts of them is equal, and that part joins the key. Near copies can still put thousands of fingerprints under one
refined key. They are connected by verified links to three fingerprints of the key first, a block of bounded size at a time; keys that
then hold several components are joined in full, each pair under one of its keys. Counts are combined map-side, so a key
of many fingerprints meets in no single task but in a join with its one row of counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import copies
from .components import components
from .store import cut, drop, forget, releasing

SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 4
SHINGLE = 4
#: Fingerprints of a key that are looked at together when near copies are first connected.
DENSE = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: words split at ASCII white space, A-Z lower-cased, XXH64 (seed 42) of each shingle.

    Fewer words than a shingle: the whole sequence is one; none (or null): 0. A bit is set if over half of the hashes,
    repeats included, have it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    hashes = np.array([hashed(joined[i:j], 42) for i, j in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for batch in batches:
        values = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fp)``, fp the 64 bits as a signed long."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(releasing(_fingerprints), "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """A row per fingerprint (with its component) and deleted bit: the bit and the rest of its segment in one long."""
    key = F.lit(None)
    for low, size in SEGMENTS:
        inside = F.col("bit").between(low, low + size - 1)
        rest = F.expr(f"(shiftrightunsigned(fp, {low}) & {(1 << size) - 1}L) & ~shiftleft(1L, bit - {low})")
        key = F.when(inside, rest).otherwise(key)
    rows = fps.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.select("fp", "c", (key + F.shiftleft(F.col("bit").cast("long"), 32)).alias("key"))


def _close(a: str, b: str):
    return F.expr(f"bit_count({a} ^ {b}) <= {MAX_BITS}")


def _refined(rows: DataFrame) -> DataFrame:
    """Each row five times, with each fifth of the bits outside its key's segment."""
    rest = F.lit(None)
    for low, size in SEGMENTS:
        above = f"shiftrightunsigned(fp, {low + size})" if low + size < 64 else "0L"
        inside = F.shiftright("key", 32).between(low, low + size - 1)
        rest = F.when(inside, F.expr(f"(fp & {(1 << low) - 1}L) | shiftleft({above}, {low})")).otherwise(rest)
    fifth = F.expr("shiftrightunsigned(rest, cast(9 * part as int)) & 511")
    parts = rows.withColumn("rest", rest).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return parts.select("key", "part", fifth.alias("fifth"), "rest", *(c for c in rows.columns if c != "key"))


def _once():
    """Of the refined keys that a pair shares, the first: the lowest near segment, deleted bit and equal fifth."""
    apart = [f"((fp ^ fp2) & {((1 << size) - 1) << low if low + size < 64 else -(1 << low)}L)" for low, size in SEGMENTS]
    bit = F.shiftright("key", 32)
    segment = F.lit(False)
    for k, (low, size) in enumerate(SEGMENTS):
        earlier = " and ".join(["true", *(f"bit_count({x}) > 1" for x in apart[:k])])
        lowest = F.expr(f"{apart[k]} <> 0") | (bit == low)
        segment = segment | (bit.between(low, low + size - 1) & F.expr(earlier) & lowest)
    fifths = F.lit(True)
    for k in range(4):
        fifths = fifths & ((F.col("part") <= k) | F.expr(f"((rest ^ rest2) & {511 << 9 * k}L) <> 0"))
    return segment & fifths


def _relabelled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    found = joined.select(F.col("node").alias("c"), "component")
    named = rows.join(found, "c", "left").withColumn("c", F.coalesce("component", "c"))
    return named.select(*rows.columns)


def _apart(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of those combinations of ``by`` that hold a pair of different components which ``_once`` may give to them.

    Under the key of any but a segment's lowest bit that takes two fingerprints that differ in this bit.
    """
    bit = F.shiftright("key", 32).cast("int")
    lowest = F.lit(False)
    for low, _ in SEGMENTS:
        lowest = lowest | (bit == low)
    side = F.expr("(shiftrightunsigned(fp, cast(shiftright(key, 32) as int)) & 1L) = 1L")
    ends = [(f(F.when(on, F.col("c"))).alias(n)) for f, on, n in ((F.min, side, "lo1"), (F.max, side, "hi1"), (F.min, ~side, "lo0"), (F.max, ~side, "hi0"))]
    counts = rows.groupBy(*by).agg(*ends)
    across = "lo0 is not null and lo1 is not null and least(lo0, lo1) < greatest(hi0, hi1)"
    return rows.join(counts.filter((lowest & F.expr("least(lo0, lo1) < greatest(hi0, hi1)")) | F.expr(across)).select(*by), by)


def links(fps: DataFrame) -> DataFrame:
    """``fps(fp)``, all different -> ``(fp, c)`` with the same c where links connect."""
    nibbles = fps.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(15)))).select(
        "fp", "at", F.expr("fp & ~shiftleft(15L, 4 * at)").alias("rest")
    )
    sure = nibbles.groupBy("at", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    first = components(nibbles.join(sure, ["at", "rest"]).select("a", F.col("fp").alias("b")))
    labelled = cut(_relabelled(fps.select("fp", F.col("fp").alias("c")), first), "labelled")

    # one shuffle: counts and members of a key meet in the partition they were dealt to, and both go to one table
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _variants(labelled.repartition(parts, "fp")).repartition("key")  # a small table, but 64 keys to a row
    counts = [F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")]
    counts += [F.min("fp").alias("f"), F.min_by("c", "fp").alias("fc"), F.max("fp").alias("g"), F.max_by("c", "fp").alias("gc")]
    counts += [F.bit_xor("fp").alias("x"), F.bit_xor("c").alias("xc")]
    met = keyed.groupBy("key").agg(*counts).filter("lo < hi")
    met = met.withColumns({"h": F.expr("x ^ f ^ g"), "hc": F.expr("xc ^ fc ^ gc")})  # the third of three
    link = lambda a, b: F.when(_close(a, b), F.struct(F.col(f"{a}c").alias("a"), F.col(f"{b}c").alias("b")))
    of_three = F.when(F.col("n") == 3, F.array(link("f", "g"), link("f", "h"), link("g", "h"))).when(F.col("n") == 2, F.array(link("f", "g")))
    small = met.select(F.filter(of_three, lambda e: e.isNotNull()).alias("found")).filter("size(found) > 0")
    nothing = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    members = keyed.join(met.filter("n > 3").select("key", "n"), "key")
    members = members.select("fp", "c", "key", "n", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("found"))
    met = cut(small.select(*nothing("fp", "c", "key", "n"), "found").union(members), "met")
    pairs = met.filter("found is not null").select(F.explode("found").alias("e")).select("e.a", "e.b").distinct()
    salt = F.pmod(F.xxhash64("fp"), 1 + F.floor(F.col("n") / DENSE))
    crowded = met.filter("fp is not null").select("fp", "c", "key", salt.alias("salt"))

    by = ["key", "part", "fifth"]
    block = Window.partitionBy(*by, "salt")
    heads = {f"head{k}": F.min(F.struct(F.xxhash64("fp", F.lit(k)).alias("h"), "fp", "c")).over(block) for k in range(3)}
    spread = {"lo": F.min("c").over(block), "hi": F.max("c").over(block)}
    near = _refined(crowded.repartition("fp")).withColumns(spread | heads).filter("lo < hi")  # members of a key are dealt out
    linked = F.filter(F.array(*heads), lambda h: (h["c"] != F.col("c")) & (F.bit_count(h["fp"].bitwiseXOR(F.col("fp"))) <= MAX_BITS))
    star = near.select("c", linked.alias("linked")).filter("size(linked) > 0").select("c", F.explode("linked").alias("head"))
    second = components(pairs.union(star.select("c", "head.c").distinct().toDF("a", "b")))
    earlier, labelled = labelled, cut(_relabelled(labelled, second), "labelled")

    left = cut(_apart(_refined(_relabelled(crowded, second).repartition("fp")), by).select(*by, "rest", "fp", "c"), "mixed")
    right = left.toDF(*(f"r_{k}" for k in by), "rest2", "fp2", "c2")
    same = [F.col(k) == F.col(f"r_{k}") for k in by]
    full = left.join(right, [*same, F.col("c") < F.col("c2"), _close("fp", "fp2"), _once()])
    third = components(full.select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct())
    found = cut(_relabelled(labelled, third), "links")
    for table in (earlier, met, labelled, left):
        drop(table)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most four differing bits. Repeated rows and equal
    texts share a fingerprint, so they share the id. Null, empty and blank texts have fingerprint zero and link like any
    other. Rows with a null doc_id keep their fingerprint and take the id of the other rows that have it (null if there
    are none). Any further columns are ignored; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs), "fingerprints")
    nodes = cut(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    joined = cut(links(nodes.select("fp")).join(nodes, "fp"), "joined")
    ids = joined.groupBy("c").agg(F.min("node").alias("component_id"))
    named = joined.join(ids, "c").select("fp", "component_id")
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _print(text: str | None) -> tuple:
    words = copies.words_of(text)
    shingles = copies.shingles(words)
    return copies.text_key(words), int(np.uint64(fingerprint(text)).view(np.int64)), len(shingles), copies.bands(shingles)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id.

    Near copies are texts whose five-word shingles have a similarity of at least 0.8 (found by ``copies``), and those that
    ``near_duplicates`` links. Where texts of a group share that doc_id, the one with the smallest hash stays; equal rows
    are reduced to one. Rows without a doc_id are kept, as nothing names their group. Null and empty texts are copies of
    each other; very long texts are compared whole; an empty table stays empty; columns of any name are carried along.
    """
    text = F.col("text").cast("string")
    number = F.col("doc_id").cast("long")
    rows = docs.filter("doc_id is not null").select(number.alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    prints = cut(copies.mapped(rows, _print, "tk long, fp long, n long, b array<long>"), "prints")
    smallest = F.min(F.struct("doc_id", "th")).alias("r")
    nodes = prints.groupBy("tk").agg(smallest, *(F.first(c).alias(c) for c in ("fp", "n", "b")))
    nodes = cut(nodes.select("tk", "r.doc_id", "r.th", "fp", "n", "b"), "nodes")
    linked = links(nodes.select("fp").distinct())
    forget(docs.sparkSession)
    close = nodes.select("tk", "fp").join(linked, "fp")
    close = close.join(close.groupBy("c").agg(F.min("tk").alias("a")), "c").select("a", F.col("tk").alias("b"))
    groups = components(close.union(copies.links(nodes, rows))).toDF("tk", "c")
    named = prints.select("doc_id", "th", "tk").join(groups, "tk", "left").withColumn("c", F.coalesce("c", "tk"))
    kept = cut(named.groupBy("c").agg(smallest).select("r.*"), "kept")
    again = cut(prints.groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th"), "again")
    drop(prints), drop(nodes)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    own = docs.filter("doc_id is not null").select(row.alias("row"), number.alias("doc_id"), F.xxhash64(text).alias("th"))
    own = own.join(kept, ["doc_id", "th"], "left_semi")
    once = own.join(again, ["doc_id", "th"], "left_anti")
    repeated = own.join(again, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])  # only these are shuffled
    return once.union(repeated).select("row.*").unionByName(docs.filter("doc_id is null"))
