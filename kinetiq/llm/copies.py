"""Texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

A fingerprint of 64 bits cannot find these: at that similarity two differ by about ten bits, and segments short enough to
survive so many say nothing. Candidates come from ``BANDS`` bands of ``ROWS`` minimal hashes instead, which miss a pair at
exactly 0.8 with a probability under 1e-7 and a closer one with less, and every candidate pair is verified on whole sets.
Texts under a band are first linked to one of them; a band whose texts then lie in one component adds nothing. Texts of the
others meet by their rarest shared shingles (a prefix filter with places), which misses no pair: in a large group of copies
that lie just under 0.8 of each other a band holds nearly all pairs, a rare shingle few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import cut, drop, forget, releasing
from .substring import Hashes

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Bits that bound from below in how many shingles two texts differ; of use for texts of up to some two thousand words.
PARITIES = 512
_RNG = np.random.default_rng(11)
_TURN, _TIMES = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes]) -> np.ndarray:
    """The different shingles' hashes as sorted signed longs; fewer words than a shingle are one, no words none."""
    if not words:
        return np.zeros(0, np.int64)
    starts = np.arange(max(1, len(words) - SHINGLE + 1))
    return np.unique(Hashes(words).runs(starts, np.minimum(starts + SHINGLE, len(words))).view(np.int64))


def text_key(words: list[bytes]) -> int:
    """Names a text up to case and white space; 0 where there are no words."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 7)).view(np.int64)) if words else 0


def mapped(rows: DataFrame, make, schema: str) -> DataFrame:
    """``make(text)`` gives the row for each of ``rows(text)``; the other columns, longs, stay in front."""
    kept = [c for c in rows.columns if c != "text"]
    fields = [f.split(" ") for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            new = [make(t.as_py()) for t in batch.column(at("text"))]
            out = [batch.column(at(c)) for c in kept]
            for k, (_, kind) in enumerate(fields):
                if kind.startswith("array"):
                    ends = np.cumsum([0, *(len(row[k]) for row in new)]).astype(np.int32)
                    values = np.concatenate([row[k] for row in new]) if new else np.zeros(0, np.int64)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                else:
                    out.append(pa.array([row[k] for row in new], pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *(name for name, _ in fields)])

    return rows.mapInArrow(releasing(run), ", ".join([*(f"{c} long" for c in kept), schema]))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band: of its rows' smallest values over the set, each row another order of all shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024].view(np.uint64)
        low = np.minimum(low, ((part[:, None] ^ _TURN) * _TIMES).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, and for each of PARITIES classes of them whether their number is odd.

    Two texts differ in at least as many shingles as in such bits.
    """
    found = shingles(words_of(text))
    odd = np.bincount(found.view(np.uint64) % np.uint64(PARITIES), minlength=PARITIES).astype(np.uint8) & 1
    return found, np.packbits(odd).view(np.int64)


def _all_sets(met: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(tk, s, k): the shingles and parities of the texts of ``met(tk)``. ``nodes`` names a row (doc_id, th) of each key."""
    need = cut(nodes.select("tk", "doc_id", "th").join(met.select("tk").distinct(), "tk", "left_semi"), "need")
    texts = rows.join(need, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("tk", "text")
    sets = cut(mapped(texts, _sets, "s array<long>, k array<long>"), "sets")
    drop(need)
    return sets


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` of text keys, those that are similar enough."""
    pairs = cut(pairs.distinct(), "pairs")
    met = pairs.join(sets.select(F.col("tk").alias("a"), F.col("s").alias("x")), "a")
    met = met.join(sets.select(F.col("tk").alias("b"), F.col("s").alias("y")), "b")
    found = cut(met.filter("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("a", "b"), "similar")
    drop(pairs)
    del met
    forget(sets.sparkSession)
    return found


def _candidates(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``texts(tk, c)`` with different c, among them all that are similar.

    Only shingles of several components can be common to a pair. A text's are ordered by how many texts have them, the rarest
    first. What two texts have in common lies behind the first common one in both orders, so that it bounds their number by
    what follows there, r: a pair has to meet under a shingle where both have enough left for their sizes. That
    takes four fifths of a text's own size at least, so only the places before that are kept. Pairs whose parities show that
    they differ in over a ninth of their shingles together (a similarity of 0.8) are left out.
    """
    keyed = texts.join(sets.select("tk", "s"), "tk").select("tk", "c", F.size("s").alias("n"), F.explode("s").alias("e")).repartition("e")
    several = keyed.groupBy("e").agg(F.count("*").alias("many"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    shared = keyed.join(several.select("e", "many"), "e").groupBy("tk", "c", "n")
    ordered = shared.agg(F.array_sort(F.collect_list(F.struct("many", "e"))).alias("es")).filter("5 * size(es) >= 4 * n")
    places = F.posexplode(F.expr("slice(es, 1, size(es) - cast((4 * n + 4) div 5 as int) + 1)")).alias("at", "p")
    posts = cut(ordered.select("tk", "c", "n", F.size("es").alias("u"), places).select("tk", "c", "n", F.expr("u - at").alias("r"), "p.e"), "posts")
    least = posts.groupBy("e").agg(F.min("n").alias("least"))
    able = posts.join(least, "e").filter("9 * r >= 4 * (n + least)").select("tk", "c", "n", "r", "e")
    mixed = able.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("e")
    able = able.join(mixed, "e", "left_semi").join(sets.select("tk", "k"), "tk")
    left = cut(able.select("tk", "c", "n", "r", "e", "k"), "prefixes")
    drop(posts)
    right = left.toDF("tk2", "c2", "n2", "r2", "e2", "k2")
    odd = " + ".join(f"bit_count(k[{i}] ^ k2[{i}])" for i in range(PARITIES // 64))
    close = F.expr(f"c < c2 and 9 * least(r, r2) >= 4 * (n + n2) and 9 * ({odd}) <= n + n2")
    full = left.join(right, (F.col("e") == F.col("e2")) & close)
    pairs = cut(full.select(F.col("tk").alias("a"), F.col("tk2").alias("b")).distinct(), "candidates")
    drop(left)
    return pairs


def _named(met: DataFrame, edges: DataFrame) -> DataFrame:
    """``met`` with the component c that each text is known to lie in, of those bands that still hold several."""
    found = components(edges).select(F.col("node").alias("tk"), F.col("component").alias("c"))
    named = met.join(found, "tk", "left").withColumn("c", F.coalesce("c", "tk"))
    several = named.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("h")
    return named.join(several, "h", "left_semi")


def links(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``nodes(tk, n, b, doc_id, th)``, a row per key -> ``(a, b)`` that connect all texts that similar pairs connect.

    n is the number of a text's shingles, b its bands, and (doc_id, th) names a row of ``rows(doc_id, th, text)``. First
    every text of a band meets one of its texts: the one that meets most others under all its bands, which is the likely source
    of a group of copies. The texts of bands that then hold several components meet by ``_candidates``.
    """
    posts = nodes.select("tk", F.explode("b").alias("h"))
    shared = posts.groupBy("h").agg(F.count("*").alias("many")).filter("many > 1")
    met = posts.join(shared, "h").join(nodes.select("tk", "n"), "tk")
    met = cut(met.select("h", "tk", "n", "many"), "met")
    degrees = met.groupBy("tk").agg(F.sum("many").alias("degree"))
    met2 = cut(met.join(degrees, "tk").select("h", "tk", "n", "degree"), "met")
    drop(met)
    sets = _all_sets(met2, nodes, rows)
    hub = met2.groupBy("h").agg(F.max(F.struct("degree", "tk", "n")).alias("p"))
    hub = hub.select("h", F.col("p.tk").alias("tk2"), F.col("p.n").alias("n2"))
    star = met2.join(hub, "h").filter("tk <> tk2 and 5 * least(n, n2) >= 4 * greatest(n, n2)")
    sure = _verified(star.select(F.least("tk", "tk2").alias("a"), F.greatest("tk", "tk2").alias("b")), sets)
    left = cut(_named(met2.select("h", "tk"), sure).select("tk", "c").distinct(), "mixed")
    drop(met2)
    more = _verified(_candidates(left, sets), sets)
    drop(left), drop(sets)
    return sure.union(more)
