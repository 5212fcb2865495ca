"""Removal of long repeated passages by compaction of a sparse token de Bruijn graph.

A passage is judged by windows of ``WINDOW`` words; a window whose words also start anywhere else is repeated, and every
word under a repeated window goes. Windows are not shuffled one by one. The graph's edges are token k-mers, kept only
where a window's smallest k-mer (by hash, the first of equals) is: equal windows keep equal edges, and about one word in
fourteen has one. An edge comes with its context, all words of the windows that chose it.

Edges are counted and joined with their counts. One that occurs once has no repeated window. One that occurs more often
is nonbranching where its context occurs more often too: then all its windows are repeated, and neighbouring such edges of
a source compact into one path, a row of source coordinates. Where paths branch (the borders of repeated passages and
changed words in near copies) the windows of contexts that occur once are read from the text again, with those of one
occurrence of each other context of the edge, and counted by edge and content. So the result holds for each window and
not only for its edge, and a passage that a third of all documents share is read at its borders only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, drop

WINDOW, EDGE = 35, 8
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE, _PART = 24, 1 << 23  # bits for a word's place in the order of k-mers, and k-mers that are looked at together

_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, up to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(2 * n, 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Hashes:
    """Hashes of any run of a document's words from sums of its words' hashes times powers of a base."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n) * up[:n], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _smallest(grams: np.ndarray, span: int) -> np.ndarray:
    """Where the smallest (the first of equals) of each ``span`` neighbours is."""
    place = np.uint64((1 << _PLACE) - 1)
    low = (grams & ~place) | np.arange(len(grams)).astype(np.uint64)
    wide = 1
    while 2 * wide <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < span:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    return (low & place).astype(np.int64)


def edges_of(words: list[bytes], window: int = WINDOW, k: int = EDGE):
    """Arrays (edge, context, first window, last window) of a document's kept edges; None if it has no window."""
    n = len(words)
    if n < window:
        return None
    h, at = Hashes(words), np.arange(n - k + 1)
    grams = h.runs(at, at + k)
    span = window - k + 1
    parts = range(0, len(grams) - span + 1, _PART)  # places are told within a part, so that they fit their bits
    chosen = np.concatenate([_smallest(grams[i : i + _PART + span - 1], span) + i for i in parts])
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    last = np.append(first[1:], len(chosen)) - 1
    where = chosen[first]
    context = h.runs(first, last + window) + (where - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return grams[where], context, first, last


_EDGES = pa.schema([("key", pa.int64()), ("edge", pa.int64()), ("context", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _edge_rows(batches):
    for batch in batches:
        keys, found = batch.column(0).to_pylist(), []
        for key, text in zip(keys, batch.column(1)):
            if (e := edges_of(words_of(text.as_py()))) is not None:
                found.append((np.full(len(e[0]), key, np.int64), *e))
        if found:
            cols = [np.concatenate(c) for c in zip(*found)]
            arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(f.type) for c, f in zip(cols, _EDGES)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_EDGES)


_WINDOWS = pa.schema([("key", pa.int64()), ("edge", pa.int64()), ("content", pa.int64()), ("first", pa.int32())])


def _window_rows(batches):
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            h = Hashes(words_of(row["text"]))
            starts = np.concatenate([np.arange(b["first"], b["last"] + 1) for b in row["branches"]])
            edge = np.concatenate([np.full(b["last"] + 1 - b["first"], b["edge"], np.int64) for b in row["branches"]])
            content = h.runs(starts, starts + WINDOW).view(np.int64)
            found.append((np.full(len(starts), row["key"], np.int64), edge, content, starts.astype(np.int32)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], schema=_WINDOWS)


_KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
)


def keep(words: list[bytes], spans: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """Which words stay, given ranges (first, last) of repeated windows."""
    cover = np.zeros(len(words) + 1, np.int64)
    if spans:
        first, last = np.array(spans, np.int64).T
        np.add.at(cover, first, 1)
        np.add.at(cover, last + window, -1)
    return np.cumsum(cover[:-1]) == 0


def _kept_rows(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            words = words_of(row["text"])
            stay = keep(words, [(s["first"], s["last"]) for s in row["spans"] or ()])
            kept = b" ".join(words[i] for i in np.flatnonzero(stay).tolist())
            out.append((row["doc_id"], len(words), len(words) - int(stay.sum()), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEPT)], schema=_KEPT)


def compact(settled: DataFrame) -> DataFrame:
    """Neighbouring nonbranching edges of a source as one path: (key, first, last)."""
    source = Window.partitionBy("key").orderBy("first")
    starts = F.coalesce(F.lag("last").over(source) + 1 < F.col("first"), F.lit(True))
    runs = settled.withColumn("new", starts.cast("int")).withColumn("path", F.sum("new").over(source))
    return runs.groupBy("key", "path").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("path")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``texts(key, doc_id, text)`` -> (key, first, last): ranges of repeated windows."""
    edges = cut(texts.select("key", "text").mapInArrow(_edge_rows, "key long, edge long, context long, first int, last int"), "edges")
    degree = edges.groupBy("edge").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
    degree = degree.filter("n > 1").select("edge", (F.col("lo") < F.col("hi")).alias("branches"))
    repeated = cut(edges.join(degree, "edge").select("key", "edge", "context", "first", "last", "branches"), "repeated")
    drop(edges)
    branching = repeated.filter("branches").drop("branches")
    contexts = branching.groupBy("edge", "context").agg(F.count("*").alias("m"), F.min(F.struct("key", "first", "last")).alias("one"))
    contexts = cut(contexts, "contexts")
    settled = branching.join(contexts.filter("m > 1").select("edge", "context"), ["edge", "context"], "left_semi")
    sure = repeated.filter("not branches").select("key", "first", "last").union(settled.select("key", "first", "last"))
    paths = compact(sure)
    open_edges = contexts.filter("m = 1").select("edge").distinct()
    borders = contexts.join(open_edges, "edge", "left_semi").select("edge", "one.*")
    borders = borders.groupBy("key").agg(F.collect_set(F.struct("edge", "first", "last")).alias("branches"))
    at_borders = texts.join(borders, "key").select("key", "doc_id", "text", "branches")
    windows = cut(at_borders.mapInArrow(_window_rows, "key long, edge long, content long, first int"), "windows")
    twice = windows.groupBy("edge", "content").count().filter("count > 1").select("edge", "content")
    found = windows.join(twice, ["edge", "content"]).select("key", "first", F.col("first").alias("last"))
    return paths.unionByName(found)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): rows equal in both share a key; they also share their windows' fate."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 of the words left, joined by one space.

    Words are parted at ASCII white space and compared as they are. Null, empty and short texts (fewer words than a
    window) lose nothing; their hash is that of their words. A repeated row repeats all of its windows, so both lose
    them. Null doc_ids are allowed; other columns are ignored; an empty table gives no rows.
    """
    texts = keyed(docs)
    spans = repeated_spans(texts).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = texts.join(spans, "key", "left").select("key", "doc_id", "text", "spans")
    return joined.mapInArrow(_kept_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")
