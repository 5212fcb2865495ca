"""Phrase collocations from sorted count streams.

A task reads texts in chunks of bounded size, numbers the chunk's words in byte order and counts its word sequences by
sorting packed numbers. What leaves the task are streams: for each language and bucket the chunk's different sequences of each
length in prefix order with their counts, compressed. A bucket's streams are merged and summed in one task; a sequence meets there
once per chunk at most, so that no frequent word or phrase makes a bucket large.

The sums that reach the smallest count are kept in two layouts: in prefix order, where a candidate finds its left part and
the longer candidates that begin with it, and in suffix order, where it finds its right part and those that end with it.
Each lookup is a merge join of two sorted streams in lockstep. Every part of a candidate occurs at least as often as the candidate, so
none is missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, drop, releasing

LONGEST, LEAST, MOST, COVERED, SCALE = 3, 10, 2000, 50, 1_000_000
UNKNOWN = "und"
#: Bytes of text counted at once: fewer than 2**21 different words, so that three numbers fit a long.
CHUNK = 8_000_000

_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: blank, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2


def _slices(text: bytes, size: int):
    """(part, words to skip): a long text in parts cut before a separator; each begins with the last words of the one before."""
    start = begin = skip = 0
    while start < len(text):
        end = min(len(text), start + size)
        while end < len(text) and not _KIND[text[end]]:
            end += 1
        yield text[begin:end], skip
        start, begin, skip = end, end, 0
        while skip < LONGEST - 1 and begin > 0:  # back over separators and a word
            at = begin
            while at > 0 and _KIND[text[at - 1]] == 1:
                at -= 1
            if at == 0 or _KIND[text[at - 1]] == 2:
                break
            while at > 0 and not _KIND[text[at - 1]]:
                at -= 1
            begin, skip = at, skip + 1


def words_of(data: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts joined by line ends: each word's number, the words by number (byte order), and each word's piece."""
    raw = np.frombuffer(data.lower(), np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = np.ascontiguousarray(raw[inside])
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order), piece


def sequences(ids: np.ndarray, piece: np.ndarray, base: int, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Different sequences of n words within pieces, in prefix order, as rows of numbers, and their counts.

    ``skip``: the first words belong to the part before; only sequences that end after them count.
    """
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros((0, n), np.int64), np.zeros(0, np.int64)
    packed = np.zeros(m, np.int64)
    for k in range(n):
        packed = packed * base + ids[k : k + m]
    packed = packed[(piece[:m] == piece[n - 1 :]) & (np.arange(n - 1, n - 1 + m) >= skip)]
    found, counts = np.unique(packed, return_counts=True)
    rows = np.empty((len(found), n), np.int64)
    for k in range(n - 1, -1, -1):
        found, rows[:, k] = np.divmod(found, base)
    return rows, counts


def _blob(parts: list[tuple[pa.Array, np.ndarray]]) -> bytes:
    """Streams one after another: their length, the phrases' lengths, the counts and the phrases' bytes, compressed."""
    sizes, letters = [], []
    for phrases, _ in parts:
        offsets = np.frombuffer(phrases.buffers()[1], np.int32)[phrases.offset : phrases.offset + len(phrases) + 1]
        sizes.append(np.diff(offsets).astype("<i4"))
        letters.append(memoryview(phrases.buffers()[2] or b"")[offsets[0] : offsets[-1]])
    sizes = np.concatenate(sizes)
    counts = np.concatenate([c for _, c in parts]).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(sizes).to_bytes(8, "little"), sizes.tobytes(), counts.tobytes(), *letters]))


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, "<i4", n, 8), np.frombuffer(raw, "<i8", n, 8 + 4 * n), raw[8 + 12 * n :]


_STREAM = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("words", pa.int64()), ("stream", pa.binary())])


def _streams(data: bytes, skip: int, lang: str, buckets: int):
    """A record batch of the chunk's streams."""
    ids, words, piece = words_of(data)
    if len(ids) <= skip:
        return
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    joined, counts, where = [], [], []
    for n in range(1, LONGEST + 1):
        rows, many = sequences(ids, piece, len(words), n, skip)
        mixed = np.zeros(len(rows), np.uint64)
        for k in range(n):
            mixed = (mixed ^ hashes[rows[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")  # within a bucket the prefix order stays
        parts = [words.take(pa.array(rows[order, k])) for k in range(n)]
        joined.append(pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if n > 1 else parts[0])
        counts.append(many[order]), where.append(bucket[order])
    cuts = [np.searchsorted(w, np.arange(buckets + 1)) for w in where]
    out = []
    for b in np.unique(np.concatenate(where)).tolist():
        spans = [(k, int(cuts[k][b]), int(cuts[k][b + 1])) for k in range(LONGEST)]
        out.append((b, _blob([(joined[k].slice(i, j - i), counts[k][i:j]) for k, i, j in spans if i < j])))
    total = [len(ids) - skip] + [0] * (len(out) - 1)
    arrays = [pa.array([lang] * len(out), pa.string()), pa.array([b for b, _ in out], pa.int32()), pa.array(total, pa.int64()), pa.array([s for _, s in out], pa.binary())]
    yield pa.RecordBatch.from_arrays(arrays, schema=_STREAM)


def _counted(buckets: int, chunk: int):
    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py()
                data = data.encode("utf-8", "surrogatepass") if data else b""
                if len(data) >= chunk:
                    for part, skip in _slices(data, chunk):
                        yield from _streams(part, skip, lang, buckets)
                    continue
                if size + len(data) + 1 > chunk:
                    for key in held:
                        yield from _streams(b"\n".join(held[key]), 0, key, buckets)
                    held, size = {}, 0
                if data:
                    held.setdefault(lang, []).append(data)
                    size += len(data) + 1
        for key in held:
            yield from _streams(b"\n".join(held[key]), 0, key, buckets)

    return releasing(run)


def _merged(least: int):
    """A bucket's streams summed: sequences of at least ``least`` occurrences, and a row without a phrase for all words."""

    def run(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        opened = [_open(s) for s in table["stream"].to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([o[0] for o in opened]), dtype=np.int64)])
        letters = pa.py_buffer(b"".join(o[2] for o in opened))
        phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), letters])
        coded = phrases.dictionary_encode()
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        which = coded.indices.to_numpy()[order]
        first = np.flatnonzero(np.diff(which, prepend=-1))
        sums = np.add.reduceat(np.concatenate([o[1] for o in opened])[order], first)
        kept = np.flatnonzero(sums >= least)
        found = coded.dictionary.take(pa.array(kept)).cast(pa.binary()).cast(pa.string())
        total = int(pc.sum(table["words"]).as_py())
        return pa.table({
            "lang": pa.array([lang] * (len(kept) + 1), pa.string()),
            "phrase": pa.concat_arrays([found, pa.array([None], pa.string())]),
            "f": pa.array(np.append(sums[kept], total).astype(np.int64)),
        })

    return run


def counts(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """``docs(lang, text)`` -> (lang, phrase, f): sequences of one to three words with f >= least; null phrases hold the words."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    streams = rows.mapInArrow(_counted(buckets, chunk), "lang string, bucket int, words long, stream binary")
    return streams.groupBy("lang", "bucket").applyInArrow(_merged(least), "lang string, phrase string, f long")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """``docs(lang, text, ...)`` -> lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases.

    A-Z are lower-cased, texts end pieces at ``[.,;:!?`` and line ends, words are parted at blanks and tabs. A phrase of two
    or three words is a candidate from ``least`` occurrences on; its score is the lowest of its cuts', and it is dropped
    where a longer candidate that holds its words has at least half of its occurrences. Null languages are ``und``; null,
    empty and blank texts have no words; very long texts are counted part by part, whole; repeated rows count again; ties in
    score go by occurrences and then by the phrase's bytes. An empty table, or a language without candidates, gives no rows;
    other columns are ignored.
    """
    table = cut(counts(docs, least, chunk), "counts")
    totals = table.filter("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    grams = table.filter("phrase is not null").withColumn("size", F.size(F.split("phrase", " ")))
    last = F.substring_index("phrase", " ", -1)
    first = F.substring_index("phrase", " ", 1)
    tail = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    head = F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)")
    candidates = grams.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size")
    # the cut after one word, and for three words the one after two
    one = candidates.select("*", F.lit(1).alias("k"), first.alias("left"), tail.alias("right"))
    two = candidates.filter("size = 3").select("*", F.lit(2).alias("k"), head.alias("left"), last.alias("right"))
    prefix = grams.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    suffix = grams.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = one.union(two).join(prefix.hint("merge"), ["lang", "left"]).join(suffix.hint("merge"), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"_a": exact("a"), "_l": exact("l"), "_r": exact("r")})
    cuts = cuts.withColumn("score", F.expr(f"({SCALE} * (_a * _a)) div (_l * _r)"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*")
    extended = candidates.filter("size = 3").select("lang", head.alias("phrase"), "a").union(candidates.filter("size = 3").select("lang", tail, "a"))
    extended = extended.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = lowest.join(extended.hint("merge"), ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {COVERED} * a")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = open_.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
g AS (
  SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3]) AS k)
), f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS p, f AS a FROM f WHERE size > 1 AND f >= {LEAST}),
cuts AS (
  SELECT lang, phrase, size, a, p, k, array_to_string(p[1:k], ' ') AS lhs, array_to_string(p[k + 1:], ' ') AS rhs
  FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lhs JOIN f y ON y.lang = c.lang AND y.phrase = rhs
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(p[1:2], ' ') AS phrase, a FROM c WHERE size = 3
    UNION ALL SELECT lang, array_to_string(p[2:3], ' '), a FROM c WHERE size = 3) GROUP BY ALL
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, l, r, score
  FROM lowest s LEFT JOIN longer x ON x.lang = s.lang AND x.phrase = s.phrase WHERE x.a IS NULL OR 100 * x.a < {COVERED} * s.a
)
SELECT q.lang, rank, q.phrase, q.a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked q JOIN t ON t.lang = q.lang WHERE rank <= {MOST}
"""
