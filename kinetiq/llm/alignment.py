"""Token alignment between two tokenizers, with counts of id pairs behind minimal perfect hashes.

A text's tokens under both tokenizers cover the same bytes. Neither merges across a space between two characters that are
not white space, so texts are cut there and each different piece is encoded and aligned once per process.

The first pass counts, per task, in how many of its documents each pair of linked ids occurs. The different pairs are dealt
into shards, and each shard gets a minimal perfect hash function (hash and displace) and its keys by index. A shard's counts
are dense vectors by that index: one for each few tasks, summed up a tree until one is left. The second pass aligns the
documents again and looks counts up: index, verify the key, read. Shards are broadcast in blocks of at most ``BLOCK`` pairs
(twelve bytes each, and a displacement for every three); a corpus with more different pairs takes a pass over the documents for each block.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .store import cut, drop, releasing

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Keys of a shard and of a hash bucket as a mean, vectors summed at a time, pairs broadcast at once, pieces remembered.
SHARD, BUCKET, FAN, BLOCK, PIECES = 16_384, 3, 16, 4_000_000, 400_000
BORDER = regex.compile(r"(?<=\S) (?=\S)")
UNCUT = f"^ | $|{tokens.BESIDE_WHITE}"
BITS = 32  # of a pair's code: the id of B in the low half


def different(x: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def align(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of texts one after another, whose tokens have these ids and bytes and which end at ``ends``: the pair codes of all
    overlapping tokens, how many of them and how many groups each text has, and the groups as text.

    Between any two neighbouring token ends there is one token of either kind, and two tokens that overlap do so in one such stretch.
    """
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    bounds = different(np.concatenate((a_ends, b_ends)))
    starts = np.concatenate(([0], bounds[:-1]))
    codes = a[np.searchsorted(a_ends, starts, "right")] << BITS | b[np.searchsorted(b_ends, starts, "right")]
    links = np.diff(np.searchsorted(bounds, ends, "right"), prepend=0)
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)

    def listed(at: np.ndarray, ids) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], at)).astype(np.int32)), ids)

    sides = [pc.binary_join(listed(np.searchsorted(e, both, "right"), pa.array(ids).cast(pa.string())), ",") for e, ids in ((a_ends, a), (b_ends, b))]
    per_text = np.searchsorted(both, ends, "right")
    texts = pc.binary_join(listed(per_text, pc.binary_join_element_wise(*sides, "|")), ";").to_pylist()
    return codes, links, np.diff(per_text, prepend=0), texts


class Aligner:
    """Aligns the different pieces of texts; what it remembers is bounded and starts anew beyond that."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

        self.a = tokens.Encoder(a_path or public_tokenizers.path(A_FILE))
        self.a.library.encode_special_tokens = True  # their strings are ordinary text
        self.b = SentencePieceProcessor(model_file=b_path or public_tokenizers.path(B_FILE))
        letter = {c: b for b, c in tokens.byte_letters().items()}
        vocabulary = self.a.library.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            a_bytes[k] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        piece = lambda k: bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()
        self.bytes = a_bytes, [piece(k) for k in range(self.b.get_piece_size())]
        self.sizes = [np.array([len(t) for t in side], np.int64) for side in self.bytes]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.codes, self.ends = array("q"), array("q", [0])
        self.shape = array("q")  # per piece: tokens of A and of B, groups; -1 where the bytes differ

    def _learn(self, pieces: list[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        for at in range(0, len(new), 65536):
            self._align(new[at : at + 65536])

    def _align(self, new: list[str]) -> None:
        spaced = [" " + p for p in new]
        found = [e.ids for e in self.a.library.encode_batch_fast(spaced, add_special_tokens=False)], self.b.encode(new, num_threads=1)
        many = [np.fromiter(map(len, f), np.int64, len(new)) for f in found]
        ids = [np.fromiter(chain.from_iterable(f), np.int64, int(n.sum())) for f, n in zip(found, many)]
        sizes = [w[i] for w, i in zip(self.sizes, ids)]
        want = pc.binary_length(pa.array(spaced)).to_numpy().astype(np.int64)
        upto = [np.concatenate(([0], np.cumsum(z)))[np.concatenate(([0], np.cumsum(n)))] for z, n in zip(sizes, many)]
        good = (np.diff(upto[0]) == want) & (np.diff(upto[1]) == want)
        bytes_of = lambda k, row: b"".join([self.bytes[k][i] for i in row])
        if not good.all() or any(bytes_of(k, i.tolist()) != "".join(spaced).encode("utf-8", "surrogatepass") for k, i in enumerate(ids)):
            whole = [t.encode("utf-8", "surrogatepass") for t in spaced]
            good &= np.array([bytes_of(0, x) == t == bytes_of(1, y) for x, y, t in zip(*found, whole)])
        kept = [np.repeat(good, n) for n in many]
        codes, links, groups, texts = align(ids[0][kept[0]], sizes[0][kept[0]], ids[1][kept[1]], sizes[1][kept[1]], np.cumsum(want[good]))
        shape, ends = np.full((len(new), 3), -1, np.int64), np.zeros(len(new), np.int64)
        shape[good] = np.stack((many[0][good], many[1][good], groups), axis=1)
        ends[good] = links
        first = len(self.texts)
        self.known.update(zip(new, range(first, first + len(new))))
        text = iter(texts)
        self.texts += [next(text) if g else "" for g in good.tolist()]
        self.ends.frombytes((np.cumsum(ends) + len(self.codes)).tobytes())
        self.codes.frombytes(codes.tobytes())
        self.shape.frombytes(shape.tobytes())

    def batch(self, column: pa.Array):
        """Some texts at a time: ``Part`` objects."""
        texts = pc.fill_null(column, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        which = np.cumsum(sizes, dtype=np.int64) // tokens.SLICE
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(which)) + 1):
            if len(part):
                if len(self.texts) > PIECES:
                    self._clear()
                yield self._part(texts.slice(int(part[0]), len(part)))

    def _part(self, texts: pa.Array) -> Part:
        odd = np.flatnonzero(pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False))
        uncut = [BORDER.split(texts[int(i)].as_py()) for i in odd]
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        first, last = offsets[:-1].copy(), offsets[1:].copy()
        first[odd] = offsets[-1] + np.cumsum([0, *map(len, uncut)])[:-1]
        last[odd] = first[odd] + np.array([*map(len, uncut)], np.int64)
        flat = pa.concat_arrays([parts.flatten(), pa.array([p for pieces in uncut for p in pieces], texts.type)])
        # an empty text and the pieces of texts that are cut otherwise take no part
        empty = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
        last[empty] = first[empty]
        used = np.zeros(len(flat) + 1, np.int64)
        np.add.at(used, first, 1), np.add.at(used, last, -1)
        used = np.cumsum(used[:-1]) > 0
        coded = pc.if_else(pa.array(used), flat, pa.scalar(None, flat.type)).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        self._learn(pieces)
        numbers = np.fromiter((self.known[p] for p in pieces), np.int64, len(pieces))
        return Part(self, numbers, pc.fill_null(coded.indices, 0).to_numpy(), used, first, last)


class Part:
    """Some texts' pieces: ``numbers`` of the different ones, ``at`` of each occurrence, ``first`` and ``last`` by text."""

    def __init__(self, aligner: Aligner, numbers: np.ndarray, at: np.ndarray, used: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.aligner, self.numbers, self.at, self.first, self.last = aligner, numbers, at, first, last
        shape = np.frombuffer(aligner.shape, np.int64).reshape(-1, 3)[numbers] if len(numbers) else np.zeros((0, 3), np.int64)
        self.used = used
        wrong = self.sums(np.where(shape[:, 0] < 0, 1, 0)) > 0
        self.last = np.where(wrong, first, last)  # such texts have no tokens
        self.sizes = np.maximum(shape, 0)
        ends = np.frombuffer(aligner.ends, np.int64)
        self.many = ends[numbers + 1] - ends[numbers]
        starts = np.repeat(ends[numbers] - np.concatenate([[0], np.cumsum(self.many)[:-1]]), self.many) if len(numbers) else np.zeros(0, np.int64)
        self.codes = np.frombuffer(aligner.codes, np.int64)[starts + np.arange(len(starts))] if len(starts) else np.zeros(0, np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value of each piece over its occurrences."""
        each = np.where(self.used, values[self.at], 0) if len(values) else np.zeros(len(self.at), np.int64)
        upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        return upto[self.last] - upto[self.first]

    def by_piece(self, values: np.ndarray) -> np.ndarray:
        """Per piece, the sum of a value of each of its links."""
        upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        ends = np.cumsum(self.many)
        return upto[ends] - upto[ends - self.many]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Different codes and how many of the texts hold each."""
        spans = self.last - self.first
        text = np.repeat(np.arange(len(spans)), spans)
        place = np.repeat(self.first - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(len(text))
        held = different(text * max(1, len(self.numbers)) + self.at[place])
        text, piece = np.divmod(held, max(1, len(self.numbers)))
        many = self.many[piece] if len(piece) else np.zeros(0, np.int64)
        begins = np.cumsum(self.many) - self.many
        code, rank = np.unique(self.codes, return_inverse=True)
        link = np.repeat(begins[piece] - (np.cumsum(many) - many), many) + np.arange(int(many.sum())) if len(piece) else np.zeros(0, np.int64)
        pairs = different(np.repeat(text, many) * max(1, len(code)) + rank[link])
        return code, np.bincount(pairs % max(1, len(code)), minlength=len(code))

    def digests(self) -> list[str]:
        texts, own = self.aligner.texts, self.numbers[self.at].tolist() if len(self.numbers) else []
        return [
            hashlib.sha256(";".join([texts[k] for k in own[i:j]]).encode()).hexdigest() if i < j else ""
            for i, j in zip(self.first.tolist(), self.last.tolist())
        ]


_ALIGNERS: dict = {}


def aligner(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    """This process's aligner; Python workers live longer than a task, and so does what it remembers."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def mixed(codes: np.ndarray, seed: int) -> np.ndarray:
    h = codes.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def shard_hash(codes: np.ndarray) -> np.ndarray:
    return (mixed(codes, 1) >> np.uint64(33)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash function of different codes, with the keys by index to verify by."""

    def __init__(self, seed: int, shift: np.ndarray, keys: np.ndarray):
        self.seed, self.shift, self.keys = seed, shift, keys

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        for seed in range(10, 1 << 20, 10):
            shift, place = np.zeros(max(1, -(-n // BUCKET)), np.int32), np.full(n, -1, np.int64)
            if cls._displace(keys, seed, shift, place):
                by_index = np.empty(n, np.int64)
                by_index[place] = keys
                return cls(seed, shift, by_index)
        raise ValueError("keys are not different")

    @staticmethod
    def _displace(keys, seed, shift, place) -> bool:
        """Bucket by bucket, larger ones first: the first displacement that puts all keys on free places."""
        n, tries = len(keys), np.arange(1, 513, dtype=np.uint64)
        bucket = (mixed(keys, seed) % np.uint64(len(shift))).astype(np.int64)
        start, step = mixed(keys, seed + 1), mixed(keys, seed + 2) | np.uint64(1)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(shift))
        begins = np.cumsum(sizes) - sizes
        free = np.ones(n, bool)
        ones = []
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[begins[b] : begins[b] + sizes[b]]
            if len(own) < 2:
                ones += own.tolist()
                continue
            for low in range(0, 1 << 20, len(tries)):
                at = ((start[own] + (tries + np.uint64(low))[:, None] * step[own]) % np.uint64(n)).astype(np.int64)
                good = free[at].all(axis=1)
                s = np.sort(at[good], axis=1)
                different = np.flatnonzero((s[:, 1:] != s[:, :-1]).all(axis=1))
                if len(different):
                    k = np.flatnonzero(good)[different[0]]
                    shift[b], place[own], free[at[k]] = low + k + 1, at[k], False
                    break
            else:
                return False
        left = np.flatnonzero(free)  # a key alone in its bucket takes any place: that place, negative
        place[ones] = left
        shift[bucket[ones]] = -1 - left
        return True

    def index(self, codes: np.ndarray) -> np.ndarray:
        """Each code's index, -1 for codes that are not keys."""
        n = np.uint64(len(self.keys))
        shift = self.shift[(mixed(codes, self.seed) % np.uint64(len(self.shift))).astype(np.int64)].astype(np.int64)
        step = mixed(codes, self.seed + 2) | np.uint64(1)
        found = ((mixed(codes, self.seed + 1) + np.maximum(shift, 0).astype(np.uint64) * step) % n).astype(np.int64)
        found = np.where(shift < 0, -1 - shift, found)
        return np.where(self.keys[found] == codes, found, -1)


def _counted(paths):
    def run(batches):
        codes, docs, held = [], [], 0
        part = TaskContext.get().partitionId()

        def rows():
            found, at = np.unique(np.concatenate(codes), return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, at, np.concatenate(docs))
            for i in range(0, len(found), 65536):
                c = found[i : i + 65536]
                cols = [np.full(len(c), part, np.int32), c, shard_hash(c), sums[i : i + 65536]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["part", "code", "h", "docs"])

        for batch in batches:
            for some in aligner(*paths).batch(batch.column(0)):
                c, d = some.documents()
                codes.append(c), docs.append(d)
                held += len(c)
                if held > BLOCK:
                    yield from rows()
                    codes, docs, held = [], [], 0
        if held:
            yield from rows()

    return releasing(run)


def _function(table: pa.Table) -> pa.Table:
    f = PerfectHash.of(np.sort(table["code"].to_numpy()))
    return pa.table({
        "shard": table["shard"].slice(0, 1), "n": pa.array([len(f.keys)], pa.int64()), "seed": pa.array([f.seed], pa.int64()),
        "shift": pa.array([f.shift.tobytes()], pa.binary()), "keys": pa.array([f.keys.tobytes()], pa.binary()),
    })


def _opened(row: dict) -> PerfectHash:
    return PerfectHash(row["seed"], np.frombuffer(row["shift"], np.int32), np.frombuffer(row["keys"], np.int64))


def _vector(shard, leaf, values: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "leaf": pa.array([leaf], pa.int64()), "counts": pa.array([values.astype(np.int64).tobytes()], pa.binary())})


def _dense(table: pa.Table, function: pa.Table) -> pa.Table:
    row = function.to_pylist()[0]
    values = np.zeros(row["n"], np.int64)
    if len(table):
        np.add.at(values, _opened(row).index(table["code"].to_numpy()), table["docs"].to_numpy())
    return _vector(row["shard"], row["leaf"], values)


def _summed(table: pa.Table) -> pa.Table:
    values = sum(np.frombuffer(v, np.int64) for v in table["counts"].to_pylist())
    return _vector(table["shard"][0].as_py(), table["up"][0].as_py(), values)


def _best(batches):
    for batch in batches:
        for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, at = np.unique(np.frombuffer(keys, np.int64) >> BITS, return_inverse=True)
            top = np.zeros(len(a), np.int64)
            np.maximum.at(top, at, np.frombuffer(counts, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(top)], names=["a", "top"])


def pair_counts(docs: DataFrame, paths=(None, None)) -> DataFrame:
    """``docs(text)`` -> a row per shard: its function (n, seed, shift, keys) and ``counts``, in how many documents a pair is linked."""
    partial = cut(docs.select("text").mapInArrow(_counted(paths), "part int, code long, h long, docs long"), "partial")
    keys = partial.select("code", "h").distinct()
    total, last = partial.select(F.count_distinct("code"), F.max("part")).first()
    shards = max(1, -(-total // SHARD))
    shard = F.pmod("h", F.lit(shards)).alias("shard")
    functions = keys.select("code", shard).groupBy("shard").applyInArrow(_function, "shard long, n long, seed long, shift binary, keys binary")
    functions = cut(functions, "functions")
    leaves = (last or 0) // FAN + 1
    rows = partial.select("code", "docs", shard, F.floor(F.col("part") / FAN).cast("long").alias("leaf"))
    each = functions.withColumn("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long"))))
    schema = "shard long, leaf long, counts binary"
    vectors = rows.groupBy("shard", "leaf").cogroup(each.groupBy("shard", "leaf")).applyInArrow(_dense, schema)
    while leaves > 1:
        leaves = -(-leaves // FAN)
        vectors = vectors.withColumn("up", F.floor(F.col("leaf") / FAN).cast("long")).groupBy("shard", "up").applyInArrow(_summed, schema)
    found = cut(functions.join(vectors.select("shard", "counts"), "shard"), "pair_counts")
    drop(partial), drop(functions)
    return found


class Table:
    """The functions and counts of some shards, as broadcast: look-ups by code."""

    def __init__(self, shards: int, rows: list[dict]):
        self.shards = shards
        self.numbers = np.array([r["shard"] for r in rows], np.int64)
        self.functions = [_opened(r) for r in rows]
        self.counts = [np.frombuffer(r["counts"], np.int64) for r in rows]

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        """Counts of codes, 0 for those that are in none of these shards."""
        out, shard = np.zeros(len(codes), np.int64), shard_hash(codes) % self.shards
        order = np.argsort(shard, kind="stable")
        low, high = np.searchsorted(shard[order], [self.numbers, self.numbers + 1])
        for f, counts, i, j in zip(self.functions, self.counts, low.tolist(), high.tolist()):
            if i < j:
                at = f.index(codes[order[i:j]])
                out[order[i:j]] = np.where(at < 0, 0, counts[at])
        return out


_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _looked_up(paths, table, best):
    def run(batches):
        for batch in batches:
            at = 0
            for some in aligner(*paths).batch(batch.column(1)):
                code, rank = np.unique(some.codes, return_inverse=True)
                counts = table.value.look_up(code) if table else np.zeros(len(code), np.int64)
                top = best.value[code >> BITS] if table else counts
                tops = ((counts == top) & (counts > 0)).astype(np.int64)
                sums = [some.sums(some.sizes[:, k]) for k in range(3)]
                sums += [some.sums(v) for v in (some.many, some.by_piece(tops[rank]), some.by_piece(counts[rank]))]
                ids = batch.column(0).slice(at, len(some.first))
                at += len(some.first)
                arrays = [ids, *(pa.array(s) for s in sums), pa.array(some.digests(), pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split(" ")[0] for f in _SCHEMA.split(", ")])

    return releasing(run)


def _blocks(sizes: list[tuple[int, int]], most: int):
    held, total = [], 0
    for shard, n in sizes:
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(shard)
        total += n
    if held:
        yield held


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Space and text are encoded by A, the text by B (which adds the space), without special tokens. Null and empty texts, and
    those whose tokens' bytes are not those of space and text, have no tokens: zeros and an empty digest. Ties for a pair's
    highest count all count; repeated rows are documents of their own; very long texts are aligned whole, piece by piece; a
    null doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    spark, paths = docs.sparkSession, (a_path, b_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = pair_counts(rows, paths)
    sizes = [(r[0], r[1]) for r in pairs.select("shard", "n").orderBy("shard").collect()]  # a row per shard, bounded by both vocabularies
    tops = pairs.select("keys", "counts").mapInArrow(_best, "a long, top long").groupBy("a").agg(F.max("top").alias("top")).toArrow()
    best = np.zeros(1 + max(tops["a"].to_pylist(), default=0), np.int64)
    best[tops["a"].to_numpy()] = tops["top"].to_numpy()
    best = spark.sparkContext.broadcast(best)
    passes = []
    for held in _blocks(sizes, block):
        part = pairs.filter(F.col("shard").between(held[0], held[-1])).toArrow().to_pylist()
        table = spark.sparkContext.broadcast(Table(1 + sizes[-1][0], part))
        passes.append(rows.mapInArrow(_looked_up(paths, table, best), _SCHEMA))
    if len(passes) < 2:
        return passes[0] if passes else rows.mapInArrow(_looked_up(paths, None, None), _SCHEMA)
    fixed = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    every = passes[0].withColumn("first", F.lit(1))
    for more in passes[1:]:
        every = every.union(more.withColumn("first", F.lit(0)))
    # documents equal in all of this have the same tokens, so each of them has an equal share of the sums
    summed = every.groupBy(*fixed).agg(F.sum("first").alias("rows"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    shared = summed.withColumns({c: F.expr(f"{c} div rows") for c in ("n_best", "count_sum")})
    copies = shared.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return copies.select(*(f.split(" ")[0] for f in _SCHEMA.split(", ")))
