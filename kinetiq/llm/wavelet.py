"""Token ids in wavelet-matrix files: one compressed file per shard that answers access, count and occurrence lookups.

A shard holds whole documents in ascending doc_id order. Its ids are stored as bit-planes, the highest bit first; each
plane is followed by the ids stably parted by that bit. With the ones counted per block of 512 bits, every query is a
rank or select per plane; planes are compressed in parts, so that a lookup unpacks one part of each. Shards are written by the tasks of a range-partitioned table and found again by Spark's binary
file source.
"""

from __future__ import annotations

import json
import zlib
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, new_path, releasing
from .tokens import encoder

MAGIC = b"KQWM0001"
BLOCK, PLANE_PART = 512, 1 << 14  # bits that share a count of ones; bytes of a plane that are compressed together
SHARD_TOKENS = 1 << 20
END_ID = 0


def part_planes(ids: np.ndarray, levels: int):
    """The bit-planes as boolean arrays with the zeros of each."""
    for shift in range(levels - 1, -1, -1):
        bit = (ids >> ids.dtype.type(shift)).astype(np.uint8) & 1
        bit = bit.view(bool)
        low, high = np.flatnonzero(~bit), np.flatnonzero(bit)  # on mixed bits places are several times faster than masks
        yield bit, len(low)
        ids = np.concatenate((ids.take(low), ids.take(high)))


def join_planes(planes: list[np.ndarray], zeros: list[int], n: int, dtype=np.uint16) -> np.ndarray:
    """All ids in order: parting is undone plane by plane from the lowest bit up."""
    ids = np.zeros(n, dtype)
    for level, (bit, zero) in enumerate(zip(reversed(planes), reversed(zeros))):
        up = np.empty(n, dtype)
        up[np.flatnonzero(~bit)] = ids[:zero]
        up[np.flatnonzero(bit)] = ids[zero:] | dtype(1 << level)
        ids = up
    return ids


def encode_shard(doc_ids: list, lengths: list[int], ids: np.ndarray, **meta) -> bytes:
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    work = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1).compress
    blocks, zeros = [], []

    def add(array):
        blocks.append(pack(array.tobytes()))

    add(np.array([d or 0 for d in doc_ids], "<i8"))
    add(np.array([d is None for d in doc_ids], np.uint8))
    add(np.array(lengths, "<i8"))
    for bit, zero in part_planes(work, levels):
        zeros.append(zero)
        packed = np.packbits(bit, bitorder="little")
        whole = np.zeros(-(-len(bit) // BLOCK) * (BLOCK // 8), np.uint8)
        whole[: len(packed)] = packed
        ones = np.bitwise_count(whole.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        for at in range(0, len(packed), PLANE_PART):
            add(packed[at : at + PLANE_PART])
        add(np.concatenate(([0], np.cumsum(ones))).astype("<u4"))
    head = json.dumps(
        meta | {"n": len(ids), "docs": len(doc_ids), "levels": levels, "zeros": zeros, "blocks": [len(b) for b in blocks]}
    ).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *blocks])


class Shard:
    """A shard file's content. Planes are unpacked when first needed, so a lookup reads what it touches."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        size = int.from_bytes(content[8:12], "little")
        self.head = json.loads(content[12 : 12 + size])
        ends = np.cumsum([12 + size, *self.head["blocks"]]).tolist()
        self.raw = [memoryview(content)[i:j] for i, j in pairwise(ends)]
        self.n, self.levels, self.zeros = self.head["n"], self.head["levels"], self.head["zeros"]
        self.parts = -(-self.n // (8 * PLANE_PART))
        self.unpacked: dict[int, np.ndarray] = {}
        self.decompress = zstandard.ZstdDecompressor().decompress

    def _block(self, k: int, dtype) -> np.ndarray:
        if k not in self.unpacked:
            self.unpacked[k] = np.frombuffer(self.decompress(self.raw[k]), dtype)
        return self.unpacked[k]

    def doc_ids(self) -> list:
        return [None if null else d for d, null in zip(self._block(0, "<i8").tolist(), self._block(1, np.uint8))]

    def lengths(self) -> list[int]:
        return self._block(2, "<i8").tolist()

    def _ones(self, level: int) -> np.ndarray:
        return self._block(3 + (level + 1) * (self.parts + 1) - 1, "<u4")

    def _bits(self, level: int, at: int, end: int) -> np.ndarray:
        """Bits that lie in one block, and so in one part of the plane."""
        if at >= end:
            return np.zeros(0, np.uint8)
        part, at = divmod(at, 8 * PLANE_PART)
        end -= 8 * PLANE_PART * part
        packed = self._block(3 + level * (self.parts + 1) + part, np.uint8)[at // 8 : -(-end // 8)]
        return np.unpackbits(packed, bitorder="little")[at % 8 : at % 8 + end - at]

    def rank1(self, level: int, at: int) -> int:
        block = at // BLOCK
        return int(self._ones(level)[block]) + int(self._bits(level, block * BLOCK, at).sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) such bit of a plane is."""
        ones = self._ones(level).astype(np.int64)
        counts = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(counts, k, side="right")) - 1
        inside = self._bits(level, block * BLOCK, min(self.n, (block + 1) * BLOCK))
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - counts[block]])

    def access(self, at: int) -> int:
        value = 0
        for level, zero in enumerate(self.zeros):
            bit, one = int(self._bits(level, at, at + 1)[0]), self.rank1(level, at)
            value, at = 2 * value + bit, zero + one if bit else at - one
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level, zero in enumerate(self.zeros):
            a, b = self.rank1(level, lo), self.rank1(level, hi)
            lo, hi = (zero + a, zero + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint16)
        planes = []
        for level in range(self.levels):
            at = 3 + level * (self.parts + 1)
            packed = b"".join(map(self.decompress, self.raw[at : at + self.parts]))
            planes.append(np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool))
        return join_planes(planes, self.zeros, self.n, np.uint16 if self.levels <= 16 else np.uint32)


def _put(fs, path: str, content: bytes) -> None:
    """A file appears whole or not at all; a task that runs again replaces it with the same bytes."""
    part = f"{path}.{TaskContext.get().taskAttemptId()}.part"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, path)


def _writer(folder: str, tokenizer: str | None, shard_tokens: int):
    def write(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        encode, part = encoder(tokenizer).batch, TaskContext.get().partitionId()
        held: list = [[], [], [], 0]
        number = 0

        def close():
            nonlocal held, number
            doc_ids, lengths, chunks, n = held
            name = f"shard-{part:06d}-{number:06d}.wm"
            content = encode_shard(doc_ids, lengths, np.concatenate(chunks), partition=part, shard=number)
            _put(fs, f"{base}/{name}", content)
            row = pa.RecordBatch.from_pydict({"partition": [part], "shard": [number], "n": [n]}, schema=MANIFEST)
            held, number = [[], [], [], 0], number + 1
            return row

        for batch in batches:
            docs = iter(batch.column(0).to_pylist())
            for ids, lengths in encode(batch.column(1), END_ID):
                ends, at = np.cumsum(lengths), 0
                while at < len(lengths):  # up to the document that fills the shard
                    start = ends[at] - lengths[at]
                    to = min(len(lengths), int(np.searchsorted(ends, start + shard_tokens - held[3])) + 1)
                    held[0] += islice(docs, to - at)
                    held[1] += lengths[at:to].tolist()
                    held[2].append(ids[start : ends[to - 1]])
                    held[3] += int(ends[to - 1] - start)
                    at = to
                    if held[3] >= shard_tokens:
                        yield close()
        if held[0]:
            yield close()

    return write


MANIFEST = pa.schema([("partition", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())])
_READ = pa.schema(
    [("partition", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def _read(batches):
    for batch in batches:
        for content in batch.column(0):
            shard = Shard(content.as_py())
            lengths = shard.lengths()
            data = memoryview(shard.ids().astype("<u4").tobytes())
            ends = np.cumsum([0, *lengths])
            crcs = [zlib.crc32(data[4 * i : 4 * j]) for i, j in pairwise(ends.tolist())]
            k = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard.head["partition"]] * k, pa.int32()),
                    pa.array([shard.head["shard"]] * k, pa.int32()),
                    pa.array(shard.doc_ids(), pa.int64()),
                    pa.array(ends[:-1], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                schema=_READ,
            )


def write_shards(docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS):
    """Encode every text and write shard files; returns the folder and the manifest ``(partition, shard, n)``.

    A null text is empty; every document gets the end id after its ids. Null ids come first, rows that repeat a doc_id
    keep their places side by side, other columns are ignored, and an empty table writes no file. A document is never
    divided, however long, and a shard closes at the first document that fills it. Bounded: a task holds one shard.
    """
    folder = new_path(docs.sparkSession, "wavelet")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]  # an id that many rows repeat (or lack) is parted by its texts
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    written = ordered.mapInArrow(releasing(_writer(folder, tokenizer, shard_tokens)), "partition int, shard int, n long")
    return folder, cut(written, "wavelet-manifest")


def read_shards(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    per_part = manifest.groupBy("partition").agg(F.sum("n").alias("n"))
    per_part = per_part.select("partition", F.coalesce(F.sum("n").over(earlier().orderBy("partition")), F.lit(0)).alias("p"))
    per_shard = manifest.select(
        "partition", "shard", F.coalesce(F.sum("n").over(earlier("partition").orderBy("shard")), F.lit(0)).alias("s")
    )
    starts = per_shard.join(per_part, "partition").select("partition", "shard", (F.col("p") + F.col("s")).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("content")
    found = files.mapInArrow(releasing(_read), "partition int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["partition", "shard"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` and read them back."""
    return read_shards(docs.sparkSession, *write_shards(docs, tokenizer))
