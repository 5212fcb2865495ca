"""Packing of documents into sequences by a configuration linear program over the histogram of piece lengths.

Texts are tokenised once; what follows sees only lengths. The program has a variable per configuration (a multiset of
lengths that fits a sequence) and a covering constraint per length. Multiplicative weights solve it: lengths that are
still short of sequences weigh more, and a knapsack by dynamic programming prices configurations. One table prices the
best configuration with each length in it; all that are nearly as good as the best of all take a step in the round. Rounds end when
the scaled solution, which covers every length, is within ``GAP`` of the least number of sequences that the tokens need, or
after ``ROUNDS``; the rounding does not depend on the gap.

The solution is rounded configuration by configuration, the largest first, as far as pieces are left, and the program is
solved again for what the rounding left over, as long as that places a share of it. What remains is placed by best fit, still
on the histogram: a tenth of the pieces or less, from the point of the rounding where that makes the fewest sequences. The histogram and the plan are bounded by the sequence length, not by the corpus: they are all that the
driver sees. Pieces get their places by joining the plan on (length, number within the length).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import number_within
from .store import cut, releasing
from .tokens import encoder

SEQUENCE = 2048
END_ID = 0
#: Rounds of a solution at most, the weights' step, how near to the best a configuration has to be, how much of a length a
#: round may cover, the gap to stop at, the share of what is left that a solution has to place for another, and the share of
#: all pieces that best fit may get.
ROUNDS, STEP, NEAR, EACH, GAP, PLACED, REST = 120, 0.05, 0.05, 0.5, 0.25, 0.05, 0.1

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def cuts(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, ...]:
    """(document, piece, start, length) of every piece: all of ``size`` but a document's first, which takes the rest."""
    many = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), many)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = (lengths - 1) % size + 1
    start = np.where(piece > 0, first[doc] + (piece - 1) * size, 0)
    return doc, piece, start, np.where(piece > 0, size, first[doc])


def _pieces(tokenizer: str | None, size: int):
    def run(batches):
        encode = encoder(tokenizer).batch
        for batch in batches:
            at = 0
            for ids, lengths in encode(batch.column(1), END_ID):
                doc, piece, start, length = cuts(lengths, size)
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                begin = 4 * ((np.cumsum(lengths) - lengths)[doc] + start)
                crc = [zlib.crc32(view[i:j]) for i, j in zip(begin.tolist(), (begin + 4 * length).tolist())]
                names = batch.column(0).slice(at, len(lengths)).take(pa.array(doc))
                cols = [names, *(pa.array(c).cast(f.type) for c, f in zip((piece, start, length, crc), list(_PIECES)[1:]))]
                yield pa.RecordBatch.from_arrays(cols, schema=_PIECES)
                at += len(lengths)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32. Null texts are empty; every document has an end id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(_pieces(tokenizer, size)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def prices(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the most value that fits into each room, and the length to take there (-1: leave one token)."""
    best, took = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(int(lengths[0]), size + 1):
        k = int(np.searchsorted(lengths, room, side="right"))
        total = best[room - lengths[:k]] + values[:k]
        i = int(total.argmax())
        if total[i] > best[room - 1]:
            best[room], took[room] = total[i], i
        else:
            best[room] = best[room - 1]
    return best, took


def _taken(took: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    """The places of the lengths that fill a room best."""
    out = []
    while room >= lengths[0]:
        i = int(took[room])
        if i < 0:
            room -= 1
        else:
            out.append(i)
            room -= int(lengths[i])
    return out


def solve(counts: dict[int, int], size: int = SEQUENCE, rounds: int = ROUNDS, step: float = STEP, gap: float = GAP) -> dict[tuple, float]:
    """Fractional numbers of configurations (sorted tuples of lengths) that cover ``counts``, by multiplicative weights."""
    lengths = np.array(sorted(counts))
    need = np.array([counts[x] for x in lengths], float)
    bound = max(1e-9, float(lengths @ need) / size)
    log_weight, covered, x = np.zeros(len(lengths)), np.zeros(len(lengths)), defaultdict(float)
    for _ in range(rounds):
        # values are by length, so that empty room costs; a token of a scarce length is worth more
        values = lengths * np.exp(np.clip(log_weight - log_weight.max(), -30, 0))
        best, took = prices(values, lengths, size)
        with_each = values + best[size - lengths]
        start = covered.copy()
        for i in np.argsort(covered, kind="stable").tolist():
            if with_each[i] < (1 - NEAR) * best[size] or covered[i] - start[i] >= EACH:
                continue
            config = Counter([i, *_taken(took, lengths, size - int(lengths[i]))])
            if any(covered[j] - start[j] >= EACH for j in config):
                continue  # common fillers are priced anew before they are taken again
            share = EACH * min(need[j] / k for j, k in config.items())
            x[tuple(sorted((int(lengths[j]) for j in config.elements()), reverse=True))] += share
            for j, k in config.items():
                covered[j] += k * share / need[j]
                log_weight[j] -= step * k * share / need[j]
        if covered.min() > 0 and sum(x.values()) / covered.min() <= (1 + gap) * bound:
            break
    scale = float(covered.min() if covered.min() > 0 else np.average(covered, weights=lengths * need))
    return {c: v / scale for c, v in x.items()}


def best_fit(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple, int]]:
    """Best-fit decreasing on a histogram: equal sequences are held as one configuration and a number."""
    spaces: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = min((s for s in spaces if s >= length and spaces[s]), default=size)
            config, many = next(iter(spaces[space].items()), ((), left)) if space in spaces and spaces[space] else ((), left)
            k = min(space // length, left)
            use = min(many, left // k)
            if config:
                spaces[space][config] -= use
                if not spaces[space][config]:
                    del spaces[space][config]
            spaces[space - k * length][config + (length,) * k] += use
            left -= use * k
        for s in [s for s in spaces if not spaces[s]]:
            del spaces[s]
    return [(c, m) for by in spaces.values() for c, m in by.items()]


def rounded(solution: dict[tuple, float], left: Counter):
    """Whole numbers of configurations, the largest first, each rounded up as far as pieces are left; ``left`` shrinks."""
    for config, x in sorted(solution.items(), key=lambda c: (-c[1], c[0])):
        use = Counter(config)
        many = min(math.ceil(x), *(left[v] // k for v, k in use.items()))
        if many:
            for v, k in use.items():
                left[v] -= k * many
            yield config, many


def plan(counts: dict[int, int], size: int = SEQUENCE, rounds: int = ROUNDS) -> tuple[list[tuple[tuple, int]], int]:
    """Configurations and how many sequences use each, together holding exactly ``counts``; and how many pieces the program
    has placed. The rest, ``REST`` of the pieces at most if the program gets so far, is placed by best fit: from where that
    makes the fewest sequences."""
    left, total = Counter(counts), sum(counts.values())
    out: list[tuple[tuple, int]] = []
    if full := left.pop(size, 0):
        out.append(((size,), full))
    ends, mark, placed = [], REST * total, full
    while total - placed > REST / 4 * total:
        before = placed
        for config, many in rounded(solve(+left, size, rounds), left):
            out.append((config, many))
            placed += many * len(config)
            if total - placed <= mark:
                ends.append((len(out), +left))
                mark = (total - placed) * 0.8
        if placed - before < PLACED * (total - before):
            break
    ends.append((len(out), +left))
    tails = [(out[:n], best_fit(rest, size), sum(rest.values())) for n, rest in ends]
    head, tail, rest = min(tails, key=lambda t: (sum(m for _, m in t[0] + t[1]), t[2]))
    return head + tail, total - rest


def places(planned: list[tuple[tuple, int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first number, number after the last, first sequence less first number, offset)."""
    taken, base, rows = Counter(), 0, []
    for config, many in planned:
        offset = 0
        for v in config:
            rows.append((v, taken[v], taken[v] + many, base - taken[v], offset))
            taken[v] += many
            offset += v
        base += many
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE, rounds: int = ROUNDS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document, empty and null texts included, has at least its end id. Only documents longer than ``size`` are cut;
    their first piece may be shorter. Repeated rows and null doc_ids are packed like any other; other columns are
    ignored; an empty table gives no rows.
    """
    cutup = cut(pieces(docs, tokenizer, size), "pieces")
    counts = {r["length"]: r["count"] for r in cutup.groupBy("length").count().collect()}  # at most ``size`` rows
    rows = places(plan(counts, size, rounds)[0]) if counts else []
    spark = docs.sparkSession
    table = spark.createDataFrame(
        rows, "p_length long, p_from long, p_to long, p_shift long, offset long"
    )  # bounded by the number of configurations
    numbered = number_within(cutup, ["length"], ["doc_id", "piece", "ids_crc32"], "n")
    on = (F.col("length") == F.col("p_length")) & (F.col("n") >= F.col("p_from")) & (F.col("n") < F.col("p_to"))
    return numbered.join(F.broadcast(table), on).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("n") + F.col("p_shift")).alias("sequence_id"), "offset"
    )
