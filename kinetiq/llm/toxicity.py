"""Toxicity by a convolutional text classifier over hashed word embeddings, trained here in numpy.

A word's vector is the sum of hashed vectors of the word and its beginnings (two hashes each, so that a rare word seldom
shares both with another). Filters over one, two and three words are max-pooled over the whole text and feed a logistic
output. Training and calibration use a bounded sample of labelled rows, taken by a hash of doc_id; executors turn its texts
into word hashes, so that the driver never holds a text. Scoring is one pass over all rows without a shuffle. A score is a calibrated probability; the decision's threshold is calibrated for each
language. Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut, drop, releasing

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
#: Bytes of a word's two beginnings.
SHORT, LONG = 5, 7
#: The sample's bounds: rows for each label, and the characters of a text that may be in it (scoring takes every text whole).
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2500, 4000, 200_000
REMEMBERED = 120_000
#: Texts of a training step, steps that training takes at least, and passes over the sample at least and at most.
TOGETHER, STEPS, PASSES = 32, 1200, (6, 30)
CUT = 0.3
#: Rows of label 1 that a threshold is calibrated on at least; with fewer it is CUT.
ENOUGH = 20
HASHES = 3


_BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def split(text: str | None) -> list[bytes]:
    """A text's words in UTF-8: lower-cased, ASCII punctuation off, parted at ASCII white space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split() if text else []


def hashes_of(word: bytes) -> tuple[int, ...]:
    """A hash of the word and of its beginnings."""
    digest = xxhash.xxh3_64_intdigest
    return digest(word, 1), digest(word[:SHORT]), digest(word[:LONG])


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The hashed rows of words, two to a hash."""
    return np.concatenate((hashes % BUCKETS, (hashes >> np.uint64(32)) % BUCKETS), axis=1).astype(np.int32)


class Vocabulary(dict):
    """Word -> its number; 0 is padding, whose row BUCKETS is zero."""

    def __init__(self):
        self.hashes = array("Q", [0] * HASHES)

    def __missing__(self, word):
        self[word] = at = len(self.hashes) // HASHES
        self.hashes.extend(hashes_of(word))
        return at

    def __len__(self):
        return len(self.hashes) // HASHES

    def rows(self, start: int = 0) -> np.ndarray:
        """The rows of the words from a number on."""
        out = buckets(np.frombuffer(self.hashes[start * HASHES :], np.uint64).reshape(-1, HASHES))
        if start == 0:
            out[0] = BUCKETS
        return out


def vectors(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return 0.5 * table[rows].sum(axis=1)


def numbered(words: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """A text's word numbers between two paddings on each side, so that every filter has a window."""
    ids = np.zeros(len(words) + 4, np.int64)
    ids[2:-2] = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    return ids


class Net:
    def __init__(self, rng=None):
        rng = rng or np.random.default_rng(7)
        self.table = (0.02 * rng.standard_normal((BUCKETS + 1, DIM))).astype(np.float32)
        self.table[BUCKETS] = 0
        self.filters = [(0.2 * rng.standard_normal((w, DIM, FILTERS))).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = (0.1 * rng.standard_normal(len(WIDTHS) * FILTERS)).astype(np.float32)
        self.out_bias = -2.0
        self.slope, self.shift = 1.0, 0.0
        self.thresholds: dict = {}
        self.threshold = CUT

    def responses(self, vecs: np.ndarray) -> list[np.ndarray]:
        """For each width and place in the filter: each word's part of the filters' values."""
        return [vecs @ f[j] for f in self.filters for j in range(len(f))]

    def pooled(self, ids: np.ndarray, starts: np.ndarray, responses: list[np.ndarray], where: bool = False):
        """Max over each text's windows; ``ids`` are texts one after another, ``starts`` where each begins."""
        tops, at, k = [], [], 0
        for w in WIDTHS:
            value = responses[k][ids[: len(ids) - w + 1]]
            for j in range(1, w):
                value = value + responses[k + j][ids[j : len(ids) - w + 1 + j]]
            k += w
            if where:
                ends = np.append(starts[1:], len(value))
                arg = np.array([s + value[s : max(s + 1, e - w + 1)].argmax(axis=0) for s, e in zip(starts, ends)])
                at.append(arg)
                tops.append(np.take_along_axis(value, arg, axis=0))
            else:
                tops.append(np.maximum.reduceat(value, starts, axis=0))
        return np.concatenate(tops, axis=1), at

    def logit(self, tops: np.ndarray) -> np.ndarray:
        return np.maximum(tops + self.bias, 0) @ self.out + self.out_bias

    def score(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit.astype(float) + self.shift, -60, 60)))


def _adam(state: dict, name: str, value: np.ndarray, grad: np.ndarray, rate: float, step: int) -> None:
    m, s = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
    m += 0.1 * (grad - m)
    s += 0.001 * (grad * grad - s)
    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def _logistic(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def train(docs: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, natural: float, langs: list, epochs: int | None = None, seed: int = 7) -> Net:
    """Fit on four fifths, calibrate on the rest. ``docs`` number each text's words with padding, ``rows`` are the words'.

    ``natural`` is the share of label 1 among all labelled rows.
    """
    rng, net = np.random.default_rng(seed), Net()
    y = labels.astype(np.float32)
    order = rng.permutation(len(docs))
    test, fit = order[: len(docs) // 5], order[len(docs) // 5 :]
    weight = np.where(y > 0, 0.5 / max(y[fit].mean(), 1e-6), 0.5 / max(1 - y[fit].mean(), 1e-6)).astype(np.float32)
    state: dict = {}
    step, steps = 0, max(1, len(fit) // TOGETHER)
    for _ in range(epochs or min(max(-(-STEPS // steps), PASSES[0]), PASSES[1])):
        for part in np.array_split(rng.permutation(fit), steps):
            step += 1
            ids = np.concatenate([docs[i] for i in part])
            starts = np.cumsum([0, *(len(docs[i]) for i in part[:-1])])
            words, ids = np.unique(ids, return_inverse=True)
            vecs = vectors(net.table, rows[words])
            tops, at = net.pooled(ids, starts, net.responses(vecs), where=True)
            hidden = np.maximum(tops + net.bias, 0)
            err = (_logistic(hidden @ net.out + net.out_bias) - y[part]) * weight[part] / len(part)
            back = err[:, None] * net.out * (hidden > 0)
            g_vecs = np.zeros_like(vecs)
            for k, w in enumerate(WIDTHS):
                b = back[:, k * FILTERS : (k + 1) * FILTERS]
                g_filter = np.zeros_like(net.filters[k])
                for j in range(w):
                    hit = ids[at[k] + j]  # documents by filters
                    g_filter[j] = np.einsum("bfd,bf->df", vecs[hit], b)
                    np.add.at(g_vecs, hit, b[:, :, None] * net.filters[k][j].T[None])
                _adam(state, f"f{k}", net.filters[k], g_filter, 0.01, step)
            _adam(state, "bias", net.bias, back.sum(axis=0), 0.01, step)
            _adam(state, "out", net.out, err @ hidden, 0.01, step)
            net.out_bias -= 0.3 * float(err.sum())
            moved = np.flatnonzero(np.abs(g_vecs).sum(axis=1))
            np.subtract.at(net.table, rows[words[moved]], np.clip(g_vecs[moved], -0.05, 0.05)[:, None, :])
            net.table[BUCKETS] = 0
    responses = net.responses(vectors(net.table, rows))
    logit = np.zeros(len(test))
    for part in np.array_split(np.arange(len(test)), max(1, len(test) // 100)):
        some = [docs[i] for i in test[part]]
        if some:
            tops, _ = net.pooled(np.concatenate(some), np.cumsum([0, *(len(d) for d in some[:-1])]), responses)
            logit[part] = net.logit(tops)
    _calibrate(net, logit, y[test], natural, [langs[i] for i in test])
    return net


def _calibrate(net: Net, logit: np.ndarray, y: np.ndarray, natural: float, langs: list) -> None:
    """Two-parameter logistic calibration at the natural class shares; then each language's threshold of best F1."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    weight = np.where(y > 0, natural / share, (1 - natural) / (1 - share))
    # labels are pulled a little to the middle, so that a separable sample gives finite values
    aim = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _logistic(a * logit + b)
        g = np.array([(weight * (p - aim) * logit).sum() + 0.01 * (a - 1), (weight * (p - aim)).sum() + 0.01 * b])
        h = weight * p * (1 - p)
        hess = np.array([[(h * logit**2).sum() + 0.01, (h * logit).sum()], [(h * logit).sum(), h.sum() + 0.01]])
        move = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
    net.slope, net.shift = max(a, 0.05), b
    p = net.score(logit)

    def best(mask):
        cuts = np.arange(0.1, 0.91, 0.05)
        f1 = [2 * (weight * y * (p >= c))[mask].sum() / max(1e-9, (weight * y)[mask].sum() + (weight * (p >= c))[mask].sum()) for c in cuts]
        top = max(f1)
        return float(min((c for c, f in zip(cuts, f1) if f >= top - 1e-9), key=lambda c: abs(c - CUT)))

    langs = np.array(langs, object)
    net.threshold = best(np.ones(len(y), bool)) if y.sum() >= ENOUGH else CUT
    for lang in {x for x in langs if x is not None}:
        mask = langs == lang
        if y[mask].sum() >= ENOUGH:
            net.thresholds[lang] = best(mask)


def held_out(doc_id):
    """Rows that nothing is learned from: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Net | None:
    """The model from a bounded sample of the labelled rows that aren't held out; None without rows of both labels.

    A doc_id with several labels counts as its largest; null labels and ids are left out.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = cut(known.filter(~held_out(F.col("doc_id"))).withColumn("y", (F.col("y") > 0).cast("int")), "labelled")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    by_hash = F.xxhash64("doc_id")
    picked = [known.filter(F.col("y") == y).orderBy(by_hash, "doc_id").limit(n) for y, n in ((1, toxic), (0, clean))]
    picked = picked[0].union(picked[1]).select(F.col("doc_id").alias("_id"), "y")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang"))
    rows = text.join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # at most ``toxic + clean`` ids
    rows = rows.filter(f"text is not null and length(text) <= {SAMPLE_CHARS}")
    first = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang", "y")).alias("r"))
    hashed = first.select("doc_id", "r.text", "r.lang", "r.y").mapInArrow(releasing(_hashed), _HASHED)
    sample = cut(hashed, "sample")
    words = sample.select(F.explode(F.arrays_zip("words", "short", "long")).alias("w")).select("w.*").distinct().toArrow()
    found = sample.select("doc_id", "lang", "y", "ids").orderBy("doc_id").toArrow()
    drop(known), drop(sample)
    y = found["y"].to_numpy()
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return None
    hashes = np.stack([words[c].to_numpy().view(np.uint64) for c in ("words", "short", "long")], axis=1)
    hashes = hashes[np.argsort(hashes[:, 0])]
    table = np.concatenate((np.full((1, 2 * HASHES), BUCKETS, np.int32), buckets(hashes)))
    numbered = [
        np.pad(np.searchsorted(hashes[:, 0], np.frombuffer(ids.as_py(), np.uint64)).astype(np.int32) + 1, 2) for ids in found["ids"]
    ]
    natural = counts.get(1, 0) / sum(counts.values())
    return train(numbered, table, y, natural, found["lang"].to_pylist())


_HASHED = "doc_id long, lang string, y int, ids binary, words array<long>, short array<long>, long array<long>"


def _hashed(batches):
    """Each text as its words' hashes in order, and its different words' hashes with those of their beginnings."""
    for batch in batches:
        ids, parts = [], [[], [], []]
        for text in batch.column(1):
            words = split(text.as_py())
            different = {w: hashes_of(w) for w in words}
            ids.append(np.array([different[w][0] for w in words], "<u8").tobytes())
            for part, hashes in zip(parts, zip(*different.values()) if different else ((), (), ())):
                part.append(np.array(hashes, np.uint64).view(np.int64))
        lists = [pa.array(p, pa.list_(pa.int64())) for p in parts]
        names = ["doc_id", "lang", "y", "ids", "words", "short", "long"]
        first = [batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3)]
        yield pa.RecordBatch.from_arrays([*first, pa.array(ids, pa.binary()), *lists], names=names)


class Scorer:
    """A model with what it has worked out for words so far, in one process."""

    def __init__(self, net: Net):
        self.net = net
        self._clear()

    def _clear(self):
        self.vocab = Vocabulary()
        self.done = 0
        self.responses = [np.zeros((1024, FILTERS), np.float32) for w in WIDTHS for _ in range(w)]

    def _work_out(self):
        n = len(self.vocab)
        if n > self.done:
            new = self.net.responses(vectors(self.net.table, self.vocab.rows(self.done)))
            for k, value in enumerate(new):
                if n > len(self.responses[k]):
                    grown = np.zeros((2 * n, FILTERS), np.float32)
                    grown[: self.done] = self.responses[k][: self.done]
                    self.responses[k] = grown
                self.responses[k][self.done : n] = value
            self.done = n

    def __call__(self, texts: list) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):
            if len(self.vocab) > REMEMBERED:
                self._clear()
            part, words = [], 0
            while at < len(texts) and words < 100_000:
                part.append(numbered(split(texts[at]), self.vocab))
                words += len(part[-1])
                at += 1
            self._work_out()
            starts = np.cumsum([0, *(len(p) for p in part[:-1])])
            tops, _ = self.net.pooled(np.concatenate(part), starts, self.responses)
            out.append(self.net.score(self.net.logit(tops)))
        return np.concatenate(out) if out else np.zeros(0)


_SCORERS: dict = {}


def _scorer(shared, at: int):
    def run(batches):
        scorer = _SCORERS.get(shared.value.key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[shared.value.key] = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(0).field(at).cast(pa.string()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(texts), pa.float64())], names=["row", "score"])

    return run


def with_scores(docs: DataFrame, net: Net | None) -> DataFrame:
    """``(row, score)``: each row of ``docs`` and the probability of label 1 for its whole text (null and empty ones too)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    if net is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    net.key = f"{zlib.crc32(net.table.tobytes())}-{zlib.crc32(net.out.tobytes())}-{net.slope}-{net.shift}"
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed
    schema = T.StructType([T.StructField("row", docs.schema, False), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(releasing(_scorer(shared, docs.columns.index("text"))), schema)


def _threshold(net: Net | None, docs: DataFrame):
    if net is None or not net.thresholds or "lang" not in docs.columns:
        return F.lit(net.threshold if net else CUT)
    by_lang = F.create_map(*(x for k, v in sorted(net.thresholds.items()) for x in (F.lit(k), F.lit(v))))
    return F.coalesce(by_lang[F.coalesce(F.col("row.lang").cast("string"), F.lit(""))], F.lit(net.threshold))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted (score >= 0.3), threshold (its language's), toxic.

    Without labelled rows of both kinds every score is 0. Null and empty texts have the score of a text without words;
    repeated rows get equal scores; a null doc_id isn't held out; an empty table gives no rows.
    """
    net = fit(docs, labels)
    columns = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    scored = with_scores(docs.select(*columns), net)
    return scored.select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        _threshold(net, docs).alias("threshold"),
        (F.col("score") >= _threshold(net, docs)).alias("toxic"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that reach their language's threshold.

    Every text is judged whole; null and empty texts count as texts without words; equal rows share their fate; without
    labelled rows of both kinds nothing goes; an empty table stays empty. Columns of any name are carried along unread.
    """
    net = fit(docs, labels)
    return with_scores(docs, net).filter(F.col("score") < _threshold(net, docs)).select("row.*")
