"""Personal data by candidate spans and gradient-boosted trees.

Base spans follow fixed rules and always stay. Generators of high recall propose further, overlapping spans of the same
four kinds in looser forms (obfuscated addresses, numbers without a plus sign or with other separators). Boosted trees
over format and context features, trained here in numpy, score each candidate; those over the threshold that held-out
candidates calibrate are added, the best first where they overlap.

The trees learn from a bounded sample of documents with digits or at signs. Base spans, rewritten into the looser forms in
their own context, are positive; candidates that no rule confirms are negative. Scoring is one pass over all whole texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
#: The sample's bounds, in documents and in characters of a document (spans are looked for in every text whole).
SAMPLE = 4000
SAMPLE_CHARS = 100_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
PRECISION = 0.98
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ODD = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed rules, leftmost and non-overlapping within a kind, in the order of ``KINDS``."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _ODD.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_ODD.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


_AT = r"\s?(?:@|\(at\)|\[at\]|\{at\}|\sat\s)\s?"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?)"
_GENERATORS = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{0,3}[0-9]{3,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{0,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])"),
}
#: What each generator cannot do without: the mark of an address, and digits with few other characters between them.
_MARK = re.compile(r"@|\(at\)|\[at\]|\{at\}|\sat(?=\s)", re.I)
_NEAR = re.compile(r"[0-9](?:[^0-9A-Za-z]{0,5}[0-9]){3,}")
_LOOSE = _LOCAL | set("\u0130\u0131\u017f\u212a")  # letters that re.I takes for i, s and k


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans in looser forms, of any kind and overlapping: all that the generators find in the whole text."""
    out, done = [], 0
    for mark in _MARK.finditer(text):  # the local part is the whole run before the mark
        end = mark.start()
        if end and text[end - 1].isspace():
            end -= 1
        start = end
        while start > max(done, end - 64) and text[start - 1] in _LOOSE:
            start -= 1
        if start < end and (m := _GENERATORS["email"].match(text, start)):
            out.append(("email", *m.span()))
            done = m.end()
    for run in _NEAR.finditer(text):  # digits that aren't far from each other
        lo, hi, digits = max(0, run.start() - 3), min(len(text), run.end() + 1), len(_DIGIT.findall(run[0]))
        for kind, possible in (("ip", "." in run[0]), ("card", digits >= 10), ("phone", digits >= 5)):
            if possible:
                out += [(kind, *m.span()) for m in _GENERATORS[kind].finditer(text, lo, hi)]
    return out


_HINTS = {
    "email": re.compile(r"mail|contact|write|schreib|courriel|correo|escrib", re.I),
    "ip": re.compile(r"\bip\b|addr|server|host|client|login|adresse", re.I),
    "card": re.compile(r"card|visa|master|amex|karte|carte|tarjeta|pay|zahl", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|anruf|appel|llam|whatsapp", re.I),
}


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 30) : start], text[end : end + 30]
    digits = _ODD.sub("", span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    parts = [int(g) for g in re.findall(r"[0-9]+", span)[:4]]
    sides = before[-1:] + after[:1]
    return [
        KINDS.index(kind), len(span), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        groups[0] if groups else 0, groups[-1] if groups else 0, len(set(digits)), luhn(digits) if digits else 0,
        sum(p <= 255 for p in parts) if kind == "ip" else -1, span.count("."), span.count("-"), span.count(" "),
        "(" in span, span[:1] == "+", span[:2] == "00", "@" in span, bool(re.search(r"\bat\b", span, re.I)),
        bool(re.search(r"\bdot\b", span, re.I)), sides[:1].isalnum(), sides[-1:].isalnum(), '"' in sides,
        sum(c.isdigit() for c in before + after), sum(c.isalpha() for c in before + after),
        bool(_HINTS[kind].search(before)), bool(_HINTS[kind].search(after)),
        bool(re.search(r"[0-9]{4}[-./][0-9]{2}[-./][0-9]{2}", span)),
    ]


class Trees:
    """Gradient boosting for two classes: trees of equal depth over binned features, leaves by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        b, self.depth, self.trees = self._bins(x), depth, []
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        logit = np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-logit))
            tree, leaf = self._grow(b, p - y, p * (1 - p), rate)
            logit += tree[2][leaf]
            self.trees.append(tree)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, b, g, h, rate):
        node, feats, cuts = np.zeros(len(b), np.int64), [], []
        for level in range(self.depth):
            n = 1 << level
            gain, feat, cut = np.zeros(n), np.zeros(n, np.int64), np.full(n, BINS)
            for f in range(b.shape[1]):
                at = node * BINS + b[:, f]
                gs, hs = (np.bincount(at, w, n * BINS).reshape(n, BINS).cumsum(axis=1) for w in (g, h))
                rest = (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                score = gs**2 / (hs + 1) + rest
                best = score.argmax(axis=1)
                better = score[np.arange(n), best] > gain + 1e-9
                gain = np.where(better, score[np.arange(n), best], gain)
                feat, cut = np.where(better, f, feat), np.where(better, best, cut)
            node = 2 * node + (b[np.arange(len(b)), feat[node]] > cut[node])
            feats.append(feat)
            cuts.append(cut)
        gs, hs = (np.bincount(node, w, 1 << self.depth) for w in (g, h))
        return (feats, cuts, -rate * gs / (hs + 1)), node

    def score(self, x: np.ndarray) -> np.ndarray:
        b, logit = self._bins(x), np.full(len(x), self.bias)
        for feats, cuts, values in self.trees:
            node = np.zeros(len(b), np.int64)
            for feat, cut in zip(feats, cuts):
                node = 2 * node + (b[np.arange(len(b)), feat[node]] > cut[node])
            logit += values[node]
        return 1 / (1 + np.exp(-logit))


def rewritten(kind: str, span: str, pick: int) -> str:
    """A base span in one of the looser forms of its kind."""
    if kind == "email":
        local, _, domain = span.partition("@")
        return [f"{local} at {domain.replace('.', ' dot ')}", f"{local}(at){domain}", f"{local} [at] {domain}"][pick % 3]
    if kind == "ip":
        return [span.replace(".", "[.]"), span.replace(".", " . "), span.replace(".", "(.)")][pick % 3]
    digits = _ODD.sub("", span)
    if kind == "card":
        return [".", "/", "--"][pick % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return [span.lstrip("+"), "00" + span[1:], f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}"][pick % 3]


class Covered:
    """Places that spans cover, as sorted ranges without overlaps."""

    def __init__(self, spans: list[tuple]):
        self.ranges: list[list[int]] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ranges and start < self.ranges[-1][1]:
                self.ranges[-1][1] = max(self.ranges[-1][1], end)
            else:
                self.ranges.append([start, end])

    def touches(self, span: tuple) -> bool:
        at = bisect_left(self.ranges, [span[2]])  # the first that begins at or after the span's end
        return at > 0 and self.ranges[at - 1][1] > span[1]

    def add(self, span: tuple) -> None:
        insort(self.ranges, [span[1], span[2]])


def examples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for n, text in enumerate(texts):
        base = base_spans(text)
        covered = Covered(base)
        for c in candidates(text):
            if not covered.touches(c):
                x.append(features(text, *c))
                y.append(0)
        for i, (kind, start, end) in enumerate(base):
            loose = rewritten(kind, text[start:end], n + i)
            around = text[max(0, start - 200) : start] + loose + text[end : end + 200]
            at = min(200, start)
            for c in candidates(around):
                if c[1] < at + len(loose) and at < c[2]:
                    whole = c[0] == kind and c[1] <= at + 1 and c[2] >= at + len(loose)
                    x.append(features(around, *c))
                    y.append(int(whole))
    return np.array(x, float), np.array(y)


def train(texts: list[str], seed: int = 3):
    """(trees, threshold by kind), or None where the texts hold too few examples of either class."""
    x, y = examples(texts)
    if len(y) < 20 or not 5 <= y.sum() <= len(y) - 5:
        return None
    order = np.random.default_rng(seed).permutation(len(y))
    test, fit = order[: len(y) // 4], order[len(y) // 4 :]
    trees = Trees(x[fit], y[fit])
    p, thresholds = trees.score(x[test]), {}
    for k, kind in enumerate(KINDS):
        own = x[test][:, 0] == k
        cuts = [c for c in np.arange(0.5, 1.0, 0.01) if (own & (p >= c)).any()]
        good = [c for c in cuts if y[test][own & (p >= c)].mean() >= PRECISION]
        thresholds[kind] = float(good[0]) if good else 1.01
    return trees, thresholds


def all_spans(text: str, base: list[tuple], model) -> list[tuple[str, int, int]]:
    """Base spans and those that the model adds, by kind, then start."""
    covered = Covered(base)
    found = [c for c in candidates(text) if not covered.touches(c)] if model else []
    added: list[tuple] = []
    if found:
        trees, thresholds = model
        p = trees.score(np.array([features(text, *c) for c in found], float))
        for score, c in sorted(zip(p.tolist(), found), key=lambda s: (-s[0], s[1][1], -s[1][2], s[1][0])):
            if score >= thresholds[c[0]] and not covered.touches(c):
                added.append(c)
                covered.add(c)
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def written(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def fit(docs: DataFrame, sample: int = SAMPLE):
    """The model from at most ``sample`` documents that hold a digit or an at sign, taken by a hash of the row."""
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), F.xxhash64("doc_id", text).alias("h"))
    # four times the sample is taken by the hash alone, so that no task sorts more than that
    share = int(min(1.0, 4 * sample / max(1, docs.count())) * (1 << 20)) + 1
    rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < share)
    rows = rows.filter(f"length(text) <= {SAMPLE_CHARS}").filter("text rlike '[0-9@]'")
    return train([r["text"] for r in rows.orderBy("h").limit(sample).toLocalIterator()])


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
)


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row per document: doc_id, base spans of each kind counted, base_sha256, and all spans as kind:start:end.

    Offsets count code points of the whole text. Null and empty texts have no spans; repeated rows give equal rows; null
    doc_ids are allowed; other columns are ignored; an empty table gives no rows. Where the sample has too few examples
    no span is added.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))  # trees of fixed size

    def run(batches):
        model = shared.value
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                sha = hashlib.sha256(written(base).encode()).hexdigest()
                out.append((doc, *counts, sha, written(all_spans(text, base, model))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _FOUND)


def masked(text: str, spans: list[tuple]) -> str:
    """The text with each span, or run of overlapping spans, as its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with spans masked in text, and n_chars (where there is one) counted anew. No row goes.

    Null and empty texts stay as they are; very long ones are read whole; equal texts are masked alike; an empty table stays
    empty; columns of any other name are carried along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(batches):
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(at).to_pylist():
                spans = all_spans(text, base_spans(text), model) if text else []
                texts.append(masked(text, spans) if spans else text)
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    text = docs.withColumn("text", F.col("text").cast("string"))
    out = text.mapInArrow(run, T.StructType(text.schema.fields))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)
