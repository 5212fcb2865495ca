"""Phrases, near-duplicate vectors and token alignment against plain loops, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pytest

from kinetiq.llm import alignment, phrases, vectors

TEXTS = [
    "The quick brown fox. the quick brown dog, the quick\tbrown fox", "a  b   c\n\n d 's don't", " leading and trailing ", "▁ literal", "<|endoftext|> and <s> <0x0A>",
    "日本語 の テキスト, naïve café \U0001f600 \U0001f600", "", None, " ", "  ", "x", "x\x00y\x1c z", "A" * 3000 + " " + "b c " * 900, "tab\there\r\nthere \n x \n\ny  ", "1234567 89, 3.14",
]


def plain_alignment(texts):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    found, counts = [], collections.Counter()
    for text in texts:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        ab = [bytes(letter[c] for c in a_lib.id_to_token(k)) for k in a]
        bb = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [b_lib.id_to_piece(k)]]
        if not text or not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            found.append(None)
            continue
        ae, be = np.cumsum([*map(len, ab)]), np.cumsum([*map(len, bb)])
        links = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(ae[x] - len(ab[x]), be[y] - len(bb[y])) < min(ae[x], be[y])]
        both = sorted(set(ae.tolist()) & set(be.tolist()))
        groups, low = [], 0
        for end in both:
            inside = lambda ends: [k for k, e in enumerate(ends) if low < e <= end]  # noqa: B023, E731
            groups.append(",".join(str(a[k]) for k in inside(ae)) + "|" + ",".join(str(b[k]) for k in inside(be)))
            low = end
        links = [(a[x], b[y]) for x, y in links]
        counts.update(set(links))
        found.append((len(a), len(b), groups, links))
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else
        (f[0], f[1], len(f[2]), len(f[3]), sum(counts[p] == best[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
        for f in found
    ]


@pytest.mark.parametrize("block", [alignment.BLOCK, 40])
def test_alignment_equals_the_libraries(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "SHARD", 25)
    monkeypatch.setattr(alignment, "FAN", 2)
    texts = TEXTS + TEXTS[:3] + [f"word{i} of the text {i * i}" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, code string, shard int").repartition(5)
    rows = {r[0]: tuple(r)[1:] for r in alignment.align_documents(docs, block=block).collect()}
    want = plain_alignment([t[:400] if t and len(t) > 2000 else t for t in texts])
    short = spark.createDataFrame([(i, t[:400] if t and len(t) > 2000 else t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r[0]: tuple(r)[1:] for r in alignment.align_documents(short, block=block).collect()} == dict(enumerate(want))
    assert len(rows) == len(texts) and rows[12][0] > 900


def test_alignment_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(empty).collect() == []
    none = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert {tuple(r) for r in alignment.align_documents(none).collect()} == {(k, 0, 0, 0, 0, 0, 0, "") for k in (None, 1)}
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")
    rows = alignment.align_documents(twice, block=1).collect()
    assert len(rows) == 3 and {r["count_sum"] for r in rows} == {3 * rows[0]["n_links"]}


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 5000):
        keys = np.unique(rng.integers(0, 1 << 48, n))
        f = alignment.PerfectHash.of(keys)
        assert sorted(f.index(keys)) == list(range(len(keys)))
        assert (f.index(keys + (1 << 50)) == -1).all()


def plain_phrases(rows, least):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        scored = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], total[lang], score))
        out += [(lang, i + 1, s[2].decode(), *s[3:]) for i, s in enumerate(sorted(scored)[:2000])]
    return set(out)


@pytest.mark.parametrize("chunk", [phrases.CHUNK, 300])
def test_phrases_equal_plain_counts(spark, chunk):
    rng = np.random.default_rng(2)
    words = ["alpha", "Beta", "gamma", "d", "é", "x-y", "the"]
    join = [" ", "  ", "\t", " ", " ", ". ", "\n", ",", "\x0b"]
    rows = [(["en", "de", None][i % 3], "".join(words[int(w * w * 7)] + join[j] for w, j in zip(rng.random(n), rng.integers(0, 9, n)))) for i, n in enumerate(rng.integers(0, 90, 60))]
    rows += [("en", None), ("en", ""), ("fr", " .,;"), (None, "Und und Und"), ("en", rows[0][1]), ("de", "longword" * 60 + " alpha beta")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "lang string, text string, phrase int, stream string").repartition(3)
    for least in (2, 10):
        assert {tuple(r) for r in phrases.collocations(docs, least=least, chunk=chunk).collect()} == plain_phrases(rows, least)


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def plain_links(rows):
    units = [None if label is None else vectors.unit(v) for _, label, v in rows]
    linked = lambda i, j: i != j and units[i] is not None and units[j] is not None and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= vectors.COSINE
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            at = todo.pop()
            new = [j for j in range(len(rows)) if j not in seen and linked(at, j)]
            seen.update(new), todo.extend(new)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids, default=None)
        out.append((rows[i][0], sum(linked(i, j) for j in range(len(rows))), low, rows[i][0] is not None and rows[i][0] == low))
    return sorted(out, key=str)


def test_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 20)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 6))
    rows = []
    for i in range(260):  # chains of neighbours between cells, a large group, copies
        x = base[0 if i % 3 == 0 else i % 12] * rng.uniform(0.1, 9) + rng.normal(size=6) * (0.1 if i % 2 else 0.02)
        rows.append((i, i % 2, x.tolist()))
    rows += [(300 + i, 1, rows[1][2]) for i in range(20)] + [(None, 1, rows[1][2]), (5, 1, rows[5][2])]
    rows += [(400, 1, None), (401, 1, []), (402, 1, [0.0] * 6), (403, 1, [1.0, None, 0, 0, 0, 0]), (404, 1, [float("nan")] * 6), (405, 1, [float("inf")] * 6), (406, None, rows[1][2])]
    rows += [(407, 1, [1e300] * 6), (408, 1, [1e-300] * 6), (409, 1, [1.0, 2.0]), (410, 1, [2.0, 4.0])]
    rows = [(a, b, None if c is None else [None if x is None else float(x) for x in c]) for a, b, c in rows]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, label int, embedding array<double>, key int, cell string")
    found = vectors.near_duplicates(df)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_links(rows)
    assert vectors.keep_one(df).count() > 5
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_every_linked_pair_meets_in_one_cell():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.05])
    x /= np.linalg.norm(x, axis=1)[:, None]
    home, member = vectors.cells_of(x, vectors.centres(x, 30), 0.98)
    at_home = np.arange(30)[None] == home[:, None]
    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1))):
        assert (member[i] & member[j] & (at_home[i] | at_home[j])).sum() == 1


def test_refined_keys_keep_only_rows_that_a_pair_needs(spark):
    from kinetiq.llm import simhash

    bit = lambda b: b << 32
    rows = [(bit(1), 0b00, 1), (bit(1), 0b01 << 30, 2), (bit(2), 0b000, 1), (bit(2), 0b100, 2), (bit(0), 0, 1), (bit(0), 1 << 40, 2), (bit(3), 0, 1), (bit(3), 8, 1)]
    df = spark.createDataFrame(rows, "key long, fp long, c long")
    assert sorted(r.key >> 32 for r in simhash._apart(df, ["key"]).collect()) == [0, 0, 2, 2]  # bit 1 is alike, bit 3 of one component
