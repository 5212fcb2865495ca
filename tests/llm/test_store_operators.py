"""Index, shard and file operators against brute force and exact round trips."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinetiq.llm import ann, sharding, warc, wavelet

rng = np.random.default_rng(12)


def exact(vectors, q, k=20):
    found = sorted((-float((np.array(vectors[q]) * np.array(v)).sum()), i) for i, v in vectors.items() if i != q)
    return [(i, -s) for s, i in found[:k]]


def vector_rows(n=900):
    base = rng.standard_normal((30, 16))
    rows = [(i, (base[i % 30] + 0.4 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(5000 + i, [4 * x for x in rows[41][1]]) for i in range(200)]  # copies, longer than the rest
    return rows


def test_neighbours_reach_the_recall(spark):
    rows = vector_rows()
    bad = [(7000, None), (7020, [0.0] * 16), (7040, [float("nan")] * 16), (7060, [float("inf")] + [1.0] * 15), (7080, [1.0] * 3), (None, rows[0][1]), (0, rows[0][1])]
    bad += [(7100, [None] + [1.0] * 15)]
    df = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows + bad], "vec_id long, embedding array<float>, leaf int, score double")
    got = {}
    for r in ann.neighbours(df, sample=500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    vectors = dict(rows)
    assert set(got) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - float((np.array(vectors[q]) * np.array(vectors[v])).sum())) < 1e-9 and v != q for _, v, s in found)
        order = [(-s, v) for _, v, s in found]
        assert order == sorted(order)
        hits += len({v for _, v, _ in found} & {i for i, _ in exact(vectors, q)})
    assert hits / (20 * len(got)) >= 0.9
    for q, found in got.items():  # of equal vectors the smaller ids come first
        copies = [v for _, v, _ in found if v >= 5000]
        assert copies == [v for v in range(5000, 5200) if v != q][: len(copies)]


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.neighbours(few).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.neighbours(few.limit(0)).count() == 0


def test_best_first_order_is_by_distance():
    points = rng.standard_normal((400, 5))
    tree = ann.Tree(points, 20)
    order = tree.best_bins(points[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.assign(points[:1])[0]
    assert ann.Tree(np.ones((50, 3)), 5).leaves == 1


@pytest.mark.parametrize("shards", [7, 40])
def test_shards_are_near_equal(spark, shards):
    texts = [(i, "x" * int(n), ["en", "de", None][i % 3], f"https://s{i % 5}") for i, n in enumerate(rng.integers(0, 400, 3000))]
    texts += [(7 if i % 2 else None, "copy of one text " * 10, "en", "https://s1") for i in range(2500)]  # a third of the bytes, two ids
    texts += [(None, None, None, None), (5, "", "en", "s"), (5, "", "en", "s")]
    df = spark.createDataFrame([(*t, 1, "h", 2, 3.0) for t in texts], "doc_id long, text string, lang string, source string, n int, h string, part int, w double")
    rows = sharding.shard(df, shards).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    by, slots = {}, {}
    for r in rows:
        by[r.shard] = by.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(by.values()) / shards
    assert max(by.values()) < 1.03 * mean + 450 and min(by.values()) > 0.97 * mean - 450
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _, _ in texts)
    assert sorted((r.size, r.text_crc32) for r in rows) == want


def test_the_tree_parts_at_weighted_medians_of_the_widest_dimension(spark):
    rows = [(int(a), int(b) << 33, int(c), int(w)) for a, b, c, w in zip(rng.integers(0, 1 << 62, 500), rng.integers(0, 5, 500), rng.integers(0, 1 << 40, 500), rng.integers(1, 90, 500))]
    units = spark.createDataFrame(rows, "k_size long, k_lang long, k_source long, w long")
    root, shards = sharding.tree(units, 13), []

    def check(node, own):
        if node.low is None:
            return shards.append((node.first, sum(r[3] for r in own)))
        spread = [(max(r[i] for r in own) >> 32) - (min(r[i] for r in own) >> 32) for i in range(3)]
        i = sharding.DIMENSIONS.index(node.dim)
        assert spread[i] == max(spread)
        low, high = [r for r in own if r[i] < node.border], [r for r in own if r[i] >= node.border]
        aim = sum(r[3] for r in own) * (node.shards // 2) / node.shards
        slow = sorted({r[i] for r in own})
        best = min(abs(sum(r[3] for r in own if r[i] < v) - aim) for v in [*slow, slow[-1] + 1])
        assert abs(sum(r[3] for r in low) - aim) <= best + 1e-3 * sum(r[3] for r in own)
        check(node.low, low), check(node.high, high)

    check(root, rows)
    assert sorted(s for s, _ in shards) == list(range(13))


def test_shards_of_little(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert len(sharding.shard(df, 40).collect()) == 2
    assert sharding.shard(df.limit(0), 40).count() == 0


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i}", f"<p>{'y' * int(rng.integers(0, 5000))}{i if i % 3 else ''}</p>") for i in range(200)]
    pages += [(300, None, None), (301, "u\r\nv", ""), (302, "u", "é\r\n\r\nWARC/1.1"), (303, "u", "é\r\n\r\nWARC/1.1"), (302, "u", "é\r\n\r\nWARC/1.1"), (None, "n", "<p></p>"), (304, "big", "z" * 400_000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, sha string, n int")
    for least in (0, 100):
        rows = warc.round_trip(df, least, frame_bytes=4000, bundle_bytes=30_000).collect()
        first = {}
        for i, _, h in pages:
            h = h or ""
            if i is not None and len(h.encode()) >= least:
                first[h] = min(first.get(h, i), i)
        want = []
        for i, _, h in pages:
            h = (h or "").encode()
            f = first.get(h.decode(), i)
            again = i is not None and f is not None and f != i
            want.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", f if again else None))
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_bundles_seek_by_frame():
    b = warc.Bundle(100)
    raws = [warc.record(i, "u", b"p" * 60, True, None) for i in range(9)]
    places = [b.add(r) for r in raws]
    content = b.content()
    table = warc.seek_table(content)
    assert len(table) == len({p[0] for p in places}) > 1
    for raw, (k, at, size) in zip(raws, places):
        assert warc.frame(content, table, k)[at : at + size] == raw
        assert warc.read_page(content, k, at, size) == warc.parse(raw)
    with pytest.raises(ValueError):
        warc.seek_table(content[:-1])


@pytest.mark.parametrize("n", [0, 1, 511, 512, 5000])
def test_wavelet_queries(n, monkeypatch):
    monkeypatch.setattr(wavelet, "PLANE_PART", 128)
    ids = rng.choice([0, 3, 7, 255, 256, 50256, 40000], n).astype("<u4")
    s = wavelet.Shard(wavelet.encode_shard([1], [n], ids, partition=0, shard=0))
    assert s.ids().tolist() == ids.tolist()
    for at in range(0, n, max(1, n // 40)):
        assert s.access(at) == ids[at]
        for token in (0, 255, 50256, 5, 1 << 20):
            assert s.count(token, at // 2, at) == int((ids[at // 2 : at] == token).sum())
    for token in set(ids.tolist()):
        places = np.flatnonzero(ids == token)
        for k in (0, len(places) // 2, len(places) - 1):
            assert s.occurrence(token, k) == places[k]
    with pytest.raises(IndexError):
        s.occurrence(50256, n + 1)


def test_wavelet_files_round_trip(spark):
    texts = [(i, " ".join(f"word{x}" for x in rng.integers(0, 50, int(n)))) for i, n in enumerate(rng.integers(0, 80, 150))]
    texts += [(900, None), (901, ""), (902, "long " * 30_000), (-5, "neg"), (904, "a \u00a0 \u00a0 b"), (3, texts[3][1])]
    df = spark.createDataFrame([(*t, 0, 0) for t in texts], "doc_id long, text string, start int, shard int")
    folder, manifest = wavelet.write_shards(df, shard_tokens=2000)
    rows = wavelet.read_shards(spark, folder, manifest).orderBy("start").collect()
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    assert [r.doc_id for r in rows] == sorted(i for i, _ in texts)
    encode = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
    by = {i: encode(t) for i, t in texts}
    for r in rows:
        ids = by[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    assert manifest.count() > 1 and wavelet.round_trip(df.limit(0)).count() == 0
