"""Each stage of the pipeline on its own input, and all of them on the smallest driver tables."""

import os
import zlib
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from kinetiq.llm import decontam, pii, simhash, toxicity
from kinetiq.llm.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="driver tables are not here")


NAMES = ["toxicity", "near_dedup", "decontaminate", "personal_data", "packing"]
ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())


def slow_groups(texts):
    """doc_id -> smallest doc_id of its group, over all pairs: a shingle similarity of 0.8, or four differing bits at most."""
    sets, prints, label = {}, {}, {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        prints[i], label[i] = simhash.fingerprint(t), i
    for a, b in combinations(sorted(sets), 2):
        near = 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 4
        if near and label[a] != label[b]:
            new, old = sorted((label[a], label[b]))
            label = {i: new if c == old else c for i, c in label.items()}
    return label


def slow_contaminated(docs):
    import duckdb

    c = duckdb.connect()
    c.register("documents", docs)
    c.execute(f"create view benchmark as select * from '{TABLES}/benchmark.parquet'")
    return {r[0] for r in c.execute(f"select doc_id from ({decontam.ORACLE})").fetchall()}


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    stages = dict(corpus_pipeline.STAGES)
    a = stages["toxicity"](spark, docs, TABLES)
    assert a.columns == docs.columns
    assert ids(a) == ids(toxicity.toxicity(docs, labels).filter("not toxic"))
    b = stages["near_dedup"](spark, docs, TABLES)
    assert b.columns == docs.columns
    assert ids(b) == sorted(set(slow_groups([(r.doc_id, r.text) for r in docs.collect()]).values()))
    c = stages["decontaminate"](spark, docs, TABLES)
    bad = slow_contaminated(docs.toPandas())
    assert bad and ids(c) == [i for i in ids(docs) if i not in bad]
    d = stages["personal_data"](spark, docs, TABLES)
    assert d.columns == docs.columns and ids(d) == ids(docs)
    assert not any(pii.base_spans(r.text or "") for r in d.collect())


def test_whole_run_against_slow_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, TABLES).toPandas()
    kept = kept[kept["doc_id"].isin(set(slow_groups(list(zip(kept["doc_id"], kept["text"]))).values()))]
    kept = kept[~kept["doc_id"].isin(slow_contaminated(kept))]
    masked = pii.redact(spark.createDataFrame(kept, docs.schema)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for r in masked:
        n = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        at = len(n) % 2048 or 2048
        for k, (i, j) in enumerate([(0, at), *((x, x + 2048) for x in range(at, len(n), 2048))]):
            want.add((r.doc_id, k, i, j - i, zlib.crc32(np.array(n[i:j], "<u4").tobytes())))
    rows = corpus_pipeline.run(spark, TABLES).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert max(r.offset + r.length for r in rows) <= 2048


def test_stages_on_odd_tables(spark):
    rows = [(None, None, 1, "a", "r", "k"), (None, "", 2, "b", "r", "k"), (1, None, 3, "c", "r", "k"), (2, "", 4, "d", "r", "k"), (2, "two words", 5, "e", "r", "k")]
    rows += [(3, "two words", 6, "f", "r", "k"), (3, "two words", 6, "f", "r", "k"), (4, "long " * 200_000, 7, "g", "r", "k"), (5, "write to me@example.com", 8, "h", "r", "k")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, _score int, _text string, row string, key string")
    stages = dict(corpus_pipeline.STAGES)
    for name, left in zip(NAMES[:4], (9, None, 9, 9)):
        out = stages[name](spark, odd, TABLES)
        found = out.collect()
        assert out.columns == odd.columns and (left is None or len(found) == left), name
        assert stages[name](spark, odd.limit(0), TABLES).count() == 0, name
        if name == "near_dedup":  # empty texts are one group, "two words" another; rows without an id stay
            assert sorted((r.doc_id or 0, len(r.text or "")) for r in found) == [(0, 0), (0, 0), (1, 0), (2, 9), (4, 1_000_000), (5, 23)]
        if name == "personal_data":
            assert [r.text for r in found if r.doc_id == 5] == ["write to [EMAIL]"]
    packed = stages["packing"](spark, odd, TABLES).collect()
    assert sum(r.doc_id is None for r in packed) == 2 and max(r.offset + r.length for r in packed) <= 2048
    assert stages["packing"](spark, odd.limit(0), TABLES).count() == 0


def test_one_query_for_each_operator():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 11)] == [1] * 10
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    want, got = c.execute(ORACLES[name]).df(), QUERIES[name](spark, TABLES).toPandas()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    assert rows(got) == rows(want)
