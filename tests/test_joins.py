"""Joins whose inputs are larger than one block."""

import numpy as np
from pyspark.sql import functions as F

from kinetiq.operators import joins as J


def test_vector_search_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(90)]
    corpus = spark.createDataFrame(rows, "uuid long, activity int, vector array<double>")
    queries = corpus.selectExpr("uuid as query_id", "vector as q", "activity").filter("query_id % 2 = 0")
    for q, on in ((queries, ["activity"]), (queries.drop("activity"), None)):
        want = sorted(map(tuple, J.vector_search(q, corpus, 3, on=on).collect()))
        assert len(want) == 45 * 3
        assert sorted(map(tuple, J.vector_search(q, corpus, 3, on=on, most=20).collect())) == want
        assert sorted(map(tuple, J.vector_search(q, corpus, 3, on=on, most=44).collect())) == want
    assert J.vector_search(queries.filter("false"), corpus, 3, on=["activity"], most=20).count() == 0


def test_a_search_keeps_its_best_over_batches_and_blocks_of_scores(spark, monkeypatch):
    scored = J._scored

    def seen(vectors, queries, metric):
        assert len(vectors) * len(queries) <= 4000  # the whole batch would be 20 000
        return scored(vectors, queries, metric)

    monkeypatch.setattr(J, "_scored", seen)
    monkeypatch.setattr(J, "SCORES", 4000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        rng = np.random.default_rng(4)
        x = rng.integers(-2, 3, (1000, 3)).astype(float)  # many equal scores
        corpus = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "uuid long, vector array<double>, side int").coalesce(1)
        queries = corpus.filter("uuid % 10 = 0").select(F.col("uuid").alias("query_id"), F.col("vector").alias("q"))
        got = {(r.query_id, r["rank"]): (r.uuid, r.side) for r in J.vector_search(queries, corpus, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    for q in range(0, 1000, 10):
        score = (unit @ unit[q]).round(9)
        best = sorted((i for i in range(1000) if i != q), key=lambda i: (-score[i], i))[:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, i % 2) for i in best]
