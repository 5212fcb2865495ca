"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Cells are those of centres fitted on a bounded sample; every vector has the cell of its nearest centre as its home. A
vector x that is linked to a y of another cell c lies near the plane between both centres: with h the centre of x's home,
x . (h - c) <= |x - y| |h - c|, and |x - y| is at most the chord of the wanted cosine. x visits all cells of higher number
for which that holds, so each linked pair meets in exactly one cell and none is lost, wherever the centres lie. On data
without clusters a vector visits many cells (a third of them in 64 dimensions); the sample's bound on the number of cells
bounds that too.

A cell's members are dealt into blocks of about ``BLOCK`` rows and each pair of blocks is one matrix product in a task of its
own. A product gives each of its vectors the number of its links and one linked vector of the same group, never the pairs.
Equal vectors of a label are one node with a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import cut, drop, releasing

COSINE = 0.98
#: The sample's bound, vectors a cell should have, bounds of the number of cells, steps of the fit and rows of a block.
SAMPLE, CELL, CELLS, STEPS, BLOCK = 20_000, 4096, (8, 1024), 12, 512


def unit(values) -> np.ndarray | None:
    """The direction of a vector, None if it has none: null, empty, zero, or with null or non-finite components."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top  # squares of any finite components stay finite
    return x / np.sqrt(x @ x)


def _key(label: str, values) -> bytes:
    """Names a vector of a label: 128 bits of its components, so that equal ones meet."""
    named = label.encode("utf-8", "surrogatepass")
    return xxhash.xxh128_digest(len(named).to_bytes(4, "little") + named + (np.asarray(values, np.float64) + 0.0).tobytes())


def _keyed(batches):
    for batch in batches:
        keys, units = [], []
        for label, values in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x = unit(values) if label is not None else None
            keys.append(None if x is None else _key(label, values))
            units.append(None if x is None else x.tobytes())
        arrays = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "key", "unit"])


def centres(sample: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means: unit centres, at most k, of unit vectors."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(STEPS):
        home = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, home, sample)
        sizes = np.sqrt((sums * sums).sum(axis=1))
        found = np.where(sizes[:, None] > 1e-12, sums / np.maximum(sizes, 1e-12)[:, None], found)
    return found


def cells_of(x: np.ndarray, c: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Homes of the unit vectors x and, as a boolean matrix, which cells each is a member of (its home and its visits)."""
    dots = x @ c.T
    home = np.argmax(dots, axis=1)
    between = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
    chord = np.sqrt(max(0.0, 2 - 2 * cosine))
    near = dots[np.arange(len(x)), home][:, None] - dots <= chord * between[home] + 1e-6
    member = near & (np.arange(len(c)) > home[:, None])
    member[np.arange(len(x)), home] = True
    return home, member


def _members(fitted: dict[int, np.ndarray], cosine: float, vectors: bool):
    """For ``mapInArrow`` over nodes: a row per cell that a node is a member of."""

    def run(batches):
        for batch in batches:
            units = batch.column(1).to_pylist()
            dims = np.array([len(u) // 8 for u in units], np.int64)
            rows, cell, home = [], [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, len(at) // 2048 + 1):
                    x = np.frombuffer(b"".join(units[i] for i in part), np.float64).reshape(len(part), dim)
                    if dim in fitted:
                        own, member = cells_of(x, fitted[dim], cosine)
                    else:
                        own, member = np.zeros(len(part), np.int64), np.ones((len(part), 1), bool)
                    i, c = np.nonzero(member)
                    rows.append(part[i]), cell.append(c), home.append(own[i] == c)
            if not rows:
                continue
            rows = pa.array(np.concatenate(rows))
            out = [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(dims).take(rows), pa.array(np.concatenate(cell).astype(np.int64))]
            if vectors:
                out += [pa.array(np.concatenate(home)), batch.column(3).take(rows), batch.column(1).take(rows)]
            yield pa.RecordBatch.from_arrays(out, names=["key", "label", "dim", "cell", "home", "m", "unit"][: len(out)])

    return releasing(run)


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        keys, block = table["key"].combine_chunks(), table["block"].to_numpy()
        x = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(len(block), -1)
        home, m = table["home"].to_numpy(), table["m"].to_numpy()
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = (x[a] @ x[b].T >= cosine) & (home[a][:, None] | home[b][None])
        if i == j:
            np.fill_diagonal(linked, False)
        n, root = np.zeros(len(block), np.int64), np.arange(len(block))
        n[a] += linked @ m[b]
        if i != j:
            n[b] += linked.T @ m[a]
        while True:  # the smallest place reachable, each to each
            old = root.copy()
            root[a] = np.minimum(root[a], np.where(linked, root[b][None], len(block)).min(axis=1, initial=len(block)))
            root[b] = np.minimum(root[b], np.where(linked, root[a][:, None], len(block)).min(axis=0, initial=len(block)))
            if (old == root).all():
                break
        some = np.flatnonzero(n)
        return pa.table({"key": keys.take(pa.array(some)), "n": pa.array(n[some]), "other": keys.take(pa.array(root[some]))})

    return run


def _fit(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Centres by the number of components, from at most SAMPLE vectors with the smallest hashes."""
    k = int(np.clip(-(-nodes.count() // CELL), *CELLS))
    sample = nodes.select("unit").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()["unit"].to_pylist()
    by_dim: dict[int, list[bytes]] = {}
    for u in sample:
        by_dim.setdefault(len(u) // 8, []).append(u)
    return {d: centres(np.frombuffer(b"".join(us), np.float64).reshape(len(us), d), k) for d, us in by_dim.items()}


def linked(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``nodes(key, unit, label, m)`` -> (key, n, other): weights of linked nodes by block, and one node of the same group."""
    fitted = _fit(nodes)
    rows = nodes.select("key", "unit", "label", "m")
    light = "key binary, label string, dim long, cell long"
    by = ["label", "dim", "cell"]
    sizes = rows.mapInArrow(_members(fitted, cosine, False), light).groupBy(*by).count().filter("count > 1")
    sizes = sizes.select(*by, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    members = rows.mapInArrow(_members(fitted, cosine, True), light + ", home boolean, m long, unit binary").join(sizes, by)
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = members.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("blocks", "with")
    return pairs.groupBy(*by, "i", "j").applyInArrow(_compare(cosine), "key binary, n long, other binary")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vectors(vec_id, embedding, label, ...)`` -> a row per row: vec_id, n_links, component_id, kept.

    Rows of equal label link where their cosine in double precision is at least ``cosine``. n_links counts the other rows
    linked directly, equal vectors (copies) included; component_id is the smallest vec_id reachable; kept marks the row that
    has it. Rows with a null label or a vector that is null, empty, zero or has null or non-finite components link with
    nothing and are their own component; so do vectors of another number of components. Rows with a null vec_id link but
    are never kept. Repeated rows are rows of their own, so several may be kept with one vec_id. An empty table gives no rows; other
    columns are ignored.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).mapInArrow(releasing(_keyed), "vec_id long, label string, key binary, unit binary")
    valid = rows.filter("key is not null")
    nodes = valid.groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("unit").alias("unit"))
    nodes = cut(nodes, "nodes")
    found = cut(linked(nodes, cosine), "linked")
    groups = components(found.select(F.col("key").alias("a"), F.col("other").alias("b"))).toDF("key", "c")
    totals = found.groupBy("key").agg(F.sum("n").alias("n"))
    named = nodes.select("key", "vec_id", "m").join(totals, "key", "left").join(groups, "key", "left")
    named = cut(named.select("key", "vec_id", F.coalesce("c", "key").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")), "named")
    smallest = named.groupBy("c").agg(F.min("vec_id").alias("component_id"))
    result = named.join(smallest, "c").select("key", "n_links", "component_id")
    drop(found), drop(nodes)
    joined = valid.select("vec_id", "key").join(result, "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def keep_one(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows of ``vectors`` that represent their group, with all columns; rows without a vec_id stay."""
    kept = near_duplicates(vectors, cosine).filter("kept").select("vec_id").distinct()
    named = vectors.filter("vec_id is not null")
    stays = named.join(kept.withColumnRenamed("vec_id", "_kept_id"), F.col("vec_id").cast("long") == F.col("_kept_id"), "left_semi")
    return stays.unionByName(vectors.filter("vec_id is null"))


ORACLE = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), parts AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM parts
"""
