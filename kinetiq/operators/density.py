"""Density clusters: neighbours within a distance, core points, clusters over core links and their borders.

Every point first meets a bounded sample. One with enough neighbours there is core, and those near the sample's largest connected
part belong together; no pair of these settled points has to be looked at again. The others meet all points: these are
dealt to the cells of a bounded number of pivots, and an open point x with home pivot h visits the cell of c if
(|x - c|^2 - |x - h|^2) / (2 |c - h|) <= distance. Open and home points of a cell are cut into blocks, and each pair of blocks is one
matrix product, so neither a cell nor a dense group meets as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetiq.operators.graphs import checkpointed, components

#: Points that all others meet at most; points a pivot should have and pivots at most; rows of a block.
SAMPLE, CELL, PIVOTS, BLOCK = 16384, 2000, 256, 1024


def _near(x: np.ndarray, y: np.ndarray, distance: float) -> np.ndarray:
    """Which pairs are within the distance: by a product, and those at its very border by their differences."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    gap = x @ (-2 * y.T)
    gap += xx[:, None]
    gap += yy[None] - distance**2
    near = gap <= 0
    slack = 1e-9 * (1 + distance**2 + xx.max(initial=0) + yy.max(initial=0))
    i, j = np.nonzero(np.abs(gap, out=gap) <= slack)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        near[p, q] = np.sqrt(((x[p] - y[q]) ** 2).sum(axis=1)) <= distance
    return near


def _rows(n: int, width: int):
    """Slices of n rows whose product with ``width`` columns is bounded."""
    step = max(1, (1 << 22) // max(1, width))
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def _vectors(column) -> np.ndarray:
    return np.array(column.tolist(), float)


def _parts(x: np.ndarray, distance: float) -> np.ndarray:
    """For each point of a sample the first point that links of at most the distance lead to."""
    part = np.full(len(x), -1)
    for first in range(len(x)):
        if part[first] >= 0:
            continue
        part[first], edge = first, np.array([first])
        while len(edge):
            rest = np.flatnonzero(part < 0)
            met = np.zeros(len(rest), bool)
            for r in _rows(len(edge), len(rest)):
                met |= _near(x[edge[r]], x[rest], distance).any(axis=0)
            edge = rest[met]
            part[edge] = first
    return part


def _sampled(whole: DataFrame, n: int, distance: float, least: int) -> DataFrame:
    """``whole(id, v)`` with ``known``, whether the sample shows that a point is core, and ``settled``, whether it shows also that
    it belongs to the sample's largest part. The sample, its counts and its parts are bounded by ``SAMPLE``."""
    spark = whole.sparkSession
    held = whole.orderBy(F.xxhash64("id"), "id").limit(int(np.clip(n // 4, 1, SAMPLE))).toPandas()
    own, x = held["id"].to_numpy(), _vectors(held["v"])
    shared = spark.sparkContext.broadcast((own, x))

    def count(batches):
        own, x = shared.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            v = _vectors(batch["v"]) if len(batch) else np.zeros((0, x.shape[1]))
            for r in _rows(len(v), len(x)):
                total += _near(v[r], x, distance).sum(axis=0)
        yield pd.DataFrame({"at": np.arange(len(own)), "n": total})

    counts = whole.select("v").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # a row a sampled point
    core = np.zeros(len(own), bool)
    core[counts["at"].to_numpy()] = counts["n"].to_numpy() >= least
    part = np.full(len(own), -1)
    part[core] = _parts(x[core], distance)
    names, sizes = np.unique(part[core], return_counts=True)
    largest = part == (names[sizes.argmax()] if len(names) else -2)
    marks = spark.sparkContext.broadcast((own, x, core, largest))

    def mark(batches):
        own, x, core, largest = marks.value
        place = {v: i for i, v in enumerate(own.tolist())}
        for batch in batches:
            if not len(batch):
                continue
            v, ids = _vectors(batch["v"]), batch["id"].to_numpy()
            known, settled = np.zeros(len(v), bool), np.zeros(len(v), bool)
            for r in _rows(len(v), len(x)):
                near = _near(v[r], x, distance)
                at = np.array([place.get(i, -1) for i in ids[r].tolist()])
                known[r] = np.where(at >= 0, core[at], near.sum(axis=1) + 1 >= least)  # a sampled point's count is whole
                settled[r] = known[r] & near[:, largest].any(axis=1)
            yield batch.assign(known=known, settled=settled)

    return whole.mapInPandas(mark, "id long, v array<double>, known boolean, settled boolean")


def _visits(pivots: np.ndarray, distance: float):
    """Each row in its home cell, and open ones as ``asks`` in every cell that may hold a neighbour."""
    between = np.sqrt(np.maximum(0, ((pivots[:, None] - pivots[None]) ** 2).sum(axis=2)))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch["v"])
            far = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)
            home = far.argmin(axis=1)
            gap = far - far[np.arange(len(x)), home][:, None]
            asks = ~batch["settled"].to_numpy(bool)[:, None] & (gap <= 2 * distance * between[home] + 1e-6 * (1 + np.abs(far)))
            i, c = np.nonzero(asks)
            for rows, cell, flag in ((np.arange(len(x)), home, False), (i, c, True)):
                yield batch.iloc[rows].reset_index(drop=True).assign(cell=cell.astype(np.int32), asks=flag)

    return run


def _compared(points: DataFrame, n: int, distance: float, compare, out: str) -> DataFrame:
    """``compare(block of open rows, block of rows, which pairs are near)`` for all open points and all points that may be near.

    ``points(id, v, settled, ...)`` with ``n`` different ids; a point is near itself.
    """
    sample = points.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(int(np.clip(n // CELL, 1, PIVOTS))).toPandas()  # the pivots
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    members = points.mapInPandas(_visits(_vectors(sample["v"]), distance), f"{kinds}, cell int, asks boolean")
    sizes = members.groupBy("cell").agg(*(F.ceil(F.count_if(F.col("asks") == asks) / BLOCK).cast("int").alias(name) for asks, name in ((True, "_asking"), (False, "_home"))))
    rows = members.join(F.broadcast(sizes.filter("_asking > 0 and _home > 0")), "cell")  # a row a pivot
    own, others = F.when(F.col("asks"), F.col("_asking")).otherwise(F.col("_home")), F.when(F.col("asks"), F.col("_home")).otherwise(F.col("_asking"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    i, j = F.when(F.col("asks"), F.col("block")).otherwise(F.col("other")), F.when(F.col("asks"), F.col("other")).otherwise(F.col("block"))
    rows = rows.withColumns({"i": i, "j": j}).drop("_asking", "_home", "block", "other")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        a, b = pdf[asks], pdf[~asks]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[f.strip().split(" ")[0] for f in out.split(",")])
        return compare(a, b, _near(_vectors(a["v"]), _vectors(b["v"]), distance))

    return rows.groupBy("cell", "i", "j").applyInPandas(run, out)


def _counted(a, b, near):
    n = pd.DataFrame({"id": a["id"], "n": near.sum(axis=1)})
    return n[n["n"] > 0]


def _linked(a, b, near):
    """Core points: one link each to the first node that connects them within the two blocks; others: their core neighbours' nodes."""
    ids, other = a["node"].to_numpy(), b["node"].to_numpy()
    core, core2 = a["core"].to_numpy(bool), b["core"].to_numpy(bool)
    out = []
    cores = near & core[:, None] & core2[None]
    root, root2 = ids.copy(), other.copy()
    top = np.iinfo(np.int64).max
    while cores.any():  # the smallest node reachable within the two blocks
        old = root.copy(), root2.copy()
        root = np.minimum(root, np.where(cores, root2[None], top).min(axis=1))
        root2 = np.minimum(root2, np.where(cores, root[:, None], top).min(axis=0))
        if (old[0] == root).all() and (old[1] == root2).all():
            break
    for own, low in ((ids, root), (other, root2)):
        moved = own != low
        out.append(pd.DataFrame({"a": own[moved], "b": low[moved], "border": False}))
    i, j = np.nonzero(near & ~core[:, None] & core2[None])
    out.append(pd.DataFrame({"a": ids[i], "b": other[j], "border": True}))
    return pd.concat(out).drop_duplicates()


def dbscan(points: DataFrame, distance: float, least: int = 5) -> DataFrame:
    """``points(id, v)`` -> (id, core, cluster): clusters are numbered by their smallest core id, -1 is noise.

    A point with ``least`` points within ``distance``, itself included, is core; cores within the distance share a cluster; another point joins the
    cluster of smallest number among its core neighbours. Ids are different longs, vectors of one length; nulls and numbers
    that aren't finite count as 0 in a vector, and rows without a vector are noise.
    """
    clean = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    rows = points.select(F.col("id").cast("long").alias("id"), F.transform(F.col("v").cast("array<double>"), clean).alias("v"))
    whole = rows.filter("v is not null")
    n = whole.count()
    if not n:
        return rows.select("id", F.lit(False).alias("core"), F.lit(-1).alias("cluster"))
    sampled = checkpointed(_sampled(whole, n, distance, least))
    unknown = sampled.select("id", "v", F.col("known").alias("settled"))
    counts = _compared(unknown, n, distance, _counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    lowest = sampled.filter("settled").agg(F.min("id")).first()[0]  # settled points are one node
    marked = sampled.join(counts, "id", "left").select(
        "id", "v", "settled", (F.col("known") | (F.coalesce("n", F.lit(1)) >= least)).alias("core"), F.when(F.col("settled"), F.lit(lowest).cast("long")).otherwise(F.col("id")).alias("node")
    )
    marked = checkpointed(marked)
    links = checkpointed(_compared(marked, n, distance, _linked, "a long, b long, border boolean"))
    groups = components(links.filter("not border").select("a", "b")).toDF("node", "first")
    cores = marked.filter("core").select("id", "node").join(groups, "node", "left").select("id", "node", F.coalesce("first", "node").alias("first"))
    nodes = cores.select("node", "first").distinct()
    reached = links.filter("border").join(nodes, links["b"] == nodes["node"]).groupBy("a").agg(F.min("first").alias("first"))
    named = cores.select("id", F.lit(True).alias("core"), "first").union(reached.select("a", F.lit(False), "first"))
    numbers = cores.select("first").distinct()
    numbers = numbers.select("first", F.expr("row_number() over (order by first) - 1").cast("int").alias("cluster"))  # a row a cluster
    found = named.join(numbers, "first").select("id", "core", "cluster")
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
