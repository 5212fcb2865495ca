"""Shards of near-equal bytes by a k-d tree over the documents' metadata.

A node of the tree that has to give k shards is parted where its weight is floor(k/2) to the rest, along the dimension
(size, lang, source) in which it is widest for its range in the whole table. The weighted median comes from histograms of
a 64-bit key, summed by Spark for all nodes of a level at once and narrowed to one bin until that bin weighs next to
nothing; the driver holds at most ``BINS`` sums a node. Text values are keyed by their rank among the distinct ones (among
``RANKS`` of them, spread by hash, where there are more). The key's low bits order equal values by a hash of the text, so
ties part anywhere and copies stay side by side: equal texts share a shard unless a border falls among them. A text whose
copies weigh much is dealt into units of 1/``PART`` of a shard, row by row, so that a border may fall between any two of them.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import number_within
from .store import cut, drop, releasing

SHARDS, OVERHEAD = 40, 16
BINS, PART, RANKS = 1024, 256, 4096
#: Bits of a key for a text's hash and for the unit of its copies, below those of the value.
HASH_BITS, PART_BITS = 16, 16
TOLERANCE = 1 / 4000
DIMENSIONS = ("size", "lang", "source")


@dataclass
class Node:
    shards: int
    first: int  # its first shard
    number: int = 0
    dim: str = ""
    border: int = 0
    low: "Node | None" = None
    high: "Node | None" = None


def _place(node: Node, value) -> Column:
    """A row's value at its leaf of the tree as it stands."""
    if node.low is None:
        return F.lit(value(node))
    return F.when(F.col(f"k_{node.dim}") < node.border, _place(node.low, value)).otherwise(_place(node.high, value))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.low is None else _leaves(node.low) + _leaves(node.high)


def _ranked(meta: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``meta`` with the text columns ``names`` as numbers: how many of the known values are smaller; a null is the smallest."""
    known = {}
    for name in names:
        values = meta.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(F.xxhash64(name), name).limit(RANKS)
        known[name] = sorted(r[0].encode("utf-8", "surrogatepass") for r in values.collect())
    schema = ", ".join(f"{f.name} {'double' if f.name in names else f.dataType.simpleString()}" for f in meta.schema.fields)

    def run(batches):
        for batch in batches:
            out = []
            for name, column in zip(batch.schema.names, batch.columns):
                if name in names:
                    coded = column.dictionary_encode()
                    rank = [1.0 + bisect.bisect_left(known[name], v.encode("utf-8", "surrogatepass")) for v in coded.dictionary.to_pylist()]
                    column = pc.fill_null(pa.array(rank, pa.float64()).take(coded.indices), 0.0)
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    return meta.mapInArrow(releasing(run), schema)


def _units(meta: DataFrame, target: float) -> DataFrame:
    """Equal texts as one weighted row, dealt row by row into parts where they weigh over 1/PART of a shard.

    The parts are drawn, not taken from an id: rows may share one, or have none. They decide nothing but the place of a row
    among its copies, and are written before they are used.
    """
    same = ["h", "size", "text_crc32"]
    parts = F.least(F.lit(1 << PART_BITS), F.ceil(F.col("n") * F.col("size") * PART / F.lit(target)))
    groups = meta.groupBy(*same).agg(F.count("*").alias("n"), F.min("lang").alias("g_lang"), F.min("source").alias("g_source"))
    groups = groups.withColumn("parts", F.greatest(F.lit(1), parts).cast("int"))
    return meta.join(groups, same).withColumn("part", F.floor(F.rand(7) * F.col("parts")).cast("int"))


def _key(value: Column, low: float, high: float) -> Column:
    scaled = F.lit(0.0) if high <= low else (value - low) / (high - low)
    tie = F.shiftleft(F.col("h").bitwiseAND(F.lit((1 << HASH_BITS) - 1)), PART_BITS) + F.col("part")
    return F.shiftleft(F.floor(scaled * ((1 << 31) - 1)).cast("long"), HASH_BITS + PART_BITS) + tie


def _medians(units: DataFrame, root: Node, nodes: list[Node]) -> None:
    """Give each of ``nodes`` its dimension and border, and two children."""
    number = _place(root, lambda n: n.number)
    keys = [f"k_{d}" for d in DIMENSIONS]
    stats = [f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]
    at = units.withColumn("node", number).filter("node > 0")
    found = {r["node"]: r for r in at.groupBy("node").agg(F.sum("w").alias("w"), *stats).collect()}
    state = {}
    for n in nodes:
        r = found.get(n.number)
        if r is None:
            n.dim, n.border = DIMENSIONS[0], 0
            continue
        spread = {d: (r[f"max_k_{d}"] >> 32) - (r[f"min_k_{d}"] >> 32) for d in DIMENSIONS}
        n.dim = max(DIMENSIONS, key=lambda d: spread[d])
        aim = r["w"] * (n.shards // 2) / n.shards
        state[n.number] = {"node": n, "lo": r[f"min_k_{n.dim}"], "hi": r[f"max_k_{n.dim}"] + 1, "aim": aim, "below": 0, "w": r["w"]}
    while state:
        ranges = []
        for k, s in state.items():
            s["step"] = max(1, -(-(s["hi"] - s["lo"]) // BINS))
            ranges.append((k, s["lo"], s["hi"], s["step"], DIMENSIONS.index(s["node"].dim)))
        table = units.sparkSession.createDataFrame(ranges, "node int, lo long, hi long, step long, dim int")
        value = F.get(F.array(*keys), F.col("dim"))
        inside = at.join(F.broadcast(table), "node").withColumn("value", value)  # a row a node
        inside = inside.filter("value >= lo and value < hi")
        binned = inside.withColumn("bin", F.expr("(value - lo) div step"))
        sums: dict = {}
        for r in binned.groupBy("node", "bin").agg(F.sum("w").alias("w")).collect():  # at most BINS a node
            sums.setdefault(r["node"], {})[r["bin"]] = r["w"]
        for k, s in list(state.items()):
            below = s["below"]
            for b, w in sorted(sums.get(k, {}).items()):
                if below + w >= s["aim"]:
                    break
                below += w
            n, lo = s["node"], s["lo"] + b * s["step"]
            if s["step"] == 1 or w <= TOLERANCE * s["w"] / n.shards:
                n.border = lo + s["step"] if below + w - s["aim"] < s["aim"] - below else lo
                del state[k]
            else:
                s |= {"lo": lo, "hi": lo + s["step"], "below": below}
    for n in nodes:
        half = n.shards // 2
        n.low, n.high = Node(half, n.first), Node(n.shards - half, n.first + half)


def tree(units: DataFrame, shards: int) -> Node:
    root = Node(shards, 0)
    while todo := [n for n in _leaves(root) if n.shards > 1]:
        for i, n in enumerate(todo):
            n.number = i + 1
        _medians(units, root, todo)
    return root


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Shards have near-equal bytes; a document is never divided, so one longer than a shard's share makes its shard
    larger. A null text counts as empty; null lang, source or doc_id are values like any other; repeated rows get slots
    of their own; other columns are ignored; an empty table gives no rows and fewer documents than shards leave some
    shards without rows.
    """
    have, text = set(docs.columns), F.coalesce(F.col("text").cast("string"), F.lit(""))
    value = lambda name: (F.col(name) if name in have else F.lit(None)).cast("string").alias(name)
    raw = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            value("lang"),
            value("source"),
        ),
        "meta",
    )
    meta = cut(_ranked(raw, ("lang", "source")), "meta")
    drop(raw)
    ends = meta.agg(F.sum("size").alias("total"), *(f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)))
    ends = ends.first()
    total = ends["total"] or 0
    rows = cut(_units(meta, max(1.0, total / shards)), "units")
    value = {"size": F.col("size").cast("double"), "lang": F.col("g_lang"), "source": F.col("g_source")}
    keys = {f"k_{d}": _key(value[d], ends[f"min_{d}"] or 0, ends[f"max_{d}"] or 0) for d in DIMENSIONS}
    rows = rows.withColumns(keys)
    names = list(keys)
    units = cut(rows.groupBy(*names).agg(F.sum("size").alias("w")), "weights")
    root = tree(units, shards) if total else Node(1, 0)
    placed = rows.withColumn("shard", _place(root, lambda n: n.first).cast("int"))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "shard"), "placed")
    for table in (meta, rows, units):
        drop(table)
    out = number_within(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
