"""Sharding by a k-d tree over document metadata.

The tree is grown level by level. Each node picks its widest metadata dimension (its range against the
range over all rows) and is cut at the byte-weighted quantile that gives both sides the bytes of their
leaves: the median where the leaf counts are equal. The quantile is found by radix search: the key
`value * 2^20 + tie` is summed into 4,096 slices per node, the slice that holds the target is sliced
again, and so on until slices have width one. Rows of equal value are told apart by `tie`, a hash of
the row and of its number among rows alike, so that one hot value or one row repeated, however many rows it has, is
cut like any other range. The driver sees
only slice sums (nodes x 4,096 at most) and cuts; rows are never moved until their slots are numbered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthstat.llm.common import documents, store, whole_text

TIES = 1 << 20
SLICES = 4096
CODES = 1 << 16
#: Rows of a shard are numbered in so many independent parts.
PARTS = 1024
#: Rows alike in all columns are numbered in so large blocks, each in one task.
COPIES = 4096


@dataclass
class Node:
    """A node of the tree: its leaves are the shards first .. first + leaves - 1."""

    first: int
    leaves: int
    dim: str = ""
    cut: int = 0
    children: list[Node] = field(default_factory=list)


def _code(col: str) -> Column:
    """A category as a number: equal values are equal, unequal ones mostly differ."""
    return F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(CODES))


def _key(dim: str) -> Column:
    return F.col(dim) * TIES + F.col("tie")


def _place(node: Node) -> Column:
    """The first shard of the leaf-most node that a row falls into."""
    if not node.children:
        return F.lit(node.first)
    left, right = node.children
    return F.when(_key(node.dim) < node.cut, _place(left)).otherwise(_place(right))


def _open(node: Node) -> list[Node]:
    if node.children:
        return [leaf for child in node.children for leaf in _open(child)]
    return [node] if node.leaves > 1 else []


def _quantiles(points: DataFrame, root: Node, nodes: dict[int, dict]) -> None:
    """Set `cut` of every open node: rows with a smaller key go left."""
    placed = points.withColumn("node", _place(root))
    while searching := {n: s for n, s in nodes.items() if s["lo"] + 1 < s["hi"]}:
        for s in searching.values():
            s["width"] = -(-(s["hi"] - s["lo"]) // SLICES)
        part = F.lit(None).cast("long")
        for n, s in searching.items():
            inside = (F.col("node") == n) & (_key(s["node"].dim) >= s["lo"]) & (_key(s["node"].dim) < s["hi"])
            part = F.when(inside, F.call_function("div", _key(s["node"].dim) - s["lo"], F.lit(s["width"]))).otherwise(part)
        sums: dict[int, list] = {n: [] for n in searching}
        rows = placed.withColumn("part", part).where("part IS NOT NULL").groupBy("node", "part").agg(F.sum("size").alias("bytes"))
        for r in rows.collect():
            sums[r.node].append((r.part, r.bytes))
        for n, s in searching.items():
            for part_no, got in sorted(sums[n]):
                if s["below"] + got >= s["target"]:
                    lo = s["lo"] + part_no * s["width"]
                    s["lo"], s["hi"], s["held"] = lo, min(s["hi"], lo + s["width"]), got
                    break
                s["below"] += got
    for s in nodes.values():
        past = s["below"] + s["held"] - s["target"] < s["target"] - s["below"]
        s["node"].cut = s["lo"] + 1 if past else s["lo"]


def grow(points: DataFrame, dims: list[str], leaves: int) -> Node:
    """The tree over points with columns size, tie and the dimensions (integers of 0 .. 2^40)."""
    root, ranges = Node(0, leaves), {}
    while nodes := _open(root):
        spread = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
        stats = points.groupBy(_place(root).alias("node")).agg(F.sum("size").alias("bytes"), *spread).collect()
        by_node = {r.node: r for r in stats}
        if not ranges:
            ranges = {d: max([1] + [r[f"hi_{d}"] - r[f"lo_{d}"] for r in stats]) for d in dims}
        search = {}
        for node in nodes:
            left = node.leaves // 2
            node.children, r = [], by_node.get(node.first)
            if r:
                node.dim = max(dims, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / ranges[d])
                lo, hi = r[f"lo_{node.dim}"] * TIES, (r[f"hi_{node.dim}"] + 1) * TIES
                search[node.first] = {"node": node, "lo": lo, "hi": hi, "below": 0, "held": r.bytes, "target": r.bytes * left / node.leaves}
            else:
                node.dim = dims[0]
        _quantiles(points, root, search)
        for node in nodes:
            left = node.leaves // 2
            node.children = [Node(node.first, left), Node(node.first + left, node.leaves - left)]
    return root


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with `copy`, their number among rows alike in all columns, from 0.

    Rows alike are counted and made again from their count, so that many of them never meet in one task.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    last = F.call_function("div", F.col("n") - 1, F.lit(COPIES))
    blocks = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).repartition("key", "text_crc32", "block")
    first = F.col("block") * COPIES
    copies = F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)
    return blocks.select(*rows.columns, F.explode(copies).alias("copy"))


def kd_shards(
    docs: DataFrame,
    n_shards: int | None = None,
    target_bytes: int = 1 << 30,
    key: str = "doc_id",
    text: str = "text",
    categories: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """Shards of near-equal bytes: key, size, text_crc32, shard, slot.

    A row's size is its text's UTF-8 bytes plus 8; a missing text has none, so such a row has size 8 and
    crc32 0. Without `n_shards` the leaves are as many as bring them to `target_bytes`. The dimensions are the
    size and the categories that the table has (a missing category is one more value). Rows alike in all
    columns are dealt like different ones. Of a very long text only size and crc are kept. Fewer rows than shards leave shards empty; an empty table gives an
    empty result. Other columns are not read. Slots number the rows of a shard without gaps from 0.
    """
    dims = ["size", *[f"dim_{c}" for c in categories if c in docs.columns]]
    body = F.encode(whole_text(text), "UTF-8")
    points = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        *[_code(c).alias(f"dim_{c}") for c in categories if c in docs.columns],
    )
    points = store(_numbered(points).withColumn("tie", F.pmod(F.xxhash64("key", "text_crc32", "copy"), F.lit(TIES))))
    if n_shards is None:
        total = points.agg(F.sum("size")).first()[0] or 0
        n_shards = max(1, -(-total // target_bytes))
    placed = points.withColumn("shard", _place(grow(points, dims, n_shards)).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("copy", "text_crc32", "key"), F.lit(PARTS)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    starts = counts.select("shard", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "text_crc32", "size", "copy"))
    numbered = placed.withColumn("own", own).join(starts, ["shard", "part"])
    return numbered.select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot")
    )


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(documents(spark, sf_dir, "doc_id", "text", "lang", "source"), n_shards=24)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
