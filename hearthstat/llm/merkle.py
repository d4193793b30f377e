"""Merkle manifest of a table as a postorder append log.

The rows of a group (a source) are the leaves of one tree, in the order of their keys; the roots of the groups,
in the order of their names, are the leaves of the manifest's tree. While a level has several nodes, every three
consecutive ones (the last run: fewer, even one) get a parent, the hash of their digests.

A builder takes an aligned block of 243 leaves and writes the block's nodes in the order in which they are
completed. A node's place in the log of its tree follows from its level, its index and the number of leaves alone
(`position`), so a block's log is one run of digests that starts at a known place, and each node above the blocks has
a known place too. A proof needs the siblings of a leaf's ancestors: those in its block are cut out of the block's run,
those above are looked up by place once for the whole block.

Leaves are numbered by a range partitioning and counts of each partition and group, so that a group of any size is
spread over all tasks; equal rows are told apart by a row number. No task holds more than a block, and of what the
driver sees only the height of the trees and the one root grow at all.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthstat.llm.common import documents, map_arrow, store

ARITY = 3
#: Levels that one builder completes above its leaves.
LEVELS = 5
BLOCK = ARITY**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


# ---- the shape of a tree of n leaves -----------------------------------------------------------------


def height(n: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def position(level: int, index: int, n: int) -> int:
    """Place in the log of the node at this level: all nodes that end before its first leaf, then its own subtree."""
    first = index * ARITY**level
    last = min(first + ARITY**level, n)
    before = sum(first // ARITY**j for j in range(height(n) + 1))
    own = sum(-(-last // ARITY**j) - first // ARITY**j for j in range(level + 1))
    return before + own - 1


@functools.lru_cache(1024)
def _block_places(leaves: int, levels: int) -> list[list[int]]:
    """Places within a block's run, by level and index: the block is a subtree with that many levels."""
    places: list[list[int]] = [[] for _ in range(levels + 1)]
    done = 0
    for leaf in range(leaves):
        for level in range(levels + 1):
            places[level] += [done] if len(places[level]) == leaf // ARITY**level else []
            if (leaf + 1) % ARITY**level and leaf + 1 < leaves:
                places[level].pop()
                break
            places[level][-1] = done
            done += 1
    return places


def _wanted(block: int, n: int) -> list[tuple[int, bool, int]]:
    """(level, left of the path, place) of the siblings of a block's ancestors, the block's root included."""
    out = []
    for level in range(LEVELS, height(n)):
        own = block // ARITY ** (level - LEVELS)
        size = -(-n // ARITY**level)
        run = own - own % ARITY
        out += [(level, j < own, position(level, j, n)) for j in range(run, min(run + ARITY, size)) if j != own]
    return out


def _parents(level: list[bytes]) -> list[bytes]:
    return [hashlib.sha256("".join(d.hex() for d in level[i : i + ARITY]).encode()).digest() for i in range(0, len(level), ARITY)]


def _levels(leaves: list[bytes], count: int) -> list[list[bytes]]:
    out = [leaves]
    for _ in range(count):
        out.append(_parents(out[-1]))
    return out


def _postorder(levels: list[list[bytes]]) -> list[bytes]:
    places = _block_places(len(levels[0]), len(levels) - 1)
    run = [b""] * sum(map(len, levels))
    for nodes, at in zip(levels, places, strict=True):
        for digest, p in zip(nodes, at, strict=True):
            run[p] = digest
    return run


# ---- leaves ------------------------------------------------------------------------------------------


def digest_of(*values: Column) -> Column:
    """Hash (lowercase hex) of values, each `-` if missing, else its UTF-8 byte count, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts]), 256)


def tree_name(group: Column) -> Column:
    """The group as a name that is never missing and sorts as the groups do: missing first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add `index`, the leaf's number in its tree, and `n`, the leaves of the tree, to a stored table."""
    by = ["tree", *order]
    ranged = leaves.repartitionByRange(*by).sortWithinPartitions(*by)
    # Numbers ascend with the partition, then with the row: the tree's rows of a partition have consecutive ones.
    placed = store(ranged.select("*", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33).alias("part")
    counts = placed.groupBy("tree", part).agg(F.count("*").alias("held"), F.min("at").alias("least"))
    whole = Window.partitionBy("tree")
    starts = counts.select(
        F.col("tree").alias("in_tree"),
        F.col("part").alias("in_part"),
        (F.sum("held").over(whole.orderBy("part")) - F.col("held") - F.col("least")).alias("shift"),
        F.sum("held").over(whole).alias("n"),
    )
    same = (F.col("tree") == F.col("in_tree")) & (F.shiftright("at", 33) == F.col("in_part"))
    return placed.join(store(starts), same).select(*leaves.columns, "n", (F.col("at") + F.col("shift")).alias("index"))


# ---- the log -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Log:
    """The log of many trees.

    `blocks` has a row for each block of leaves: tree, n, block, members (of its leaves, in order), start (place of
    its first node) and nodes (the digests of its nodes in the order of completion). `upper` has the nodes from the
    blocks' roots on: tree, place, digest.
    """

    blocks: DataFrame
    upper: DataFrame

    def nodes(self) -> DataFrame:
        """All nodes: tree, place, digest (lowercase hex)."""
        cut = F.expr(f"transform(sequence(0, octet_length(nodes) div {DIGEST} - 1), i -> substring(nodes, i * {DIGEST} + 1, {DIGEST}))")
        inner = self.blocks.select("tree", "start", F.posexplode(cut).alias("i", "digest"))
        inner = inner.select("tree", (F.col("start") + F.col("i")).alias("place"), "digest")
        return inner.union(self.upper).distinct().withColumn("digest", F.lower(F.hex("digest")))

    def roots(self) -> DataFrame:
        """The root of each tree: tree, root."""
        last = F.max_by("digest", "place")
        return self.upper.groupBy("tree").agg(last.alias("root"))


def _gathered(nodes: DataFrame, size: int, *more: str) -> DataFrame:
    """Nodes (tree, n, index, digest) of a level by aligned blocks of so many: items are in order."""
    block = F.expr(f"index div {size}").alias("block")
    return nodes.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(F.struct("index", "digest", *more))).alias("items"))


def _build_blocks(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, runs = [], []
            for n, block, leaves in zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True):
                levels = _levels(leaves, min(LEVELS, height(n)))
                done = _postorder(levels)
                starts.append(position(0, block * BLOCK, n))
                runs.append(b"".join(done))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column(4), pa.array(starts, pa.int64()), pa.array(runs, pa.binary())],
                names=["tree", "n", "block", "members", "start", "nodes"],
            )

    read = blocks.select("tree", "n", "block", F.col("items.digest").alias("leaves"), F.col("items.member").alias("members"))
    kind = read.schema["members"].dataType.simpleString()
    return map_arrow(read, run, f"tree string, n long, block long, members {kind}, start long, nodes binary")


def _build_above(nodes: DataFrame, level: int) -> DataFrame:
    """From nodes (tree, n, index, digest) of one level, all nodes of the next LEVELS levels: the same, level and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, n, block, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for up, digests in enumerate(_levels(leaves, min(LEVELS, height(n) - level))):
                    first = block * BLOCK // ARITY**up
                    rows += [(tree, n, first + i, d, level + up, position(level + up, first + i, n)) for i, d in enumerate(digests) if up]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["tree", "n", "index", "digest", "level", "place"]
    read = _gathered(nodes, BLOCK).select("tree", "n", "block", F.col("items.digest").alias("leaves"))
    return map_arrow(read, run, "tree string, n long, index long, digest binary, level int, place long")


def append_log(leaves: DataFrame) -> Log:
    """The log of all trees from numbered leaves: tree, n, index, digest (binary) and member (what to keep of a leaf)."""
    blocks = store(_build_blocks(_gathered(leaves, BLOCK, "member")))
    last = F.expr(f"substring(nodes, -{DIGEST}, {DIGEST})")
    tops = blocks.select("tree", "n", F.col("block").alias("index"), last.alias("digest"), "start", "nodes")
    place = F.col("start") + F.expr(f"octet_length(nodes) div {DIGEST} - 1")
    upper = tops.select("tree", place.alias("place"), "digest")
    most = blocks.agg(F.max("n")).first()[0] or 0
    level, reached = LEVELS, tops.where(F.col("n") > BLOCK).select("tree", "n", "index", "digest")
    while height(most) > level:
        above = store(_build_above(reached, level))
        upper = upper.union(above.select("tree", "place", "digest"))
        level += LEVELS
        reached = above.where(F.col("level") == level).select("tree", "n", "index", "digest")
    return Log(blocks, store(upper))


# ---- proofs ------------------------------------------------------------------------------------------

STEPS = "array<struct<left:string,right:string>>"


def proofs(log: Log, tails: DataFrame) -> DataFrame:
    """One row for each leaf: tree, member, leaf (hex), path, and the columns of `tails`, a row for each tree.

    `path` has a step for each level: the hex digests of the siblings to the left and to the right, joined. If
    `tails` has a column `tail` of steps, they follow.
    """
    wanted = F.udf(lambda block, n: _wanted(block, n), "array<struct<level:int,left:boolean,place:long>>")
    asked = log.blocks.where(F.col("n") > BLOCK).select("tree", "block", F.explode(wanted("block", "n")).alias("s"))
    found = asked.select("tree", "block", "s.*").join(log.upper, ["tree", "place"])
    step = F.struct("level", "left", "place", "digest")
    above = found.groupBy("tree", "block").agg(F.array_sort(F.collect_list(step)).alias("above"))
    # Places in a level ascend with the index, and `left` only restates their order.
    more = [c for c in tails.columns if c != "tree"]
    whole = log.blocks.join(above, ["tree", "block"], "left").join(tails, "tree")
    read = whole.select("tree", "members", "n", "nodes", "above", *more)
    kind = read.schema["members"].dataType.elementType.simpleString()
    tail_at = more.index("tail") + 5 if "tail" in more else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1)
                tree, members, n, nodes, above = (row.column(i) for i in range(5))
                members = members.values.slice(members.offsets[0].as_py(), members.offsets[1].as_py() - members.offsets[0].as_py())
                n, nodes = n[0].as_py(), nodes[0].as_py()
                levels = min(LEVELS, height(n))
                places = _block_places(len(members), levels)
                hexes = [nodes[i : i + DIGEST].hex() for i in range(0, len(nodes), DIGEST)]
                rest = [{"left": "", "right": ""} for _ in range(levels, height(n))]
                for s in above[0].as_py() or []:
                    rest[s["level"] - LEVELS]["left" if s["left"] else "right"] += s["digest"].hex()
                rest += (row.column(tail_at)[0].as_py() or []) if tail_at else []
                paths = []
                for leaf in range(len(members)):
                    path, i = [], leaf
                    for level in range(levels):
                        run_ = places[level][i - i % ARITY : i - i % ARITY + ARITY]
                        path.append({"left": "".join(hexes[p] for p in run_[: i % ARITY]), "right": "".join(hexes[p] for p in run_[i % ARITY + 1 :])})
                        i //= ARITY
                    paths.append(path + rest)
                repeated = [pa.array([row.column(c)[0].as_py()] * len(members), batch.schema.field(c).type) for c in (0, *range(5, 5 + len(more))) if c != tail_at]
                leaves = pa.array([hexes[p] for p in places[0]], pa.string())
                yield pa.RecordBatch.from_arrays([members, leaves, pa.array(paths, steps), *repeated], names=names)

    kept = [c for c in more if c != "tail"]
    names = ["member", "leaf", "path", "tree", *kept]
    steps = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    types = "".join(f", {c} {tails.schema[c].dataType.simpleString()}" for c in kept)
    return map_arrow(read, run, f"member {kind}, leaf string, path {STEPS}, tree string{types}")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]), 256))


def siblings(path: Column) -> Column:
    """The siblings of a path, level by level, left to right, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest_proofs(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "source", kept: dict[str, Column] | None = None
) -> tuple[DataFrame, str | None]:
    """A proof for each row, and the root of the manifest (hex; None for an empty table).

    Rows: `member` (key and the `kept` columns), leaf, path, subroot. A missing value counts as `-`, so that it differs
    from an empty one; rows without a group are a group of their own, the first one; a missing key comes first. Rows
    with the same key stand in the order of their leaves; a repeated row is a leaf each time. Texts may have any
    length: they are hashed in the scan and go no further. Columns not named are not read.
    """
    values = docs.select(
        tree_name(F.col(group)).alias("tree"),
        F.unhex(digest_of(*[F.col(c) for c in columns])).alias("digest"),
        F.struct(F.col(key).alias("key"), *[c.alias(name) for name, c in (kept or {}).items()]).alias("member"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = store(values.withColumn("key", F.col("member.key")))
    log = append_log(numbered(rows, ["key", "digest", "row"]))
    subroots = store(log.roots())
    named = subroots.select(F.lit("").alias("tree"), F.col("root").alias("digest"), F.struct("tree").alias("member"), F.col("tree").alias("name"))
    top = append_log(numbered(store(named), ["name"]))
    root = top.roots().first()
    of_group = proofs(top, top.roots().select("tree"))
    tails = of_group.select("member.tree", F.col("leaf").alias("subroot"), F.col("path").alias("tail"))
    return proofs(log, store(tails)), root and root["root"].hex()


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document, checked against documents of which half have lost their line breaks.

    Missing values, empty and long texts, repeated rows and an empty table are handled as `manifest_proofs` states.
    """
    docs = documents(spark, sf_dir, *COLUMNS)
    cut = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.unhex(digest_of(*cut)))
    found, root = manifest_proofs(docs, kept={"tampered": tampered})
    start = F.coalesce(F.lower(F.hex("member.tampered")), "leaf")
    checked = found.select("*", folded(start, F.col("path")).alias("folded_root"))
    return checked.select(
        F.col("member.key").alias("doc_id"),
        "leaf",
        "subroot",
        F.lit(root).cast("string").alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        F.coalesce(F.col("folded_root") == F.lit(root), F.lit(False)).alias("verified"),
    )


#: crc32 of short ASCII text in SQL, as its arithmetic bit by bit.
CRC32 = """
  list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)),
    lambda crc, ch: list_reduce(list_concat([xor(crc, ch)], [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]),
      lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

OP11_SQL = f"""
WITH RECURSIVE part AS (
  SELECT doc_id, source,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    text,
    CASE WHEN xor({CRC32.format(text="doc_id::VARCHAR")}, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
  FROM documents
), leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS digest,
    sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS tampered
  FROM part
), base AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM leaf
), tree AS (
  SELECT source, 0 AS level, idx, n, digest FROM base
  UNION ALL
  SELECT source, level + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY source, level, idx // 3
), sub AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, idx, n, digest FROM sub
  UNION ALL
  SELECT level + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 3
), path AS (
  SELECT b.source, b.idx, t.level,
    coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx < b.idx // (3 ** t.level)::BIGINT), '') AS before,
    coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx > b.idx // (3 ** t.level)::BIGINT), '') AS after
  FROM base b JOIN tree t ON b.source IS NOT DISTINCT FROM t.source AND t.n > 1 AND t.idx // 3 = b.idx // (3 ** t.level)::BIGINT // 3
  GROUP BY b.source, b.idx, t.level
), top_path AS (
  SELECT s.source, t.level,
    coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx < s.idx // (3 ** t.level)::BIGINT), '') AS before,
    coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (WHERE t.idx > s.idx // (3 ** t.level)::BIGINT), '') AS after
  FROM sub s JOIN top t ON t.n > 1 AND t.idx // 3 = s.idx // (3 ** t.level)::BIGINT // 3
  GROUP BY s.source, t.level
), step AS (
  SELECT source, idx, list(before ORDER BY level) AS before, list(after ORDER BY level) AS after FROM path GROUP BY source, idx
), top_step AS (
  SELECT source, list(before ORDER BY level) AS before, list(after ORDER BY level) AS after FROM top_path GROUP BY source
), proof AS (
  SELECT b.doc_id, b.digest AS leaf, b.tampered, s.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root,
    list_concat(coalesce(p.before, []), coalesce(q.before, [])) AS before, list_concat(coalesce(p.after, []), coalesce(q.after, [])) AS after
  FROM base b JOIN sub s ON b.source IS NOT DISTINCT FROM s.source
  LEFT JOIN step p ON b.source IS NOT DISTINCT FROM p.source AND b.idx = p.idx
  LEFT JOIN top_step q ON b.source IS NOT DISTINCT FROM q.source
), folded AS (
  SELECT *, list_reduce(list_concat([tampered], list_transform(before, lambda x, i: x || '|' || after[i])),
    lambda below, s: sha256(string_split(s, '|')[1] || below || string_split(s, '|')[2])) AS folded_root
  FROM proof
)
SELECT doc_id, leaf, subroot, root,
  sha256(list_aggregate(list_concat([''], list_transform(before, lambda x, i: x || after[i])), 'string_agg', '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded
"""
