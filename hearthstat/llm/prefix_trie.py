"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt by ranges of their ids into shards of a few thousand. A shard's index maps (position, turn)
to the set of its conversations that have this turn there, as the bits of one integer. The trie is walked depth first:
the members of a node, met with the set of the next turn of any member not yet taken, are a child; bit counts give the
number of members, and the set of conversations of that length gives those that end here.

A node's name is the hash of its parent's name and its last turn, so that nodes of all shards are merged by
name. What is summed over a subtree is added up in the shards: a node counts in the shard of its smallest member alone, and
that shard has all its ancestors. Only rows of nodes are shuffled, never texts, and a node that many conversations
share has one row in each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthstat.llm.common import map_arrow, store, table
from hearthstat.llm.merkle import CRC32

#: Conversations and turns after which a shard is closed.
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 1 << 18
#: Rows of a record batch.
ROWS = 8192


class VerticalIndex:
    """(position, turn) -> bits of the conversations that have this turn there; conversations come in order."""

    def __init__(self, turns: list[list[bytes]]):
        self.turns = turns
        self.having: dict[tuple[int, bytes], int] = {}
        self.ended: dict[int, int] = {}
        for b, own in enumerate(turns):
            bit = 1 << b
            for at in enumerate(own):
                self.having[at] = self.having.get(at, 0) | bit
            self.ended[len(own)] = self.ended.get(len(own), 0) | bit

    def nodes(self) -> Iterator[tuple[int, int, int, list[int]]]:
        """Depth first: depth, members, those that end here (as bits), and the smallest member of each child."""
        open_ = [(0, (1 << len(self.turns)) - 1)]
        while open_:
            depth, members = open_.pop()
            ends = members & self.ended.get(depth, 0)
            rest, children, firsts = members & ~ends, [], []
            while rest:
                first = (rest & -rest).bit_length() - 1
                child = members & self.having[depth, self.turns[first][depth]]
                children.append((depth + 1, child))
                firsts.append(first)
                rest &= ~child
            open_ += reversed(children)
            yield depth, members, ends, firsts


def bits(of: int) -> list[int]:
    out = []
    while of:
        out.append((of & -of).bit_length() - 1)
        of &= of - 1
    return out


LOCAL = {"shard": pa.int64(), "pre": pa.int32(), "depth": pa.int64(), "name": pa.binary(), "n": pa.int64(), "first": pa.int64(),
         "inner": pa.bool_(), "chars": pa.int64(), "ends": pa.list_(pa.int64())}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def _shard_nodes(ids: list[int], turns: list[list[tuple[bytes, int]]]) -> Iterator[pa.RecordBatch]:
    index = VerticalIndex([[digest for digest, _ in own] for own in turns])
    path: list[bytes] = []
    rows = []
    for pre, (depth, members, ends, children) in enumerate(index.nodes()):
        first = (members & -members).bit_length() - 1
        del path[depth:]
        last = turns[first][depth - 1] if depth else (b"", 0)
        path.append(hashlib.sha256((path[-1] if path else b"") + last[0]).digest())
        rows.append((ids[0], pre, depth, path[-1], members.bit_count(), ids[first], bool(children), last[1], [ids[b] for b in bits(ends)]))
        if len(rows) >= ROWS:
            yield _batch(rows, LOCAL)
            rows = []
    yield _batch(rows, LOCAL)


def _local_tries(sequences: DataFrame) -> DataFrame:
    """The nodes of each shard's trie, numbered in the order of the walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        turns: list[list[tuple[bytes, int]]] = []
        held = 0
        for batch in batches:
            for conv, digest, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not ids or conv != ids[-1]:
                    if len(ids) >= SHARD_CONVERSATIONS or held >= SHARD_TURNS:
                        yield from _shard_nodes(ids, turns)
                        ids, turns, held = [], [], 0
                    ids.append(conv)
                    turns.append([])
                if digest is not None:
                    turns[-1].append((digest, chars))
                    held += 1
        if ids:
            yield from _shard_nodes(ids, turns)

    # All rows of a conversation have one id, so they are in one partition and, sorted, in one shard.
    ranged = sequences.repartitionByRange("conv").sortWithinPartitions("conv", "part", "at")
    schema = "shard long, pre int, depth long, name binary, n long, first long, inner boolean, chars long, ends array<long>"
    return map_arrow(ranged.select("conv", "digest", "chars"), run, schema)


SUMS = {"name": pa.binary(), "conv": pa.int64(), "depth": pa.int64(), "n": pa.int64(), "parent": pa.int64(),
        "children": pa.int64(), "leaves": pa.int64(), "saved": pa.int64()}


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """Per shard and node what its subtree holds of the nodes that count in this shard; a node's own facts where it counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # From the root to the node at hand: name, conv, depth, n, parent, children, leaves, saved, counts here.
        path: list[list] = []
        done: list[tuple] = []

        def close(to: int) -> None:
            while len(path) > to:
                name, conv, depth, n, parent, children, leaves, saved, own = path.pop()
                if path:
                    path[-1][5] += own
                    path[-1][6] += leaves
                    path[-1][7] += saved
                done.append((name, *((conv, depth, n, parent) if own else [None] * 4), children, leaves, saved))

        shard = None
        for batch in batches:
            for of, depth, name, first, conv, n, inner, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != shard:
                    close(0)
                    shard = of
                close(depth)
                own = first == conv
                path.append([name, conv, depth, n, path[-1][1] if path else None, 0, int(own and not inner), (n - 1) * chars if own else 0, own])
                if len(done) >= ROWS:
                    yield _batch(done, SUMS)
                    done.clear()
        close(0)
        yield _batch(done, SUMS)

    walked = nodes.repartition("shard").sortWithinPartitions("shard", "pre")
    schema = "name binary, conv long, depth long, n long, parent long, children long, leaves long, saved long"
    return map_arrow(walked.select("shard", "depth", "name", "first", "conv", "total", "inner_", "chars"), run, schema)


def _end_digests(local: DataFrame) -> DataFrame:
    """Per node at which conversations end: sha256 of their ids. A task holds one shard's ids at a time, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, hashlib.sha256()
        done: list[tuple] = []
        types = {"name": pa.binary(), "ends_sha256": pa.string()}
        for batch in batches:
            for of, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if of != name:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = of, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, ids.values.to_pylist())).encode())
            if len(done) >= ROWS:
                yield _batch(done, types)
                done = []
        if name is not None:
            done.append((name, digest.hexdigest()))
        yield _batch(done, types)

    ended = local.where(F.size("ends") > 0).select("name", "first", "ends")
    return map_arrow(ended.repartition("name").sortWithinPartitions("name", "first"), run, "name binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Per node of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A row of `sequences` is a turn: conv (long), part and at (its order in the conversation), digest (binary, equal for
    equal turns) and chars (the length of its text); a row without a digest only names a conversation, which may
    have no turns and then ends at the root. `saved_tokens` are the code points that a node's members share, all but
    one of them, summed over the subtree. An empty table has no nodes. A conversation may have as many turns as a
    task has room for, at some hundred bytes each; nodes may have any number of members and children.
    """
    local = store(_local_tries(sequences))
    merged = local.groupBy(F.col("name").alias("of")).agg(
        F.min("first").alias("conv"), F.sum("n").alias("total"), F.max("inner").alias("inner_")
    )
    nodes = local.drop("ends", "n", "inner").join(merged, F.col("name") == F.col("of"))
    sums = _subtree_sums(nodes).groupBy("name").agg(
        *[F.max(c).alias(c) for c in ("conv", "depth", "n", "parent")], *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]
    )
    whole = sums.join(_end_digests(local), "name", "left")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as rows for `prefix_trie`: conv, part, at (from 0), digest, chars.

    Turns are in the order of `turn`, a missing one first, equal ones in the order of their digests; a missing role or text is
    empty; repeated rows are turns of their own. Rows without a conversation are left out. Other columns are not read.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    read = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role_), F.lit(":"), role_, text_), 256)).alias("digest"),
        F.char_length(text_).cast("long").alias("chars"),
    )
    at = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")) - 1
    return read.select("conv", F.lit(0).alias("part"), at.alias("at"), "digest", "chars")


def with_shared_openings(turns: DataFrame, every: int, opening: Column, most: int) -> DataFrame:
    """Conversations c with their first `opening` turns (an expression over conv, at most `most`) replaced by those of c - c % every.

    A conversation in whose place no other stands keeps only what comes after its opening.
    """
    turns = store(turns)
    convs = turns.where("at = 0").select("conv", opening.alias("h"))
    own = turns.where(F.col("at") >= opening).select("conv", F.lit(1).alias("part"), "at", "digest", "chars")
    first = turns.where((F.col("conv") % every == 0) & (F.col("at") < most)).select(F.col("conv").alias("base"), "at", "digest", "chars")
    asked = convs.select("conv", "h", (F.col("conv") - F.col("conv") % every).alias("base"))
    taken = asked.join(first, "base").where("at < h").select("conv", F.lit(0).alias("part"), "at", "digest", "chars")
    none = F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")
    named = convs.select("conv", F.lit(-1).alias("part"), F.lit(0).alias("at"), *none)
    return named.union(taken).union(own)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with the opening of the first of its hundred.

    Missing values, empty texts, ties, repeated rows and an empty table are handled as `turn_rows` and `prefix_trie` state.
    """
    turns = turn_rows(table(spark, sf_dir, "conversations"))
    opening = F.crc32(F.col("conv").cast("string")) % 6
    return prefix_trie(with_shared_openings(turns, 100, opening, 5))


OP12_SQL = f"""
WITH digests AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM digests
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor({CRC32.format(text="conv_id::VARCHAR")}, 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.place, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.digest, t.chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h
), sequences AS (
  SELECT c.conv_id, coalesce(list(digest ORDER BY part, place) FILTER (WHERE digest IS NOT NULL), []) AS digests,
    coalesce(list(chars ORDER BY part, place) FILTER (WHERE digest IS NOT NULL), []) AS chars
  FROM convs c LEFT JOIN rebuilt r ON c.conv_id = r.conv_id GROUP BY c.conv_id
), members AS (
  SELECT conv_id, depth, array_to_string(digests[1:depth], '') AS path, coalesce(chars[depth], 0) AS chars, depth = len(digests) AS ends
  FROM (SELECT *, unnest(range(0, len(digests) + 1)) AS depth FROM sequences)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth
), children AS (
  SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), up AS (
  SELECT left(n.path, 64 * n.above) AS path, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf, (n.n - 1) * n.chars AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM nodes) n LEFT JOIN children c ON n.path = c.path
), subtrees AS (
  SELECT path, sum(leaf) AS leaves, sum(saved) AS saved FROM up GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON n.path = s.path LEFT JOIN children c ON n.path = c.path
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1))
"""
