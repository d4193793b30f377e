"""Exact substring dedup: suffix automata of reference shards, matching statistics of the streamed texts.

A word goes if a window of `window` words that covers it also starts in a document with a smaller key. Sending
all text past all references would be quadratic, so both are routed first. Every window has an anchor, the
smallest hash among its word `grams`: equal windows have equal anchors. Anchors that occur in one document only are
dropped; what is left are passages, the runs of windows with one anchor, cut at word ends.

Passages meet at their anchor. A shard is a bounded batch of anchors: its different passages are the references of a
generalised suffix automaton over words, whose states know the smallest key among the references that
contain them. The passages are streamed through it: the matching statistic at each word, held at the window
length, is the state of the window that ends there, and so the smallest key that has this window.
An anchor of more than `hot` documents (a common line in ever new surroundings) would make its shard grow;
its windows are routed one by one, each by its own hash, and meet only their equals.

The shards are not broadcast to all tasks as would do for a small reference: a corpus against itself has as many
shards as it has text, and each text needs only those that share an anchor with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.llm.common import documents, map_arrow
from hearthstat.llm.near_dedup import _mix

GRAM = 5
HOT = 256
#: Words of the references of one automaton; a shard ends with the anchor that fills it.
SHARD_WORDS = 50_000
#: Texts that are worked on at once, and rows that are given out at once.
TEXTS, ROWS = 256, 1 << 14


def _packed(docs: DataFrame) -> DataFrame:
    """(key, row, body) with compressed bodies: the texts are shuffled once, and that is most of what this operator moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                bodies = [None if b is None else compress(b) for b in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(bodies, pa.binary())], names=["key", "row", "body"])

    return map_arrow(docs.select("key", "row", "body"), run, "key long, row long, body binary")


def _unpacked(bodies: pa.Array) -> list[bytes | None]:
    decompress = zstandard.ZstdDecompressor().decompress
    return [None if b is None else decompress(b) for b in bodies.to_pylist()]


def split_words(body: bytes | None) -> list[bytes]:
    return (body or b"").split()  # of bytes: ASCII white space


def anchors(words: list[bytes], window: int, gram: int) -> np.ndarray:
    """The anchor of each window; its lowest bit is free for a mark."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams = _mix(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - gram + 1 + j])
    width = window - gram + 1
    # Sliding minimum by doubling: the minimum over 2k is that of two minima over k.
    least, span = grams, 1
    while span < width:
        step = min(span, width - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    return least.view(np.int64) & ~np.int64(1)


class SuffixAutomaton:
    """Generalised suffix automaton over words; a state knows the smallest key of the references that contain it."""

    def __init__(self) -> None:
        self.moves: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [np.iinfo(np.int64).max]

    def _state(self, length: int, link: int, moves: dict[bytes, int], least: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        return len(self.moves) - 1

    def _clone(self, p: int, q: int, word: bytes) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.moves[q]), self.least[q])
        self.link[q] = c
        while p >= 0 and self.moves[p].get(word) == q:
            self.moves[p][word] = c
            p = self.link[p]
        return c

    def add(self, words: list[bytes], key: int) -> None:
        last = 0
        for word in words:
            q = self.moves[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
                self.least[last] = min(self.least[last], key)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}, key), last
            while p >= 0 and word not in self.moves[p]:
                self.moves[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.moves[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
            last = new

    def finish(self) -> None:
        """Hand the smallest keys down to all suffixes."""
        for s in sorted(range(1, len(self.moves)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.least[s] < self.least[p]:
                self.least[p] = self.least[s]

    def window_keys(self, words: list[bytes], window: int) -> list[int]:
        """For each window of a text that the references contain, the smallest key that has it."""
        out, state, held = [], 0, 0
        for word in words:
            while state and word not in self.moves[state]:
                state = self.link[state]
                held = self.length[state]
            if word not in self.moves[state]:
                continue
            state, held = self.moves[state][word], held + 1
            # Of the matched suffix only the last `window` words count.
            while self.length[self.link[state]] >= window:
                state = self.link[state]
                held = self.length[state]
            held = min(held, max(window, self.length[self.link[state]] + 1))
            if held >= window:
                out.append(self.least[state])
        return out


def _rows(columns: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _held(of: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones."""
    return sorted_[np.minimum(np.searchsorted(sorted_, of), len(sorted_) - 1)] == of if len(sorted_) else np.zeros(len(of), bool)


def _passages(docs: DataFrame, window: int, gram: int, texts: bool) -> DataFrame:
    """Passages of rows (key, row, body, marked) with their content (h1, h2) and key.

    With `texts` also route (the anchor) and text, and the single windows of hot anchors without text, routed by
    content and of equal ones only that of the smallest key per task; else all with their row and first word.
    `marked` has the document's anchors that other documents share, with the lowest bit set if they are hot.
    """
    more = [("route", pa.int64(), "long"), ("passage", pa.string(), "string")] if texts else [("row", pa.int64(), "long"), ("offset", pa.int32(), "int")]
    names = ["h1", "h2", "key", *[name for name, _, _ in more]]
    types = [pa.int64()] * 3 + [t for _, t, _ in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        hot_windows: dict[tuple[int, int], int] = {}

        def hot_rows() -> pa.RecordBatch:
            rows = [(h1, h2, key, h1 | 1, None) for (h1, h2), key in hot_windows.items()]
            hot_windows.clear()
            return _rows(list(zip(*rows, strict=True)), names, types)

        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                for key, row, body, marked in zip(*(c.to_pylist() for c in part.columns[:2]), _unpacked(part.column(2)), part.column(3), strict=True):
                    words = split_words(body)
                    own = anchors(words, window, gram)
                    if not len(own):  # the anchors are those of another text of the key
                        continue
                    mark = np.sort(marked.values.to_numpy())
                    shared, hot = _held(own, mark & ~np.int64(1)), _held(own, mark[(mark & 1) == 1] & ~np.int64(1))
                    change = np.concatenate([[True], (own[1:] != own[:-1]) | hot[1:]])
                    first = np.flatnonzero(change)
                    size = np.diff(np.concatenate([first, [len(own)]]))
                    mine = shared[first]
                    for a, k, alone in zip(first[mine].tolist(), size[mine].tolist(), hot[first[mine]].tolist(), strict=True):
                        passage = b" ".join(words[a : a + k + window - 1])
                        both = xxhash.xxh3_128_intdigest(passage)
                        h1, h2 = (both & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (both >> 64) - (1 << 63)
                        if texts and alone:
                            hot_windows[h1, h2] = min(key, hot_windows.get((h1, h2), key))
                            continue
                        for c, v in zip(out, (h1, h2, key, *((int(own[a]), passage.decode()) if texts else (row, a))), strict=True):
                            c.append(v)
                    if len(hot_windows) >= ROWS:
                        yield hot_rows()
                    if len(out[0]) >= ROWS:
                        yield _rows(out, names, types)
                        out = [[] for _ in names]
        yield _rows(out, names, types)
        if hot_windows:
            yield hot_rows()

    schema = ", ".join(["h1 long, h2 long, key long", *[f"{name} {type_}" for name, _, type_ in more]])
    return map_arrow(docs.select("key", "row", "body", "marked"), run, schema)


def _matched(passages: DataFrame, window: int) -> DataFrame:
    """Per distinct passage (h1, h2) that shares a window with another document: the smallest key of each of its windows."""

    def shard(routes: list[dict[tuple[int, int], list]]) -> pa.RecordBatch:
        """One automaton for the passages ([smallest key, documents, words] by content) of some anchors.

        A hot window comes without words: it meets only its equals.
        """
        automaton = SuffixAutomaton()
        for passages in routes:
            if len(passages) > 1:  # the only passage of its anchor has nothing to meet
                for key, _, words in passages.values():
                    automaton.add(words or [], key)
        automaton.finish()
        rows: list[list] = [[], [], []]
        for passages in routes:
            for (h1, h2), (key, documents, words) in passages.items():
                alone = len(passages) == 1 or words is None
                least = [key] * (len(words or [b""] * window) - window + 1) if alone else automaton.window_keys(words, window)
                if documents > 1 or min(least) < key:
                    for c, v in zip(rows, (h1, h2, least), strict=True):
                        c.append(v)
        return _rows(rows, ["h1", "h2", "least"], [pa.int64(), pa.int64(), pa.list_(pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes: list[dict] = []
        held, last = 0, None
        for batch in batches:
            for h1, h2, key, route, passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if route != last:
                    if held >= SHARD_WORDS:
                        yield shard(routes)
                        routes, held = [], 0
                    routes.append({})
                    last = route
                known = routes[-1].get((h1, h2))
                if known:
                    known[0], known[1] = min(known[0], key), known[1] + 1
                else:
                    words = passage.encode().split() if passage is not None else None
                    routes[-1][h1, h2] = [key, 1 if words else 2, words]
                    held += len(words or ())
        yield shard(routes)

    routed = passages.repartition("route").sortWithinPartitions("route")
    return map_arrow(routed.select("h1", "h2", "key", "route", "passage"), run, "h1 long, h2 long, least array<long>")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 13, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row: key, n_words, removed (array of [first, last) word spans), kept (the other words, joined by one space).

    A missing text has no words; one with fewer than `window` words keeps all. Windows are judged on the input.
    Rows with the same key are one document to each other: they remove nothing from each other, and each loses what
    its own text shares with smaller keys. Rows with a missing key are compared with nothing. An empty table gives an
    empty result. Texts may have any length; one text at a time is unpacked. Columns other than key and text are not read.
    """
    # The new names make all scans of the texts alike, so that they share one shuffle.
    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("body"))
    # With the key, the row's text as a number tells rows apart; equal rows have equal results.
    read = read.select("key", F.xxhash64("body").alias("row"), "body")
    named = read.where("key IS NOT NULL")

    def own_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                found = [np.unique(anchors(split_words(t), window, gram)) for t in part.column(1).to_pylist()]
                keys = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(keys)], names=["anchor", "key"])

    pairs = map_arrow(named.select("key", "body"), own_anchors, "anchor long, key long")
    # A document has an anchor once; a repeated row at worst makes one more candidate.
    spread = pairs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    mark = F.col("anchor").bitwiseOR(F.when(F.col("n") > hot, 1).otherwise(0).cast("long"))
    marked = pairs.join(spread.select("anchor", mark.alias("mark")), "anchor").groupBy("key").agg(F.collect_list("mark").alias("marked"))
    # A copy of a whole text has the same windows as the first one: only the first is matched.
    first = named.groupBy(F.md5("body").alias("content")).agg(F.min("key").alias("rep")).where("content IS NOT NULL")
    packed = _packed(named).where("key IS NOT NULL")  # said again, so that both joins below share one shuffle
    candidates = packed.join(marked.join(first, F.col("key") == F.col("rep"), "left_semi"), "key")

    least = _matched(_passages(candidates, window, gram, texts=True), window)
    occurring = _passages(candidates, window, gram, texts=False)
    gone = F.expr("filter(transform(least, (x, i) -> CASE WHEN x < key THEN offset + i END), x -> x IS NOT NULL)")
    hits = occurring.join(least, ["h1", "h2"]).select("key", "row", gone.alias("gone")).where(F.size("gone") > 0)
    hits = hits.groupBy("key", "row").agg(F.flatten(F.collect_list("gone")).alias("hits"))
    copies = named.select("key", "row", F.md5("body").alias("content")).join(first, "content").where("rep < key")
    copies = copies.select("key", "row", F.lit(True).alias("copy")).dropDuplicates(["key", "row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                counts, spans, kept = [], [], []
                for body, found, copy in zip(_unpacked(part.column(1)), part.column(2), part.column(3).to_pylist(), strict=True):
                    words = split_words(body)
                    n = len(words)
                    if copy and n >= window:
                        edge = [[0, n]]
                    elif found.is_valid:
                        start = np.sort(found.values.to_numpy())
                        # Windows that touch or overlap make one span.
                        first = np.concatenate([[True], start[1:] > start[:-1] + window])
                        last = np.concatenate([first[1:], [True]])
                        edge = np.column_stack([start[first], start[last] + window]).tolist()
                    else:
                        edge = []
                    counts.append(n)
                    spans.append(edge)
                    for a, b in reversed(edge):
                        del words[a:b]
                    kept.append(b" ".join(words).decode())
                yield _rows([part.column(0).to_pylist(), counts, spans, kept], names, types)

    names, types = ["key", "n_words", "removed", "kept"], [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]
    schema = "key long, n_words long, removed array<array<long>>, kept string"
    # Joined by the key, so that the texts keep the shuffle they have; the few rows of a key are told apart beside it.
    found, same = hits.toDF("hk", "hr", "hits"), copies.toDF("ck", "cr", "copy")
    whole = packed.join(found, (packed["key"] == found["hk"]) & (packed["row"].bitwiseXOR(found["hr"]) == 0), "left")
    whole = whole.join(same, (whole["key"] == same["ck"]) & (whole["row"].bitwiseXOR(same["cr"]) == 0), "left")
    none = F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("boolean").alias("copy")
    unnamed = _packed(read.where("key IS NULL")).select("key", "body", *none)
    return map_arrow(whole.select("key", "body", "hits", "copy").union(unnamed), cut, schema).withColumnRenamed("key", key)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
