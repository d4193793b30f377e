"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch that are not known yet are laid end to end and indexed by a suffix array
(sorted by the first eight bytes, which is what the search needs; the rest of longer pieces is compared in the
text). A binary search for every piece of the vocabulary gives its range of occurrences. The occurrences are
the edges of a graph over text positions; sorted by position they are looked up by their two ends. The
edges are then relaxed in the order of the model, that of byte-pair merges: in every word the best-scored edge
over two adjacent symbols (the leftmost of equals) replaces them, until none is left. All words are
relaxed at once, one merge per word and pass. Characters without a piece fall back to bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.llm.common import Recent, documents, forgotten_by_others, map_arrow

SPACE = "▁"
#: A word ends where a space follows; no piece goes on behind it.
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NEVER = np.iinfo(np.int64).max
#: Words with more symbols are relaxed one by one with a queue: the passes of a long word would be many.
QUEUED = 64
#: Bytes of a piece that an edge's key has room for.
LONGEST = 62
#: Bytes of new words that are indexed at once.
BLOCK = 2 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a byte-pair model: ids and texts of the normal ones, their rank (0 best), byte ids, decoding table."""

    ids: np.ndarray
    pieces: list[bytes]
    rank: np.ndarray
    byte_ids: np.ndarray
    decoding: list[bytes]
    recent: Recent


@cache
def vocabulary(path: str) -> Vocabulary:
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    proto = ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec, kind = proto.normalizer_spec, ModelProto.SentencePiece.Type
    if proto.trainer_spec.model_type != 2 or spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
        raise ValueError("only byte-pair models with identity normalisation and a dummy prefix are supported")
    normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL]
    if any(p.type == kind.USER_DEFINED for p in proto.pieces) or any(SPACE in p.piece.lstrip(SPACE) for _, p in normal):
        raise ValueError("pieces that are user-defined or span words are not supported")
    if any(len(p.piece.encode()) > LONGEST for _, p in normal):
        raise ValueError(f"pieces of more than {LONGEST} bytes are not supported")
    scores = np.array([p.score for _, p in normal])
    byte_ids = np.full(256, -1, np.int64)
    decoding = []
    for i, p in enumerate(proto.pieces):
        if p.type == kind.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
        decoding.append(
            b"" if p.type == kind.CONTROL
            else bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE
            else b" \xe2\x81\x87 " if p.type == kind.UNKNOWN
            else p.piece.replace(SPACE, " ").encode()
        )
    if (byte_ids < 0).any():
        raise ValueError("models without byte fallback are not supported")
    rank = np.unique(-scores, return_inverse=True)[1]
    return Vocabulary(np.array([i for i, _ in normal]), [p.piece.encode() for _, p in normal], rank, byte_ids, decoding, Recent())


def _heads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number that sorts like them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[at + j]
    return out


@cache
def _searched(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per piece: first and last head of the suffixes that begin with it, and its length."""
    v = vocabulary(path)
    low = np.array([int.from_bytes(p[:8].ljust(8, b"\0"), "big") for p in v.pieces], np.uint64)
    high = np.array([int.from_bytes(p[:8].ljust(8, b"\xff"), "big") for p in v.pieces], np.uint64)
    return low, high, np.array([len(p) for p in v.pieces])


for _kept in (vocabulary, _searched):
    forgotten_by_others(__name__, _kept.cache_clear)


def edges(data: bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of all pieces: sorted keys start * 64 + length, and the piece number of each."""
    v, text = vocabulary(path), np.frombuffer(data, np.uint8)
    starts = np.flatnonzero((text & 0xC0) != 0x80)
    heads = _heads(text, starts)
    order = np.argsort(heads)
    suffixes, heads = starts[order], heads[order]
    low, high, length = _searched(path)
    first, last = np.searchsorted(heads, low, "left"), np.searchsorted(heads, high, "right")
    short = np.flatnonzero((length <= 8) & (last > first))
    count = (last - first)[short]
    total = np.cumsum(count)
    where = np.arange(total[-1] if len(total) else 0) - np.repeat(total - count, count) + np.repeat(first[short], count)
    at, piece = [suffixes[where]], [np.repeat(short, count)]
    for p in np.flatnonzero((length > 8) & (last > first)):
        hits = [s for s in suffixes[first[p] : last[p]].tolist() if data.startswith(v.pieces[p], s)]
        at.append(np.array(hits, np.int64))
        piece.append(np.full(len(hits), p))
    number = np.concatenate(piece).astype(np.int64)
    packed = np.sort(((np.concatenate(at) * 64 + length[number]) << 20) | number)
    return packed >> 20, packed & ((1 << 20) - 1)


class Graph:
    """Edges by their two ends."""

    def __init__(self, data: bytes, path: str) -> None:
        self.keys, self.pieces = edges(data, path)
        self.rank = vocabulary(path).rank

    def find(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece number of each span, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(start), -1)
        length = end - start
        key = start * 64 + np.minimum(length, 63)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (length < 63), self.pieces[at], -1)

    def ranks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        piece = self.find(start, end)
        return np.where(piece >= 0, self.rank[piece], NEVER)


def _relax_all(graph: Graph, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols (start, end, word) left when no edge joins two of them; symbols are in text order."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def pair_ranks(i: np.ndarray) -> np.ndarray:
        """Of symbols i and i + 1, within a word."""
        out = np.full(len(i), NEVER)
        inside = (i >= 0) & (i + 1 < len(start))
        inside[inside] = word[i[inside]] == word[i[inside] + 1]
        out[inside] = graph.ranks(start[i[inside]], end[i[inside] + 1])
        return out

    rank = pair_ranks(np.arange(len(start)))
    while len(start):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.concatenate([first, [len(word)]]))
        best = np.minimum.reduceat(rank, first)
        open_ = np.repeat(best < NEVER, size)
        if not open_.all():
            done.append((start[~open_], end[~open_], word[~open_]))
            start, end, word, rank = start[open_], end[open_], word[open_], rank[open_]
            size, best = size[best < NEVER], best[best < NEVER]
            if not len(start):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
        end[hit] = end[hit + 1]
        keep = np.ones(len(start), bool)
        keep[hit + 1] = False
        start, end, word, rank = start[keep], end[keep], word[keep], rank[keep]
        hit = hit - np.arange(len(hit))  # one symbol before each earlier hit is gone
        rank[hit] = pair_ranks(hit)
        before = hit[hit > 0] - 1
        rank[before] = pair_ranks(before)
    start, end, word = (np.concatenate(c) if done else np.zeros(0, np.int64) for c in zip(*done or [((), (), ())], strict=True))
    order = np.argsort(start)
    return start[order], end[order], word[order]


def _relax_one(graph: Graph, start: list[int], end: list[int]) -> tuple[list[int], list[int]]:
    """The same for one long word, with a queue of edges."""
    n = len(start)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    ranks = graph.ranks(np.array(start[:-1]), np.array(end[1:])).tolist()
    queue = [(r, i, end[i + 1]) for i, r in enumerate(ranks) if r < NEVER]
    heapq.heapify(queue)

    def push(i: int, j: int) -> None:
        r = int(graph.ranks(np.array([start[i]]), np.array([end[j]]))[0])
        if r < NEVER:
            heapq.heappush(queue, (r, i, end[j]))

    while queue:
        _, i, to = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != to:
            continue
        end[i], alive[j], after[i] = to, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            push(i, after[i])
        if before[i] >= 0:
            push(before[i], i)
    left = [i for i in range(n) if alive[i]]
    return [start[i] for i in left], [end[i] for i in left]


def encode_words(words: list[str], path: str) -> list[bytes]:
    """The ids of each word as little-endian int32 bytes."""
    v = vocabulary(path)
    encoded = [w.encode() for w in words]
    # A byte that no text has keeps pieces from matching across words.
    data = b"\xff".join(encoded)
    graph, text = Graph(data, path), np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(w) + 1 for w in encoded]) - 1
    start = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0xFF))
    word = np.searchsorted(ends, start, "right")
    following = np.concatenate([start[1:], [len(data)]])
    end = np.minimum(following, ends[word])
    counts = np.bincount(word, minlength=len(words))
    long_ = counts[word] > QUEUED
    found = [_relax_all(graph, start[~long_], end[~long_], word[~long_])]
    for w in np.flatnonzero(counts > QUEUED):
        mine = slice(*np.searchsorted(word, [w, w + 1]))
        a, b = _relax_one(graph, start[mine].tolist(), end[mine].tolist())
        found.append((np.array(a), np.array(b), np.full(len(a), w)))
    start, end, word = (np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))
    order = np.argsort(start)
    start, end, word = start[order], end[order], word[order]
    piece = graph.find(start, end)
    # Characters without a piece become one id per byte.
    width = np.where(piece >= 0, 1, end - start)
    at = np.repeat(start, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    ids = np.where(np.repeat(piece >= 0, width), v.ids[np.repeat(piece, width)], v.byte_ids[text[at]]).astype("<i4")
    cuts = np.cumsum(np.bincount(word, weights=width, minlength=len(words)).astype(np.int64)).tolist()
    raw = ids.tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def encode(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text; of none for a missing or empty one."""
    split = [WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]

    def make(new: list[str]) -> list[bytes]:
        made, at = [], 0
        while at < len(new):
            upto, held = at, 0
            while upto < len(new) and held < BLOCK:
                held += 4 * len(new[upto])
                upto += 1
            made += encode_words(new[at:upto], path)
            at = upto
        return made

    ids = vocabulary(path).recent.table({w for words in split for w in words}, make)
    return [np.frombuffer(b"".join(map(ids, words)), "<i4") for words in split]


def decode(ids: np.ndarray, path: str) -> str:
    """The text of ids; the blank that encoding puts first is taken off, bytes that are no text are replaced."""
    return b"".join(map(vocabulary(path).decoding.__getitem__, ids.tolist())).decode(errors="replace").removeprefix(" ")


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids, ids_crc32, decoded_crc32 (of the decoded text), lossless (decoding gives the text back).

    A missing or empty text has no ids; decoding gives the empty text, so a missing one counts as lossless. A text
    with the model's own space mark decodes to a plain blank and is not lossless. Repeated rows each get their
    result; columns other than key and text are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                texts = part.column(1).to_pylist()
                ids = encode(texts, model_path)
                decoded = [decode(i, model_path) for i in ids]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                columns = [
                    part.column(0),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                    pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(d.encode()) for d in decoded], pa.int64()),
                    pa.array([d == (t or "") for d, t in zip(decoded, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "ids_crc32", "decoded_crc32", "lossless"])

    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = map_arrow(read, run, f"key {kind}, ids array<int>, ids_crc32 long, decoded_crc32 long, lossless boolean")
    return found.withColumnRenamed("key", key)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", "decoded_crc32", "lossless")
