"""Token ids of documents in patched frame-of-reference blocks.

A file is a Parquet table of segments. A segment holds the ids of whole documents, in ascending key order, as
one binary value (little-endian):

    header      8 bytes "PFOR0001", uint32 number of ids, uint32 number of blocks
    index       per block: uint32 byte offset of its data behind the index, uint32 minimum, uint8 width,
                uint8 0, uint16 number of exceptions
    block       128 ids less the minimum (the last block is padded with zeros): packed at `width` bits into
                2 * width uint64 words, value i at bit i * width; then the exceptions, uint8 positions and
                uint32 values

The width is the least that fits the 90th percentile of a block's values; larger ones are exceptions, whose
packed value is 0. Any block can be decoded alone from its index entry. Segments end with a document once they
hold `segment_ids` ids, and a document that is longer makes a longer segment.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthstat.llm.common import Recent, documents, forgotten_by_others, map_arrow, store, whole_text

BLOCK = 128
MAGIC = b"PFOR0001"
HEADER = np.dtype([("magic", "S8"), ("ids", "<u4"), ("blocks", "<u4")])
INDEX = np.dtype([("offset", "<u4"), ("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")])
PERCENTILE = 0.9


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def encode_ids(ids: np.ndarray) -> bytes:
    """One segment of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.zeros(blocks * BLOCK, np.int64)
    values[:n] = ids
    values[n:] = ids[-1] if n else 0
    values = values.reshape(blocks, BLOCK)
    index = np.zeros(blocks, INDEX)
    least = values.min(axis=1) if blocks else np.zeros(0, np.int64)
    values = values - least[:, None]
    # The value that PERCENTILE of the block do not exceed.
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = _widths(np.partition(values, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.int64)
    outlier = values >= (1 << width)[:, None]
    index["least"], index["width"], index["exceptions"] = least, width, outlier.sum(axis=1)
    sizes = 16 * width + 5 * index["exceptions"].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    index["offset"] = offsets[:-1]
    data = np.zeros(offsets[-1], np.uint8)
    packed = np.where(outlier, 0, values).astype(np.uint64)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        words = np.zeros((2 * int(w), len(mine)), np.uint64)
        lanes = np.ascontiguousarray(packed[mine].T)
        for i in range(BLOCK):
            word, bit = divmod(i * int(w), 64)
            words[word] |= lanes[i] << np.uint64(bit)
            if bit + w > 64:
                words[word + 1] |= lanes[i] >> np.uint64(64 - bit)
        at = offsets[mine][:, None] + np.arange(16 * int(w))
        data[at] = np.ascontiguousarray(words.T).view(np.uint8)
    for b in np.flatnonzero(index["exceptions"]):
        where = np.flatnonzero(outlier[b])
        start, k = offsets[b] + 16 * width[b], len(where)
        data[start : start + k] = where
        data[start + k : start + 5 * k] = values[b, where].astype("<u4").view(np.uint8)
    header = np.array([(MAGIC, n, blocks)], HEADER)
    return header.tobytes() + index.tobytes() + data.tobytes()


def decode_ids(segment: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of blocks first_block .. last_block - 1 of a segment; of all blocks by default."""
    header = np.frombuffer(segment, HEADER, 1)[0]
    if header["magic"] != MAGIC:
        raise ValueError("not a segment of token ids")
    index = np.frombuffer(segment, INDEX, header["blocks"], HEADER.itemsize)[first_block:last_block]
    data = np.frombuffer(segment, np.uint8, offset=HEADER.itemsize + header["blocks"] * INDEX.itemsize)
    values = np.zeros((len(index), BLOCK), np.int64)
    offsets, width = index["offset"].astype(np.int64), index["width"].astype(np.int64)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        raw = np.ascontiguousarray(data[offsets[mine][:, None] + np.arange(16 * int(w))])
        words = np.ascontiguousarray(raw.view("<u8").T)
        lanes, mask = np.zeros((BLOCK, len(mine)), np.uint64), np.uint64((1 << int(w)) - 1)
        for i in range(BLOCK):
            word, bit = divmod(i * int(w), 64)
            lanes[i] = words[word] >> np.uint64(bit)
            if bit + w > 64:
                lanes[i] |= words[word + 1] << np.uint64(64 - bit)
        values[mine] = (lanes & mask).T
    for b in np.flatnonzero(index["exceptions"]):
        start, k = offsets[b] + 16 * width[b], int(index["exceptions"][b])
        values[b, data[start : start + k]] = np.ascontiguousarray(data[start + k : start + 5 * k]).view("<u4")
    values += index["least"][:, None].astype(np.int64)
    return values.ravel()[: int(header["ids"]) - first_block * BLOCK].astype(np.uint32)


# The white space at which this vocabulary's pre-tokeniser splits: a piece is a word with the blank before it,
# or white space. No token crosses the ends of a piece, so that equal pieces have equal ids everywhere.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


@functools.cache
def _tokenizer(path: str):
    # Tasks already use all cores: a thread pool in each worker would only wait.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # Added tokens are found in a text before anything else; they split it.
    added = {t.content: np.array([i], "<u4").tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
    split = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None
    return tokenizer, added, split, Recent()


forgotten_by_others(__name__, _tokenizer.cache_clear)


def _pieces(text: str, added: dict[str, bytes], split: re.Pattern | None) -> list[str]:
    if not any(t in text for t in added):
        return PIECES.findall(text)
    return [p for part in split.split(text) for p in ([part] if part in added else PIECES.findall(part))]


def tokenize(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian uint32 bytes; each distinct piece is encoded once."""
    tokenizer, added, split, recent = _tokenizer(path)
    pieces = [_pieces(text, added, split) for text in texts]

    def make(new: list[str]) -> list[bytes]:
        made = {t: added[t] for t in new if t in added}
        words = [p for p in new if not p.isspace() and p not in made]
        made.update(zip(words, _encode_words(tokenizer, words), strict=True))
        spaces = [p for p in new if p.isspace()]
        made.update(zip(spaces, _encode_each(tokenizer, spaces), strict=True))
        return [made[p] for p in new]

    ids = recent.table(set().union(*pieces), make)
    return [b"".join(map(ids, p)) for p in pieces]


def _encode_each(tokenizer, pieces: list[str]) -> list[bytes]:
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def _encode_words(tokenizer, words: list[str]) -> list[bytes]:
    """The ids of pieces that are not white space, encoded as one text: a line break between two is a token of its own."""
    if not words:
        return []
    line = tokenizer.encode("\n", add_special_tokens=False).ids
    ids = np.array(tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4")
    breaks = np.flatnonzero(ids == line[0]).tolist()
    if len(line) != 1 or len(breaks) != len(words) - 1:
        return _encode_each(tokenizer, words)
    raw = ids.tobytes()
    return [raw[4 * a + 4 : 4 * b] for a, b in zip([-1, *breaks], [*breaks, len(ids)], strict=True)]


SEGMENTS = "shard int, segment int, keys array<long>, counts array<long>, ids binary"


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", segment_ids: int = 1 << 20
) -> DataFrame:
    """Encode all texts, append `end_id` to each, write segments in ascending key order; returns a scan of the files.

    A missing or empty text has the end id alone. Rows with a missing key come first, rows with equal keys are
    in order of their texts. Columns other than key and text are not read. Shards are ranges of keys in
    ascending order; shard and segment number the files' content from first to last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        parts: list[bytes] = []
        number, held, shard, end = 0, 0, 0, np.array([end_id], "<u4").tobytes()

        def segment() -> pa.RecordBatch:
            counts = [len(p) // 4 for p in parts]
            packed = encode_ids(np.frombuffer(b"".join(parts), "<u4"))
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([number], pa.int32()),
                pa.array([keys], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([packed], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "segment", "keys", "counts", "ids"])

        for batch in batches:
            shard = batch.column(2)[0].as_py() if len(batch) else shard
            # Slices keep the texts and ids of a whole batch from being held at once.
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                for k, ids in zip(some.column(0).to_pylist(), tokenize(some.column(1).to_pylist(), tokenizer_path), strict=True):
                    keys.append(k)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= segment_ids:
                        yield segment()
                        keys, parts, held, number = [], [], 0, number + 1
        if keys:
            yield segment()

    read = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text"))
    ranged = read.repartitionByRange("key").sortWithinPartitions("key", "text")
    segments = map_arrow(ranged.withColumn("shard", F.spark_partition_id()), run, SEGMENTS)
    return store(segments)


def read_token_files(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                shard, segment, keys, counts, ids = (c[row].as_py() for c in batch.columns)
                data, ends = decode_ids(ids).astype("<u4").tobytes(), np.cumsum(counts)
                starts = ends - counts
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(keys), shard, np.int32)),
                    pa.array(np.full(len(keys), segment, np.int32)),
                    pa.array(keys, pa.int64()),
                    pa.array(starts.astype(np.int64)),
                    pa.array(np.asarray(counts, np.int64)),
                    pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "segment", "key", "inside", "n_tokens", "ids_crc32"])

    decoded = map_arrow(segments, run, "shard int, segment int, key long, inside long, n_tokens long, ids_crc32 long")
    # Ids before each segment: within its shard, then over the shards, of which there are as many as files.
    sizes = segments.select("shard", "segment", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    within = F.sum("n").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n")
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    starts = sizes.select("shard", "segment", within.alias("within")).join(before, "shard")
    starts = starts.select("shard", "segment", (F.col("before") + F.col("within")).alias("first"))
    found = decoded.join(starts, ["shard", "segment"])
    return found.select(F.col("key").alias(key), (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(write_token_files(documents(spark, sf_dir), path))
