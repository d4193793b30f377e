import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthstat.llm import token_files as tf
from hearthstat.llm.common import Recent
from tests.llm.conftest import TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 2**32])
def test_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    if n > 200:
        ids[::50] = 2**32 - 1  # outliers
    assert (tf.decode_ids(tf.encode_ids(ids)) == ids).all()


def test_blocks_can_be_read_alone():
    ids = np.random.default_rng(0).integers(0, 50_000, 1000).astype(np.uint32)
    assert (tf.decode_ids(tf.encode_ids(ids), 3, 5) == ids[3 * 128 : 5 * 128]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(128, dtype=np.uint32) % 16
    plain = len(tf.encode_ids(ids))
    ids[7] = 2**31
    assert len(tf.encode_ids(ids)) == plain + 5


def test_not_a_segment():
    with pytest.raises(ValueError):
        tf.decode_ids(b"x" * 64)


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    at, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_query(spark, sf, given):
    assert got(tf.op1_token_files(spark, sf)) == expected(given)


@pytest.mark.parametrize("segment_ids", [1, 1000, 1 << 20])
def test_odd_rows(odd, segment_ids):
    files = tf.write_token_files(odd, PATH, segment_ids=segment_ids)
    assert got(tf.read_token_files(files)) == expected(TEXTS)


def test_empty(empty):
    assert tf.read_token_files(tf.write_token_files(empty, PATH)).collect() == []


def test_special_and_odd_pieces():
    texts = ["<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n\n <|endoftext", "<|endoftext|>", "a  b\n\n c\t d e　f  \n don't \x1c x\x85y \r\n", "Ġ Ċ", "\n\n\n", ""]
    tokenizer = Tokenizer.from_file(PATH)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tf.tokenize(texts, PATH) == want


def test_texts_without_blanks_leave_a_small_cache():
    """Every run is one word; none of them comes twice."""
    recent = tf._tokenizer(PATH)[3]
    for i in range(40):
        texts = ["".join(chr(0x4E00 + (i * 7 + j * j + k) % 20_000) for j in range(4000)) for k in range(16)]
        tf.tokenize(texts, PATH)
    assert not any(len(w) > recent.longest for w in [*recent.young, *recent.old])


def test_two_generations_of_words():
    asked = []

    def make(words):
        asked.append(sorted(words))
        return [w.encode() * 2 for w in words]

    recent = Recent(most_bytes=1000)
    for i in range(50):
        wanted = {"kept", f"word{i}", f"long{i}" * 30}
        ids = recent.table(wanted, make)
        assert {w: ids(w) for w in wanted} == {w: w.encode() * 2 for w in wanted}
        assert recent.held < 2000 and len(recent.young) + len(recent.old) < 20
    # What is asked for again and again is made once; what is not kept is made each time.
    assert sum("kept" in a for a in asked) == 1
    recent.table({"long1" * 30}, make)
    assert asked[-1] == ["long1" * 30]
