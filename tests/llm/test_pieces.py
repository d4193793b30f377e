import random
import zlib

import public_tokenizers
import pytest
import sentencepiece

from hearthstat.llm import pieces
from tests.llm.conftest import TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "Hello  world\nÜ x 😀 \t a", "", None, " ", "      a    b  ", "▁a b", "ﬁ é x\xa0y　z \x00 \r\n <s> <0x41> </s>",
    "a" * 300 + " " + "ababab" * 100, " " * 100, "1234567890" * 50, "the" * 200 + "中文字符測試漢字" * 30, "\x7f​﻿",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encoding_and_decoding_are_the_library_s(library, given):
    texts = ODD + [t for _, t in given[:150]]
    ids = pieces.encode(texts, PATH)
    assert [i.tolist() for i in ids] == library.encode([t or "" for t in texts])
    assert [pieces.decode(i, PATH) for i in ids] == library.decode([i.tolist() for i in ids])


def test_long_and_short_words_are_relaxed_alike(library, monkeypatch):
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("abethion") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    at_once = pieces.encode_words(words, PATH)
    monkeypatch.setattr(pieces, "QUEUED", 1)
    assert pieces.encode_words(words, PATH) == at_once


def test_edges_are_all_occurrences():
    data = "▁the▁theory▁of▁▁▁▁things".encode()
    keys, numbers = pieces.edges(data, PATH)
    found = {(int(k) // 64, int(k) % 64, int(n)) for k, n in zip(keys, numbers, strict=True)}
    want = set()
    for number, piece in enumerate(pieces.vocabulary(PATH).pieces):
        at = data.find(piece)
        while at >= 0:
            want.add((at, len(piece), number))
            at = data.find(piece, at + 1)
    assert found == want and list(keys) == sorted(keys)


def test_odd_rows(odd, library):
    rows = {(r.doc_id, tuple(r.ids), r.ids_crc32, r.decoded_crc32, r.lossless) for r in pieces.encode_documents(odd, PATH).collect()}
    want = set()
    for key, text in TEXTS:
        ids = library.encode(text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.add((key, tuple(ids), zlib.crc32(raw), zlib.crc32((text or "").encode()), True))
    assert rows == want


def test_empty(empty):
    assert pieces.encode_documents(empty, PATH).collect() == []


def test_query(spark, sf, given, library):
    got = {r.doc_id: r for r in pieces.op5_pieces(spark, sf).collect()}
    assert all(got[k].n_pieces == len(library.encode(t)) and got[k].lossless for k, t in given)
