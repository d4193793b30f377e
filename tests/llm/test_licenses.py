import random
import re

import numpy as np
import pytest

from hearthstat.llm import licenses
from hearthstat.llm.licenses import NOTICES, PHRASES, TEMPLATES, Template, distances, find_spans, gram_hashes, license_spans, split_words, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_distances(template, words):
    """Least edit distance of the template to any words that end here, by the full table."""
    column, out = list(range(len(template) + 1)), []
    for w in words:
        new = [0]
        for i, t in enumerate(template):
            new.append(min(column[i] + (t != w), column[i + 1] + 1, new[i] + 1))
        column = new
        out.append(column[-1])
    return out


def phrase_places(words):
    return sorted((i, no) for no, t in enumerate(PHRASES) for i in range(len(words)) if words[i : i + len(t.words)] == [w.decode() for w in t.words])


def expected(doc_id, text):
    words = plain_words(text)
    base = phrase_places(words)
    scores = {no: 1 - min(plain_distances([w.decode() for w in t.words], words), default=99) / len(t.words) for no, t in enumerate(TEMPLATES)}
    hit = {no: s for no, s in scores.items() if s >= TEMPLATES[no].least - 1e-9}
    at = [i for i, _ in base]
    return (
        doc_id, len(words), len(base), min(at, default=None), max(at, default=None),
        ",".join(sorted({PHRASES[no].label for _, no in base})), ",".join(sorted({TEMPLATES[no].label for no in hit})), max(hit.values(), default=0.0),
    )


def changed(template, edits, rng):
    words = [w.decode() for w in template.words]
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + rng.randint(0, 1)] = rng.choice([[], ["changed"], ["of"]])
    return " ".join(words)


def texts():
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["of", "the", "software", "license", "a", "under", "mit", "cc", "by", "é", "中文", "x1"]) for _ in range(n))
    out = [None, "", " \n", "cc", "CC-BY", "CC BY-NC 4.0", "under the MIT license" * 3, "under the MIT license, Under The Mit License.", "apache license\nversion 2.0 " * 50]
    for t in NOTICES:
        for edits in (0, 1, t.edits, t.edits + 1, t.edits + 4):
            out.append(f"{filler(rng.randint(0, 40))} {changed(t, edits, rng)} {filler(rng.randint(0, 40))}")
    out.append(" ".join(changed(t, t.edits // 2, rng) for t in NOTICES for _ in range(2)))
    out += [filler(n) for n in (1, 2, 3, 50, 3000)]
    return out


def run(spark, rows, tmp_path, parts=3):
    spark.createDataFrame(rows, "doc_id long, text string, no int, gram long, key string").repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in licenses.op13_license_scan(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("small", [False, True], ids=["whole", "cut"])
def test_against_brute_force(spark, tmp_path, monkeypatch, small):
    if small:  # texts over many segments, pieces and batches
        monkeypatch.setattr(licenses, "SEGMENT", 64)
        monkeypatch.setattr(licenses, "PIECE", 7)
    rows = [(i, t, 1, 1, "k") for i, t in enumerate(texts())]
    rows += [rows[30], rows[30], (30, "another text under the mit license", 1, 1, "k"), (None, "cc by nc", 1, 1, "k")]
    got = run(spark, rows, tmp_path)
    want = sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert np.allclose([g[7] for g in got], [w[7] for w in want], atol=1e-12)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_given_documents(spark, sf, given):
    got = sorted(tuple(r)[:6] for r in licenses.op13_license_scan(spark, sf).collect())
    assert got == sorted(expected(k, t)[:6] for k, t in given)
    assert any(g[2] for g in got)


def test_long_text(spark, tmp_path):
    text = "word under the mit license " * 60_000 + "x" * 5_000_000 + " under the MIT license"
    got = run(spark, [(1, text, 1, 1, "k")], tmp_path)
    assert got == [(1, 300_005, 60_001, 1, 300_001, "mit", "mit", 1.0)]


def test_words_and_hashes():
    for text in ["É Ünï A-b_c 9z\x00q", "", "a", *filter(None, texts()[:12])]:
        raw = text.encode()
        assert [w.decode() for w in split_words(raw)] == plain_words(text)
        first, hashes = word_hashes(np.frombuffer(raw, np.uint8))
        assert len(first) == len(plain_words(text))
        alone = [int(word_hashes(np.frombuffer(w, np.uint8))[1][0]) for w in split_words(raw)]
        assert alone == hashes.tolist()
    words = word_hashes(np.frombuffer(b"a b c a b c", np.uint8))[1]
    grams = gram_hashes(words).tolist()
    assert grams[0] == grams[3] and len(set(grams)) == 3


def test_distances_are_those_of_the_table():
    rng = random.Random(5)
    for _ in range(200):
        template = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 70))]
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 90))]
        assert distances(template, words) == plain_distances(template, words)


def test_spans_cover_what_matched():
    t = Template("t", " ".join(f"w{i}" for i in range(30)))
    words = ["x"] * 5 + [f"w{i}" for i in range(30) if i != 9] + ["x"] * 3
    text = " ".join(words)
    votes = [(i, 0, int(words[i][1:])) for i in range(5, 32) if words[i][0] == "w" and [int(w[1:]) for w in words[i : i + 3]] == [int(words[i][1:]) + j for j in range(3)]]
    assert find_spans(text.encode(), votes, (t,)) == [(0, 5, 34, 1 - 1 / 30)]


def test_too_short_a_template(spark):
    with pytest.raises(ValueError):
        license_spans(spark.createDataFrame([(1, "a")], "doc_id long, text string"), (Template("x", "a b c d e"),))
