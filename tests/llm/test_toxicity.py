import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from hearthstat.llm import toxicity as tox
from tests.llm.conftest import TEXTS, table


def test_symbols():
    assert tox.symbols("Ab, c!!").tolist() == [0, 1, 2, 0, 3, 0]
    assert tox.symbols("").tolist() == tox.symbols(None).tolist() == tox.symbols("123 --").tolist() == [0]
    assert tox.symbols("É")[1] == tox.symbols("é")[1] >= 27


def test_models_are_distributions():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 3, tox.ALPHABET**tox.ORDER) * (rng.random(tox.ALPHABET**tox.ORDER) < 0.01)
    counts = counts.reshape((tox.ALPHABET,) * tox.ORDER).astype(float)
    lower = np.full(tox.ALPHABET, 1 / tox.ALPHABET)
    assert tox._interpolated(counts, lower).sum(axis=-1) == pytest.approx(1)
    toxic, ordinary = tox.log_shares(counts.ravel(), counts.ravel())
    assert np.abs(toxic - ordinary).max() == 0
    assert np.exp(toxic).reshape(-1, tox.ALPHABET).sum(axis=1) == pytest.approx(1)


def test_a_word_is_spelt_alike_everywhere():
    values = np.random.default_rng(1).normal(size=tox.ALPHABET**tox.ORDER)
    (every,) = tox.by_word(tox.symbols("some words, here"), values)
    for word, got in zip(["some", "words", "here"], every, strict=True):
        at = [0, 0, 0, *(ord(c) - 96 for c in word), 0]
        by_hand = sum(values[((at[i - 3] * 40 + at[i - 2]) * 40 + at[i - 1]) * 40 + at[i]] for i in range(3, len(at)))
        assert got == pytest.approx(by_hand)
    assert len(tox.by_word(tox.symbols(" 1 "), values)[0]) == 0


def brute_force(texts, labels):
    """Features of every text by the model of all training rows, from dicts and loops alone."""
    training = [(t, labels[i]) for i, t in texts if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    words = {y: Counter(w for t, label in training if label == y for w in t.split()) for y in (0, 1)}

    def grams(w):
        s = "___" + w + "_"
        return [s[i - 3 : i + 1] for i in range(3, len(s))]

    seen = {y: Counter() for y in (0, 1)}
    for y, counted in words.items():
        for w, n in counted.items():
            for g in grams(w):
                seen[y][g] += n
    kinds = set(seen[0]) | set(seen[1])
    shorter = [Counter(g[1:] for g in kinds)]
    for _ in range(2):
        shorter.append(Counter(g[1:] for g in shorter[-1]))

    def mixed(counts, g, lower):
        same = [n for k, n in counts.items() if k[:-1] == g[:-1]]
        if not same:
            return lower
        return max(counts.get(g, 0) - 0.75, 0) / sum(same) + 0.75 * len(same) / sum(same) * lower

    @cache
    def symbol(y, g):
        p = 1 / 40
        for counts, k in zip(reversed(shorter), (g[3:], g[2:], g[1:]), strict=True):
            p = mixed(counts, k, p)
        return mixed(seen[y], g, p)

    @cache
    def ratio(w):
        p = {}
        for y in (0, 1):
            total, spelt = sum(words[y].values()), math.prod(symbol(y, g) for g in grams(w))
            freed = sum(1 if n == 1 else 0.75 for n in words[y].values())
            p[y] = (words[y][w] - 0.75 if words[y][w] > 1 else 0) / total + freed / total * spelt
        return min(max(math.log(p[1] / p[0]), -10), 10)

    found = []
    for _, t in texts:
        each = [ratio(w) for w in t.split()]
        parts = [sum(max(r - level, 0) for r in each) / len(each) for level in (tox.CLEAR, tox.STRONG)]
        found.append([sum(each) / len(each), *(math.log(1 + 100 * p) for p in parts)])
    return np.array(found)


def test_features_against_brute_force(spark, monkeypatch):
    """Scores are a logistic function of the brute force's features: their logits are a linear function of them, without a rest."""
    monkeypatch.setattr(tox, "PRUNE", 0.0)
    rng = np.random.default_rng(8)
    bag = ["".join(rng.choice(list("abcde"), rng.integers(1, 5))) for _ in range(150)]
    texts = [(i, " ".join(rng.choice(bag[: 150 if i % 3 else 60], 12))) for i in range(120)]
    labels = {i: int(i % 3 == 0) for i, _ in texts}
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    score = np.array([r.score for r in tox.score_toxicity(table(spark, texts), known).orderBy("doc_id").collect()])
    x = np.column_stack([brute_force(texts, labels), np.ones(len(texts))])
    logit = np.log(score / (1 - score))
    weights, *_ = np.linalg.lstsq(x, logit, rcond=None)
    assert np.abs(x @ weights - logit).max() < 1e-4 and np.std(logit) > 0.3


def test_words_of_other_scripts_tell_classes_apart(spark):
    """The words differ in letters that share a symbol, so spelling alone cannot tell them."""
    bad, good = "\u0430\u0431\u0432\u0430", "\u043d\u043e\u043f\u043d"
    assert tox.symbols(bad).tolist() == tox.symbols(good).tolist()
    rng = np.random.default_rng(4)
    bag = ["".join(rng.choice(list("\u0433\u0434\u0435\u0436\u0437"), 4)) for _ in range(200)]
    texts = [(i, " ".join([*rng.choice(bag, 15), bad if i % 4 == 0 else good])) for i in range(600)]
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id long, toxic int")
    got = [r for r in tox.score_toxicity(table(spark, texts), known).collect() if r.held_out]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got]) >= 0.95


def test_the_model_grows_with_the_corpus(spark):
    def kinds(n):
        rows = [(0, i % 2, f"same word{''.join(chr(97 + int(c)) for c in str(i))}") for i in range(n)]
        return tox.count_words(spark.createDataFrame(rows, "half int, label int, text string")).count()

    assert kinds(50) == 51 and kinds(500) == 501


def corpus(spark):
    rng = np.random.default_rng(5)
    texts = []
    for i in range(400):
        words = ["".join(rng.choice(list("abdeilnorst"), 5)) for _ in range(30)]
        if i % 4 == 0:
            words[rng.integers(30)] = "wuzzle"
        texts.append((i, " ".join(words)))
    labels = [(i, int(i % 4 == 0), None) for i, _ in texts if i % 10] + [(5, 0, None), (None, 1, None), (9999, 1, None), (6, None, None)]
    return texts, spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_held_out_rows_are_told_apart(spark):
    texts, labels = corpus(spark)
    got = {r.doc_id: r for r in tox.score_toxicity(table(spark, texts), labels).collect()}
    held_out = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == set(held_out)
    assert all(0 <= r.score <= 1 for r in got.values())
    right = [(got[i].score >= 0.5) == (i % 4 == 0) for i in held_out]
    assert np.mean(right) >= 0.95


def test_a_long_clean_text_stays_clean(spark):
    """Joining 95 clean texts, none of which was trained on, moves the median score by less than 0.05."""
    texts, labels = corpus(spark)
    clean = [t for i, t in texts if zlib.crc32(str(i).encode()) % 3 == 1 and i % 4]
    rng = np.random.default_rng(2)
    held_out = [i for i in range(10**6, 10**6 + 400) if zlib.crc32(str(i).encode()) % 3 == 1]
    joined = [(i, " ".join(rng.choice(clean, 95))) for i in held_out[:20]]
    single = [(i, str(rng.choice(clean))) for i in held_out[20:60]]
    got = {r.doc_id: r.score for r in tox.score_toxicity(table(spark, texts + joined + single), labels).collect()}
    many, one = [got[i] for i, _ in joined], [got[i] for i, _ in single]
    assert abs(np.median(many) - np.median(one)) < 0.05 and max(many) < 0.7


def test_scores_do_not_depend_on_the_cap(spark, monkeypatch):
    """One in eight texts is toxic, and its word is no proof: a fit that sees half toxic rows moves all scores."""
    rng = np.random.default_rng(11)
    texts, labels = [], []
    for i in range(2000):
        words = ["".join(rng.choice(list("abdeilnorst"), 5)) for _ in range(12)]
        if rng.random() < (0.6 if i % 8 == 0 else 0.15):
            words[0] = "wuzzle"
        texts.append((i, " ".join(words)))
        labels.append((i, int(i % 8 == 0)))
    docs, known = table(spark, texts).cache(), spark.createDataFrame(labels, "doc_id long, toxic int")
    logits = []
    for cap in (10_000, 150):
        monkeypatch.setattr(tox, "FIT_ROWS", cap)
        score = np.array([r.score for r in tox.score_toxicity(docs, known).orderBy("doc_id").collect()])
        logits.append(np.log(score / (1 - score)))
    assert abs(np.mean(logits[1] - logits[0])) < 0.7


def test_a_capped_sample_is_fitted_like_all_rows():
    rng = np.random.default_rng(3)
    y = (rng.random(40_000) < 0.1).astype(float)
    x = rng.normal(size=(len(y), tox.FEATURES)) + 1.5 * y[:, None]
    some = np.concatenate([np.flatnonzero(y == 1)[:2000], np.flatnonzero(y == 0)[:2000]])
    times = np.where(y[some] == 1, (y == 1).sum() / 2000, (y == 0).sum() / 2000)
    (a, v), (b, w) = tox.fit_logistic(x, y), tox.fit_logistic(x[some], y[some], times)
    assert w[-1] == pytest.approx(v[-1], abs=0.3) and w[:-1] / b == pytest.approx(v[:-1] / a, rel=0.2)


def test_scores_do_not_depend_on_the_join(spark, monkeypatch):
    texts, labels = corpus(spark)
    found = []
    for most in (32 << 20, 0):
        monkeypatch.setattr(tox, "BROADCAST_BYTES", most)
        found.append([r.score for r in tox.score_toxicity(table(spark, texts), labels).orderBy("doc_id").collect()])
    assert found[0] == pytest.approx(found[1], abs=1e-9)


def test_labels_of_held_out_rows_are_not_used(spark):
    texts, labels = corpus(spark)
    flipped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic"
    )
    a, b = (sorted(map(tuple, tox.score_toxicity(table(spark, texts), y).collect())) for y in (labels, flipped))
    assert a == b


def test_odd_rows(spark, odd, empty):
    texts, labels = corpus(spark)
    texts = [(i, t) for i, t in texts if i > 99]
    both = odd.unionByName(table(spark, texts))
    rows = tox.score_toxicity(both, labels).collect()
    assert len(rows) == len(TEXTS) + len(texts) and all(r.score is not None and r.held_out is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
    kept = tox.drop_toxic(both, labels)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {k for k, _ in TEXTS if k is not None and k < 0}
    assert tox.score_toxicity(empty, labels).collect() == []
    assert {r.score for r in tox.score_toxicity(odd, labels.limit(0)).collect()} == {0.5}


def test_query(spark, sf):
    out = tox.op6_toxicity(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert out.where("predicted <> CAST(score >= 0.7 AS INT) OR score < 0 OR score > 1").isEmpty()
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
