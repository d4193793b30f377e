import random

import pytest

from hearthstat.llm import substrings as sub
from hearthstat.llm.queries import QUERIES
from tests.llm.conftest import TEXTS, table


def expected(rows, window=13):
    named = [(k, (t or "").encode().split()) for k, t in rows]
    first: dict = {}
    for k, words in named:
        for i in range(len(words) - window + 1) if k is not None else ():
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, k), k)
    out = []
    for k, words in named:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1) if k is not None else ():
            if first[tuple(words[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        out.append((k, len(words), sum(gone), kept))
    return sorted(out, key=repr)


def got(df):
    rows = [(r.doc_id, r.n_words, sum(b - a for a, b in r.removed), r.kept) for r in df.collect()]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("hot", [0, 256])
def test_odd_rows(odd, hot):
    assert got(sub.remove_repeats(odd, hot=hot)) == expected(TEXTS)


def test_empty(empty):
    assert sub.remove_repeats(empty).collect() == []


def several_texts():
    """Rows of one id with different texts: A, its copies, one without and one with some words of A."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    c = " ".join([*(f"c{i}" for i in range(5)), *(f"a{i}" for i in range(5, 24)), *(f"c{i}" for i in range(24, 30))])
    return a, b, c


@pytest.mark.parametrize("hot", [0, 256])
@pytest.mark.parametrize("which", ["b", "c", "all"])
def test_one_id_with_several_texts(spark, hot, which):
    a, b, c = several_texts()
    more = {"b": [(5, b)], "c": [(5, c)], "all": [(5, b), (5, c), (5, a), (7, b), (7, c), (7, a), (3, b)]}[which]
    rows = [(1, a), (5, a), *more]
    assert got(sub.remove_repeats(table(spark, rows).repartition(4), hot=hot)) == expected(rows)


@pytest.mark.parametrize("seed", range(2))
def test_ids_that_come_several_times(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(25), " ".join(rng.choice("aab") for _ in range(rng.randrange(40)))) for _ in range(60)]
    assert got(sub.remove_repeats(table(spark, rows), window=6, gram=3)) == expected(rows, 6)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [1, 256])
def test_few_different_words(spark, seed, hot):
    """Texts of three words repeat themselves and one another in every way."""
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("aab") for _ in range(rng.randrange(60)))) for i in range(60)]
    df = table(spark, rows)
    assert got(sub.remove_repeats(df, window=6, gram=3, hot=hot)) == expected(rows, 6)


def test_automaton_against_search():
    rng = random.Random(5)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(4, 40))] for _ in range(40)]
    automaton = sub.SuffixAutomaton()
    for key, words in enumerate(texts):
        automaton.add(words, 100 - key)
    automaton.finish()
    for words in texts:
        want = []
        for i in range(len(words) - 3):
            w = words[i : i + 4]
            want.append(min(100 - k for k, t in enumerate(texts) if any(t[j : j + 4] == w for j in range(len(t) - 3))))
        assert automaton.window_keys(words, 4) == want


def test_query(spark, sf, given):
    import hashlib

    found = {tuple(r) for r in QUERIES["op2_substring_dedup"](spark, sf).collect()}
    assert found == {(k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in expected(given)}
