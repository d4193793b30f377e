import random

import numpy as np
import pytest

from hearthstat.llm import near_dedup as nd
from tests.llm.conftest import TEXTS, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = {key: key for key, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            common = len(sets[i] & sets[j])
            if a is not None and b is not None and common and 100 * common >= percent * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((key, len(s), None if key is None else find(key)) for (key, _), s in zip(rows, sets, strict=True)), key=repr)


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.component_id == r.doc_id) for r in rows if r.doc_id is not None)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def test_odd_rows(odd):
    assert got(nd.near_duplicates(odd, k=3, percent=85)) == expected(TEXTS, 3, 85)


def linked_texts():
    rng = random.Random(3)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(200)) for x in "abc")
    return a, a + " more", b, b + " more", c, c + " more"


@pytest.mark.parametrize("which", range(4))
def test_one_id_with_several_texts(spark, which):
    """An id with two texts has the links of both, and joins what is linked with either."""
    a, a2, b, b2, c, c2 = linked_texts()
    rows = [
        [(5, a), (5, b), (7, a2), (8, b2)],
        [(1, b), (2, a), (5, a), (5, b), (9, a2), (8, b2)],
        [(5, a), (5, b), (5, c), (3, c), (4, b2), (6, c2), (7, a2), (7, a2)],
        [(1, a), (9, a2), (9, b2), (4, b), (4, c2), (2, c)],
    ][which]
    keys = sorted({k for k, _ in rows})
    sets = {k: [shingle_set(t, 3) for key, t in rows if key == k] for k in keys}
    find = {k: k for k in keys}
    for _ in keys:
        for x in keys:
            for y in keys:
                if any(100 * len(s & t) >= 85 * len(s | t) for s in sets[x] for t in sets[y]):
                    find[x] = find[y] = min(find[x], find[y])
    result = {r.doc_id: r.component_id for r in nd.near_duplicates(table(spark, rows).repartition(4), k=3, percent=85).collect()}
    assert result == find


def test_rows_that_stay(odd):
    kept = nd.drop_near_duplicates(odd, k=3, percent=85)
    assert kept.columns == odd.columns
    smallest = {r[2] for r in expected(TEXTS, 3, 85) if r[0] is not None}
    keys = [r.doc_id for r in kept.collect()]
    assert sorted(k for k in keys if k is not None) == sorted(smallest) and keys.count(None) == 1


def test_empty(empty):
    assert nd.near_duplicates(empty).collect() == []
    assert nd.drop_near_duplicates(empty).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_a_large_group_of_edited_copies(spark, seed):
    """Copies with edits of their own, copies of copies, and chains around the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [base]
    for _ in range(150):
        new = list(rng.choice(texts if rng.random() < 0.3 else [base]))
        for _ in range(rng.randrange(9)):
            new[rng.randrange(len(new))] = f"x{rng.randrange(10_000)}"
        texts.append(new)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert got(nd.near_duplicates(table(spark, rows), k=3, percent=85)) == expected(rows, 3, 85)


def test_components(spark):
    nodes = spark.range(12).selectExpr("id AS key", "id AS comp")
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 9), (9, 7), (11, 2), (6, 6)], "a long, b long")
    found = {r.key: r.comp for r in nd.components(nodes, edges).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6, 7: 7, 8: 7, 9: 7, 10: 10, 11: 2}


def test_sketches_of_similar_sets_are_near():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a = np.unique(rng.integers(0, 1 << 62, 500, dtype=np.uint64))
        b = np.concatenate([a[40:], rng.integers(0, 1 << 62, 40, dtype=np.uint64)])
        flips = np.bitwise_count(nd.signature(a)[1].view(np.uint64) ^ nd.signature(np.unique(b))[1].view(np.uint64)).sum()
        assert flips <= nd.most_flips(0.85)
        whole = np.bitwise_count(nd.parity(a).view(np.uint64) ^ nd.parity(np.unique(b)).view(np.uint64)).sum()
        assert 60 <= whole <= len(np.setxor1d(a, b))


def test_query(spark, sf, given):
    assert got(nd.op4_near_dedup(spark, sf)) == expected(given, 3, 85)
