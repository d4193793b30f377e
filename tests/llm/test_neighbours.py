import numpy as np
import pytest

from hearthstat.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, dim int, shard int, ids int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 1, 1, 1, 1) for k, v in rows], SCHEMA)


def expected(rows, asked, k):
    fine = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, v in fine:
        if q in asked:
            scored = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in fine if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def check(got, want):
    assert set(got) == {q for q, a in want.items() if a}
    for q, answers in got.items():
        assert [i for i, _ in answers] == [i for i, _ in want[q]]
        assert [s for _, s in answers] == pytest.approx([s for _, s in want[q]])


@pytest.mark.parametrize("shard_rows", [7, 4096])
def test_odd_vectors(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, list(rng.normal(size=4))) for i in range(40)]
    same = [0.5, 0.25, -1.0, 2.0]
    rows += [(100 + i, same) for i in range(30)] + [(100, same), (60, [1.0, 2.0]), (61, [2.0, 1.0]), (62, [3.0])]
    rows += [(70, None), (71, [0.0] * 4), (72, [1.0, None, 2.0, 3.0]), (73, [1.0, float("nan"), 2.0, 3.0]), (74, [float("inf")] + [1.0] * 3)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0]), (75, [])]
    df = frame(spark, rows)
    got = found(nn.nearest(df, df.where("vec_id % 5 = 0"), k=6, shard_rows=shard_rows))
    check(got, expected(rows, {k for k, _ in rows if k is not None and k % 5 == 0}, 6))


def test_empty_and_single(spark):
    empty = frame(spark, [])
    assert nn.nearest(empty, empty).collect() == []
    one = frame(spark, [(1, [1.0, 2.0])])
    assert nn.nearest(one, one).collect() == [] and nn.nearest(one, empty).collect() == []


def test_recall_of_a_graph():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(3000, 32)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    layers = nn.build_graph(vectors)
    assert len(layers[0]) == 3000 and layers[0].shape[1] == 2 * nn.LINKS and layers[0].max() < 3000
    queries = vectors[::30]
    got = nn.search_graph(vectors, layers, queries)
    want = np.argsort(-(queries @ vectors.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) for a, b in zip(got, want, strict=True)]) / 20 >= 0.9


def test_query_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = found(nn.op7_neighbours(spark, sf))
    want = expected(rows, {k for k, _ in rows if k % 20 == 0}, 20)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    exact = {k: np.array(v, float) for k, v in rows}
    assert all(s == pytest.approx(float(exact[q] @ exact[i]), abs=1e-12) for q, a in got.items() for i, s in a)
