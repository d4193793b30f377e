import zlib

import pytest
from pyspark.sql import functions as F

from hearthstat.llm import sharding
from tests.llm.conftest import TEXTS


def check(rows, texts, n_shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=repr) == sorted(
        ((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in texts), key=repr
    )
    for shard in range(n_shards):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < n_shards for r in rows)


def test_query(spark, sf, given):
    out = sharding.op10_kd_sharding(spark, sf)
    rows = out.collect()
    check(rows, given, 24)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    assert all(abs(sum(r.size for r in rows if r.shard == s) - total / 24) <= most for s in range(24))


def test_near_equal_whatever_the_hot_value(spark):
    """A third of the rows share all metadata; 5 shards are no power of two."""
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('x', int(CASE WHEN id % 3 = 0 THEN 50 ELSE id % 97 END))").alias("text"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE string(id % 11) END").alias("source"),
        F.lit(None).cast("string").alias("lang"),
    )
    rows = sharding.kd_shards(docs, n_shards=5).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    total = sum(r.bytes for r in rows)
    assert len(rows) == 5 and all(abs(r.bytes - total / 5) <= 0.01 * total for r in rows)


def test_a_row_that_is_repeated(spark):
    """A third of the rows, more than a block of copies, are the same row: its copies are dealt like other rows."""
    texts = [(7, "same " * 9)] * 6000 + [(i, "t" * (i % 80)) for i in range(100, 12_100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = sharding.kd_shards(docs, n_shards=24).collect()
    check(rows, texts, 24)
    total = sum(r.size for r in rows)
    assert all(abs(sum(r.size for r in rows if r.shard == s) - total / 24) <= 3 * 88 for s in range(24))
    again = sharding.kd_shards(docs.repartition(3), n_shards=24).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("n_shards", [1, 3, 24])
def test_odd_rows(odd, n_shards):
    check(sharding.kd_shards(odd, n_shards=n_shards).collect(), TEXTS, n_shards)


def test_target_bytes(odd):
    total = sum(len((t or "").encode()) + 8 for _, t in TEXTS)
    rows = sharding.kd_shards(odd, target_bytes=total // 3 + 1).collect()
    assert {r.shard for r in rows} <= {0, 1, 2}


def test_empty(empty):
    assert sharding.kd_shards(empty, n_shards=24).collect() == [] and sharding.kd_shards(empty).collect() == []


def test_plan_has_no_python(spark, sf):
    plan = sharding.op10_kd_sharding(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("Python", "Arrow", "Pandas", "CartesianProduct"))
