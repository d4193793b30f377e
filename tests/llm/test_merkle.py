import hashlib
import random
import zlib

import pytest

from hearthstat.llm import merkle
from hearthstat.llm.common import store
from pyspark.sql import functions as F


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        run = i - i % 3
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return out


def counted(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def expected(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, digest(*map(counted, row)), row))
    trees = {s: [sorted(g, key=lambda x: x[:3]), None] for s, g in groups.items()}
    for pair in trees.values():
        pair[1] = levels_of([x[2] for x in pair[0]])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels_of([trees[s][1][-1][0] for s in order])
    root, out = top[-1][0], []
    for at, s in enumerate(order):
        leaves, levels = trees[s]
        for i, (_, _, leaf, row) in enumerate(leaves):
            path = steps(levels, i) + steps(top, at)
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            got = digest(*map(counted, (*row[:4], text)))
            for left, right in path:
                got = digest(left, got, right)
            out.append((row[0], leaf, levels[-1][0], root, digest(*[a + b for a, b in path]), got, got == root))
    return sorted(out, key=repr)


def postorder(n):
    """(level, index) in the order of completion, by recursion."""

    def walk(level, index, size):
        if level:
            for child in range(3 * index, min(3 * index + 3, size[level - 1])):
                yield from walk(level - 1, child, size)
        yield level, index

    size = [n]
    while size[-1] > 1:
        size.append(-(-size[-1] // 3))
    return list(walk(len(size) - 1, 0, size))


@pytest.mark.parametrize("n", [*range(1, 60), 243, 244, 729, 730, 1000])
def test_places_in_closed_form(n):
    for place, (level, index) in enumerate(postorder(n)):
        assert merkle.position(level, index, n) == place


@pytest.mark.parametrize("leaves, levels", [(1, 0), (1, 5), (2, 1), (9, 2), (242, 5), (243, 5), (100, 5), (7, 2)])
def test_a_block_is_one_run(leaves, levels):
    got = merkle._block_places(leaves, levels)
    assert [len(level) for level in got] == [-(-leaves // 3**j) for j in range(levels + 1)]
    assert sorted(p for level in got for p in level) == list(range(sum(map(len, got))))
    n = leaves if levels < 5 else leaves + 3 * 243  # the last block of four
    shift = merkle.position(0, n - leaves, n)
    if n > 243:
        first = (n - leaves) // 3**0
        assert [merkle.position(0, first + i, n) - shift for i in range(leaves)] == got[0]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def run(spark, rows, tmp_path):
    path = str(tmp_path)
    table(spark, rows).repartition(5).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11_merkle_manifest(spark, path).collect()), key=repr)


def made(n, source, seed):
    rng = random.Random(seed)
    return [(i, source, rng.choice(["en", None, ""]), rng.choice([None, i]), rng.choice([None, "", "a\nb", f"{i}", "x\n" * i])) for i in range(n)]


ODD = [(None, None, None, None, None), (None, None, None, None, ""), (3, "", "", 0, ""), (3, "", "", 0, ""), (3, "", "de", 0, "é\n中"), (-7, "é", "x", 1, "\n")]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(2, "a", None, 3, "t\n")],
        ODD,
        [*ODD, *made(800, "hot", 1), *made(3, "b", 2), *made(244, None, 3), *[(9, "same", "en", 1, "q\nq")] * 300],
        [(i, f"s{i % 700}", "en", i, "one\ntwo") for i in range(1500)],
    ],
    ids=["empty", "one", "odd", "mixed", "many groups"],
)
def test_against_brute_force(spark, rows, tmp_path):
    assert run(spark, rows, tmp_path) == expected(rows) if rows else run(spark, rows, tmp_path) == []


def test_the_log_lists_every_node_in_order(spark):
    leaves = [digest(str(i)) for i in range(1000)]
    rows = spark.createDataFrame([("t", i, d) for i, d in enumerate(leaves)], "tree string, member long, hex string")
    named = rows.select("tree", F.unhex("hex").alias("digest"), F.struct("member").alias("member"), F.col("member").alias("at_"))
    log = merkle.append_log(merkle.numbered(store(named), ["at_"]))
    levels = levels_of(leaves)
    got = [r.digest for r in log.nodes().orderBy("place").collect()]
    assert got == [levels[level][index] for level, index in postorder(1000)]


def test_clashing_columns(spark, odd):
    docs = odd.withColumn("source", F.lit("s")).withColumn("lang", F.lit("l")).withColumn("n_chars", F.lit(1).cast("long"))
    docs = docs.withColumn("tree", F.lit(1)).withColumn("index", F.lit(1)).withColumn("n", F.lit(2))
    found, root = merkle.manifest_proofs(docs)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    want = {(e[0], e[1]): e[3] for e in expected(rows)}
    got = found.select("member.key", "leaf", merkle.folded(F.col("leaf"), F.col("path")).alias("root")).collect()
    assert {(r.key, r.leaf): r.root for r in got} == want and {r.root for r in got} == {root}
