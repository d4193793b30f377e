import hashlib
import random
import zlib

import pytest

from hearthstat.llm import prefix_trie
from hearthstat.llm.prefix_trie import VerticalIndex, bits

SCHEMA = "conv_id long, turn long, role string, text string, conv int, digest string, name int, part int, at int"


def order(turn, role, text):
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    return turn is not None, turn or 0, digest


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: order(*t))] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def expected(rows):
    members = {}
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append((c, len(turns) == d))
    childless = {p for p in members} - {p[:-1] for p in members if p}
    out = []
    for p, of in members.items():
        subtree = [q for q in members if q[: len(p)] == p]
        children = [q for q in subtree if len(q) == len(p) + 1]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in subtree if q)
        ends = ",".join(map(str, sorted(c for c, end in of if end)))
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(of)[0], len(p), parent, len(of), len(children), len(childless & set(subtree)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path):
    data = [(*r, 1, "x", 1, 1, 1) for r in rows]
    spark.createDataFrame(data, SCHEMA).repartition(4).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in prefix_trie.op12_prefix_trie(spark, str(tmp_path)).collect()), key=repr)


def made(n, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", None], ["a", "bb", "é中", "", None, "longer text"]
    return [(c, t if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, 9))]


ODD = [
    (None, 0, "user", "nobody"), (-5, 0, "user", "x"), (-150, 1, "user", "y"), (-100, 0, None, None), (0, 0, "user", "hi"), (0, 0, "user", "hi"),
    (0, None, "system", ""), (7, 3, "a", "b"), (7, 3, "a", "b"), (7, 3, "c", "d"), (1234, 0, "user", "alone"), (99, 0, "user", "z" * 50_000),
]


@pytest.mark.parametrize("rows", [[], ODD, made(420, 1), [(c, t, "user", "same") for c in range(300) for t in range(4)]], ids=["empty", "odd", "mixed", "copies"])
@pytest.mark.parametrize("size", [4096, 3])
def test_against_brute_force(spark, rows, size, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", size)
    monkeypatch.setattr(prefix_trie, "ROWS", 64 if size == 3 else 8192)
    assert run(spark, rows, tmp_path) == expected(rows)


def test_a_turnless_conversation_ends_at_the_root(spark, tmp_path):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    got = run(spark, [(c, 0, "user", "gone")], tmp_path)
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_vertical_index():
    turns = [[b"a", b"b"], [b"a"], [b"a", b"b", b"c"], [], [b"x"]]
    got = [(depth, bits(members), bits(ends), firsts) for depth, members, ends, firsts in VerticalIndex(turns).nodes()]
    assert got == [(0, [0, 1, 2, 3, 4], [3], [0, 4]), (1, [0, 1, 2], [1], [0]), (2, [0, 2], [0], [2]), (3, [2], [2], []), (1, [4], [4], [])]
    assert bits(0) == [] and bits((1 << 5000) | 5) == [0, 2, 5000]
