import re

import pytest

from hearthstat.llm import decontaminate as dc
from tests.llm.conftest import PASSAGE, TEXTS, long_text

WORD = re.compile(dc.WORD)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, PASSAGE.upper()),
    (2, " ".join(PASSAGE.split()[3:14])),
    (3, "shared1 shared2"),
    (4, "SHORT"),
    (5, None),
    (6, "--- !!"),
    (7, " ".join(long_text().split()[500:515])),
    (7, " ".join(long_text().split()[500:515])),
    (None, "five shared0"),
    (8, "É ünïcode"),
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(rows, items, window=10):
    cut = []
    for item, text in items:
        w = words(text)
        cut += [(item, tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1)) if w]
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for item, window_words in cut:
            n = len(window_words)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window_words:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} if item is not None else set()
        out.append((key, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, token int")


@pytest.mark.parametrize("block_bytes", [3000, 32 << 20])
def test_odd_rows(odd, items, block_bytes):
    got = dc.contaminated_words(odd, items, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == expected(TEXTS, ITEMS)


def test_rows_that_stay(odd, items):
    kept = dc.drop_contaminated(odd, items)
    want = [(k, t) for (k, t), r in ((x, expected([x], ITEMS)[0]) for x in TEXTS) if not r[2]]
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_one_window_of_all_items(spark):
    """A prompt line that every item begins with, and texts that have parts of windows only."""
    prompt = "Read the passage below and answer the question that follows"
    items = [(i, f"{prompt} now number{i} is here") for i in range(300)]
    rows = [
        (1, f"so {prompt} again"),
        (1, f"another text of the same id, {prompt}"),
        (2, f"so {prompt} again"),
        (3, prompt.rsplit(" ", 1)[0]),
        (4, f"{prompt} now number7 is here {prompt}"),
        (5, "passage below and answer the question that follows now number7 is"),
        (6, "follows now number8 is here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (0, 32 << 20):
        got = dc.contaminated_words(docs, benchmark, block_bytes=block_bytes).collect()
        assert sorted(map(tuple, got), key=repr) == expected(rows, items)


def test_repeated_words(spark):
    """Windows that overlap themselves, and shingles that a window has several times."""
    rows = [(1, "a " * 25), (2, "a " * 9), (3, "a b " * 6 + "a a b a b"), (4, "b a " * 5), (5, "x " + "a " * 10)]
    items = [(1, "a " * 10), (2, "a b " * 5), (3, "b a"), (4, "x")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated_words(docs, benchmark).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows, items)


def test_empty(odd, empty, items):
    assert dc.contaminated_words(empty, items).collect() == []
    none = dc.contaminated_words(odd, items.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r.hit or r.item_ids for r in none)
    assert dc.drop_contaminated(odd, items.limit(0)).count() == len(TEXTS)


def test_plan_has_no_python(spark, sf):
    plan = dc.op3_decontamination(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("Python", "Arrow", "Pandas", "CartesianProduct"))
