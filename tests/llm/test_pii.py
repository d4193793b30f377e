import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from hearthstat.llm import pii
from tests.llm.conftest import TEXTS, table

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(value):
    d = [int(c) for c in value if c in "0123456789"][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def counts(kind, value):
    digits = sum(c in "0123456789" for c in value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    return kind == "email" or (16 <= digits <= 19 and luhn(value) if kind == "card" else 8 <= digits <= 15)


def base(text):
    found = [(k, m.start(), m.end(), m[0]) for k, p in PATTERNS for m in re.finditer(p, text or "") if counts(k, m[0])]
    return [(pii.KINDS.index(k), a, b, v) for k, a, b, v in found]


ODD = [
    "a@b", "a@b.c", "..a@b.c@d.e.f x@y.", "a@b.com.@x.yy", "é@a.b", "x" * 50_000 + "@" + "y" * 9, "a.b+c%d@e-f.g-h.i",
    "1.2.3.4.5.6.7.8", "256.1.1.1 0255.01.1.1", "1.1.1.1.", "9" * 40_000, "1.2.3", "0.0.0.0é255.255.255.255",
    "4785 3805 9239 1139", "4785-3805-9239-1139 1", "4785  380592391139", "0 " * 3000, "é4785380592391139", "47853805923911391", "0" * 19,
    "+1 (743) 555-3824", "++12345678", "+1", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1234567 ", "+12345678.", "日本 +81-3-1234-5678",
]


def test_base_entities_are_those_of_the_plain_patterns(spark, given):
    rows = [(i, t) for i, t in enumerate(ODD + [t for _, t in TEXTS] + [t for _, t in given])]
    found = table(spark, rows).select("doc_id", pii.base_entities(pii.whole_text("text")).alias("base")).collect()
    for r in found:
        assert [tuple(x) for x in r.base] == base(rows[r.doc_id][1]), rows[r.doc_id][1]


def near_rows():
    """Colleague writes of one address only; other words are everywhere."""
    rows = [(i, f"The note {i} says colleague zanzibar a{i}a wrote from boss@corp.example.com to people number {i}x") for i in range(6)]
    rows += [(100 + i, f"The note {i} says people wrote to number {i}y and nothing else") for i in range(60)]
    rows += [(200 + i, rows[0][1]) for i in range(20)]
    return rows + [(300, None), (None, "x")]


def brute_terms(rows, support=3, generalise_at=0.8, remove_at=0.9):
    texts = {t or "" for _, t in rows} if None in [t for _, t in rows] else {t for _, t in rows}
    n_t, together, n_e = Counter(), Counter(), Counter()
    near = {}
    for t in texts:
        n_t.update({w.lower() for w in re.findall(r"[^\W\d_]+", t)})
        near[t] = defaultdict(set)
        for _, a, b, v in base(t):
            for m in re.finditer(r"[^\W\d_]+", t):
                inside = (a - pii.REACH <= m.start() and m.end() <= a) or (b <= m.start() and m.end() <= b + pii.REACH)
                if inside and not any(x < m.end() and m.start() < y for _, x, y, _ in base(t)):
                    near[t][v].add((m.start(), m.end(), m[0].lower()))
        for v, words in near[t].items():
            n_e[v] += 1
            together.update((v, w) for w in {w for *_, w in words})
    out = {}
    for t in texts:
        spans = set()
        for v, words in near[t].items():
            for a, b, w in words:
                k = together[v, w]
                if k >= support and n_e[v] < len(texts):
                    score = 1 + math.log(k / n_t[w]) / math.log(len(texts) / n_e[v])
                    if score >= generalise_at:
                        spans.add((a, b, "remove" if score >= remove_at else "generalise"))
        out[t] = sorted(spans)
    return out


def test_disclosing_terms(spark):
    rows = near_rows()
    want = brute_terms(rows)
    got = pii.find_personal_data(table(spark, rows)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(t) for t in r.terms] == want[texts[r.doc_id] or ""]
    words = {texts[r.doc_id][t.start : t.end] for r in got for t in r.terms}
    assert {"colleague", "zanzibar"} <= words and not words & {"The", "note", "people", "number"}


def test_terms_far_from_their_entity_and_without_it(spark):
    """The name stands 500 characters from its address, again in a heading, and once in a document without the address."""
    far = " ".join(["people wrote of the note"] * 25)
    rows = [(i, f"Zanzibar {i}\n{far} number {i} zanzibar {far} boss@corp.example.com {i}") for i in range(9)]
    rows += [(100 + i, f"{far} and number {i}") for i in range(400)] + [(900, "é A note on ZANZIBAR alone.")]
    texts = dict(rows)
    got = {r.doc_id: [(texts[r.doc_id][t.start : t.end], t.action) for t in r.terms] for r in pii.find_personal_data(table(spark, rows), everywhere=True).collect()}
    assert all(got[i] == [("Zanzibar", "remove"), ("zanzibar", "remove")] for i in range(9))
    assert got[900] == [("ZANZIBAR", "remove")] and got[100] == []


def test_sanitised_text(spark):
    rows = near_rows()
    found = pii.find_personal_data(table(spark, rows)).alias("f").join(table(spark, rows).alias("d"), "doc_id")
    out = {r.doc_id: r.t for r in found.select("doc_id", pii.sanitised(F.col("d.text"), F.col("base"), F.col("terms")).alias("t")).collect()}
    assert "boss@" not in out[1] and "[email]" in out[1] and "zanzibar" not in out[1] and out[1].startswith("The note 1 says")
    assert out[100] == rows[6][1]


def test_odd_rows(spark, odd, empty):
    got = pii.find_personal_data(odd).collect()
    assert sorted((str(r.doc_id), len(r.base)) for r in got) == sorted((str(k), len(base(t))) for k, t in TEXTS)
    assert pii.find_personal_data(empty).collect() == []


def test_plan_has_no_python(spark, sf):
    plan = pii.op8_personal_data(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_query(spark, sf, given):
    got = {r.doc_id: r for r in pii.op8_personal_data(spark, sf).collect()}
    for key, text in given:
        spans = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b, _ in base(text)]
        assert got[key].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[key].spans.startswith(",".join(spans))
        assert [got[key][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in spans) for k in pii.KINDS]
