import hashlib
import random
import re

import numpy as np
import pytest

from hearthstat.llm import automaton, secrets
from tests.llm.conftest import TEXTS

BASE = [
    (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 8),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
ODD = [
    "token=token:abcdefghijk", "token==abcdefgh x", "Secret : 'abcdefgh' AKIAAKIA1234567890 é deadbeef" * 30, "", None, "api_key = \"x\" passwd=12345678",
    "a" * 5000, "ab12" * 3000, "PASSWORD\"  :  \"" + "Zz9+/_.=-" * 3, "token= short", "AKIA" * 9, "é" * 3000 + "secret=abcdefgh",
]


def expected(text):
    return sorted((m.start(), no, m.end()) for no, (p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m))


def test_base_spans_are_those_of_the_plain_patterns(given):
    for texts in (ODD, [t for _, t in given]):
        block = [(t or "").encode() for t in texts]
        for text, raw, spans in zip(texts, block, secrets.find_in(block), strict=True):
            assert [s for s in secrets._in_code_points(raw, spans) if s[1] < 3] == expected(text)


def test_further_rules():
    text = b"x ghp_" + b"a1" * 20 + b" xoxb-123456789012 eyJab.eyJcd.e_f-0 ghp_short\n-----BEGIN RSA PRIVATE KEY-----"
    kinds = [secrets.RULES[no].kind for _, no, _ in secrets.find_in([text])[0]]
    assert [k for k in kinds if k != "hex"] == ["github", "slack", "private_key"]
    long_ = b"eyJ" + b"a" * 20 + b".eyJ" + b"b" * 9 + b".c"
    assert secrets.find_in([long_])[0] == [(0, 5, len(long_))]


def test_private_keys_are_redacted_whole(spark):
    body = ["".join(random.Random(i).choices("ABCDwxyz0189+/", k=64)) for i in range(40)] + ["q7Jk/+s="]
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    key = "\n".join([head, *body, end])
    texts = [
        (1, f"é before\n{key}\nafter {key}, END"),
        (2, "x = '" + key.replace("\n", "\\n") + "' after"),  # escaped line breaks
        (3, key.replace("\n", "\r\n> ")),
        (4, f"{head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB\n\n" + "\n".join(body)),  # no END line
        (5, f"{head}\n" + "\n".join(body[:9]) + f"\nthen prose. {key}"),  # cut off before another key
        (6, f"The line {head} starts a key, and nothing here is one."),
        (7, f"{head}\n" + "\n".join(body[:3]) + "\nABcd"),
    ]
    got = {r.doc_id: r.text for r in secrets.redact_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    p = "[private_key]"
    assert got == {
        1: f"é before\n{p}\nafter {p}, END", 2: f"x = '{p}' after", 3: p, 4: p, 5: f"{p}\nthen prose. {p}",
        6: f"The line {p} starts a key, and nothing here is one.", 7: p,
    }
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (9, 6, 9 + len(key)) in spans[1]


@pytest.mark.parametrize("seed", range(4))
def test_automata_against_patterns(seed):
    """Random small patterns: the searching automaton tells what matches, the anchored one where."""
    rng = random.Random(seed)
    atoms = ["a", "b", "[ab]", "(ab|c)", "[^a]", "(a|bc)?", "b{2}", "c+", "(ab)*c"]
    for _ in range(15):
        patterns = [("".join(rng.choice(atoms) for _ in range(rng.randrange(1, 4))) + "c", False) for _ in range(3)]
        combined = automaton.compile_rules(patterns, searching=True)
        texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(12))) for _ in range(60)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        found = automaton.scan(combined, data, ends - [len(t) for t in texts], ends, width=7)
        for text, bits in zip(texts, found.tolist(), strict=True):
            assert bits == sum(1 << i for i, (p, _) in enumerate(patterns) if re.search(p.encode(), text)), (patterns, text)
        for pattern, _ in patterns:
            own = automaton.compile_rules([(pattern, False)], searching=False)
            for text in texts:
                spans = automaton.longest(own, text)
                assert all(re.fullmatch(pattern.encode(), text[a:b], re.S) for a, b in spans)
                assert bool(spans) == bool(re.search(pattern.encode(), text, re.S))


def test_minimal():
    a = automaton.compile_rules([("(ab|cb)", False), ], searching=False)
    assert len(a.next) == 4  # start, after a or c, end, dead
    with pytest.raises(ValueError):
        automaton.compile_rules([(r"\bword", False)], searching=True)


def test_odd_rows(odd, empty):
    got = [(r.doc_id, [tuple(s) for s in r.spans if s.rule < 3]) for r in secrets.scan_secrets(odd).collect()]
    assert sorted(got, key=repr) == sorted([(k, expected(t)) for k, t in TEXTS], key=repr)
    assert secrets.scan_secrets(empty).collect() == [] and secrets.redact_secrets(empty).collect() == []


def test_redaction(odd):
    out = secrets.redact_secrets(odd)
    assert out.columns == odd.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[10] == '[assign]" and [access]; é [hex]' and texts[4] is None and texts[8] == dict(TEXTS)[8]


def test_query(spark, sf, given):
    got = {r.doc_id: r for r in secrets.op9_secret_scan(spark, sf).collect()}
    for key, text in given:
        spans = [f"{secrets.BASE[no]}:{a}:{b}" for a, no, b in expected(text)]
        assert got[key].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[key][f"n_{k}"] for k in secrets.BASE] == [sum(s.startswith(k) for s in spans) for k in secrets.BASE]
