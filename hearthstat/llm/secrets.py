"""Secret scanning with one combined deterministic automaton.

All rules are compiled into one minimal transition array. Texts are cut behind bytes that send every state back
to the start, so the pieces are independent and advance together through the array: one pass over the bytes
tells which rules end a match in which piece. In those pieces alone the rule's own automaton gives the
leftmost longest matches, and the rule's condition is applied to them. A private key's header is extended over
its body in the whole text, as the body runs over many pieces.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.llm.automaton import Automaton, compile_rules, longest, scan
from hearthstat.llm.common import documents, map_arrow


@dataclass(frozen=True)
class Rule:
    """`pattern` finds matches; those count in which `counted` (its first group) has `least` characters.

    `sure` matches within every match that counts; it is what the one pass looks for. A count in it multiplies
    the states of all other rules, so only one rule has one. `extend` takes a whole text and the end of a match in it,
    and gives the end of what belongs to the match.
    """

    kind: str
    pattern: str
    sure: str
    least: int
    counted: str = r"(.*)"
    fold: bool = False
    extend: Callable[[bytes, int], int] | None = None


_KEY_END = re.compile(rb"-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----")
# Between lines of a key: line breaks, also escaped ones, and what quotes a line.
_BREAK = rb"(?:\\[rnt]|[\s>|*#\"',])*+"
_KEY_LINES = re.compile(
    rb"(?:%(b)s(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:%(b)s[A-Za-z0-9+/]{20,}+={0,2}+)*+(?:%(b)s[A-Za-z0-9+/]{1,19}+(?:={1,2}+|(?=\s*\Z)))?+"
    % {b"b": _BREAK}
)


def key_end(text: bytes, at: int) -> int:
    """End of the private key whose header ends at `at`: its END line or, if there is none before the next header, its last line."""
    following = text.find(b"-----BEGIN", at)
    end = _KEY_END.search(text, at, following if following >= 0 else len(text))
    return (end or _KEY_LINES.match(text, at)).end()


_NAME = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
RULES = (
    Rule("assign", _NAME + r"[A-Za-z0-9+/_.=-]+", _NAME + r"[A-Za-z0-9+/_.=-]", 8, r"[^:=]*[:=]\x20*[\"']?(.*)", True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", 16),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{32}", 32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"\.eyJ[A-Za-z0-9_-]+\.", 20),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", r"PRIVATE\x20KEY-----", 20, extend=key_end),
)
BASE = ("assign", "access", "hex")
#: Bytes of a piece, up to the next byte behind which a text may be cut.
PIECE = 1024
#: Bytes of text that are scanned at once.
BLOCK = 8 << 20


@functools.cache
def _compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, np.ndarray, list[Automaton]]:
    combined = compile_rules([(r.sure, r.fold) for r in rules], searching=True)
    return combined, combined.resets(), [compile_rules([(r.pattern, r.fold)], searching=False) for r in rules]


def _pieces(resets: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Cuts of the concatenated texts: at the ends of texts, and inside long ones at safe bytes."""
    safe = np.flatnonzero(resets[data]) + 1
    wanted = np.concatenate([[0], *[np.arange(a, b, PIECE) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]]).astype(np.int64)
    at = np.searchsorted(safe, wanted)
    inner = safe[at[at < len(safe)]]
    return np.unique(np.concatenate([bounds, inner]))


def find_in(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text its spans (start, rule number, end) in bytes, by start, then rule."""
    combined, resets, own = _compiled(rules)
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    cuts = _pieces(resets, data, bounds)
    hits = scan(combined, data, cuts[:-1], cuts[1:])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    taken: dict[tuple[int, int], int] = {}
    for i in np.flatnonzero(hits):
        first, last = int(cuts[i]), int(cuts[i + 1])
        doc = int(np.searchsorted(bounds, first, side="right")) - 1
        piece = data[first:last].tobytes()
        for no, rule in enumerate(rules):
            if not hits[i] >> no & 1:
                continue
            for a, b in longest(own[no], piece):
                counted = re.match(rule.counted, piece[a:b].decode("ascii"), re.S)
                if counted and len(counted[1]) >= rule.least:
                    start, end = (first - int(bounds[doc]) + x for x in (a, b))
                    if rule.extend:
                        if start < taken.get((doc, no), 0):
                            continue
                        taken[doc, no] = end = rule.extend(texts[doc], end)
                    found[doc].append((start, no, end))
    return [sorted(spans) for spans in found]


def _blocks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Consecutive texts of about BLOCK bytes; a missing text is empty."""
    block, held = [], 0
    for t in texts:
        block.append((t or "").encode())
        held += len(block[-1])
        if held >= BLOCK:
            yield block
            block, held = [], 0
    yield block


def _in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), no, int(before[b])) for a, no, b in spans]


SPAN = pa.struct([("start", pa.int32()), ("rule", pa.int32()), ("end", pa.int32())])


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: key and spans (start, rule, end) in code points, end exclusive, by start, then rule.

    A missing or empty text has no spans. Every row gets its result, repeated rows too; columns other than
    key and text are not read. Matches of one rule do not overlap; those of different rules may.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for block in _blocks(batch.column(1).to_pylist()):
                for t, s in zip(block, find_in(block, rules), strict=True):
                    spans.append([{"start": a, "rule": no, "end": b} for a, no, b in _in_code_points(t, s)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], names=["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = map_arrow(read, run, f"key {kind}, spans array<struct<start:int,rule:int,end:int>>")
    return found.withColumnRenamed("key", key)


def redact_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with every secret replaced by its kind in brackets; overlapping spans become one.

    All columns stay, missing texts stay missing, and a text without secrets stays as it is.
    """
    at = docs.columns.index(text)

    def redact(t: bytes, spans: list[tuple[int, int, int]]) -> str:
        out, end = [], 0
        for a, no, b in spans:
            if a >= end:
                out += [t[end:a], f"[{rules[no].kind}]".encode()]
            end = max(end, b)
        return b"".join([*out, t[end:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            done: list[str] = []
            for block in _blocks(texts):
                done += [redact(t, s) for t, s in zip(block, find_in(block, rules), strict=True)]
            kept = [None if t is None else d for t, d in zip(texts, done, strict=True)]
            columns = [pa.array(kept, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])))

    def count(no: int):
        return F.size(F.filter("spans", lambda s: s["rule"] == no)).cast("long")

    return found.select(
        "doc_id",
        *[count(no).alias(f"n_{kind}") for no, kind in enumerate(BASE)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
