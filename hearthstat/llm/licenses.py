"""License scanning by diagonal voting.

All rolling word 3-gram hashes of all texts are joined to the positions at which license templates have them. A hit is
a vote for its diagonal, the text's position less the template's: words that follow a template vote for one diagonal,
and every inserted or missing word moves the votes by one. The votes of neighbouring diagonals are merged in
overlapping bands that are as wide as a match may drift, and where a band has enough votes, the span is verified: the
template is aligned with the words there, and matches if their word edit distance is within the template's bound.

By the q-gram lemma m words of which at most e are changed keep m - 2 - 3e of their grams, on diagonals at most e
apart, so the vote misses nothing that the alignment would accept.

The templates are a table of bounded size, so the join is a broadcast one: hits stay in the task and in the order of
their document, where the votes are counted and verified beside its text. Nothing is shuffled, no document can make
a hot key, and the memory of a task is bounded by its longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.llm.common import documents, map_arrow

GRAM = 3
#: Bytes of text that are hashed at once; a longer word is hashed whole.
SEGMENT = 1 << 21
#: Grams of one row on their way to the join.
PIECE = 1 << 16
#: Most template positions, so that their table can be broadcast to any executor.
MOST_POSITIONS = 1 << 20


@dataclass(frozen=True)
class Template:
    """A license's words. A span matches whose word edit distance is at most `1 - least` of the template's words."""

    label: str
    text: str
    least: float = 0.8

    @property
    def words(self) -> list[bytes]:
        return split_words(self.text.encode())

    @property
    def edits(self) -> int:
        return int((1 - self.least) * len(self.words) + 1e-9)

    @property
    def votes(self) -> int:
        return len(self.words) - GRAM + 1 - GRAM * self.edits


# Phrases that settle a license by themselves.
PHRASES = (
    Template("mit", "under the mit license", 1.0),
    Template("apache-2", "apache license version 2", 1.0),
    Template("cc-by-nc", "cc by nc", 1.0),
)
# Notices and grants of public licenses.
NOTICES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
        " distributed under the License is distributed on an AS IS BASIS",
    ),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", 0.95),
    Template("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", 0.95),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages"),
)
TEMPLATES = PHRASES + NOTICES

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def split_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: runs of digits, ASCII letters and non-ASCII characters."""
    return _WORD.findall(text.lower())


# ---- rolling hashes ----------------------------------------------------------------------------------

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_IN_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, SEGMENT) + 1
        for at, factor in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[at : at + 1] = [np.cumprod(steps, dtype=np.uint64)]
    return _powers


def _segments(data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the bytes at about SEGMENT, between words."""
    at = 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        if end < len(data):
            back = np.flatnonzero(~inside[at:end])
            ahead = np.flatnonzero(~inside[end:]) if not len(back) else back
            end = at + int(back[-1]) + 1 if len(back) else end + int(ahead[0]) if len(ahead) else len(data)
        yield at, end
        at = end


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word of the bytes."""
    inside = _IN_WORD[data]
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in _segments(data, inside):
        power, inverse = _power_tables(b - a)
        edge = np.flatnonzero(np.diff(inside[a:b], prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[data[a:b]] * power[: b - a], dtype=np.uint64)])
        of = (total[last] - total[first]) * inverse[first]
        starts.append(first + a)
        hashes.append(of ^ (of >> np.uint64(31)))
    return np.concatenate(starts), np.concatenate(hashes)


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the gram that starts at each word but the last ones."""
    n = max(0, len(words) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for i, k in enumerate(_MIX[:GRAM]):
        out = (out ^ (words[i : i + n] * k)) * _MIX[-1]
        out ^= out >> np.uint64(29)
    return out


def template_positions(templates: tuple[Template, ...]) -> list[tuple[int, int, int]]:
    """(gram, template, place) of all templates."""
    out = []
    for no, t in enumerate(templates):
        if t.votes < 1:
            raise ValueError(f"template {t.text!r} is too short for least={t.least}")
        grams = gram_hashes(word_hashes(np.frombuffer(t.text.encode(), np.uint8))[1])
        out += [(int(g), no, i) for i, g in enumerate(grams.view(np.int64))]
    if len(out) > MOST_POSITIONS:
        raise ValueError(f"{len(out)} template positions are more than {MOST_POSITIONS}")
    return out


# ---- votes and spans ---------------------------------------------------------------------------------


def distances(template: list[bytes], words: list[bytes], anchored: bool = False) -> list[int]:
    """Per word the least edit distance of the template to words that end with it: any, or with `anchored` all from the first.

    The columns of the alignment are kept as bits, one word of the text a step.
    """
    has: dict[bytes, int] = {}
    for i, w in enumerate(template):
        has[w] = has.get(w, 0) | 1 << i
    full, high = (1 << len(template)) - 1, 1 << len(template) - 1
    up, down, score, out = full, 0, len(template), []
    for w in words:
        eq = has.get(w, 0)
        vertical, across = eq | down, (((eq & up) + up) ^ up) | eq
        plus, minus = down | full & ~(across | up), up & across
        score += bool(plus & high) - bool(minus & high)
        plus, minus = plus << 1 & full | anchored, minus << 1 & full
        up, down = minus | full & ~(vertical | plus), plus & vertical
        out.append(score)
    return out


def spans_within(template: Template, words: list[bytes], lo: int, hi: int) -> list[tuple[int, int, float]]:
    """Matches (first word, end, score) in words[lo:hi], one for each run of ends within the bound."""
    pattern, near, out = template.words, words[lo:hi], []
    ends = distances(pattern, near)
    at = 0
    while at < len(ends):
        run = at
        while run < len(ends) and ends[run] <= template.edits:
            run += 1
        if run > at:
            least = min(ends[at:run])
            end = at + ends[at:run].index(least) + 1
            back = distances(pattern[::-1], near[max(0, end - len(pattern) - template.edits) : end][::-1], anchored=True)
            out.append((lo + end - 1 - back.index(least), lo + end, 1 - least / len(pattern)))
        at = run + 1
    return out


def _voted(template: Template, diagonals: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Ranges of words in which bands of neighbouring diagonals have enough votes; ranges that touch are one."""
    half = template.edits + 1
    ranges = []
    for shift in (0, half):
        band, votes = np.unique((diagonals + shift) // (2 * half), return_counts=True)
        first = band[votes >= template.votes] * (2 * half) - shift
        ranges += [(max(0, a - half), min(n, a + 3 * half + len(template.words))) for a in first.tolist()]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def find_spans(text: bytes, votes: list[tuple[int, int, int]], templates: tuple[Template, ...]) -> list[tuple[int, int, int, float]]:
    """Spans (template, first word, end, score) of a text from its votes (word, template, place)."""
    if not votes:
        return []
    at, of, place = np.array(votes, np.int64).T
    words, out = None, []
    for no in np.unique(of).tolist():
        mine = of == no
        if mine.sum() < templates[no].votes:
            continue
        words = split_words(text) if words is None else words
        for lo, hi in _voted(templates[no], at[mine] - place[mine], len(words)):
            out += [(no, *span) for span in spans_within(templates[no], words, lo, hi)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _hashed(batch: pa.RecordBatch, no: int) -> pa.RecordBatch:
    """Rows (key, no, n_words, offset, text, grams) of texts: a text's first row has it, and a null before its grams.

    Long texts have several rows; `offset` counts what stood in the rows before.
    """
    raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])]).astype(np.int64)
    first, hashes = word_hashes(np.frombuffer(b"\0".join([*raw, b""]), np.uint8))
    of = np.searchsorted(bounds, first, side="right") - 1
    grams = gram_hashes(hashes)
    whole = of[: len(grams)] == of[GRAM - 1 :] if len(grams) else np.zeros(0, bool)
    grams, of_gram = grams[whole], of[: len(whole)][whole]
    start = np.arange(len(raw)) + np.searchsorted(of_gram, np.arange(len(raw)))
    values, null = np.zeros(len(raw) + len(grams), np.int64), np.zeros(len(raw) + len(grams), bool)
    values[np.arange(len(grams)) + of_gram + 1] = grams.view(np.int64)
    null[start] = True
    ends = np.append(start[1:], len(values))
    long_ = np.flatnonzero(ends - start > PIECE)
    cuts = np.unique(np.concatenate([start, *[np.arange(start[i], ends[i], PIECE) for i in long_]])).astype(np.int64)
    doc = np.searchsorted(start, cuts, side="right") - 1
    head = cuts == start[doc]
    texts = batch.column(1).take(pa.array(np.where(head, doc, 0), pa.int64(), mask=~head))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(doc)),
            pa.array(doc + no, pa.int64()),
            pa.array(np.bincount(of, minlength=len(raw))[doc], pa.int64()),
            pa.array(cuts - start[doc], pa.int64()),
            texts,
            pa.ListArray.from_arrays(pa.array(np.append(cuts, len(values)), pa.int32()), pa.array(values, pa.int64(), mask=null)),
        ],
        names=["key", "no", "n_words", "offset", "text", "grams"],
    )


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SEGMENT bytes of text."""
    size = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)])
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SEGMENT, side="right")))
        yield batch.slice(at, end - at)
        at = end


SPAN = pa.struct([("template", pa.int32()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, spans (template number, first word, end, score) by first word.

    A missing or empty text has no words and no spans. Texts may have any length. Every row gets its result, repeated
    rows and rows with the same key too; an empty table gives an empty result. Spans of one template do not overlap
    beyond what its edits allow, those of different templates may. Columns other than key and text are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in batches:
            for part in _blocks(batch):
                yield _hashed(part, no)
                no += len(part)

    read = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    pieces = map_arrow(read, hashed, f"key {kind}, no long, n_words long, offset long, text string, grams array<long>")
    rolling = pieces.select("key", "no", "n_words", "offset", "text", F.posexplode("grams").alias("i", "gram"))
    places = docs.sparkSession.createDataFrame(template_positions(templates), "at_gram long, template int, place int")
    hits = rolling.join(F.broadcast(places), F.col("gram") == F.col("at_gram"), "left").where("template IS NOT NULL OR gram IS NULL")
    voting = hits.select(
        "key", "no", "n_words", F.when(F.col("gram").isNull(), F.col("text")).alias("text"), "template",
        (F.col("offset") + F.col("i") - 1).alias("at"), "place",
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        votes: list[tuple[int, int, int]] = []
        done: list[tuple] = []

        def close() -> None:
            if held is not None:
                spans = find_spans((held[3] or "").encode(), votes, templates)
                done.append((held[0], held[2], [dict(zip(("template", "first", "end", "score"), s, strict=True)) for s in spans]))
                votes.clear()

        def rows(key_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 3
            types = [key_type, pa.int64(), pa.list_(SPAN)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "n_words", "spans"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[4] is None:
                    close()
                    held = row
                elif held is None or held[1] != row[1]:
                    raise RuntimeError("votes have left their document")
                else:
                    votes.append((row[5], row[4], row[6]))
            yield rows(batch.schema.field("key").type)
            done.clear()
        if held is not None:
            close()
            yield rows(batch.schema.field("key").type)

    span = "array<struct<template:int,first:bigint,end:bigint,score:double>>"
    return map_arrow(voting, verified, f"key {kind}, n_words long, spans {span}").withColumnRenamed("key", key)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document, by the phrases and by notices that match for the most part.

    Missing and empty texts, very long ones, repeated rows and an empty table are handled as `license_spans` states.
    """
    found = license_spans(documents(spark, sf_dir))
    names = F.array(*[F.lit(t.label) for t in TEMPLATES])
    base = F.filter("spans", lambda s: s["template"] < len(PHRASES))

    def labels(spans: str | Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.get(names, s["template"])))), ",")

    firsts = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
