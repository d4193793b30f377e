"""Shared helpers: input tables, stored intermediates, Python work in tasks."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import hearthstat
from hearthstat.sources.stored import store

__all__ = ["Recent", "documents", "forgotten_by_others", "map_arrow", "ship", "store", "table", "unused", "whole_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(cols or ("doc_id", "text")))


def whole_text(text: str | Column = "text") -> Column:
    """The text, a missing one read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their workers import it by name."""
    context = spark.sparkContext
    if not getattr(context, "_hearthstat_shipped", False):
        root = Path(hearthstat.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="hearthstat-code-")) / "hearthstat_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._hearthstat_shipped = True


#: How a worker process drops what it remembers between tasks, by the module that remembers it.
_forget: dict[str, list[Callable[[], None]]] = {}
#: The module whose work this process did last.
_worked: list[str] = []


def forgotten_by_others(module: str, forget: Callable[[], None]) -> None:
    """Lets a worker that goes on to another module's work call `forget` first: processes outlive the stages that fill them."""
    _forget.setdefault(module, []).append(forget)


def _begin(module: str) -> None:
    if _worked != [module]:
        for other in _forget.keys() - {module}:
            for forget in _forget[other]:
                forget()
        _worked[:] = [module]
        _give_back()


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that gives freed memory back to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidy(run: Callable) -> Callable:
    """The same work on a task's batches, begun without what other modules remember; freed memory is given back in the end."""
    module = run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(module)
        yield from run(batches)
        _give_back()

    return task


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


class Recent:
    """Values of words that were asked for lately, in two generations of at most so many bytes each.

    Words longer than `longest` are not kept: text without blanks is one word per run, and seldom comes twice.
    """

    #: Bytes of an entry besides its word and value.
    ENTRY = 200

    def __init__(self, most_bytes: int = 64 << 20, longest: int = 64) -> None:
        self.most_bytes, self.longest, self.held = most_bytes, longest, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def table(self, wanted: set[str], make: Callable[[list[str]], Iterable[bytes]]) -> Callable[[str], bytes]:
        """A function that gives the value of each wanted word, valid until the next call; `make` gives those of new words."""
        if self.held > self.most_bytes:
            self.old, self.young, self.held = self.young, {}, 0
        new, back = [], {}
        for w in wanted.difference(self.young):
            if w in self.old:
                back[w] = self.old[w]
            else:
                new.append(w)
        made = dict(zip(new, make(new), strict=True))
        passing = {w: made.pop(w) for w in new if len(w) > self.longest} if max(map(len, new), default=0) > self.longest else {}
        young = self.young
        for part in (back, made):
            young.update(part)
            self.held += self.ENTRY * len(part) + 4 * sum(map(len, part)) + sum(map(len, part.values()))
        return (lambda w: passing[w] if w in passing else young[w]) if passing else young.__getitem__
