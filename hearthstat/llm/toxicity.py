"""Toxicity by class-conditional Kneser-Ney models.

Words are runs of letters, in lower case; whatever is no letter, in ASCII, parts them. Spark counts the words of the toxic and the
ordinary training texts into a stored table that grows with the corpus. A class's model gives a word its discounted share of the class's
words (a single occurrence is discounted whole), and the mass that the discounts free goes to the word's spelling: an interpolated
Kneser-Ney model of order four over the word's symbols (one for the end, a fixed number for letters outside a-z), counted from the
same table. The lower orders of both classes' spellings are shared: they come from the continuation counts of both together, so that a rare
expression is judged alike by both models.

Of the counted words, those whose counts make them tell of toxic texts, or clear them of what their spelling tells, are joined to the texts'
words by Spark, broadcast while they have a checked size (BROADCAST_BYTES) and shuffled beyond. All others have the log ratio
(toxic over ordinary) of their spelling, from the counts of four-symbol sequences, which are broadcast: at most 40^4, a fixed number.

A text is scored by three length-normalised forms of its words' log ratios: their mean, and the means of what they have above a
level and above a higher one. All are means over its words, so that a text joined from many alike is scored like one of them. A logistic
function of these is the score. It is fitted on texts that their own model has not seen: the training rows are split in two, and each half
is scored by the other half's model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.llm.common import documents, forgotten_by_others, map_arrow, store, table, unused, whole_text

#: Symbols: 0 is no letter, 1-26 are a-z, the others are shared by all other letters.
ALPHABET = 40
ORDER = 4
DISCOUNT = 0.75
#: The logistic function is fitted on at most this many scored training rows of each label, those of the smallest key hashes. They
#: count for all labelled rows of their label, so that the share of toxic rows is that of the labels whatever the table's size.
FIT_ROWS = 10_000
FEATURES = 3
#: Log ratio of a word above which it tells of toxic texts, and above which it does so strongly.
CLEAR, STRONG = 3, 6
#: The most that one word's log ratio counts, in either direction.
LIMIT = 10
#: A word whose counts change what its log ratio has above CLEAR by less than this is scored by its spelling.
PRUNE = 0.05
#: Words that are joined to the texts' words are broadcast up to this many bytes; beyond it, both are shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes of such a word as a broadcast row, besides the word.
ROW_BYTES = 100
#: What parts words; all other code points are letters. In `symbols` these are symbol 0.
NO_LETTERS = r"[\x00-\x60\x7B-\x7F]+"
#: Models: 0 of all training rows, 1 and 2 for the rows of the first and the second half, each from the other half's rows.
MODELS = 3
SUMS = ("total", "clear", "strong", "words")


@cache
def _ascii() -> np.ndarray:
    code = np.zeros(128, np.int64)
    code[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return code


def symbols(text: str | None) -> np.ndarray:
    """The symbols of a text, with a 0 on either end."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(points) + 2, np.int64)
    low = points < 128
    out[1:-1] = np.where(low, _ascii()[np.where(low, points, 0)], 27 + points % (ALPHABET - 27))
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def sequences(s: np.ndarray) -> np.ndarray:
    """The number of the four-symbol sequence that ends at each symbol but the first; what precedes a word is 0."""
    last = s[:-1]
    second = np.concatenate([s[:1] * 0, s[:-2]]) * (last != 0)
    third = np.concatenate([s[:2] * 0, s[:-3]])[: len(last)] * (second != 0)
    return ((third * ALPHABET + second) * ALPHABET + last) * ALPHABET + s[1:]


def log_shares(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log probabilities of every sequence's last symbol, in the toxic and the ordinary spelling, from its counts in either class."""
    shape = (ALPHABET,) * ORDER
    counts = [c.reshape(shape).astype(np.float64) for c in (toxic, ordinary)]
    # Continuation counts of both classes together: in how many contexts a shorter sequence occurs.
    seen = (counts[0] + counts[1]) > 0
    shorter = [seen.sum(axis=0)]
    while shorter[-1].ndim > 1:
        shorter.append((shorter[-1] > 0).sum(axis=0))
    shared = np.full(ALPHABET, 1 / ALPHABET)
    for c in reversed(shorter):
        shared = _interpolated(c.astype(np.float64), shared)
    return np.stack([np.log(_interpolated(c, shared)).ravel() for c in counts])


def _interpolated(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1, keepdims=True)
    kinds = (counts > 0).sum(axis=-1, keepdims=True)
    some = np.maximum(total, 1)
    mixed = np.maximum(counts - DISCOUNT, 0) / some + DISCOUNT * kinds / some * lower
    return np.where(total > 0, mixed, lower)


def by_word(s: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums of the values of the sequences of each word, its end included."""
    ends = np.flatnonzero(s[1:] == 0)
    if not len(ends) or len(s) < 3:
        return [np.zeros(0) for _ in values]
    starts = np.concatenate([[0], ends[:-1] + 1])
    found = sequences(s)
    return [np.add.reduceat(v[found].astype(np.float64), starts) for v in values]


def levels(ratios: np.ndarray) -> np.ndarray:
    """A word's log ratio, and what it has above either level; one of more than LIMIT counts as that."""
    ratios = np.clip(ratios, -LIMIT, LIMIT)
    return np.stack([ratios, np.maximum(ratios - CLEAR, 0), np.maximum(ratios - STRONG, 0)], axis=-1)


def _split() -> Column:
    return F.crc32(F.col("key").cast("string").cast("binary")) % 3


def _words(text: str = "text") -> Column:
    return F.explode(F.split(F.lower(text), NO_LETTERS)).alias("word")


def count_words(train: DataFrame) -> DataFrame:
    """Rows (half, label, text) as a stored table of their words' counts: word, and n_<label>_<half>."""
    each = train.select("half", "label", _words()).where("word <> ''")
    sums = [F.count(F.when((F.col("label") == y) & (F.col("half") == h), 1)).alias(f"n_{y}_{h}") for y in (0, 1) for h in (0, 1)]
    return store(each.groupBy("word").agg(*sums))


def _counts(batch: pa.RecordBatch) -> dict[tuple[int, int], np.ndarray]:
    return {(y, h): batch.column(1 + 2 * y + h).to_numpy() for y in (0, 1) for h in (0, 1)}


def _of_model(counts: dict[tuple[int, int], np.ndarray], y: int, model: int) -> np.ndarray:
    return counts[y, 2 - model] if model else counts[y, 0] + counts[y, 1]


def count_sequences(words: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Counts of the symbol sequences by (label, half), from counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, ALPHABET**ORDER), np.int64)
        for batch in batches:
            times = _counts(batch)
            spelt = symbols(" ".join(batch.column(0).to_pylist()))
            every, ends = sequences(spelt), np.flatnonzero(spelt[1:] == 0)
            lengths = np.diff(ends, prepend=-1)[: len(batch)]
            for (y, h), n in times.items():
                np.add.at(sums[2 * y + h], every, np.repeat(n, lengths))
        flat = sums.ravel()
        some = np.flatnonzero(flat)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(flat[part])], names=["sequence", "n"])

    sums = map_arrow(words, run, "sequence long, n long").groupBy("sequence").agg(F.sum("n").alias("n"))
    # A sum for every sequence, label and half at most: 4 x ALPHABET^ORDER rows whatever the corpus.
    got = sums.toArrow()
    flat = np.zeros((4, ALPHABET**ORDER), np.int64)
    flat.ravel()[got.column("sequence").to_numpy()] = got.column("n").to_numpy()
    return {(y, h): flat[2 * y + h] for y in (0, 1) for h in (0, 1)}


def _discounted(n: np.ndarray) -> np.ndarray:
    return np.where(n > 1, n - DISCOUNT, 0)


#: The spellings that a worker process has built last, by the name of their counts.
_built: dict[str, list[np.ndarray]] = {}
forgotten_by_others(__name__, _built.clear)


def told(counts: dict[tuple[int, int], np.ndarray]) -> tuple[str, np.ndarray, np.ndarray]:
    """What is broadcast: the sequences that occur and their four counts, under a name of their own. At most ALPHABET^ORDER sequences."""
    every = np.stack([counts[y, h] for y in (0, 1) for h in (0, 1)])
    some = np.flatnonzero(every.any(axis=0))
    return uuid.uuid4().hex, some.astype(np.int32), every[:, some]


def spellings(name: str, some: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """The log shares of every model, built once per process."""
    if name not in _built:
        _built.clear()
        every = np.zeros((4, ALPHABET**ORDER), np.int64)
        every[:, some] = times
        counts = {(y, h): every[2 * y + h] for y in (0, 1) for h in (0, 1)}
        _built[name] = [log_shares(_of_model(counts, 1, m), _of_model(counts, 0, m)).astype(np.float32) for m in range(MODELS)]
    return _built[name]


def _sizes(words: DataFrame) -> list[list[tuple[int, float]]]:
    """Number of words, and the part of it that is discounted, of either label in each model."""
    n = {
        (y, m): F.col(f"n_{y}_{2 - m}") if m else F.col(f"n_{y}_0") + F.col(f"n_{y}_1") for y in (0, 1) for m in range(MODELS)
    }
    sums = [f for c in n.values() for f in (F.sum(c), F.count(F.when(c == 1, 1)), F.count(F.when(c > 1, 1)))]
    row = words.agg(*[F.coalesce(f, F.lit(0)) for f in sums]).first()
    pairs = {k: (row[3 * i], row[3 * i + 1] + DISCOUNT * row[3 * i + 2]) for i, k in enumerate(n)}
    return [[pairs[y, m] for y in (0, 1)] for m in range(MODELS)]


def _freed(total: int, discounted: float) -> float:
    """Log of the mass that a class's discounted words leave to spelling."""
    return float(np.log(discounted / total)) if total else 0.0


def word_table(words: DataFrame, sequences_told, sizes: list[list[tuple[int, float]]]) -> DataFrame:
    """Per model and word that it scores by its counts: what the word's levels differ by from those of its spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = spellings(*sequences_told.value)
        for batch in batches:
            times, text = _counts(batch), batch.column(0)
            spelt = symbols(" ".join(text.to_pylist()))
            for m in range(MODELS):
                logs = []
                each = by_word(spelt, *both[m])
                for y, column in ((1, 0), (0, 1)):
                    own = _discounted(_of_model(times, y, m)) / max(sizes[m][y][0], 1)
                    plain = _freed(*sizes[m][y]) + each[column]
                    with np.errstate(divide="ignore"):
                        logs.append((np.logaddexp(np.log(own), plain), plain))
                known, plain = logs[0][0] - logs[1][0], logs[0][1] - logs[1][1]
                differ = levels(known) - levels(plain)
                some = np.flatnonzero(np.abs(differ[:, 1]) >= PRUNE)
                columns = [pa.array(differ[some, i]) for i in range(FEATURES)]
                kind = pa.array(np.full(len(some), m, np.int32))
                yield pa.RecordBatch.from_arrays([text.take(pa.array(some)), kind, *columns], names=["word", "model", *SUMS[:FEATURES]])

    return store(map_arrow(words, run, "word string, model int, total double, clear double, strong double"))


def _spelt(docs: DataFrame, sequences_told, offsets: list[float], by: list[str]) -> DataFrame:
    """Per row the sums of its words' levels by spelling, and their number; `by` is kept. Columns: text, model, then `by`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = [toxic - ordinary for toxic, ordinary in spellings(*sequences_told.value)]
        for batch in batches:
            rows = np.zeros((len(batch), len(SUMS)))
            for i, (t, m) in enumerate(zip(batch.column(0), batch.column(1).to_pylist(), strict=True)):
                (found,) = by_word(symbols(t.as_py()), ratios[m])
                rows[i] = [*levels(found + offsets[m]).sum(axis=0), len(found)]
            kept = [batch.column(i) for i in range(2, 2 + len(by))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(rows[:, i]) for i in range(len(SUMS)))], names=[*by, *SUMS])

    out = docs.select(*by).limit(0).schema
    for name in SUMS:
        out = out.add(name, "double")
    return map_arrow(docs.select("text", "model", *by), run, out)


def _bounded(known: DataFrame) -> DataFrame:
    """The stored words, to be broadcast if they are few."""
    held = known.agg(F.sum(F.octet_length("word") + ROW_BYTES)).first()[0] or 0
    return F.broadcast(known) if held <= BROADCAST_BYTES else known


def _features(docs: DataFrame, sequences_told, offsets: list[float], known: DataFrame, by: list[str]) -> DataFrame:
    """Rows (text, model, `by`) as one row per value of `by`, which is to tell texts apart: features, and the number of rows.

    Sums over equal texts are as many times those of one, so their means are the same.
    """
    hits = docs.select("model", *by, _words()).join(_bounded(known), ["word", "model"])
    table_part = hits.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS[:FEATURES]])
    spelling = _spelt(docs, sequences_told, offsets, by).withColumn("n_rows", F.lit(1))
    both = spelling.unionByName(table_part.withColumn("words", F.lit(0.0)).withColumn("n_rows", F.lit(0)))
    sums = both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*SUMS, "n_rows")])
    mean = {c: F.when(F.col("words") > 0, F.col(c) / F.col("words")).otherwise(0.0) for c in SUMS[:FEATURES]}
    excess = [F.log1p(100 * F.greatest(mean[c], F.lit(0.0))) for c in SUMS[1:FEATURES]]
    return sums.select(*by, F.array(mean["total"], *excess).alias("features"), "n_rows")


def fit_logistic(
    x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, rounds: int = 50, ridge: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Scale and weights (constant last) of a ridge logistic function, by Newton steps; a row counts `times` times."""
    times = np.ones(len(x)) if times is None else times
    scale, total = np.ones(FEATURES), times.sum()
    if len(x):
        mean = times @ x / total
        spread = np.sqrt(times @ (x - mean) ** 2 / total)
        scale = np.where(spread > 0, spread, 1)
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (times * p * (1 - p))[:, None]).T @ z + ridge * total * np.eye(len(w)) / 100 + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (times * (y - p)) - ridge * total / 100 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return scale, w


def _names(text: str | Column = "text") -> list[Column]:
    """96 bits of a text's hashes, by which rows meet their score."""
    return [F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")]


def _trained(read: DataFrame, labels: DataFrame, key: str, label: str):
    """The broadcast counts of spellings, offsets, the stored table of words, scale and weights; None without rows of both labels."""
    spark = read.sparkSession
    found = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
    known = store(found.agg(F.max(label).cast("int").alias("label")))
    half = (_split() / 2).cast("int").alias("half")
    # Labels grow with the texts: both are shuffled at any size, and sorted, as sorted rows can spill.
    train = read.where(_split() != 1).join(known.hint("merge"), F.col("key") == F.col("k"))
    words = count_words(train.select(half, "label", "text"))
    sizes = _sizes(words)
    if not (sizes[0][0][0] and sizes[0][1][0]):
        return None
    spelt = spark.sparkContext.broadcast(told(count_sequences(words)))
    offsets = [_freed(*sizes[m][1]) - _freed(*sizes[m][0]) for m in range(MODELS)]
    scored = word_table(words, spelt, sizes)
    # At most 2 x FIT_ROWS keys and labels: small enough to broadcast whatever the corpus.
    fit = read.join(F.broadcast(_fit_sample(known)), F.col("key") == F.col("k"))
    fit = fit.select("text", (half + 1).alias("model"), "label", *_names())
    keys = known.withColumn("key", F.col("k")).where(_split() != 1).groupBy("label").count().collect()
    times = {r["label"]: max(r["count"] / FIT_ROWS, 1.0) for r in keys}
    seen = _features(fit, spelt, offsets, scored, ["h1", "h2", "label", "model"]).orderBy("h1", "h2", "label", "model").toPandas()
    x = np.array(seen["features"].tolist()).reshape(-1, FEATURES)
    weight = (seen["label"].map(times) * seen["n_rows"]).to_numpy(float)
    scale, w = fit_logistic(x, seen["label"].to_numpy(float), weight)
    return spelt, offsets, scored, scale, w


def _scores(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame | None:
    """Scores by the hashes of texts: h1, h2, score."""
    read = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    trained = _trained(read, labels, key, label)
    if trained is None:
        return None
    spelt, offsets, known, scale, w = trained
    z = F.lit(float(w[-1]))
    for i in range(FEATURES):
        z = z + F.get("features", F.lit(i)) * float(w[i] / scale[i])
    every = read.select("text", F.lit(0).alias("model"), *_names())
    found = _features(every, spelt, offsets, known.where("model = 0"), ["h1", "h2"])
    return store(found.select("h1", "h2", (1 / (1 + F.exp(-z))).alias("score")))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Per row: key, held_out, score (0 to 1, higher: more likely toxic).

    Trains on the labelled rows whose crc32 of the key, as text, modulo 3 is not 1; the others are held out. A
    missing or empty text is scored like one without words. Rows without a label or with a missing key are
    not trained on. Repeated labels of a key count once (the larger label). Without training rows of both labels
    all scores are 0.5. A very long text is scored whole, by the same means as a short one; an empty table gives an
    empty result. Other columns are not read.
    """
    scores = _scores(docs, labels, key, text, label)
    held_out = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(key, held_out.alias("held_out"), *_names(whole_text(text)))
    if scores is None:
        return rows.select(key, "held_out", F.lit(0.5).alias("score"))
    return rows.join(scores, ["h1", "h2"]).select(key, "held_out", "score")


def drop_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    scores = _scores(docs, labels, key, text, label)
    if scores is None:
        return docs if threshold > 0.5 else docs.limit(0)
    first, second = unused(docs, "h1"), unused(docs, "h2")
    toxic = store(scores.where(F.col("score") >= threshold).select(F.col("h1").alias(first), F.col("h2").alias(second)))
    h1, h2 = _names(whole_text(text))
    return docs.withColumns({first: h1, second: h2}).join(toxic, [first, second], "left_anti").select(*docs.columns)


def _fit_sample(known: DataFrame) -> DataFrame:
    """Up to FIT_ROWS training keys of each label, those of the smallest hashes."""
    ordered = known.withColumn("key", F.col("k")).where(_split() != 1).select("k", "label", F.xxhash64("k").alias("order"))
    parts = [ordered.where(F.col("label") == y).orderBy("order", "k").limit(FIT_ROWS) for y in (0, 1)]
    return parts[0].union(parts[1]).select("k", "label")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
