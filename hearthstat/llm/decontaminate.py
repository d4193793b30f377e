"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Every benchmark item is cut into windows of `window` consecutive words (an item of fewer words is one
window), and every window into word shingles. One scan of the documents keeps the positions whose shingle some
window has. A window occurs in a document only if all its shingles do, so by the prefix filter one is enough to
look for: the first when its shingles are ordered by rarity over the whole corpus. Positions of prefix shingles
pass the positional bound (the window must begin and end inside the document), and a candidate is confirmed if each
shingle of the window, compared as text, stands at its place.

The texts are split into words once, for shingles of all sizes; everything after that works on the stored positions.
The benchmark's shingles are broadcast up to `block_bytes`; beyond, documents and shingles meet by a shuffle. The
ids of a window's items stay in a table of their own and are listed once per distinct set of windows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.llm.common import documents, store, table, unused, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
#: Memory that a shingle takes as a broadcast row, besides its text.
ROW_BYTES = 100
#: A document's own row, which no shingle has, is dealt by one of so many tokens.
SPREAD = 1024


def ascii_lower(text: Column) -> Column:
    # Letters A-Z alone: a text of one-byte characters has no other capitals.
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: str) -> Column:
    return F.regexp_extract_all(ascii_lower(whole_text(text)), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """One row per window and item that has it: the window's words, their number and digest, and the item's id as a string."""
    w, n = F.col("w"), F.size("w")
    starts = F.when(n >= window, F.sequence(F.lit(1), n - (window - 1))).when(n > 0, F.array(F.lit(1)))
    cut = items.select(F.col(key).cast("string").alias("item"), words(text).alias("w")).select(
        "item", "w", F.explode(starts).alias("at")
    )
    cut = cut.select("item", F.slice("w", F.col("at"), F.lit(window)).alias("window")).distinct()
    # Words hold no blank, so that equal digests mean equal words.
    return cut.select("*", F.size("window").alias("len"), F.md5(F.concat_ws(" ", "window")).alias("id"))


def _token(w: str, at: Column, size: int) -> Column:
    """Hash of a shingle; words that are missing do not change it."""
    return F.xxhash64(*[F.get(w, at + i) for i in range(size)])


def _shingles(windows: DataFrame) -> DataFrame:
    """Every shingle of every distinct window: id, len, size, offset, shingle, token."""
    size = F.least(F.col("len"), F.lit(SHINGLE))
    at = F.sequence(F.lit(0), F.col("len") - size)
    parts = F.transform(at, lambda i: F.slice("window", i + 1, size))
    cut = windows.select("id", "window", "len").distinct().select("id", "len", size.alias("size"), F.posexplode(parts).alias("offset", "part"))
    return cut.select(
        "id", "len", "size", "offset", F.concat_ws(" ", "part").alias("shingle"), _token("part", F.lit(0), SHINGLE).alias("token")
    )


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per document (pos -1, no shingle) and one per word position and shingle size: doc, hash, n, pos, shingle, token."""
    kinds, at, n = max(1, len(sizes)), F.col("at"), F.col("n")
    each = docs.select("*", F.size("w").alias("n")).select("*", F.explode(F.sequence(F.lit(-1), n * len(sizes) - 1)).alias("at"))
    each = each.withColumn("pos", at if kinds == 1 else F.floor(at / kinds).cast("int"))
    pos = F.col("pos")
    token, shingle = F.when(at < 0, F.pmod("hash", F.lit(SPREAD))), F.when(at < 0, "")
    for i, size in enumerate(sizes):
        here = (at % kinds == i) & (pos + size <= n)
        token = token.when(here, _token("w", pos, size))
        shingle = shingle.when(here, F.concat_ws(" ", *[F.get("w", pos + j) for j in range(size)]))
    return each.select("doc", "hash", "n", "pos", shingle.alias("shingle"), token.alias("token"))


def _hits(read: DataFrame, shingles: DataFrame, block_bytes: int) -> DataFrame:
    """Stored positions whose shingle some window has, and a row with pos -1 for every document row."""
    spark = read.sparkSession
    spread = spark.range(SPREAD).select(F.col("id").alias("token"), F.lit("").alias("known"))
    known = store(shingles.select("token", F.col("shingle").alias("known")).distinct().union(spread))
    held = known.agg(F.sum(F.octet_length("known") + ROW_BYTES)).first()[0]
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())
    known = F.broadcast(known) if held <= block_bytes else known.hint("merge")
    met = _positions(read, sizes).join(known, "token").where(F.col("shingle") == F.col("known"))
    return store(met.select("doc", "hash", "n", "pos", "shingle"))


def _occurrences(hits: DataFrame, shingles: DataFrame) -> DataFrame:
    """Confirmed window occurrences: doc, hash, start, len, id; each once, however often the document row is repeated."""
    at = hits.where("pos >= 0")
    rarity = at.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = shingles.join(rarity, "shingle", "left")
    # A window with a shingle that no document has occurs nowhere.
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
    prefix = ranked.groupBy("id", "len").agg(rarest).where("rarest.n > 0").select("id", "len", "rarest.shingle", "rarest.offset")
    start = F.col("pos") - F.col("offset")
    candidates = at.join(store(prefix), "shingle").where((start >= 0) & (start + F.col("len") <= F.col("n")))
    candidates = candidates.select("doc", "hash", start.alias("start"), "len", "id").distinct()
    places = F.col("start") + F.col("offset")
    wanted = candidates.join(shingles.select("id", "size", "offset", "shingle"), "id").select(
        F.col("doc").alias("d"), F.col("hash").alias("h"), "start", "len", "id", "size", "offset", places.alias("p"), F.col("shingle").alias("s")
    )
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")) & (F.col("pos") == F.col("p"))
    met = at.join(store(wanted), same & (F.col("shingle") == F.col("s")))
    whole = met.groupBy("doc", "hash", "start", "len", "id", "size").agg(F.count_distinct("offset").alias("met"))
    return whole.where(F.col("met") == F.col("len") - F.col("size") + 1).select("doc", "hash", "start", "len", "id")


def _search(
    docs: DataFrame, items: DataFrame, window: int, key: str, text: str, item_key: str, item_text: str, block_bytes: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The hits, the confirmed occurrences, and the windows with their items."""
    windows = store(item_windows(items, window, item_key, item_text))
    shingles = store(_shingles(windows))
    read = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("hash"), words(text).alias("w"))
    hits = _hits(read, shingles, block_bytes)
    return hits, _occurrences(hits, shingles), windows


def contaminated_words(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Per document row: key, n_words, hit (word positions inside benchmark windows), item_ids (sorted strings).

    A missing or empty text has no words and no hits; a very long one is cut into words whole, in its task. An item
    without an id marks words but is not listed; repeated items count once; an item without words has no window.
    Rows with the same key but different texts are different documents; repeated rows each get their result. An
    empty benchmark marks nothing, an empty table gives an empty result. Other columns are not read, so their names
    cannot clash.
    """
    hits, found, windows = _search(docs, items, window, key, text, item_key, item_text, block_bytes)
    per_doc = found.groupBy(F.col("doc").alias("d"), F.col("hash").alias("h")).agg(
        F.collect_set(F.struct("start", "len")).alias("at"), F.array_sort(F.collect_set("id")).alias("ids")
    )
    per_doc = store(per_doc)
    # Documents with the same windows have the same items.
    sets = per_doc.select("ids").distinct().select("ids", F.explode("ids").alias("id"))
    listed = sets.join(windows.select("id", "item"), "id").groupBy(F.col("ids").alias("set"))
    listed = store(listed.agg(F.array_sort(F.collect_set("item")).alias("items")))
    per_doc = per_doc.join(listed, F.col("ids") == F.col("set"), "left")
    covered = F.flatten(F.transform("at", lambda a: F.sequence(a["start"], a["start"] + a["len"] - 1)))
    joined = hits.where("pos = -1").join(per_doc, F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    return joined.select(
        F.col("doc").alias(key),
        F.col("n").cast("long").alias("n_words"),
        F.coalesce(F.array_sort(F.array_distinct(covered)), F.array().cast("array<int>")).alias("hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("item_ids"),
    )


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """The rows, with all their columns, that have no word inside a benchmark window."""
    _, found, _ = _search(docs, items, window, key, text, item_key, item_text, block_bytes)
    d, h = unused(docs, "doc"), unused(docs, "hash")
    hit = store(found.select(F.col("doc").alias(d), F.col("hash").alias(h)).distinct())
    return docs.join(hit, docs[key].eqNullSafe(hit[d]) & (F.xxhash64(docs[text]) == hit[h]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS k,
         unnest(list_transform(range(0, greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1 : i + 10], ' '))) AS win
  FROM b WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM bw),
p AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks),
dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win FROM p),
hits AS (SELECT DISTINCT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
