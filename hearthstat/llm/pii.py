"""Personal data and the terms that give it away, with DataFrame functions only.

Base entities (e-mail, IP, card, phone) are found by patterns. A term of a document with an entity is judged by what the
corpus says it reveals: over documents of different text, with N documents, n(e) of them with the entity,
n(t) with the term and n(t, e) with both, the term's pointwise mutual information with the
entity is ln(P(e|t) / P(e)), and its disclosure is that over the entity's information -ln P(e):

    disclosure = 1 + ln(n(t, e) / n(t)) / ln(N / n(e))

A term that occurs only with one entity discloses all of it (1). Terms at or over `remove_at` are removed,
those at or over `generalise_at` are generalised to the class of the word. Evidence below `support` documents is
no evidence. Copies of a text count once, so repetition alone gives no evidence. A judged term is marked wherever it
occurs in documents with the entity and, if asked for, in all others too.

Entities, and the words of documents that have some, are extracted once and stored. Entities without support go
before they meet words; each of m copies of a text counts 1/m, so that all counts are partial sums before the shuffle. The
pass over all words keeps only terms that are candidates, and words are located in documents with judged terms alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.llm.common import documents, store, whole_text

# Matches are as those of the plain patterns. Possessive repeats and the look-behind (or the end of the last
# match) keep a long run of word characters from being tried at each of its positions.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Only whole digit chains of 16 to 19 digits: the others fail the count.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

KINDS = ("email", "ip", "card", "phone")
TERM = r"\p{L}+"
#: Code points on either side of an entity in which terms are judged: longer than any text, so all of the document.
REACH = 1 << 31
#: What is joined to texts or words is broadcast up to this many bytes; beyond it, it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def located(text: Column, pattern: str) -> Column:
    """All matches as structs (start, end, value) in code points, end exclusive."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(values.alias("value"), F.split(text, pattern, -1).alias("gap"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    found = F.filter(pairs, lambda x: x["value"].isNotNull())
    return F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])


def _luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.char_length(F.regexp_replace(value, "[^0-9]", ""))


def base_entities(text: Column) -> Column:
    """Entities as structs (kind_no, start, end, value), by kind as in KINDS, then start."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    digit = text.rlike("[0-9]")
    by_kind = (
        F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none),
        F.filter(
            F.when(digit, located(text, IP)).otherwise(none), lambda x: x["value"].rlike(rf"^(?:{IP_PART}\.){{3}}{IP_PART}$")
        ),
        F.filter(F.when(digit, located(text, CARD)).otherwise(none), lambda x: _luhn(x["value"])),
        F.filter(
            F.when(F.contains(text, F.lit("+")), located(text, PHONE)).otherwise(none), lambda x: _digits(x["value"]).between(8, 15)
        ),
    )

    def tagged(no: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(no).alias("kind_no"), x["start"], x["end"], x["value"]))

    return F.concat(*[tagged(no, spans) for no, spans in enumerate(by_kind)])


def _entity(x: Column) -> Column:
    """What names the same person or account: letter case and separators aside."""
    plain = F.when(x["kind_no"] >= 2, F.regexp_replace(x["value"], "[^0-9]", "")).otherwise(F.lower(x["value"]))
    return F.concat_ws(":", x["kind_no"], plain)


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _outside(text: Column, base: Column) -> Column:
    """The text without its entities and the words that they cut."""

    def add(acc: Column, x: Column) -> Column:
        # A word that begins before an entity or ends behind it is no word outside it.
        before = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        before = F.when(acc["at"] > 0, F.regexp_replace(before, rf"^{TERM}", "")).otherwise(before)
        kept = F.concat(acc["out"], F.regexp_replace(before, rf"(?<!\p{{L}}){TERM}$", ""), F.lit(" "))
        later = F.struct(x["end"].alias("at"), kept.alias("out"))
        return F.when(x["start"] >= acc["at"], later).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))

    def last(acc: Column) -> Column:
        rest = F.substring(text, acc["at"] + 1, F.char_length(text))
        return F.concat(acc["out"], F.when(acc["at"] > 0, F.regexp_replace(rest, rf"^{TERM}", "")).otherwise(rest))

    ordered = F.array_sort(F.transform(base, lambda x: F.struct(x["start"], x["end"])))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, last)


def _located_terms(text: Column, base: Column, terms: Column, removed: Column) -> Column:
    """Where terms occur outside all entities: structs (start, end, action), by start. Only terms are appended, so long texts are no burden."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("value"), F.split(text, TERM, -1).alias("gap"))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        term = F.lower(x["value"])
        action = F.when(F.array_contains(removed, term), "remove").otherwise("generalise")
        span = F.struct(start.alias("start"), end.alias("end"), action.alias("action"))
        spans = F.when(F.array_contains(terms, term), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    found = F.filter(pairs, lambda x: x["value"].isNotNull())
    spans = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])
    return F.filter(spans, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))


def _small(df: DataFrame, size: Column) -> DataFrame:
    """The stored rows, to be broadcast if they are few."""
    stored = store(df)
    held = stored.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(stored) if held <= BROADCAST_BYTES else stored


def find_personal_data(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    support: int = 3,
    remove_at: float = 0.9,
    generalise_at: float = 0.8,
    everywhere: bool = False,
) -> DataFrame:
    """Per document row: key, hash (of the text), base (entities), terms (start, end, action).

    A missing text is read as empty: no entities. Rows with the same key but different texts are different
    documents; repeated rows each get their result. Columns other than key and text are not read. An
    entity that most documents have (its information is near 0) discloses nothing. Terms are marked in all of the documents
    that have their entity; with `everywhere`, as op8_personal_data asks, in all documents.
    """
    whole = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("hash"), whole_text(text).alias("body"))
    found = whole.select("doc", "hash", "body", base_entities(F.col("body")).alias("base"))
    entities = F.array_distinct(F.transform("base", _entity))
    words = F.when(F.size("base") > 0, _words(_outside(F.col("body"), F.col("base"))))
    found = store(found.select("doc", "hash", "base", entities.alias("entities"), words.alias("words")))
    copies = found.groupBy("hash").agg(F.count("*").alias("m"))
    n = copies.count()
    copies = _small(copies.where("m > 1").withColumnRenamed("hash", "h"), F.lit(32))

    def counted(rows: DataFrame) -> DataFrame:
        """The rows with their share of a text."""
        return rows.join(copies, F.col("hash") == F.col("h"), "left").withColumn("part", 1 / F.coalesce("m", F.lit(1))).drop("h", "m")

    def texts() -> Column:
        return F.round(F.sum("part")).cast("long")

    with_entity = found.where(F.size("base") > 0)
    n_e = counted(with_entity.select("hash", F.explode("entities").alias("entity"))).groupBy("entity").agg(texts().alias("n_e"))
    n_e = _small(n_e.where((F.col("n_e") >= support) & (F.col("n_e") < n)), F.octet_length("entity") + 40)
    pairs = counted(with_entity.select("hash", "words", F.explode("entities").alias("entity"))).join(n_e, "entity")
    pairs = pairs.select("entity", "n_e", "part", F.explode("words").alias("term"))
    together = pairs.groupBy("entity", "n_e", "term").agg(texts().alias("n_te")).where(F.col("n_te") >= support)
    together = store(together)
    candidates = _small(together.select("term").distinct(), F.octet_length("term") + 32)
    words = counted(whole).select("part", F.explode(_words(F.col("body"))).alias("term")).join(candidates, "term", "left_semi")
    n_t = words.groupBy("term").agg(texts().alias("n_t"))
    disclosure = 1 + F.log(F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))) / F.log(F.lit(float(max(n, 1))) / F.col("n_e"))
    judged = together.join(n_t, "term").withColumn("disclosure", disclosure).where(F.col("disclosure") >= generalise_at)
    by = ["term"] if everywhere else ["entity", "term"]
    judged = judged.groupBy(*by).agg((F.max("disclosure") >= remove_at).alias("removed"))
    judged = _small(judged, F.octet_length(F.concat(*by)) + 40)
    if everywhere:
        held = whole.select("doc", "hash", F.explode(_words(F.col("body"))).alias("term"))
    else:
        held = with_entity.select("doc", "hash", "words", F.explode("entities").alias("entity")).join(judged.select("entity").distinct(), "entity", "left_semi")
        held = held.select("doc", "hash", "entity", F.explode("words").alias("term"))
    held = held.join(judged, by)
    held = held.groupBy(F.col("doc").alias("d"), F.col("hash").alias("h")).agg(
        F.collect_set("term").alias("listed"), F.collect_set(F.when(F.col("removed"), F.col("term"))).alias("gone")
    )
    held = _small(held, F.octet_length(F.concat_ws(" ", "listed")) * 2 + 64)
    marked = whole.join(held, F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")))
    spans = _located_terms(F.col("body"), base_entities(F.col("body")), F.col("listed"), F.col("gone"))
    added = marked.select("d", "h", spans.alias("terms")).groupBy("d", "h").agg(F.first("terms").alias("terms"))
    joined = found.join(added, F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return joined.select(F.col("doc").alias(key), "hash", "base", F.coalesce("terms", none).alias("terms"))


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with entities replaced by their kind, terms removed or generalised to the class of the word."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    spans = F.concat(
        F.transform(base, lambda x: F.struct(x["start"], x["end"], F.get(names, x["kind_no"]).alias("put"))),
        F.transform(
            terms, lambda x: F.struct(x["start"], x["end"], F.when(x["action"] == "remove", "").otherwise("[word]").alias("put"))
        ),
    )

    def add(acc: Column, x: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), x["put"])
        later = F.struct(x["end"].alias("at"), kept.alias("out"))
        return F.when(x["start"] >= acc["at"], later).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        F.array_sort(spans), start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    )


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir), everywhere=True)
    name = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda x: F.concat_ws(":", F.get(name, x["kind_no"]), x["start"], x["end"]))
    terms = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"], x["end"]))

    def count(no: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind_no"] == no)).cast("long")

    return found.select(
        "doc_id",
        *[count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, terms)).alias("spans"),
    )
