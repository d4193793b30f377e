import corpus_pipeline
from hearthstat.llm import decontaminate, near_dedup, secrets
from hearthstat.llm.common import store, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, sf))
        assert docs.columns == columns
        kept.append(docs)
    toxic, near, clean, redacted = kept
    assert toxic.count() < table(spark, sf, "documents").count()
    # What a stage keeps has nothing left for it to remove.
    assert near_dedup.near_duplicates(near).where("NOT kept").isEmpty()
    found = decontaminate.contaminated_words(clean, table(spark, sf, "benchmark"))
    assert found.where("size(hit) > 0").isEmpty()
    assert secrets.scan_secrets(redacted).where("size(spans) > 0").isEmpty()
    assert redacted.where("n_chars <> char_length(text)").isEmpty() and redacted.count() == clean.count()


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)


def test_odd_rows(spark, sf, odd, empty):
    for docs in (odd, empty):
        docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "bigint(0) AS n_chars", "hash", "key")
        for _, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, sf))
        assert docs.count() <= odd.count()
