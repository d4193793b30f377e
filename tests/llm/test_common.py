from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa

from hearthstat.llm import common, near_dedup, pieces, secrets, toxicity

PATH = public_tokenizers.path("piece_bpe_32k.model")


def worked(spark, module):
    """A module's work on one batch, as a worker gets it, done in this process."""

    def run(batches):
        for batch in batches:
            pieces.encode(["some words"], PATH) if module is pieces else None
            yield batch

    run.__module__ = module.__name__
    task = common.map_arrow(SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema: run), run, "key long")
    batch = pa.RecordBatch.from_pydict({"key": [1, 2]})
    assert list(task(iter([batch]))) == [batch]


def test_a_worker_forgets_the_stages_before(spark):
    """Processes live on from stage to stage: what one remembers must not add up with the next one's."""
    for other in (near_dedup, toxicity, secrets):
        worked(spark, pieces)
        words = pieces.vocabulary(PATH)
        worked(spark, pieces)
        assert pieces.vocabulary(PATH) is words and words.recent.young
        worked(spark, other)
        assert not pieces.vocabulary.cache_info().currsize and not pieces._searched.cache_info().currsize
    toxicity._built["counts"] = []
    worked(spark, toxicity)
    assert toxicity._built
    worked(spark, near_dedup)
    assert not toxicity._built


def test_work_ends_with_its_batches(spark):
    """Nothing but the batches comes out, and an error stays the one that was raised."""

    def run(batches):
        yield from batches
        raise ValueError("bad row")

    task = common.tidy(run)(iter([1, 2]))
    assert [next(task), next(task)] == [1, 2]
    try:
        next(task)
    except ValueError as error:
        assert str(error) == "bad row"
    else:
        raise AssertionError
