"""What a Python worker holds: batches are small in jobs that the package runs, and one operator's memory isn't kept beside another's."""

import gc
import weakref

import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from sigmaspark.llm import common, quality, sentencepieces, simhash, toxicity

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_written_batches_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    before = spark.conf.get(NAME)
    texts = spark.range(6000, numPartitions=1).select(F.expr("repeat('abcdefgh', 250)").alias("text"))
    found = common.cut(texts.mapInArrow(sizes, "rows bigint, bytes bigint")).collect()
    assert sum(x.rows for x in found) == 6000 and max(x.bytes for x in found) < 1.1 * common.BATCH_BYTES
    assert spark.conf.get(NAME) == before


def test_smaller_batches_of_the_session_stay(spark):
    before = spark.conf.get(NAME)
    spark.conf.set(NAME, "1m")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(NAME) == "1m"
        assert spark.conf.get(NAME) == "1m"
    finally:
        spark.conf.set(NAME, before)


def test_rarity_over_many_batches(spark):
    """The counts are those of all rows, however the rows come in batches."""
    made = spark.range(3000, numPartitions=2).select(F.expr("sequence(id, id + 400)").alias("hashes"))
    found = simhash._rarity(made)
    assert found.sum() == 3000 * 401 and found[0] == 1 and found[1000] == 401


def test_other_operators_forget_the_encoder():
    path = public_tokenizers.path("piece_bpe_32k.model")
    sentencepieces._encoder(path).encode(["some words"])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "host": ["h"], "text_key": [1], "row": [1], "text": ["a b"]})
    assert next(quality._measured(iter([batch]))).num_rows == 1
    assert not sentencepieces._encoder.cache_info().currsize and not sentencepieces.load_pieces.cache_info().currsize


def test_scorers_of_earlier_tasks_are_freed():
    gc.disable()
    try:
        scorer = toxicity.Scorer(toxicity.log_model(toxicity.np.zeros((toxicity.SYMBOLS,) * 3)), {"awful": 3.0}, [0.0] * 4)
        scorer.scores(["an awful text"])
        left = weakref.ref(scorer)
        del scorer
        assert left() is not None  # it is in a cycle
        common.forget()
        assert left() is None
    finally:
        gc.enable()
