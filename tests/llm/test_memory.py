"""What tasks hold in a Python worker, and what they leave there for the next ones."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from verdictflow.llm import bpe


def test_a_task_leaves_no_words_in_its_worker():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["some words, more words", None, ""]})
    found = bpe.encode_batches([batch, batch], public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, forget=True)
    assert next(found).column("n_tokens").to_pylist() == [5, 0, 0]
    codec = bpe.Codec.of(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    assert codec.ids and codec.decoded
    assert next(found).column("n_tokens").to_pylist() == [5, 0, 0] and next(found, None) is None
    assert not (codec.ids or codec.decoded or codec.old_ids or codec.old_decoded) and codec.ranks


@pytest.mark.parametrize("stage", [corpus_pipeline.secrets_stage, corpus_pipeline.token_stage])
def test_long_texts_come_to_python_in_small_batches(spark, stage):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        docs = spark.range(40).repartition(1).selectExpr("cast(id as string) doc_id", "repeat('ab cd ', 200000) text")
        stage(spark, docs, "")
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) < 12 << 20 and sum(r.n for r in sizes) > 40 * 1_200_000
    finally:
        spark.conf.set(name, before)
