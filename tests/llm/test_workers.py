"""What a worker process keeps."""

import pyarrow as pa

from tidemark.llm import automaton
from tidemark.llm.tables import tokenizer


def test_workers_drop_the_automaton(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(8)], "doc_id long, text string").coalesce(1)
    assert automaton.encode_and_decode(docs, tokenizer("word_bpe_49k.json"), keep_tables=False).collect()

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([automaton.encoder_of.cache_info().currsize])], names=["n"])

    assert {r.n for r in docs.select("doc_id").mapInArrow(held, "n long").collect()} == {0}
