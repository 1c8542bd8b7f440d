"""The pipeline against its stages done plainly, on a small table."""

import zlib

import numpy as np
from oracle import SF

import corpus_pipeline as cp
from threadloom.llm import token_files


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == list(cp.COLUMNS)
        kept.append(docs.collect())
    assert all(r.n_chars == len(r.text) for r in kept[0])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len({r.text for r in kept[1]}) == len(kept[1]) and not [r for r in kept[2] if any(i in r.text for i in items)]
    out = cp.tokens(spark, docs, SF).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_format().tokenizer)
    tokenizer.encode_special_tokens = True
    text = {r.doc_id: r.text for r in kept[3]}
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in kept[3])
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        ids = [*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted((r.doc_id, r.copy) for r in cp.run(spark, SF).collect()) == sorted((r.doc_id, r.copy) for r in out)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
