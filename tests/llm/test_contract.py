"""The registered corpus queries and the pipeline."""

from __future__ import annotations

import re

import __spark_entry__ as contract
import corpus_pipeline
from ratescope.llm import common, exact, mixing, shingles

FOLDER = "/root/testdata/sf0.001"


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = [n for n in contract.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert contract.queries()["pipeline"] is corpus_pipeline.run


def test_stages_make_no_copy_of_the_texts(spark, tmp_path, monkeypatch):
    source, copied = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60), []
    source.write.parquet(f"{tmp_path}/docs")
    for module in (common, exact, mixing, shingles):
        monkeypatch.setattr(module, "settle", lambda df, of=module.settle: copied.append(df.columns) or of(df))
    for name, stage in corpus_pipeline.STAGES:
        if name in ("exact_dedup", "jaccard_join", "mix_sources"):
            assert stage(spark, spark.read.parquet(f"{tmp_path}/docs"), FOLDER).count() > 0
    assert len(copied) > 3 and not any("text" in c for c in copied)


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name != "pack":
            assert docs.columns == columns
            docs = corpus_pipeline.settle(docs)
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[4] > 0
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns)
