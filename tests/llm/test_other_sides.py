"""Queries give the same where nothing is small enough to be sent: every bound on rows at -1."""

import pytest

import corpus_pipeline
from gleaner.llm import decontam, simhash, substring, suffix, toxicity, warc, word_lm
from gleaner.llm.queries import QUERIES

BOUNDS = {
    "op2_substring_dedup": (substring, "BROADCAST_SPANS"), "op3_suffix_array_dedup": (suffix, "BROADCAST_SPANS"), "op6_warc": (warc, "BROADCAST_ROWS"),
    "op7_lm_scoring": (word_lm, "BROADCAST_IDS"), "op8_toxicity": (toxicity, "BROADCAST_LABELS"), "op9_benchmark_decontamination": (decontam, "BROADCAST_ROWS"),
}


def _rows(frame):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", list(BOUNDS))
def test_nothing_is_sent(spark, sf_dir, monkeypatch, name):
    want = _rows(QUERIES[name](spark, sf_dir))
    monkeypatch.setattr(*BOUNDS[name], -1)
    assert _rows(QUERIES[name](spark, sf_dir)) == want


def test_no_numbers_or_leaks_are_sent(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def kept():
        near = simhash.one_of_each(docs)
        clean = corpus_pipeline.benchmark_decontamination(spark, docs, sf_dir)
        return _rows(near), _rows(clean)

    want = kept()
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_LEAKS", -1)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    assert kept() == want
