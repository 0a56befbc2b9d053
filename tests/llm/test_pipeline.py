"""The pipeline: each stage's decisions against what its operator says, run() against the stages by hand."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tidegauge.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, made = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        made.append(docs)
    return made


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").dtypes
    assert [s.dtypes for s in stages[:-1]] == [columns] * 4


def test_stages(spark, stages):
    start = sorted(spark.read.parquet(f"{SF_DIR}/documents.parquet").collect(), key=lambda r: r.doc_id)
    named, alone, clean, mixed, encoded = [s.collect() for s in stages]
    assert {r.doc_id for r in start} - {r.doc_id for r in named} <= {r.doc_id for r in start if len(r.text) < 60}
    named.sort(key=lambda r: r.doc_id)
    roots = plain_components([plain_fingerprint(r.text) for r in named])
    assert sorted(r.doc_id for r in alone) == sorted({named[i].doc_id for i in roots})
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in alone)
    before = {r.doc_id: r.text for r in alone}
    assert all((r.text == before[r.doc_id]) == ("[SECRET]" not in r.text) for r in clean)
    counts = Counter(r.doc_id for r in mixed)
    assert max(counts.values()) <= 3 and set(counts) <= {r.doc_id for r in clean}
    words = sum(len(r.text.split()) for r in clean)
    assert abs(sum(len(r.text.split()) for r in mixed) - words) < 0.1 * words
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    expected = Counter()
    for r in mixed:
        ids = library.encode(r.text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(decoded)] += 1
    assert Counter(map(tuple, encoded)) == expected


def test_run(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == Counter(map(tuple, stages[-1].collect()))
