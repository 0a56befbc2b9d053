"""Op 5: accuracy on the held-out fold, blocks against whole texts, odd rows."""

import numpy as np

from tidegauge.llm import langid, queries
from tidegauge.llm.langid import LanguageSettings, bag, identify, keep_identified, subword_buckets, train

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.op5_language_id(spark, SF_DIR).join(
        spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_long_texts_are_read_in_blocks(monkeypatch):
    data = ("une très longue histoire, the end; " * 40).encode()
    whole = bag(data, 12)
    monkeypatch.setattr(langid, "BLOCK", 17)
    parts = bag(data, 12)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    assert sum(map(len, subword_buckets(b"a", 12))) == 1


def test_training_is_repeatable(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    settings = LanguageSettings(per_language=40, epochs=1)
    one, two = train(docs, settings), train(docs.repartition(5), settings)
    assert np.array_equal(one.table, two.table) and one.temperature == two.temperature


def test_odd_rows(spark, odd_documents, no_documents):
    model = train(odd_documents, LanguageSettings(per_language=10))
    rows = identify(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        letters = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0 and r.rejected))
    assert keep_identified(odd_documents, model).columns == odd_documents.columns
    empty = train(no_documents)
    assert {r.lang_pred for r in identify(odd_documents, empty).collect()} == {"und"}
    assert identify(no_documents, empty).collect() == []


def test_numbers_are_no_letters(spark):
    texts = ["½ ② ² Ⅷ 10", "x²", "ª", "日本", "", "12 34", "é"]
    model = train(spark.read.parquet(f"{SF_DIR}/documents.parquet"), LanguageSettings(per_language=20, epochs=1, least_steps=100))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.lang_pred for r in identify(rows, model).collect()}
    assert [found[i] == "und" for i in range(len(texts))] == [not any(c.isalpha() for c in t) for t in texts]


def test_prediction_against_its_definition(spark):
    """Each subword of a short text looked up by itself."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    model = train(docs, LanguageSettings(per_language=20, epochs=1, least_steps=200))
    for r in identify(docs.where("length(text) < 600"), model).collect():
        plain = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in f" {r.text.lower()} ").encode()
        rows = []
        for size in langid.SUBWORD_BYTES:
            for i in range(len(plain) - size + 1):
                key = size
                for byte in plain[i : i + size]:
                    key = (key * 257 + byte) % 2**32
                rows.append(model.table[(key * 2654435761 % 2**32) >> (32 - model.settings.bits)].astype(float))
        wanted = langid.softmax((np.mean(rows, axis=0) + model.bias) / model.temperature)
        assert r.lang_pred == model.languages[wanted.argmax()] and abs(r.score - wanted.max()) < 1e-6


def test_sample_is_bounded_over_all_languages(spark):
    rows = [(i, f"word{i % 50} " * 3000, f"l{i % 50:02d}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    settings = LanguageSettings(most_documents=100, learned_bytes=500)
    sample = langid._sample(docs, settings, "text", "lang", "doc_id").collect()
    assert len(sample) == 100 and len({r.lang for r in sample}) == 50
    assert max(len(b["buckets"]) for r in sample for b in r.bags) <= 4 * 2 * 502


def test_sampled_bags_are_read_in_place(spark, monkeypatch):
    """Rows of bags would be pickled in the driver and copied into Python objects."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    frame, collected = type(docs), []
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: collected.append(self.columns) or plain(self))
    model = train(docs, LanguageSettings(per_language=5, epochs=1, least_steps=50))
    assert model.languages and not [c for c in collected if "bags" in c]
