"""Op 3: folding, exceptions, long texts and accuracy on held-out labels."""

import pytest

from tidegauge.llm import queries, toxicity
from tidegauge.llm.toxicity import Lexicon, fold_text, learn, score

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "raw,folded",
    [
        ("SCUM!!", " scum "),
        ("1d10t", " idiot "),
        ("$tupid", " stupid "),
        ("mоrоn", " moron "),  # Cyrillic
        ("ｃｌｏｗｎ", " clown "),  # full width
        ("lo​ser", " loser "),
        ("𝐈𝐃𝐈𝐎𝐓 𝕄𝕠𝕣𝕠𝕟", " idiot moron "),
        ("a$$ kil1 idi0t! wow!", " ass kill idiot wow "),
        ("İDİOT K9 2x4", " idiot k xa "),
        ("réêou 2024 $$$ the###", " reeou the "),
        ("", "  "),
    ],
)
def test_fold(raw, folded):
    assert fold_text(raw) == folded


def test_exceptions_cancel_what_they_cover():
    lexicon = Lexicon({" clown ": 2.0, " clow": 1.0, " trash ": 3.0}, frozenset({" clown fish "}))
    made = lexicon.automaton()
    assert lexicon.measure("a clown fish and a clown", made) == (2.0, 1, 6)
    assert lexicon.measure("clownish trash", made) == (4.0, 2, 2)
    assert lexicon.measure(None, made) == (0.0, 0, 0)


@pytest.mark.parametrize("size", [7, 11, 16, 40])
def test_long_texts_are_read_in_parts_with_the_same_result(monkeypatch, size):
    lexicon = Lexicon({" clown ": 2.0, " trash ": 3.0}, frozenset({" clown fish ", " no trash "}))
    made = lexicon.automaton()
    text = "a clown fish or trash and no trash then a clown and fish clown\nfish trash no clown " * 3
    whole = lexicon.measure(text, made)
    monkeypatch.setattr(toxicity, "PIECE_CHARS", size)
    assert lexicon.measure(text, made) == pytest.approx(whole)


def test_held_out_accuracy(spark):
    rows = queries.op3_toxicity(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9
    assert sum(r.predicted for r in held if not r.toxic) <= 0.03 * len(held)


def test_recall_of_toxic_documents(spark):
    """At sf0.1, where there are labels enough: toxic documents are found, held out or not, and others are left alone."""
    rows = queries.op3_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    for held_out in (True, False):
        toxic = [r.predicted for r in rows if r.held_out == held_out and r.toxic]
        clean = [r.predicted for r in rows if r.held_out == held_out and not r.toxic]
        assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_score_against_its_definition(spark):
    """Entries found by looking every word up, without an automaton."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    lexicon = learn(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    for r in score(docs, lexicon).collect():
        words, weight, hits = fold_text(r.text).split(), 0.0, 0
        for i, word in enumerate(words):
            forms = [f" {word} ", *[f" {word[:n]}" for n in range(4, min(8, len(word)) + 1)]]
            best = max(lexicon.weights.get(f, 0.0) for f in forms)
            pairs = [f" {' '.join(words[j : j + 2])} " for j in (i - 1, i) if j >= 0 and j + 2 <= len(words)]
            if best > 0 and not any(p in lexicon.exceptions for p in pairs):
                weight, hits = weight + best, hits + 1
        assert r.hits == hits and r.weight == pytest.approx(weight)


def test_odd_rows(odd_documents, no_documents, no_labels):
    empty = learn(odd_documents, no_labels)
    assert empty.weights == {}
    rows = score(odd_documents, empty).collect()
    assert len(rows) == odd_documents.count() and {r.predicted for r in rows} == {0}
    known = odd_documents.selectExpr("doc_id", "CAST(coalesce(doc_id % 2, 1) AS INT) AS toxic")
    assert score(no_documents, learn(odd_documents, known)).collect() == []
    assert learn(no_documents, no_labels).weights == {}
