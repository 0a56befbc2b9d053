"""Op 11: bounds never below scores, and the ranking against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import lexical, queries
from tidegauge.llm.lexical import Corpus, LexicalSettings, Questions, build_index, search, sketch, term_counts

PATTERN = re.compile(lexical.TERM_PATTERN)
LOWER = str.maketrans(lexical.CAPITALS, lexical.SMALL)


def terms_of(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=10):
    """{(item_id, rank): (doc_id, score)} by scoring every document for every item."""
    held = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs if terms_of(text)]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    found = {}
    for item, terms in asked.items():
        ranked = []
        for doc_id, counts in held:
            m = 100 - 90 + (90 * counts.total() * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in terms & counts.keys()
            )
            if score > 0 and doc_id is not None:
                ranked.append((-score, doc_id))
        found |= {(item, rank): (doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(ranked)[:k], 1)}
    return found


def answers(df):
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_terms(text):
    counts, n = term_counts(text.encode("utf-8", "replace"))
    wanted = Counter(t.encode("utf-8", "replace") for t in terms_of(text))
    assert counts == wanted and n == wanted.total()


def test_sketch_keeps_the_largest_count(monkeypatch):
    monkeypatch.setattr(lexical, "COORDINATES", 4)
    counts = Counter({b"a": 3, b"b": 7, b"c": 1, b"d": 300, b"e": 2})
    at, most = sketch(counts)
    wanted = {}
    for t, n in counts.items():
        place = lexical.coordinate(t)
        wanted[place] = max(wanted.get(place, 0), min(n, 255))
    assert dict(zip(at.tolist(), most.tolist())) == wanted and at.tolist() == sorted(wanted)
    assert [len(x) for x in sketch(Counter())] == [0, 0]


@pytest.mark.parametrize("coordinates", [8, 64, 1 << 16])
def test_bounds_are_never_below_scores(monkeypatch, coordinates):
    monkeypatch.setattr(lexical, "COORDINATES", coordinates)
    rng = np.random.default_rng(3)
    words = [f"w{i}".encode() for i in range(60)]
    texts = [b" ".join(rng.choice(words, rng.integers(1, 400))) for _ in range(50)] + [b"w1 " * 1000]
    rows = []
    for i, text in enumerate(texts):
        counts, n = term_counts(text)
        at, most = sketch(counts)
        rows.append((i, n, at.astype("<u2").tobytes(), most.tobytes()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "n", "places", "counts"]
    )
    members = [np.sort(rng.choice(60, 12, replace=False)) for _ in range(9)]
    asked = Questions(list(range(9)), words, rng.integers(1, 9000, 60), members, Corpus(51, sum(r[1] for r in rows)), LexicalSettings(items_at_once=4))
    known = {w: i for i, w in enumerate(words)}
    bounds = np.zeros((len(texts), 9))
    for start, ids, found in asked.bounds([batch], rows=16):
        bounds[ids, start : start + found.shape[1]] = found
    scores = np.array([asked.scores(t, list(range(9)), known) for t in texts])
    assert (bounds >= scores).all()
    if coordinates == 1 << 16 and len({lexical.coordinate(w) for w in words}) == 60:
        assert (bounds[:-1] == scores[:-1]).all()  # nothing collides and no count is cut off


def test_ranking_on_a_table(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    items = queries.table(spark, "/root/testdata/sf0.001", "benchmark")
    wanted = brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert answers(queries.op11_lexical_search(spark, "/root/testdata/sf0.001")) == wanted


def test_ties_and_many_passes(spark, monkeypatch):
    """Copies tie and rank by id; passes of few terms, few first candidates and colliding sketches change nothing."""
    monkeypatch.setattr(lexical, "COORDINATES", 1 << 16)
    rows = [(i, f"alpha beta gamma{i % 7} " + "delta " * (i % 3)) for i in range(300)] + [(i, "beta epsilon zeta eta") for i in range(900, 960)]
    items = [(1, "Epsilon, zeta"), (2, "gamma3 DELTA"), (3, "nothing-here"), (4, "eta?"), (5, None), (None, "gamma1 gamma2"), (2, "zeta")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = brute_force(rows, items)
    assert [wanted[1, r][0] for r in range(1, 11)] == list(range(900, 910))
    for chosen in (LexicalSettings(), LexicalSettings(first=10, terms_at_once=3, items_at_once=1)):
        assert answers(search(docs, asked, chosen)) == wanted


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "plain text nothing quick"), (2, ""), (3, "12 ünïcödé"), (3, "fox")], "item_id bigint, text string")
    found = search(odd_documents, items)
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert answers(found) == brute_force(rows, [(r.item_id, r.text) for r in items.collect()])
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert search(no_documents, items).collect() == [] == search(odd_documents, items.where("false")).collect()
    assert build_index(no_documents).collect() == []
