"""Op 8: ids and decoding against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegauge.llm import bpe, queries

PATH = public_tokenizers.path(queries.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.vocabulary(PATH)
SF_DIR = "/root/testdata/sf0.001"


def both(text):
    theirs = LIBRARY.encode(text, add_special_tokens=False).ids
    (ids,) = OURS.encode([text.encode()])
    return (ids.tolist(), OURS.decode(ids.tolist())), (theirs, LIBRARY.decode(theirs, skip_special_tokens=False))


@pytest.mark.parametrize(
    "text",
    [
        "", "  ", "it's I'LL 'tis don't x'y''s", "İstanbul ΣΑΣ ς Straße ﬁ ǅ", "a<|endoftext|>b <|startoftext|>",
        "<|endoftext|≯ x", "日本語 test　wide\xa0nb\x1cfs\x85nel", "é ́ x́", "1234 ٣٤ ½ Ⅷ",
        "ab" * 5000 + "!" * 700, "\U0001f600‍\U0001f469 ok", "﻿bom \xad soft", "<|ENDOFTEXT|>", "\xa0", "İ. ẋ",
    ],
)
def test_texts(text):
    ours, theirs = both(text)
    assert ours == theirs


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ours, theirs = both(text)
    assert ours == theirs


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("the inganerst'. é"), max_size=200))
def test_wordlike_text(text):
    ours, theirs = both(text)
    assert ours == theirs


def test_small_stores_change_nothing(monkeypatch):
    texts = [f"{'alpha beta gamma delta'[i % 9 :]} word{i} again" for i in range(200)]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    small = bpe.vocabulary.__wrapped__(PATH)
    found = [ids.tolist() for ids in small.encode(t.encode() for t in texts)]
    assert found == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op8_bpe(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(rows) == len(docs)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = LIBRARY.encode(d.text, add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert tuple(rows[d.doc_id])[1:] == (len(ids), digest(" ".join(map(str, ids))), digest(text))


def test_digests_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "IDS_AT_ONCE", 3)
    for text in ("", "one", "a b c d e f g", "seven words make more than three ids"):
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        wanted = " ".join(map(str, ids)), LIBRARY.decode(ids, skip_special_tokens=False)
        (found,) = OURS.encode([text.encode()])
        assert OURS.digests(found) == tuple(hashlib.sha256(w.encode()).hexdigest() for w in wanted)


def test_odd_rows(odd_documents, no_documents):
    made = bpe.encode_documents(odd_documents, PATH)
    rows = made.withColumn("again", bpe.decoded("ids", PATH)).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert list(r.ids) == LIBRARY.encode(r.text or "", add_special_tokens=False).ids and r.again == r.decoded
    assert bpe.encode_documents(no_documents, PATH).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="not a vocabulary of this kind"):
        bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
