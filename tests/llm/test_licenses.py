"""Op 6: copies with edits are found with their spans, ordinary text is not."""

import numpy as np
import pytest

from tidegauge.llm.license_texts import TEMPLATES
from tidegauge.llm.licenses import PLAIN, LicenseIndex, LicenseSettings, align, scan, winnow


@pytest.fixture(scope="module")
def index():
    return LicenseIndex(TEMPLATES, LicenseSettings())


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_whole_templates(index, name):
    text = f"Ünrelated wörds first. {TEMPLATES[name]} And words after."
    (found,) = index.find(text.encode())
    assert found["coverage"] == 1.0
    inside = text[found["start"] : found["stop"]]
    assert inside.split()[0] == TEMPLATES[name].split()[0] and "after" not in inside


@pytest.mark.parametrize("seed", range(5))
def test_edited_copies(index, seed):
    random = np.random.default_rng(seed)
    words = TEMPLATES["MIT"].split()
    for _ in range(12):
        at = int(random.integers(len(words)))
        words[at : at + int(random.integers(0, 2))] = ["inserted"] * int(random.integers(0, 2))
    (found,) = index.find(("before " * 30 + " ".join(words) + " after" * 30).encode())
    assert found["license"] == "MIT" and found["coverage"] > 0.85


def test_repeats_and_nested_templates(index):
    line = "Licensed under CC BY-NC 4.0.\n"
    assert [f["license"] for f in index.find((line * 5).encode())] == ["CC-BY-NC-4.0 notice"] * 5
    assert [f["license"] for f in index.find(TEMPLATES["Apache-2.0"].encode())] == ["Apache-2.0"]


def test_ordinary_text(index):
    assert index.find(b"the license of the software and the terms of use are with the author") == []
    assert index.find(b"") == []


def longest_common(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


@pytest.mark.parametrize("seed", range(6))
def test_alignment_counts_what_is_in_order(seed):
    random = np.random.default_rng(seed)
    template = np.arange(1, 41)
    words = template[random.random(40) > 0.1]
    matched, first, last = align(template, np.concatenate([np.full(12, -1), words, np.full(9, -1)]), 12)
    assert matched == longest_common(template, words) == len(words)
    assert (first, last) == (12, 11 + len(words))


def test_winnow_guarantee():
    hashes = np.random.default_rng(3).integers(0, 50, 300)
    chosen = set(winnow(hashes, 4).tolist())
    assert all(chosen & set(range(i, i + 4)) for i in range(297))


def test_odd_rows(odd_documents, no_documents):
    assert scan(odd_documents).collect() == [] == scan(no_documents).collect()


def enough(index, name, words, diagonal):
    """Whether alignment at the true place covers enough of a template and names it."""
    t = index.names.index(name)
    band = index.band(t)
    begin = diagonal - band
    part = np.concatenate([np.full(max(0, -begin), -1), words[max(0, begin) : diagonal + len(index.words[t]) + band]])
    matched, first, last = align(index.words[t], part, band)
    return matched >= index.settings.least_coverage * len(index.words[t]) and index.named(t, words[begin + first : begin + last + 1])


def plain_words(index, text):
    return np.array([index.numbers.get(w, 0) for w in text.encode().translate(PLAIN).split()])


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_one_changed_word_at_every_place(index, name):
    words = TEMPLATES[name].split()
    # All places of a notice, some of a long text.
    for at in range(0, len(words), 1 + len(words) // 16):
        for new in ([], ["changed"], [words[at], "inserted"]):
            text = " ".join(["some", "text", "first", *words[:at], *new, *words[at + 1 :], "then", "more"])
            licenses = [f["license"] for f in index.find(text.encode())]
            if enough(index, name, plain_words(index, text), 3):
                assert licenses, (at, new)
                # Another template may cover as much of what is left, but none is found besides.
                assert licenses == [name] or len(licenses) == 1, (at, new, licenses)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("name", list(TEMPLATES))
def test_as_many_changes_as_the_coverage_allows(index, name, seed):
    """Changed and dropped words: whatever alignment accepts, the fingerprints find."""
    random = np.random.default_rng(seed)
    words = TEMPLATES[name].split()
    t = index.names.index(name)
    n = len(index.words[t])
    for at in random.choice(len(words), int(n * 0.3), replace=False):
        words[at] = random.choice(["", "other"])
    text = "before " * 9 + " ".join(words) + " after" * 9
    if enough(index, name, plain_words(index, text), 9):
        assert index.find(text.encode())


@pytest.mark.parametrize(
    "text,licenses",
    [
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0 notice"]),
        ("This work is licensed under the GNU General Public License, version 4.", []),
        ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1 notice"]),
        ("Licensed under the Apache License, Version 1.0.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0 notice"]),
        ("Licensed under CC BY-SA 4.0.", []),
        ("Released under the WTF License.", []),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.", []),
        (TEMPLATES["GPL-3.0-or-later"].replace("version 3", "version 2"), ["GPL-2.0-or-later"]),
    ],
)
def test_versions_and_variants_are_kept_apart(index, text, licenses):
    assert [f["license"] for f in index.find(f"Before. {text} After.".encode())] == licenses


def test_scan_against_every_place(spark, index):
    """Documents with licenses: each template aligned at every place of the text, without fingerprints."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    made = {}
    for r in scan(spark.createDataFrame(docs)).collect():
        made.setdefault(r.doc_id, set()).add(r.license)
    for doc in docs:
        words = plain_words(index, doc.text)
        places = set()
        known = np.flatnonzero(words > 0)
        for t, template in enumerate(index.words):
            if len(template) > 20:
                continue
            for at in known.tolist():
                part = words[at : at + len(template) + index.band(t)]
                if longest_common(template.tolist(), part.tolist()) >= 0.7 * len(template) and index.named(t, part):
                    places.add(index.names[t])
        assert bool(places) == bool(made.get(doc.doc_id)) and made.get(doc.doc_id, set()) <= places, doc.doc_id
