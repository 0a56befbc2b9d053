"""Op 7: fingerprints and components against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidegauge.llm import queries, simhash
from tidegauge.llm.components import connected_components

SF_DIR = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints):
    """Smallest index reachable over at most 3 differing bits."""
    values = np.array(fingerprints, np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(values))]


def test_query(spark):
    rows = queries.op7_simhash_near_dedup(spark, SF_DIR).collect()
    docs = sorted(spark.read.parquet(f"{SF_DIR}/documents.parquet").collect(), key=lambda d: d.doc_id)
    found = {r.doc_id: r for r in rows}
    prints = [plain_fingerprint(d.text) for d in docs]
    assert [found[d.doc_id].fingerprint for d in docs] == [f"{p:016x}" for p in prints]
    assert [found[d.doc_id].component_id for d in docs] == [docs[i].doc_id for i in plain_components(prints)]


@pytest.mark.parametrize("most", [1024, 6])
def test_links_connect_all_that_brute_force_connects(spark, monkeypatch, most):
    """Random fingerprints, chains and a dense group; ``most`` 6 sends groups through chains of segments."""
    monkeypatch.setattr(simhash, "GROUP_AT_MOST", most)
    random = np.random.default_rng(5)
    values = [int(x) for x in random.integers(0, 1 << 63, 60)]
    for centre in values[:12]:
        at = centre
        for _ in range(8):  # a chain
            for bit in random.choice(64, int(random.integers(1, 5)), replace=False):
                at ^= 1 << int(bit)
            values.append(at)
    values += [values[20] ^ sum(1 << int(b) for b in random.choice(64, 2, replace=False)) for _ in range(150)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    groups = {r.fp: r.component for r in simhash.fingerprint_components(frame).collect()}
    expected = plain_components([v % (1 << 64) for v in values])
    assert [groups.get(v, v) for v in values] == [values[i] for i in expected]


def test_every_close_pair_has_a_chain():
    """The pigeonring bound, for all ways to spread up to 3 bits over 4 segments."""
    from itertools import product

    for spread in product(range(4), repeat=4):
        if sum(spread) <= 3:
            chains = [[sum(spread[(s + i) % 4] for i in range(n)) for n in range(1, 5)] for s in range(4)]
            assert any(all(c <= n * 3 // 4 for n, c in enumerate(chain, 1)) for chain in chains)


def test_components_of_long_paths_and_stars(spark):
    random = np.random.default_rng(2)
    path = [int(x) for x in random.permutation(200)]
    edges = list(zip(path, path[1:])) + [(1000, 2000 + i) for i in range(50)] + [(7, 7), (3000, 3001), (3001, 3000)]
    found = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(found[i] == 0 for i in range(200))
    assert found[2049] == 1000 and found[3001] == 3000 and len(found) == 200 + 51 + 2


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    monkeypatch.setattr(simhash, "word_blocks", lambda data: iter([data.split()[i : i + 7] for i in range(0, 1000, 7)]))
    assert simhash.fingerprint_of(text.encode()) == plain_fingerprint(text)


def test_keep_one(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (2, text), (2, text), (9, "quite another text"), (None, "with no number"), (None, "with no number"), (None, text), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _wins")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = defaultdict(int)
    for r in kept.collect():
        found[r.doc_id, r.text] += 1
    assert dict(found) == {(2, text): 1, (9, "quite another text"): 1, (None, "with no number"): 1, (4, None): 1}


def test_odd_rows(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r.component_id for r in rows if r.fp == 0} == {2}
    assert simhash.near_duplicates(no_documents).collect() == [] == simhash.keep_one(no_documents).collect()
    assert simhash.keep_one(odd_documents).count() == len({r.component for r in rows})
