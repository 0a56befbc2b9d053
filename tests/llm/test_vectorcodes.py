"""Op 12: codes, errors and codebooks against brute force."""

import hashlib

import numpy as np
import pytest

from tidegauge.llm import queries, vectorcodes
from tidegauge.llm.vectorcodes import CodeSettings, compress

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute_force(rows, entries=256, rounds=4, parts=4):
    """(vec_id, label, code, error) of each row and the digest, by plain distances; all vectors of one length."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(1024 * float(np.float32(c)))) for c in r[1]] for r in kept]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in x] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            used = {}
            for v in cut[p]:
                used.setdefault(nearest(v, books[p])[1], []).append(v)
            for i, members in used.items():
                books[p][i] = [sum(c) // len(members) for c in zip(*members)]
    found = []
    for n, row in enumerate(kept):
        best = [nearest(cut[p][n], books[p]) for p in range(parts)]
        found.append((row[0], row[2], "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
    text = ",".join(str(c) for book in books for e in book for c in e)
    return found, hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, chosen=CodeSettings(), schema=SCHEMA):
    found = compress(spark.createDataFrame(rows, schema).repartition(3), chosen).collect()
    wanted, digest = brute_force(rows, chosen.entries, chosen.rounds, chosen.parts)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted([(r.vec_id, r.label, r.code, r.error) for r in found], key=key) == sorted(wanted, key=key)
    assert {r.codebooks_sha256 for r in found} == {digest}
    per = {}
    for _, label, _, error in wanted:
        per[label] = per.get(label, 0) + error
    assert all(r.label_error == per[r.label] for r in found)


def vectors(n, dim, seed=1, low=-3.0, high=3.0):
    rng = np.random.default_rng(seed)
    return [(i, rng.uniform(low, high, dim).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]


def test_more_vectors_than_entries(spark):
    check(spark, vectors(90, 8), CodeSettings(entries=16, block_rows=16))
    check(spark, vectors(300, 8, low=-0.02, high=0.02), CodeSettings(block_rows=64))  # many equal integers and ties


def test_odd_rows(spark):
    rows = vectors(40, 4)
    rows += rows[:3] + [(7, [1.0, 2.0, 3.0, 4.0], None), (None, [0.5, 0.5, 0.5, 0.5], 1), (None, [0.0] * 4, None)]
    rows += [(50, None, 1), (51, [1.0, None, 0.0, 0.0], 1), (52, [1.0, float("nan"), 0.0, 0.0], 1), (53, [float("inf")] * 4, 2)]
    check(spark, rows, CodeSettings(entries=12))
    check(spark, rows)  # fewer vectors than entries, those without an id last
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "2 AS error", "3 AS x", "4 AS dim", "5 AS `a.b`")
    assert compress(more).count() == 46
    assert compress(more.where("false")).collect() == [] == compress(more.where("embedding is null")).collect()


def test_lengths_are_apart(spark):
    """Each length has its own codebooks; one that is no multiple of four is filled up with zeros."""
    rows = vectors(20, 8) + [(100 + i, v, n) for i, v, n in vectors(20, 6, seed=2)] + [(200, [], 1)]
    found = {r.vec_id: r for r in compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    filled = [(i, v + [0.0, 0.0], n) for i, v, n in rows[20:40]]
    for part in (rows[:20], filled):
        wanted, digest = brute_force(part)
        assert all((found[i].code, found[i].error, found[i].codebooks_sha256) == (c, e, digest) for i, _, c, e in wanted)
    assert found[200].code == "00000000" and found[200].error == 0


def test_codes_stand_for_near_vectors(spark):
    rows = spark.createDataFrame(vectors(400, 16, low=-1, high=1), SCHEMA)
    chosen = CodeSettings()
    held = vectorcodes.integers(rows, chosen, "vec_id", "embedding", "label").cache()
    books = vectorcodes.learn(vectorcodes.blocks(held, chosen), vectorcodes.first_codebooks(held, chosen), chosen)
    codes = compress(rows).join(held.select("vec_id", "dim"), "vec_id")
    near = {r.vec_id: r for r in vectorcodes.decoded(codes, books, chosen).collect()}
    for r in held.collect():
        assert sum((a - b) ** 2 for a, b in zip(r.x, near[r.vec_id].x)) == near[r.vec_id].error


def test_too_large_components_are_an_error(spark):
    rows = [(1, [1e30, 0.0, 0.0, 0.0], 1), (2, [0.0, 0.0, 0.0, 0.0], 1)]
    with pytest.raises(Exception, match="no exact distances"):
        compress(spark.createDataFrame(rows, SCHEMA)).collect()


def test_query_on_a_table(spark):
    table = queries.table(spark, "/root/testdata/sf0.001", "embeddings").collect()
    wanted, digest = brute_force([(r.vec_id, r.embedding, r.label) for r in table if r.vec_id < 290], rounds=1)
    made = spark.createDataFrame([r for r in table if r.vec_id < 290], SCHEMA)
    found = {r.vec_id: r for r in compress(made, CodeSettings(rounds=1)).collect()}
    assert {i: (r.code, r.error) for i, r in found.items()} == {i: (c, e) for i, _, c, e in wanted}
    assert {r.codebooks_sha256 for r in found.values()} == {digest}
    assert queries.op12_vector_codes(spark, "/root/testdata/sf0.001").count() == len(table)
