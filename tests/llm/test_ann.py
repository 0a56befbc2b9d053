"""Op 9: against brute force, with ties, repeats and unusable vectors."""

import numpy as np
import pytest

from tidegauge.llm import ann, queries
from tidegauge.llm.ann import AnnSettings, encode, estimates, rotation, search

SF_DIR = "/root/testdata/sf0.01"


def plain(rows, asked, k):
    ids = [i for i, _ in rows]
    vectors = np.array([v for _, v in rows], float)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = {}
    for q in asked:
        scores = units @ units[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-round(float(scores[i]), 12), ids[i]))
        found[q] = [(ids[i], float(scores[i])) for i in order[:k]]
    return found


def collected(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    expected = plain(rows, [i for i, _ in rows if i % 50 == 0], 5)
    found = collected(queries.op9_nearest_vectors(spark, SF_DIR))
    assert set(found) == set(expected)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.99 * 5 * len(expected)
    exact = {i: np.array(v, float) for i, v in rows}
    for q, list_ in found.items():
        for i, score in list_:
            a, b = exact[q], exact[i]
            assert score == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-14)


def test_error_bounds_hold():
    random = np.random.default_rng(0)
    units = random.standard_normal((4000, 100))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    turn, settings = rotation(100, 1), AnnSettings()
    assert np.allclose(turn @ turn.T, np.eye(100))
    codes = encode(units, turn)
    for query in units[:20]:
        estimate, bound = estimates(codes, query, turn, settings)
        assert (np.abs(estimate - units @ query) <= bound).mean() > 0.995
        assert abs((estimate - units @ query).mean()) < 0.01


def test_blocks_repeats_and_ties(spark):
    random = np.random.default_rng(4)
    rows = [(i, [float(x) for x in random.standard_normal(6)]) for i in range(120)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000 + i, rows[3][1]) for i in range(3)]
    frame = spark.createDataFrame(rows + [rows[5], rows[5]], "vec_id bigint, embedding array<double>")
    settings = AnnSettings(block_rows=16, group_rows=4, spread=6.0)
    found = collected(search(frame, frame.where("vec_id % 3 = 0"), settings))
    expected = plain(rows, [i for i, _ in rows if i % 3 == 0], 5)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in expected.items()}


def test_unusable_vectors_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS key", "2 AS dim", "3 AS v")
    found = collected(search(frame, frame))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {1: [2], 2: [1]}
    assert found[1][0][1] == pytest.approx(np.sqrt(0.5))
    assert search(frame.where("false"), frame.where("false")).collect() == []


def test_few_candidates():
    vectors = np.array([[1.0, 0.0]])
    ((places, scores),) = ann.nearest(vectors, vectors, np.array([3]), 6, AnnSettings())
    assert places.tolist() == [0] and scores.tolist() == [1.0]
