import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pricelane.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, every, k):
    from math import floor, isfinite
    good = [(i, [floor(256 * x) for x in v]) for i, v, _ in vectors
            if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    found = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        own = min(v for i, v in good if i == q)
        scores = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == len(own)))
        found += [{"query_id": q, "rank": r + 1, "vec_id": i, "score": -s} for r, (s, i) in enumerate(scores[:k])]
    return found


def check(spark, vectors, every=5, k=5, **options):
    table = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    found = rows(topk.top_k(table, F.col("vec_id") % every == 0, k, **options))
    assert sorted(found, key=lambda r: (r["query_id"], r["rank"])) == plain(vectors, every, k)


def exact(x):
    """A number that a float holds exactly."""
    return round(x * 64) / 64


def test_random_vectors_with_ties(spark):
    r = random.Random(1)
    check(spark, [(i, [exact(r.uniform(-2, 2)) for _ in range(4)], 0) for i in range(300)])
    check(spark, [(i, [float(r.randint(-1, 1)) for _ in range(3)], 0) for i in range(200)])


def test_few_bins_take_more_passes(spark):
    r = random.Random(2)
    check(spark, [(i, [exact(r.uniform(-2, 2)) for _ in range(4)], 0) for i in range(200)], bins=3)


def test_chunks_of_queries(spark):
    r = random.Random(3)
    check(spark, [(i, [exact(r.uniform(-2, 2)) for _ in range(4)], 0) for i in range(100)], chunk_rows=4)


def test_all_equal(spark):
    check(spark, [(i, [1.0, 2.0], 0) for i in range(400)], every=50)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(0, [1.0, 0.5], 1), (0, [0.5, 1.0], 1), (5, None, 1), (10, [nan, 1.0], 1), (15, [1.0, None], 1),
                  (20, [1.0, -inf], 1), (25, [1.0], 1), (30, [], 1), (35, [], 1), (None, [1.0, 1.0], 1),
                  (1, [1.0, 1.0], None), (1, [1.0, 1.0], None), (2, [0.0, 0.0], None), (3, [-1.0, -1.0], None)])


def test_large_components(spark):
    check(spark, [(i, [2.0 ** (i % 20), -2.0 ** (i % 7), 1.0], 0) for i in range(40)])
    check(spark, [(i, [2.0 ** 20 + 256 * i, 1.0], 0) for i in range(20)])


def test_beyond_a_long(spark):
    table = spark.createDataFrame([(0, [1e20], 0), (1, [1e20], 0), (2, [-1e20], 0)], SCHEMA)
    found = rows(topk.top_k(table, F.col("vec_id") == 0, 5), "rank")
    assert [r["vec_id"] for r in found] == [1, 2]
    assert found[0]["score"] == 2 ** 63 - 1 and found[1]["score"] == -2 ** 63


@pytest.mark.parametrize("vectors", [[], [(1, [1.0], 0)], [(5, [1.0], 0)]])
def test_nothing_to_find(spark, vectors):
    table = spark.createDataFrame(vectors, SCHEMA)
    assert topk.top_k(table, F.col("vec_id") % 5 == 0, 5).count() == 0


def plain_by_row(vectors, every, k):
    from math import floor
    good = [(i, [floor(256 * x) for x in v]) for i, v, _ in vectors]
    found = []
    for at, (q, own) in enumerate(good):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for j, (i, v) in enumerate(good) if j != at)
            found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(found)


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 3, "bins": 3}])
def test_every_row_is_a_query_that_meets_all_others(spark, options):
    r = random.Random(4)
    some = [(i % 40, [exact(r.uniform(-2, 2)) for _ in range(3)], 0) for i in range(120)]
    vectors = some + some[:30] + [(5, [0.0, 0.0, 0.0], 0)] * 7 + [(10, [3.0, 0.0, 0.0], 0), (10, [3.0, 1.0, 0.0], 0)]
    table = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    found = topk.top_k(table, F.col("vec_id") % 5 == 0, 5, by_row=True, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(x) for x in found.collect()) == plain_by_row(vectors, 5, 5)
    alone = spark.createDataFrame([(5, [1.0], 0)], SCHEMA)
    assert topk.top_k(alone, F.col("vec_id") % 5 == 0, 5, by_row=True).count() == 0


def test_registered_query_finds_twins(spark, tmp_path):
    from pricelane.llm.queries import op1_topk
    spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0)], SCHEMA) \
        .write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted(tuple(x) for x in op1_topk(spark, str(tmp_path)).collect())
    assert found == [(0, 1, 0, 65536), (0, 1, 0, 65536), (0, 2, 1, 32768), (0, 2, 1, 32768)]
