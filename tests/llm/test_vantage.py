import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm.vantage import VantageTree, nearest, op4_vantage_trees


def brute(rows, query_ids, k):
    """Lists of (vec_id, score) by query id; where ids repeat, the rows of each are told apart by their place."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for at, (q, x) in enumerate(good):
        if q in query_ids:
            scores = [(-float((v * x).sum()), i) for n, (i, v) in enumerate(good) if n != at and len(v) == len(x)]
            out.setdefault(q, []).extend((i, -s) for s, i in sorted(scores)[:k])
    return {q: x for q, x in out.items() if x}


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert 1 <= r.rank <= len(out[r.query_id])
    return out


@pytest.mark.parametrize("factor", [1.0, 1.15, 1.4])
def test_tree_prunes_and_factor_one_is_exact(factor):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    q = rng.normal(size=(40, 6))
    tree = VantageTree(x, 32)
    best, _ = tree.search(q, 5, factor)
    want = np.sort(q @ x.T, axis=1)[:, -5:]
    if factor == 1.0:
        assert np.allclose(np.sort(best, axis=1), want)
    else:
        assert np.mean([np.isin(np.round(a, 9), np.round(b, 9)).mean() for a, b in zip(best, want, strict=True)]) > 0.9


def test_exact_search_on_real_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = as_lists(nearest(vectors, queries, 20, 1.0))
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], {r.query_id for r in queries.collect()}, 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert np.allclose([s for x in got.values() for _, s in x], [s for q in got for _, s in want[q]], rtol=1e-12)


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    got = as_lists(op4_vantage_trees(spark, sf))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in x}) / len(x) for q, x in want.items()])
    assert recall >= 0.97, recall


def test_a_larger_factor_scores_less():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 8))
    scored = []
    for factor in (1.0, 2.0, 4.0):
        tree, n = VantageTree(x), [0]
        leaf = tree._leaf
        tree._leaf = lambda rows, active, n=n, leaf=leaf: (n.__setitem__(0, n[0] + len(rows) * len(active)), leaf(rows, active))
        tree.search(x[:50] + 0.01, 5, factor)
        scored.append(n[0] / (50 * len(x)))
    assert scored[0] > scored[1] > scored[2] and scored[2] < 0.5


def test_edge_rows(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(60)] + [
        (100, None), (101, [0.0, 0.0]), (102, [None, 1.0]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (None, same),
        (105, [3.0]), (106, []), (107, [5.0, 1.0]), (107, [5.0, 1.0]), (108, [-9.0, 9.0]), (20, [7.0, 7.0]), (108, [8.0, 8.0]),
    ]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    queries = vectors.where("vec_id in (0, 5, 20, 105, 107, 101)").select(F.col("vec_id").alias("query_id"), "embedding")
    got, want = as_lists(nearest(vectors, queries, 20, 1.0)), brute(rows, [0, 5, 20, 105, 107, 101], 20)
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    assert len(got[20]) == len(got[107]) == 40 and [i for i, _ in got[0]].count(108) == 2
    assert nearest(vectors.limit(0), queries).count() == nearest(vectors, queries.limit(0)).count() == 0
