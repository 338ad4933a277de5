import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clausewright.llm.quality import STATISTICS, isotonic, op1_fourier_quality, score_quality, statistics


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 5)), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_isotonic_is_the_max_min_formula(pairs):
    v, w = np.array([p[0] for p in pairs]), np.array([float(p[1]) for p in pairs])
    mean = lambda a, b: np.average(v[a : b + 1], weights=w[a : b + 1])
    n = len(v)
    want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    assert np.allclose(isotonic(v, w), want)


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    s, y = np.array(scores)[order], np.array(y)[order]
    ranks = np.empty(len(s))
    for v in np.unique(s):
        own = s == v
        ranks[own] = np.flatnonzero(own).mean() + 1
    ones = y.sum()
    return (ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op1_fourier_quality(spark, sf).collect()}
    held = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    value = auc([g.score for g, _ in held], [q for _, q in held])
    right = np.mean([g.predicted == q for g, q in held])
    print(value, right, np.mean([q for _, q in held]))
    assert value > 0.85 and right > 0.9
    assert len(got) == 10_000 and all(0 <= r.score <= 1 for r in got.values())


def test_edge_rows(spark):
    assert len(statistics(None)) == len(statistics("a b")) == len(STATISTICS) and statistics("") == [0.0] * len(STATISTICS)
    docs = spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "", 3), (2, " \n ", 1), (3, "word " * 60_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0)], "doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_fit_is_one_direct_solve(spark):
    """Summed normal equations and ridge weights against numpy on all rows at once; features against the kernel."""
    from clausewright.llm import quality as q

    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, len(STATISTICS))).astype(np.float32)
    x[:, 3] = 1.0  # a statistic that doesn't vary
    y = (x[:, 0] + 0.3 * rng.normal(size=600) > 0).astype(float)
    learn = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<float>, y double").repartition(5)
    model = q.fit(learn)
    wide = x.astype(float)
    scale = wide.std(axis=0)
    plain = q.FourierRidge(wide.mean(axis=0), np.where(scale > 1e-9, scale, 1.0))
    z = plain.features(wide)
    penalty = np.diag([q.PENALTY * len(x)] * q.N_FEATURES + [0.0]) + 1e-9 * np.eye(q.N_FEATURES + 1)
    want = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(model.raw(wide), z @ want, atol=1e-5)
    steps = np.clip(np.floor((z @ want + 0.5) / 2 * q.BINS), 0, q.BINS - 1).astype(int)
    used = np.unique(steps)
    level = q.isotonic(np.array([y[steps == s].mean() for s in used]), np.array([(steps == s).sum() for s in used], float))
    assert np.mean(np.abs(model.score(wide) - np.interp(z @ want, (used + 0.5) * 2 / q.BINS - 0.5, level)) < 1e-3) > 0.98
    many = q.FourierRidge(np.zeros(4), np.ones(4), n_features=20_000)
    a = rng.normal(size=(30, 4))
    kernel = np.exp(-((a[:, None] - a[None]) ** 2).sum(axis=2) / (2 * q.WIDTH**2))
    assert np.abs(many.features(a)[:, :-1] @ many.features(a)[:, :-1].T - kernel).max() < 0.05
