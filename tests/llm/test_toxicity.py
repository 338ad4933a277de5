import numpy as np
import pytest

from clausewright.llm import toxicity
from clausewright.llm.toxicity import GatedNetwork, Memo, as_batch, op6_recurrent_toxicity, score_toxicity, starts_of, words_of


def test_gradients_are_the_numerical_ones():
    network = GatedNetwork()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    names, index, mask = as_batch([[b"ab", b"cde", b"ab"], [b"xyz"] * 5])
    y = np.array([1, 0], np.float32)
    step = network.gradients(names, index, mask, y)

    def loss():
        z = network.run(network.project(network.inputs(names)[0])[index], mask)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    for k, v in network.p.items():
        at = np.unravel_index(np.argmax(np.abs(step[k])), v.shape)
        old = v[at]
        v[at] = old + 1e-3
        up = loss()
        v[at] = old - 1e-3
        down = loss()
        v[at] = old
        assert step[k][at] == pytest.approx((up - down) / 2e-3, rel=1e-2)


@pytest.mark.parametrize("n", [1, 24, 31, 32, 33, 57, 500])
def test_windows_overlap_and_cover_every_word(n):
    s = starts_of(n)
    covered = {i for a in s for i in range(a, min(n, a + toxicity.WINDOW))}
    assert covered == set(range(n)) and (np.diff(s) < toxicity.WINDOW).all()


def test_a_window_s_score_does_not_depend_on_its_batch():
    network = GatedNetwork()
    texts = [words_of(f"some words number {i} " * (i % 7)) for i in range(40)]
    alone = [network.scores([t])[0] for t in texts]
    assert np.allclose(network.scores(texts, Memo(network)), alone, atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op6_recurrent_toxicity(spark, sf).collect()}
    held = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = np.mean([g.predicted == t for g, t in held])
    caught = np.mean([g.predicted for g, t in held if t])
    spared = np.mean([1 - g.predicted for g, t in held if not t])
    print(right, caught, spared)
    assert right > 0.93 and spared > 0.97 and caught > 0.6 and len(got) == 10_000


def test_edge_rows(spark):
    texts = [(1, None), (1, None), (None, ""), (2, "!!! ..."), (3, "fine words " * 20_000), (4, "you foul thing"), (5, "a fine thing")]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(4, 1), (5, 0), (3, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    got = score_toxicity(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.doc_id in (None, 1, 2)] == [0, 0, 0, 0]
    assert {r.predicted for r in score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_scores_are_those_of_windows_taken_one_by_one(spark):
    """Every whole text of the table against a plain version: slice its windows, run each alone, take the worst."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    learn = toxicity.sample(docs, labels).orderBy("doc_id", "y").toPandas()
    network = toxicity.fit(learn["text"].tolist(), learn["y"].tolist())
    got = {r.doc_id: r for r in op6_recurrent_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words, worst = words_of(r.text), -np.inf
        for start in range(0, max(1, len(words) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE):
            window = words[start : start + toxicity.WINDOW]
            if window:
                names, index, mask = as_batch([window])
                worst = max(worst, float(network.run(network.project(network.inputs(names)[0])[index], mask)[0]))
        score = 1 / (1 + np.exp(-(worst - float(network.shift))))
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-4), r.doc_id
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)
