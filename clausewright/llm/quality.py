"""Quality scores: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel. Each partition sums its part of the normal equations,
Spark adds the sums up, and the driver solves one system of the features' number. Isotonic
calibration turns the ridge score into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import held_out, written

N_FEATURES = 256
#: Gaussian kernel's width over standardised statistics, ridge penalty a row, seed of the features.
WIDTH, PENALTY, SEED = 3.0, 1e-4, 17
#: Steps of the ridge score's range that calibration counts labels in.
BINS = 2_000
THRESHOLD = 0.3

STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "upper", "digits", "spaces", "newlines", "non_ascii", "stops",
    "marks", "symbols", "distinct_words", "distinct_pairs", "repeated_next", "top_word", "short_words", "long_words",
    "words_with_symbols", "capital_words", "distinct_lines", "line_bytes",
]
_BYTES = np.arange(256)
_CLASSES = np.stack(
    [
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 48) & (_BYTES <= 57),
        _BYTES == 32,
        _BYTES == 10,
        _BYTES >= 128,
        np.isin(_BYTES, list(b".,")),
        np.isin(_BYTES, list(b"!?;:'\"-()")),
        np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    ]
).astype(float)


def statistics(text: str | None) -> list[float]:
    """STATISTICS of one whole text; an empty or null text has 0 throughout."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(STATISTICS)
    n = len(data)
    shares = _CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    words = data.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in data.split(b"\n") if x]
    return [
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), n / m, *shares,
        len(counts) / m, len(set(pairs)) / max(1, len(pairs)), sum(a == b for a, b in pairs) / max(1, len(pairs)),
        max(counts.values(), default=0) / m, float((sizes <= 2).sum()) / m, float((sizes >= 14).sum()) / m,
        sum(not w.isalnum() and w.isascii() for w in words) / m, sum(w.isupper() for w in words) / m,
        len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of each row's text; no other column is read."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "x": [np.asarray(statistics(t), np.float32) for t in rows["text"]]}).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(measure, "doc_id long, x array<float>")


class FourierRidge:
    """Standardisation, random features and ridge weights; scores rows of statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n_features: int = N_FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), n_features)) / width
        self.b = rng.uniform(0, 2 * np.pi, n_features)
        self.weights = np.zeros(n_features + 1)
        self.steps = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.w + self.b
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Ridge scores."""
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, 0 to 1."""
        return np.interp(self.raw(x), *self.steps)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-falling sequence nearest to values in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.array([])


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["x"].to_numpy()).astype(float)


def fit(learn: DataFrame) -> FourierRidge:
    """Fit on learn (x array, y 0 or 1), all of its rows; with none, every score is 0.5.

    To the driver come one row of moments, one matrix of the features' number and at most BINS counts.
    """
    spark, size = learn.sparkSession, len(STATISTICS)
    moments = learn.select(
        F.count("*").alias("n"),
        *[F.avg(F.col("x")[i].cast("double")).alias(f"m{i}") for i in range(size)],
        *[F.stddev_pop(F.col("x")[i].cast("double")).alias(f"s{i}") for i in range(size)],
    ).first()
    if not moments.n:
        return FourierRidge(np.zeros(size), np.ones(size))
    mean, scale = np.array([moments[f"m{i}"] for i in range(size)]), np.array([moments[f"s{i}"] for i in range(size)])
    model = FourierRidge(mean, np.where(scale > 1e-9, scale, 1.0))
    shared = spark.sparkContext.broadcast(model)  # some 6,000 numbers, whatever the input

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((N_FEATURES + 1, N_FEATURES + 2))
        for rows in batches:
            z = shared.value.features(_matrix(rows))
            total += z.T @ np.concatenate([z, rows["y"].to_numpy(float)[:, None]], axis=1)
        yield pd.DataFrame({"row": np.arange(len(total)), "values": list(total)})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": rows["row"].iloc[:1], "values": [np.sum(np.stack(rows["values"].to_numpy()), axis=0)]})

    schema = "row int, values array<double>"
    sums = learn.select("x", "y").mapInPandas(summed, schema).groupBy("row").applyInPandas(added, schema)
    matrix = np.zeros((N_FEATURES + 1, N_FEATURES + 2))
    for r in sums.collect():
        matrix[r["row"]] = r["values"]
    penalty = np.eye(N_FEATURES + 1) * PENALTY * moments.n
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(matrix[:, :-1] + penalty + 1e-9 * np.eye(N_FEATURES + 1), matrix[:, -1])
    fitted = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            steps = np.clip(np.floor((fitted.value.raw(_matrix(rows)) + 0.5) / 2 * BINS), 0, BINS - 1).astype(int)
            yield pd.DataFrame({"step": steps, "y": rows["y"].astype(int)}).groupby("step").agg(n=("y", "size"), ones=("y", "sum")).reset_index()

    counts = (
        learn.select("x", "y").mapInPandas(binned, "step int, n long, ones long").groupBy("step").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    )
    bins = sorted(counts.collect(), key=lambda r: r.step)
    at = np.array([(b.step + 0.5) * 2 / BINS - 0.5 for b in bins])
    model.steps = (at, isotonic(np.array([b.ones / b.n for b in bins]), np.array([b.n for b in bins], float)))
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    labels: doc_id, quality; rows where either is null, and documents that are held out, teach
    nothing; of repeated labels each counts. Null and empty texts get a score like any other.
    Repeated rows get equal scores; an empty table gives an empty result; other columns aren't read.
    """
    measured = written(with_statistics(docs), "statistics")
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    learn = written(measured.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("x", "y"), "labelled")
    model = docs.sparkSession.sparkContext.broadcast(fit(learn))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            scores = np.clip(model.value.score(_matrix(rows)), 0.0, 1.0) if len(rows) else []
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": scores}).astype({"doc_id": "Int64"})

    scored = measured.mapInPandas(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_fourier_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
