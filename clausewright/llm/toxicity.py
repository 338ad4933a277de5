"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word enters as a hashed word vector and the mean of hashed vectors of its letter triples. The
network reads windows that overlap and cover every whole text; a document's score is its worst
window's. Training is plain numpy on the driver, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clausewright.llm.shared import held_out, tidy

#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 24
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN = 1 << 14, 1 << 13, 12, 12
#: The training sample's bound: labelled documents of each class, and bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES = 1_500, 20_000
ROUNDS, EPOCHS, BATCH, RATE, SEED = 3, 3, 128, 0.01, 5
#: Distinct words whose network inputs a Python worker keeps at once, and windows scored together.
MEMO_ENTRIES, CHUNK = 80_000, 1_024
THRESHOLD = 0.5
_EDGES = b"\"'.,;:!?()[]{}<>|#$%&*+-=/\\^_`~@"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a whole text, as UTF-8, without marks at their ends."""
    return [w for w in map(_bare, (text or "").lower().encode().split()) if w]


def _bare(word: bytes) -> bytes:
    return word.strip(_EDGES)


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the letter table, word of each) for all letter triples of all words."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    codes = (data[:-2] * 961 + data[1:-1] * 31 + data[2:]) * 2_654_435_761 >> 7
    inside = owner[:-2] == owner[2:]
    return codes[inside] % CHAR_ROWS, owner[:-2][inside]


def word_rows(words: list[bytes]) -> np.ndarray:
    """Rows of the word table."""
    return np.fromiter((zlib.crc32(w) % WORD_ROWS for w in words), np.int64, len(words))


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class GatedNetwork:
    """The network's weights; inference, gradients and training."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(size=shape, scale=scale).astype(np.float32)
        h, d = HIDDEN, 2 * WIDTH
        self.p = {"word": normal(WORD_ROWS, WIDTH, scale=0.1), "char": normal(CHAR_ROWS, WIDTH, scale=0.3)}
        for way in "fb":  # forward, backward
            self.p |= {f"x{way}": normal(d, 3 * h, scale=d**-0.5), f"h{way}": normal(h, 3 * h, scale=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}
        self.p |= {"u": normal(2 * h, h, scale=0.3), "v": normal(h, scale=0.3), "o": normal(2 * h, scale=0.3), "t": np.zeros(1, np.float32)}
        self.shift = np.float32(0)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Word vector and mean letter vector of each word, and what the gradient needs."""
        rows = word_rows(words)
        codes, owner = triples(words)
        counts = np.maximum(np.bincount(owner, minlength=len(words)), 1).astype(np.float32)[:, None]
        chars = np.zeros((len(words), WIDTH), np.float32)
        if len(codes):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            chars[owner[starts]] = np.add.reduceat(self.p["char"][codes], starts, axis=0)
        return np.concatenate([self.p["word"][rows], chars / counts], axis=1), (rows, codes, owner, counts)

    def project(self, e: np.ndarray) -> np.ndarray:
        """Both directions' share of the gates that the words themselves give."""
        return np.concatenate([e @ self.p["xf"] + self.p["cf"], e @ self.p["xb"] + self.p["cb"]], axis=1)

    def run(self, g: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; g: (window, step, both directions' gates), mask: 1 where there is a word."""
        p, h, (n, steps) = self.p, HIDDEN, mask.shape
        states = np.zeros((n, steps, 2 * h), np.float32)
        tape = []
        for way, lo, order in (("f", 0, range(steps)), ("b", 3 * h, range(steps - 1, -1, -1))):
            s, side = np.zeros((n, h), np.float32), (0 if way == "f" else h)
            for t in order:
                x, r = g[:, t, lo : lo + 3 * h], s @ p[f"h{way}"]
                gates = _gate(x[:, : 2 * h] + r[:, : 2 * h])
                z, q = gates[:, :h], gates[:, h:]
                c = np.tanh(x[:, 2 * h :] + q * r[:, 2 * h :])
                m = mask[:, t : t + 1]
                new = (z * s + (1 - z) * c) * m
                if keep:
                    tape.append((way, lo, t, s, r, z, q, c, m))
                states[:, t, side : side + h] = s = new
        a = np.tanh(states @ p["u"])
        weights = np.exp(np.clip(a @ p["v"], -30, 30)) * mask
        weights /= np.maximum(weights.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weights, states)
        logits = pooled @ p["o"] + p["t"]
        return (logits, (states, tape, a, weights, pooled)) if keep else logits

    def gradients(self, words: list[bytes], index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        """Gradients of the mean logistic loss; index: word number of each step of each window."""
        p, h, n = self.p, HIDDEN, len(y)
        e, (rows, codes, owner, counts) = self.inputs(words)
        logits, (states, tape, a, weights, pooled) = self.run(self.project(e)[index], mask, keep=True)
        out = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((_gate(logits) - y) / n).astype(np.float32)
        out["o"], out["t"] = pooled.T @ dl, dl.sum(keepdims=True)
        dp = dl[:, None] * p["o"]
        ds = weights[:, :, None] * dp[:, None, :]
        dw = np.einsum("nth,nh->nt", states, dp)
        dw = weights * (dw - (weights * dw).sum(axis=1, keepdims=True))
        out["v"] = np.einsum("nt,nth->h", dw, a)
        da = dw[:, :, None] * p["v"] * (1 - a * a)
        out["u"] = states.reshape(-1, 2 * h).T @ da.reshape(-1, h)
        ds += da @ p["u"].T
        dg = np.zeros((*index.shape, 6 * h), np.float32)
        carry = {"f": np.zeros((n, h), np.float32), "b": np.zeros((n, h), np.float32)}
        for way, lo, t, s, r, z, q, c, m in reversed(tape):
            side = 0 if way == "f" else h
            d = (ds[:, t, side : side + h] + carry[way]) * m
            dc = d * (1 - z) * (1 - c * c)
            dz, dq = d * (s - c) * z * (1 - z), dc * r[:, 2 * h :] * q * (1 - q)
            dr = np.concatenate([dz, dq, dc * q], axis=1)
            dg[:, t, lo : lo + 3 * h] = np.concatenate([dz, dq, dc], axis=1)
            out[f"h{way}"] += s.T @ dr
            carry[way] = d * z + dr @ p[f"h{way}"].T
        by_word = np.zeros((len(words), 6 * h), np.float32)
        np.add.at(by_word, index.reshape(-1), dg.reshape(-1, 6 * h))
        for way, lo in (("f", 0), ("b", 3 * h)):
            own = by_word[:, lo : lo + 3 * h]
            out[f"x{way}"], out[f"c{way}"] = e.T @ own, own.sum(axis=0)
        de = by_word[:, : 3 * h] @ p["xf"].T + by_word[:, 3 * h :] @ p["xb"].T
        np.add.at(out["word"], rows, de[:, :WIDTH])
        np.add.at(out["char"], codes, (de[:, WIDTH:] / counts)[owner])
        return out

    def train(self, windows: list[list[bytes]], y: np.ndarray, epochs: int, moments: dict, rng) -> None:
        """Adam over all windows, classes weighted equally by drawing."""
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                names, index, mask = as_batch([windows[i] for i in own])
                step = self.gradients(names, index, mask, y[own].astype(np.float32))
                moments["n"] = moments.get("n", 0) + 1
                for k, g in step.items():
                    m, v = moments.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= RATE * (m / (1 - 0.9 ** moments["n"])) / (np.sqrt(v / (1 - 0.99 ** moments["n"])) + 1e-6)

    def score_windows(self, texts: list[list[bytes]], memo: Memo | None = None) -> list[np.ndarray]:
        """Logits of all windows of each text."""
        memo = Memo(self) if memo is None else memo
        spans = [starts_of(len(t)) for t in texts]
        numbers = [memo.numbers(t) for t in texts]
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        gates = memo.table()
        offsets = np.cumsum([0] + [len(t) for t in texts])
        begin = np.concatenate([offsets[i] + s for i, s in enumerate(spans)]) if spans else np.zeros(0, np.int64)
        end = np.concatenate([np.full(len(s), offsets[i + 1]) for i, s in enumerate(spans)]) if spans else begin
        logits = np.zeros(len(begin), np.float32)
        steps = np.arange(WINDOW)
        for lo in range(0, len(begin), CHUNK):
            at = begin[lo : lo + CHUNK, None] + steps
            inside = at < end[lo : lo + CHUNK, None]
            index = flat[np.where(inside, at, 0)]
            logits[lo : lo + CHUNK] = self.run(gates[index], inside.astype(np.float32))
        return np.split(logits, np.cumsum([len(s) for s in spans])[:-1]) if spans else []

    def scores(self, texts: list[list[bytes]], memo: Memo | None = None) -> np.ndarray:
        """Each text's score: its worst window's, 0 without words."""
        worst = [x.max() if len(x) else -np.inf for x in self.score_windows(texts, memo)]
        return 1.0 / (1.0 + np.exp(-(np.array(worst, float) - float(self.shift))))


def starts_of(n: int) -> np.ndarray:
    """Where the windows of n words begin: every word is in one, neighbours overlap."""
    if n == 0:
        return np.zeros(0, np.int64)
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def as_batch(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, their numbers by window and step, mask)."""
    number: dict[bytes, int] = {}
    index, mask = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.float32)
    for i, w in enumerate(windows):
        index[i, : len(w)] = [number.setdefault(x, len(number)) for x in w]
        mask[i, : len(w)] = 1
    return list(number), index, mask


class Memo:
    """Gates' inputs by word, computed once for each distinct word."""

    def __init__(self, network: GatedNetwork):
        self.network, self.number, self.new = network, {}, []
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of words; new words wait for table()."""
        number, new = self.number, self.new
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = number.get(w)
            if k is None:
                k = number[w] = len(number)
                new.append(w)
            out[i] = k
        return out

    def table(self) -> np.ndarray:
        """The table that numbers() refers to."""
        if self.new:
            if len(self.number) > len(self.gates):
                more = np.zeros((max(len(self.number), 2 * len(self.gates)), self.gates.shape[1]), np.float32)
                more[: len(self.gates)] = self.gates
                self.gates = more
            first = len(self.number) - len(self.new)
            for lo in range(0, len(self.new), 20_000):
                part = self.new[lo : lo + 20_000]
                self.gates[first + lo : first + lo + len(part)] = self.network.project(self.network.inputs(part)[0])
            self.new = []
        return self.gates

    def fresh(self) -> Memo:
        """Itself, or an empty one once it is full."""
        return self if len(self.number) < MEMO_ENTRIES else Memo(self.network)


def _unlike(docs: list[tuple[list[bytes], int]]) -> list[tuple[list[bytes], int]]:
    """docs without words left out, and without near copies: one label's chance must not count often."""
    kept, known = [], set()
    for words, y in docs:
        if words:
            runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
            marks = {(salt, min(zlib.crc32(r, salt) for r in runs)) for salt in (1, 2, 3, 4)}
            if not marks & known:
                kept.append((words, y))
            known |= marks
    return kept


def fit(texts: list[str], labels: list[int]) -> GatedNetwork:
    """Train on whole texts and their labels (1: toxic).

    Labels are of documents, not windows: at first a toxic document's window is the one around the
    words that toxic documents have oftenest against others, later the network's own worst window;
    windows of other documents that score worst join the negative ones round by round.
    """
    network, rng = GatedNetwork(), np.random.default_rng(SEED)
    seen = {}
    for t, y in zip(texts, labels, strict=True):
        seen.setdefault(t, y)
    docs = _unlike([(words_of(t), int(y)) for t, y in seen.items()])
    toxic, other = [w for w, y in docs if y == 1], [w for w, y in docs if y == 0]
    if not toxic or not other:
        network.shift = np.float32(0 if toxic else 60)
        return network
    odds: dict[bytes, list[int]] = {}
    for group, side in ((toxic, 0), (other, 1)):
        for w in group:
            for x in set(w):
                odds.setdefault(x, [0, 0])[side] += 1
    least = max(2, 0.01 * len(toxic))
    weight = {x: np.log((a + 0.5) / len(toxic)) - np.log((b + 0.5) / len(other)) for x, (a, b) in odds.items() if a >= least}
    weight = {x: v * odds[x][0] for x, v in weight.items() if v > 1.5}
    spans = lambda w: [w[s : s + WINDOW] for s in starts_of(len(w)).tolist()]

    def pointed(w):
        best = max(spans(w), key=lambda s: sum(weight.get(x, 0.0) for x in s))
        return best if any(x in weight for x in best) else None

    drawn = lambda w, n: [w[s : s + WINDOW] for s in rng.integers(0, max(1, len(w) - WINDOW + 1), n).tolist()]
    positive = [s for s in map(pointed, toxic) if s]
    negative = [s for w in other for s in drawn(w, 3)]
    moments: dict = {}
    for turn in range(ROUNDS):
        repeated = positive * max(1, round(len(negative) / max(1, len(positive)) / 3))
        y = np.r_[np.ones(len(repeated)), np.zeros(len(negative))]
        network.train(repeated + negative, y, EPOCHS, moments, rng)
        if turn + 1 < ROUNDS:
            memo = Memo(network)
            for w, logits in zip(other, network.score_windows(other, memo), strict=True):
                s = int(np.argmax(logits)) * STRIDE
                negative.append(w[s : s + WINDOW])
            positive = []
            for w, logits in zip(toxic, network.score_windows(toxic, memo), strict=True):
                if logits.max() > 0:
                    s = int(np.argmax(logits)) * STRIDE
                    positive.append(w[s : s + WINDOW])
            positive = positive or [s for s in map(pointed, toxic) if s]
    worst = np.array([x.max() for x in network.score_windows([w for w, _ in docs])])
    y = np.array([y for _, y in docs])
    # The cut that errs least on whole documents becomes score 0.5; the middle one of equals.
    cuts = np.unique(np.r_[worst, worst.min() - 1])
    order, ones = np.sort(worst[y == 0]), np.sort(worst[y == 1])
    errors = (len(order) - np.searchsorted(order, cuts, "right")) / len(order) + np.searchsorted(ones, cuts, "right") / len(ones)
    best = int(np.argmin(errors))
    after = cuts[best + 1] if best + 1 < len(cuts) else cuts[best]
    network.shift = np.float32((cuts[best] + after) / 2)
    return network


def sample(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_DOCS) -> DataFrame:
    """The training sample: text and y of at most n labelled documents of each class.

    Held-out documents are no part of it. Ids are drawn by hash over all labels; 2 n of them, a few
    kilobytes, are broadcast to the documents.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y in (0, 1)]
    ids = drawn[0].union(drawn[1]).select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text")
    return short.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _scored(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """row (a struct of columns) and score of every row of docs."""
    learn = sample(docs, labels).orderBy("doc_id", "y").toPandas()  # at most 2 * SAMPLE_DOCS rows of SAMPLE_BYTES
    network = fit(learn["text"].tolist(), learn["y"].tolist())
    shared = docs.sparkSession.sparkContext.broadcast(network)  # two tables of fixed size and a few matrices

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(shared.value)
        for batch in batches:
            row = batch.column("row")
            texts = row.field("text")
            out = np.zeros(len(batch))
            for lo in range(0, len(batch), 256):
                memo = memo.fresh()
                out[lo : lo + 256] = shared.value.scores([words_of(t) for t in texts.slice(lo, 256).to_pylist()], memo)
            # Rows pass through as they came, without becoming Python objects.
            yield pa.RecordBatch.from_arrays([row, pa.array(out)], ["row", "score"])

    packed = docs.select(F.struct(*dict.fromkeys([*columns, "text"])).alias("row"))
    return packed.mapInArrow(tidy(score), StructType([packed.schema["row"], StructField("score", DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text).

    labels: doc_id, toxic; rows where either is null teach nothing. Texts are read whole, however
    long. A null text, or one without words, scores 0. Repeated rows get equal scores; an empty
    table gives an empty result; other columns aren't read.
    """
    scored = _scored(docs, labels, ["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that score THRESHOLD or more."""
    return _scored(docs, labels, docs.columns).where(F.col("score") < THRESHOLD).select("row.*")


def op6_recurrent_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
