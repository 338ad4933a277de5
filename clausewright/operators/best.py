"""Questions scored against all rows in tasks, as arrays: each task hands on each question's best rows only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores are rounded to six digits afterwards: what may still be equal to the last of the best is kept.
MARGIN = 1.1e-6
#: Numbers in a block of scores or weights, and texts that are counted at a time.
BLOCK, TEXTS = 2_000_000, 256


def _place(*columns: np.ndarray) -> np.ndarray:
    """Place of each row, from 0, in its run of equal values."""
    changed = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    opens = np.append(0, np.flatnonzero(changed) + 1)
    return np.arange(len(columns[0])) - np.repeat(opens, np.diff(np.append(opens, len(columns[0]))))


class Best:
    """Of (question, key, score) the limit best of each question: score falls, then key rises.

    Rows that could be among them after rounding stay. once: a key counts once, with its greatest score.
    """

    def __init__(self, n_questions: int, limit: int, once: bool = False):
        self.n_questions, self.limit, self.once = n_questions, limit, once
        self.floor = np.full(n_questions, -np.inf)
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.size, self.room = 0, 4 * BLOCK // 8

    def add(self, keys: pa.Array, scores: np.ndarray, kept: np.ndarray) -> None:
        """scores and kept: a row a key, a column a question."""
        at, question = np.nonzero(kept & (scores >= self.floor[None, :]))
        if len(at):
            self.parts.append((question, keys.take(pa.array(at)), scores[at, question]))
            self.size += len(at)
        if self.size > self.room:
            self._prune()
            self.room = max(self.room, 2 * self.size)

    def _prune(self) -> None:
        question, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        keys = pa.chunked_array([p[1] for p in self.parts]).combine_chunks()
        coded = pc.rank(keys, tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.arange(len(question))
        if self.once:
            order = np.lexsort((-score, coded, question))
            order = order[_place(question[order], coded[order]) == 0]
        order = order[np.lexsort((coded[order], -score[order], question[order]))]
        question, score = question[order], score[order]
        place = _place(question)
        last = np.flatnonzero(place == self.limit - 1)
        least = np.full(self.n_questions, -np.inf)
        least[question[last]] = score[last]
        self.floor = least - MARGIN
        # Behind the last of the best: nothing of its very score, whose keys are smaller; of any other score, copies above all, no more than could count.
        near = (score >= self.floor[question]) & (score != least[question]) & (_place(question, score) < self.limit)
        stay = (place < self.limit) | near
        self.parts = [(question[stay], keys.take(pa.array(order[stay])), score[stay])]
        self.size = int(stay.sum())

    def rows(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        if self.parts:
            self._prune()
        yield from self.parts


def _emitted(best: Best, qids: pa.Array, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows; infinite scores stand for null and for not a number, as those rank."""
    for question, keys, score in best.rows():
        found = pa.array(np.where(np.isposinf(score), np.nan, score), mask=np.isneginf(score), from_pandas=False)
        for first in range(0, len(question), 50_000):
            own = slice(first, first + 50_000)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(question[own])), keys[own], found[own]], schema=kind)


def counted(terms: list[str], kind: pa.Schema):
    """Texts (key, lang, words) as numbers of the terms that they hold, and how often; n_words counts all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for whole in batches:
            for first in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(first, TEXTS)
                words = batch.column("words")
                n_words = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                found = pc.index_in(words.flatten(), value_set=known)
                some = found.is_valid().to_numpy(zero_copy_only=False)
                pairs, tfs = np.unique(np.repeat(np.arange(len(n_words)), n_words)[some] * len(terms) + found.drop_null().to_numpy().astype(np.int64), return_counts=True)
                offsets = pa.array(np.searchsorted(pairs // max(1, len(terms)), np.arange(len(n_words) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(terms)), tfs)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array(n_words.astype(np.int32)), *lists], schema=kind)

    return count


def keyword_best(asked: dict[str, dict], idf: dict[str, np.ndarray], mean_words: dict[str, float], weight, limit: int, qid_type: pa.DataType, kind: pa.Schema):
    """Of counted texts each question's best: the sum of weight * idf over the question's terms, of those above zero.

    asked: by language, the numbers of each question's terms; idf: by language and number.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(dict.fromkeys(q for own in asked.values() for q in own))
        number, best = {q: i for i, q in enumerate(names)}, Best(len(names), limit)
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                if lang not in mean_words or not asked.get(lang):
                    continue
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                of = np.array([number[q] for q in asked[lang]])
                used, places = np.unique(np.concatenate(list(asked[lang].values())), return_inverse=True)
                starts = np.cumsum([0] + [len(t) for t in asked[lang].values()])[:-1]
                step = max(1, BLOCK // len(places))
                for first in range(0, own.num_rows, step):
                    part = own.slice(first, step)
                    lengths = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(part.num_rows), lengths)
                    term, tfs = (part.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
                    at = np.minimum(np.searchsorted(used, term), len(used) - 1)
                    here = used[at] == term
                    table = np.zeros((part.num_rows, len(used)))
                    table[row[here], at[here]] = idf[lang][term[here]] * weight(tfs[here], part.column("n_words").to_numpy()[row[here]], mean_words[lang])
                    sums = np.add.reduceat(table[:, places], starts, axis=1)
                    spread = np.zeros((part.num_rows, len(names))) if len(of) < len(names) else sums
                    if len(of) < len(names):
                        spread[:, of] = sums
                    best.add(part.column("key"), spread, spread > 0)
                    if limit > BLOCK:  # all rows are asked for: none waits for better ones
                        yield from _emitted(best, pa.array(names, qid_type), kind)
                        best.parts, best.size = [], 0
        yield from _emitted(best, pa.array(names, qid_type), kind)

    return score


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of that width without nulls as rows of a matrix, and which they are."""
    sound = np.array(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False), bool)
    flat = vectors.filter(pa.array(sound)).flatten()
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    if flat.null_count:
        holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        matrix, sound[np.flatnonzero(sound)[holes]] = matrix[~holes], False
    return matrix, sound


def meaning_best(qids: list, vectors: list, limit: int, once: bool, qid_type: pa.DataType, kind: pa.Schema):
    """Of rows (key, vector) each question's best by cosine, as matrix products; once: a key counts once."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, widths = Best(len(qids), limit, once), {}
        for width in {len(v) for v in vectors if v is not None and None not in v and len(v)}:
            at = [i for i, v in enumerate(vectors) if v is not None and len(v) == width and None not in v]
            q = np.array([vectors[i] for i in at], np.float64)
            widths[width] = at, q, np.sqrt((q * q).sum(axis=1))
        for batch in batches:
            step = max(1, BLOCK // max(1, len(qids)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                scores = np.full((part.num_rows, len(qids)), -np.inf)
                for width, (at, q, sizes) in widths.items():
                    matrix, sound = _matrix(part.column("vector"), width)
                    with np.errstate(all="ignore"):
                        own = (matrix @ q.T) / (np.sqrt((matrix * matrix).sum(axis=1))[:, None] * sizes[None, :])
                    scores[np.ix_(np.flatnonzero(sound), at)] = np.where(np.isnan(own), np.inf, own)
                best.add(part.column("key"), scores, np.ones_like(scores, bool))
        yield from _emitted(best, pa.array(qids, qid_type), kind)

    return score
