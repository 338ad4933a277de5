"""Removal of repeated word windows by level-wise doubling.

Short windows come first. Of these, each window of the next length, twice as long, names the one of
least hash, so that every repeat of the longer window names an equal shorter one; only the named are
counted over the corpus. Longer windows whose named part occurs once are dropped, the rest go on to
the next level, until the full length or until none survive. The full length is counted by 128-bit
hashes, as its answers remove words; shorter ones, which only let candidates through, by 64 bits.

Documents are put into chunks of a few megabytes, written once as rows. A chunk sends the distinct
hashes of a level, sorted and cut into ranges; each range is counted by one group, which answers
every chunk with a bit a hash. Positions never travel: a chunk finds them again from its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import tidy, written

WINDOW = 35
#: Windows of no more words than this aren't halved again.
BASE = 9
#: Bytes of text in a chunk, about; bytes of text whose hashes one range gets, about.
CHUNK_BYTES, RANGE_BYTES = 4_000_000, 4_000_000
#: Bytes whose words are hashed at once.
BLOCK = 1 << 19
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, 656, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _STEP, _BYTE_2 = _RANDOM[:256], _RANDOM[256:400], _RANDOM[400:]
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def levels(window: int) -> list[int]:
    """Lengths from the shortest to the full one, each at most twice the one before."""
    out = [window]
    while out[0] > BASE:
        out.insert(0, -(-out[0] // 2))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of a column of texts: where they begin and end, their hashes, their documents."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base = ends[0] if len(ends) else 0
        self.data = np.frombuffer(data, np.uint8)[base : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
        self.bounds = ends - base
        space = _SPACE[self.data]
        inside = ~space
        first, last = inside.copy(), inside.copy()
        first[1:] &= space[:-1] | self._at(self.bounds[:-1])[1:]
        last[:-1] &= space[1:] | self._at(self.bounds[1:] - 1)[:-1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.bounds, self.begin, "right") - 1
        self.hashes = self._hash(0)

    def _at(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.data), bool)
        out[places[(places >= 0) & (places < len(self.data))]] = True
        return out

    def _hash(self, other: int) -> np.ndarray:
        """64-bit hashes of the words, a block of bytes at a time; other: which of two independent functions."""
        letters, step = (_BYTE, _STEP[0]) if not other else (_BYTE_2, _STEP[121])
        out, lo = [], 0
        while lo < len(self.begin):
            hi = max(lo + 1, int(np.searchsorted(self.end, self.begin[lo] + BLOCK, "right")))
            begin, sizes = self.begin[lo:hi], self.end[lo:hi] - self.begin[lo:hi]
            starts = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
            powers = np.cumprod(np.full(int(sizes.max()), step))
            out.append(np.add.reduceat(letters[self.data[np.repeat(begin, sizes) + place]] * powers[place], starts))
            lo = hi
        return _mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.begin)

    def whole(self, length: int) -> np.ndarray:
        """Which windows of this length lie in one document, by their first word."""
        n = max(0, len(self) - length + 1)
        return self.doc[:n] == self.doc[length - 1 :] if n else np.zeros(0, bool)

    def windows(self, length: int, other: int = 0) -> np.ndarray:
        """Hashes of the windows of this length, by one or the other function."""
        h, size, turn = self._hash(1) if other else self.hashes, 1, 45 * other
        while 2 * size <= length:
            h = _mix(h[:-size] * _STEP[turn] + h[size:]) if len(h) > size else h[:0]
            size, turn = 2 * size, turn + 1
        off = length - size
        if off:
            h = _mix(h[:-off] * _STEP[turn + 40] + h[off:]) if len(h) > off else h[:0]
        return h


def _sliding(x: np.ndarray, span: int, choose) -> np.ndarray:
    """choose (minimum or maximum) over each span of x."""
    size = 1
    while 2 * size <= span:
        x = choose(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    off = span - size
    if off:
        x = choose(x[:-off], x[off:]) if len(x) > off else x[:0]
    return x


def _distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows sorted, each row's number among them, counts) of hashes of one or, in two halves, two words."""
    if not len(high):
        rows, inverse, counts = np.unique(low, return_inverse=True, return_counts=True)
        return rows[:, None], inverse, counts
    order = np.lexsort((high, low))
    rows = np.stack([low[order], high[order]], axis=1)
    new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    inverse = np.empty(len(rows), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return rows[new], inverse, np.bincount(inverse, minlength=int(new.sum()))


def survivors(words: Words, lengths: list[int], answers: list[np.ndarray]):
    """What a chunk knows after the levels answered so far.

    The next level's (distinct hashes sorted, a row of one or two words each, whether each is repeated
    in the chunk), or, once all levels are answered, the first words of the repeated windows of full
    length. answers: a bit for each hash sent at a level. Hashes are mixed once more before they are
    sent: those named are least ones, which would crowd in the lowest ranges.
    """
    alive = words.whole(lengths[0])
    for k, length in enumerate(lengths):
        h, last = words.windows(length), k + 1 == len(lengths)
        sent = alive
        if not last:
            longer, span = words.whole(lengths[k + 1]), lengths[k + 1] - length + 1
            least = _sliding(h, span, np.minimum)
            padded = np.concatenate([np.zeros(span - 1, np.uint64), np.where(longer, least, np.uint64(0)), np.zeros(span - 1, np.uint64)])
            sent = alive & (_sliding(padded, span, np.maximum) == h) if len(least) else np.zeros(len(h), bool)
        places = np.flatnonzero(sent)
        spread = _mix(h[places] * _STEP[120])
        distinct, inverse, counts = _distinct(spread, words.windows(length, 1)[places] if last else spread[:0])
        if k == len(answers):
            return distinct, counts > 1
        kept = places[answers[k][inverse]]
        if last:
            return kept
        named = np.full(len(h), _MOST)
        named[kept] = h[kept]
        alive = longer & (_sliding(named, span, np.minimum) == least)
    return None


def _chunks(docs: DataFrame) -> DataFrame:
    """docs as rows of chunks: chunk number, a serialised record batch, its bytes of text."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch["text"].cast(pa.large_binary())), 0)))
            lo = 0
            while lo < len(batch):
                done = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, done + CHUNK_BYTES, "right")))
                part = batch.slice(lo, hi - lo)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                row = [[number], [sink.getvalue().to_pybytes()], [int(sizes[min(hi, len(sizes)) - 1] - done)]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.int64())], ["chunk", "batch", "bytes"])
                number, lo = number + 1, hi

    return docs.mapInArrow(tidy(gather), "chunk long, batch binary, bytes long")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The batches' rows one at a time: a row is a whole chunk, and a batch of them as objects would weigh too much."""
    for rows in batches:
        for i in range(len(rows)):
            yield rows.slice(i, 1).to_pylist()[0]


def _open(row: pa.Scalar) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(pa.py_buffer(row.as_py()))))


def _answers(row: dict, n_levels: int) -> list[np.ndarray]:
    """Bits of each level from their ranges."""
    out = []
    for k in range(n_levels):
        parts = sorted(row[f"answers{k}"] or [], key=lambda a: a["range"])
        bits = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]).astype(bool) for a in parts]
        out.append(np.concatenate(bits) if bits else np.zeros(0, bool))
    return out


def _count(chunks: DataFrame, lengths: list[int], done: int, shift: int) -> DataFrame:
    """Answers to the next level's hashes: chunk, answers (range, bits, n)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            distinct, several = survivors(Words(_open_text(row)), lengths, _answers(row, done))
            ranges = (distinct[:, 0] >> np.uint64(shift)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1], True]) if len(distinct) else np.zeros(1, int)
            pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ranges[cuts[:-1]], pa.int64()),
                    pa.array([row["chunk"]] * len(pairs), pa.int64()),
                    pa.array([distinct[a:b].tobytes() for a, b in pairs], pa.binary()),
                    pa.array([np.packbits(several[a:b]).tobytes() for a, b in pairs], pa.binary()),
                ],
                ["range", "chunk", "hashes", "several"],
            )

    wide = 2 if done + 1 == len(lengths) else 1

    def count(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64).reshape(-1, wide) for x in table["hashes"].to_pylist()]
        more = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(o)) for x, o in zip(table["several"].to_pylist(), own, strict=True)]
        every = np.concatenate(own)
        _, inverse, _ = _distinct(every[:, 0], every[:, 1] if wide == 2 else every[:0, 0])
        alive = np.bincount(inverse, weights=1.0 + np.concatenate(more))[inverse] > 1
        parts = np.split(alive, np.cumsum([len(o) for o in own])[:-1])
        return pa.table(
            {
                "range": table["range"],
                "chunk": table["chunk"],
                "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
                "n": pa.array([len(p) for p in parts], pa.int32()),
                "alive": pa.array([bool(p.any()) for p in parts], pa.bool_()),
            }
        )

    sent = chunks.mapInArrow(tidy(send), "range long, chunk long, hashes binary, several binary")
    counted = sent.groupBy("range").applyInArrow(count, "range long, chunk long, bits binary, n int, alive boolean")
    return counted.groupBy("chunk").agg(F.collect_list(F.struct("range", "bits", "n", "alive")).alias(f"answers{done}"))


def _open_text(row: dict) -> pa.Array:
    return _open(pa.scalar(row["batch"], pa.binary()))["text"]


def _rewritten(words: Words, repeated: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, removed words of each document, kept bytes of all, each document's bounds there)."""
    n, n_docs = len(words), len(words.bounds) - 1
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + window, -1)
    kept = np.cumsum(cover[:-1]) == 0
    doc = words.doc[kept]
    sizes = (words.end - words.begin)[kept]
    gaps = np.ones(len(sizes), np.int64)
    gaps[np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)] = 0
    ends = np.cumsum(sizes + gaps)
    begin, place = words.begin[kept], ends - sizes - gaps
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    # A block of bytes at a time: a number for each byte of a chunk would weigh many times its text.
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, place[lo] + BLOCK, "right")))
        n_bytes = sizes[lo:hi]
        within = np.arange(int(n_bytes.sum())) - np.repeat(np.cumsum(n_bytes) - n_bytes, n_bytes)
        out[np.repeat(place[lo:hi], n_bytes) + within] = words.data[np.repeat(begin[lo:hi], n_bytes) + within]
        lo = hi
    bounds = np.r_[0, np.cumsum(np.bincount(doc, weights=sizes + gaps, minlength=n_docs).astype(np.int64))]
    totals = np.bincount(words.doc, minlength=n_docs)
    return totals, totals - np.bincount(doc, minlength=n_docs), out, bounds


def _results(docs: DataFrame, window: int, make, schema) -> DataFrame:
    """make(record batch, words, removed, kept bytes, bounds) for all chunks of docs."""
    lengths = levels(window)
    chunks = written(_chunks(docs), "chunks")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    shift = 64 - max(2, int(np.ceil(np.log2(max(1, total) / RANGE_BYTES + 1))))
    answered, repeats = chunks.select("chunk", "batch"), True
    for k in range(len(lengths)):
        answers = written(_count(answered, lengths, k, shift), "answers")
        # Answers grow with the input: they are merged with the chunks at every size, never broadcast.
        answered = answered.join(answers.hint("merge"), "chunk", "left")
        repeats = not answers.where(F.exists(F.col(f"answers{k}"), lambda a: a["alive"])).isEmpty()
        if not repeats:  # no candidate survives
            break

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            batch = _open(pa.scalar(row["batch"], pa.binary()))
            words = Words(batch["text"])
            repeated = survivors(words, lengths, _answers(row, len(lengths))) if repeats else np.zeros(0, np.int64)
            yield make(batch, *_rewritten(words, repeated, window))

    return answered.mapInArrow(tidy(finish), schema)


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text).

    Each word in a window of ``window`` words whose sequence also starts anywhere else is removed;
    windows are judged on the texts as given, with 128-bit hashes of their words. Null and empty texts
    have no words. Repeated rows are repeats of each other. Texts are read whole, however long; null
    ids are kept. An empty table gives an empty result; other columns aren't read.
    """

    def make(batch, n_words, n_removed, out, bounds):
        data = out.tobytes()
        digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        columns = [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _results(rows, window, make, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, with the repeated windows' words removed from ``text``.

    A text that loses words is its kept words joined by a space; others stay as they are.
    """

    def make(batch, n_words, n_removed, out, bounds):
        data, old = out.tobytes(), batch["text"].to_pylist()
        pairs = zip(old, n_removed.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        text = pa.array([data[a:b].decode() if gone else t for t, gone, a, b in pairs], batch["text"].type)
        return batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), text)

    return _results(docs, window, make, docs.schema)


def op7_doubling_substrings(spark, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated windows of 35 words are removed."""
    return removal_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
