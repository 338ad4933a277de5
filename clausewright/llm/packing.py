"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

A segment tree over remaining capacities finds the tightest open bin in logarithmic time. Pieces are
dealt at random to groups of bounded size; each group is packed by itself and leaves about one bin
that isn't full.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import tidy, written

CAPACITY = 4096
#: Pieces packed together; a task holds a group of them.
GROUP_PIECES = 32_768
#: The id that ends every document.
END_ID = 1
#: Distinct words whose ids a Python worker keeps at once.
MEMO_ENTRIES = 400_000
#: Texts of these characters only are split here; others go to the library whole.
PLAIN_TEXT = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
#: The splitting pattern and the word end of the word-end BPE.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: The same pattern as it acts on lower-case PLAIN_TEXT.
PLAIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

_ENCODERS: dict = {}


def _as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class _WordIds:
    """Ids of whole texts by way of their words; the library encodes each distinct word once.

    The vocabulary marks word ends, so that words are encoded together and their ids told apart.
    """

    def __init__(self, tokenizer, split, whole):
        self.tokenizer, self.split, self.whole, self.memo = tokenizer, split, whole, {}
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(WORD_END)

    def learn(self, words: list[str]) -> None:
        """Put the ids of words, all new, into the memo."""
        if len(self.memo) + len(words) > MEMO_ENTRIES:
            self.memo.clear()
        parts = [words[i : i + 500] for i in range(0, len(words), 500)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                data = ids.tobytes()
                self.memo.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
            else:
                self.memo.update((w, self.whole(w)) for w in part)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        words = [self.split(t) for t in texts]
        used = set().union(*words)
        new = used - self.memo.keys()
        if new:
            self.learn(list(new))
            if not used <= self.memo.keys():
                self.learn(list(used - self.memo.keys()))
        return [b"".join(map(self.memo.__getitem__, w)) for w in words]


def _encoder(tokenizer_file: str):
    """A function texts -> ids of each as bytes, exactly as the library's encode gives them."""
    if tokenizer_file not in _ENCODERS:
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(tokenizer_file)
        whole = lambda text: _as_bytes(tokenizer.encode(text, add_special_tokens=False).ids)
        with open(tokenizer_file, encoding="utf-8") as file:
            parts = json.load(file)
        encode = lambda texts: [whole(t) for t in texts]
        if WORD_END_PATTERN in str(parts["pre_tokenizer"]).replace("\\\\", "\\") and parts["model"]["end_of_word_suffix"] == WORD_END:
            split, special = re.compile(PLAIN_WORDS).findall, re.compile("|".join(re.escape(x["content"]) for x in parts["added_tokens"]) or r"(?!)")
            by_word = _WordIds(tokenizer, lambda text: split(text.lower()), whole)

            def encode(texts: list[str]) -> list[bytes]:
                odd = {i for i, t in enumerate(texts) if PLAIN_TEXT.search(t) or special.search(t)}
                plain = iter(by_word.encode([t for i, t in enumerate(texts) if i not in odd]))
                return [whole(t) if i in odd else next(plain) for i, t in enumerate(texts)]

        _ENCODERS[tokenizer_file] = encode
    return _ENCODERS[tokenizer_file]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document (doc_id, text) as ids and END_ID; those over capacity cut into pieces of it.

    A null text is an empty one and gives one piece of END_ID alone.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = _encoder(tokenizer_file), END_ID.to_bytes(4, "little")
        for rows in batches:
            out = []
            texts = [t or "" for t in rows["text"]]
            found = (ids for lo in range(0, len(texts), 256) for ids in encode(texts[lo : lo + 256]))
            for doc_id, ids in zip(rows["doc_id"], found, strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out.append((doc_id, n, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(tidy(cut), PIECE_SCHEMA)


class OpenBins:
    """Open bins by remaining capacity, below a segment tree that knows which capacities occur."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, remaining: int, number: int) -> None:
        """Put a bin in."""
        own = self.bins.setdefault(remaining, [])
        own.append(number)
        if len(own) == 1:
            at = self.size + remaining
            while at and not self.tree[at]:
                self.tree[at] = True
                at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Take out the bin with the least capacity of at least length: (capacity, number)."""
        at = self.size + length
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at + (not self.tree[2 * at])
        remaining = at - self.size
        own = self.bins[remaining]
        number = own.pop()
        if not own:
            self.tree[at] = False
            at >>= 1
            while at:
                self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]
                at >>= 1
        return remaining, number


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, for lengths that don't rise; each goes to the tightest open bin."""
    open_bins, out, n = OpenBins(capacity), [], 0
    for length in lengths:
        found = open_bins.take(length)
        if found is None:
            found, n = (capacity, n), n + 1
        remaining, number = found
        out.append((number, capacity - remaining))
        if remaining > length:
            open_bins.add(remaining - length, number)
    return out


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their sequence_id and offset there.

    Each row of docs is packed by itself, so repeated rows and null ids are too; other columns
    aren't read; an empty table gives an empty result. Texts of any length are whole: those over
    capacity are cut into pieces, no other is. Pieces are dealt to groups by their place in the
    written table of pieces, so no value of a column can make a group large.
    """
    cut = written(pieces(docs, tokenizer_file, capacity), "pieces")
    n_groups = max(1, -(-cut.count() // group_pieces))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        found = best_fit(rows["length"].tolist(), capacity)
        rows["sequence_id"] = [(int(g) << 32) + b for g, (b, _) in zip(rows["group"], found, strict=True)]
        rows["offset"] = [at for _, at in found]
        return rows.drop(columns="group").astype({"doc_id": "Int64"})

    grouped = cut.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))
    return grouped.groupBy("group").applyInPandas(fill, f"{PIECE_SCHEMA}, sequence_id long, offset long")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens of word_bpe_49k."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
