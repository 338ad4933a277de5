"""Token counts with a digest cache.

Content and tokenizer are known by digests. Counts already stored for a pair of digests are
joined; only distinct contents without a stored count are encoded, once each, and appended.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.shared import shared_path

CACHE_SCHEMA = "content_sha256 binary, tokenizer_sha256 string, n_tokens bigint"
#: Distinct pieces of text whose counts a Python worker keeps at once.
MEMO_ENTRIES = 400_000
#: Texts of these characters only are split here, by the tokenizer's own pattern, into the pieces
#: that it merges separately; any other text goes to the library whole.
PLAIN_TEXT = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
#: The splitting pattern of byte-level BPE.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_COUNTERS: dict = {}


class _PieceCounts(dict):
    """Token counts by piece of text, encoded by the library when first met."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        n = self[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n


def _counter(tokenizer_file: str):
    """A function text -> number of tokens, exactly as the library's encode gives them."""
    if tokenizer_file in _COUNTERS:
        return _COUNTERS[tokenizer_file]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer_file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file)
        count = lambda text: len(model.encode(text))
    else:
        import json

        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as file:
            parts = json.load(file)
        whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        before = parts["pre_tokenizer"] or {}
        byte_level = parts["normalizer"] is None and before.get("type") == "ByteLevel"
        if byte_level and before["use_regex"] and not before["add_prefix_space"]:
            pieces, memo = regex.compile(BYTE_LEVEL_PATTERN).findall, _PieceCounts(tokenizer)
            special = re.compile("|".join(re.escape(x["content"]) for x in parts["added_tokens"]) or r"(?!)")

            def count(text: str) -> int:
                if PLAIN_TEXT.search(text) or special.search(text):
                    return whole(text)
                return sum(map(memo.__getitem__, pieces(text)))

        else:
            count = whole
    _COUNTERS[tokenizer_file] = count
    return count


def tokenizer_digest(tokenizer_file: str) -> str:
    """The tokenizer's version: SHA-256 of its file."""
    with open(tokenizer_file, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _encode(tokenizer_file: str, digest: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(tokenizer_file)
        for rows in batches:
            yield pd.DataFrame(
                {
                    "content_sha256": rows["content_sha256"],
                    "tokenizer_sha256": digest,
                    "n_tokens": [count(x) for x in rows["content"]],
                }
            )

    return encode


def count_tokens(
    docs: DataFrame,
    tokenizer_file: str,
    cache_path: str | None = None,
    *,
    text: str = "text",
    columns: list[str] | None = None,
) -> DataFrame:
    """``columns`` of docs with ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text.

    cache_path: a Parquet table of stored counts (CACHE_SCHEMA); it is made where it is missing,
    and counts that were missing are appended to it. None: a new table in the shared folder. Runs that
    share a cache at the same time may store a count twice, which changes no result.

    Content is normalised to what the tokenizer sees: null becomes the empty text (0 tokens), else
    nothing is changed, as every byte counts. Equal texts share one digest, are encoded once and
    each keep their own row, as do repeated rows. An empty table gives an empty result. Columns
    besides ``columns`` and ``text`` aren't read, so clashing names in them do no harm.
    """
    spark = docs.sparkSession
    path = cache_path or shared_path(spark, "token-counts")
    digest = tokenizer_digest(tokenizer_file)
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.struct(*(columns or ["doc_id"])).alias("row"),
        F.octet_length(content).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(content, 256)).alias("content_sha256"),
        content.alias("content"),
    )
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    stored = lambda: (
        spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer_sha256") == digest).select("content_sha256", "n_tokens")
    )
    # Runs side by side may append the same count twice: one row a digest is joined.
    known = lambda: stored().groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))
    misses = keyed.select("content_sha256", "content")
    if not stored().isEmpty():
        misses = misses.join(stored(), "content_sha256", "left_anti")
    (
        misses.dropDuplicates(["content_sha256"])
        .mapInPandas(_encode(tokenizer_file, digest), CACHE_SCHEMA)
        .write.mode("append")
        .parquet(path)
    )
    counted = keyed.drop("content").join(known(), "content_sha256")
    return counted.select("row.*", "n_bytes", "n_tokens")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k, and whether they are over 512."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
