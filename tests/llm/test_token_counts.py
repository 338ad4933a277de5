import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausewright.llm import token_counts
from clausewright.llm.token_counts import count_tokens, op10_token_counts

TEXTS = [
    None, "", "a", " ", "\n\n  x  \n", "Don't we'll  stop?  ", "x" * 5000, "naïve Ñandú größe 123 456!!!",
    "tab\tand\x0bform\x0cfeed", "<|endoftext|> inside <|endoftext|>", "日本語 テキスト 🙂", "a b c \x1c d", "the the the", "the the the",
]


def test_counts_are_the_library_s(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    file = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs, file).collect()}
    assert got == {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)}


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    file = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, file).collect()}
    assert got == {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    file, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (None, "three")], "doc_id long, text string")
    assert count_tokens(first, file, cache).count() == 3
    assert spark.read.parquet(cache).count() == 2
    more = first.union(spark.createDataFrame([(4, "four")], "doc_id long, text string"))
    assert count_tokens(more, file, cache).count() == 4
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content_sha256").distinct().count() == 3


def test_stored_counts_are_used(spark, tmp_path):
    file, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    spark.sql("select unhex(sha2('x', 256)) content_sha256").select(
        "content_sha256", F.lit(token_counts.tokenizer_digest(file)).alias("tokenizer_sha256"), F.lit(77).cast("long").alias("n_tokens")
    ).write.parquet(cache)
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert count_tokens(docs, file, cache).first().n_tokens == 77


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers_and_empty_tables(spark, name):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert count_tokens(docs, public_tokenizers.path(name)).first().n_tokens >= 2
    assert count_tokens(docs.limit(0), public_tokenizers.path(name)).count() == 0


def test_query_is_the_library_s(spark):
    sf, tokenizer = "/root/testdata/sf0.001", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = op10_token_counts(spark, sf).collect()
    want = {r.doc_id: (len(r.text.encode()), len(tokenizer.encode(r.text, add_special_tokens=False).ids)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got) and {r.over_limit for r in got} == {True, False}


def test_counts_stored_twice_double_no_row(spark, tmp_path):
    file, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(5)], "doc_id long, text string")
    first = sorted(r.n_tokens for r in count_tokens(docs, file, cache).collect())
    stored = spark.createDataFrame(spark.read.parquet(cache).collect(), token_counts.CACHE_SCHEMA)
    stored.write.mode("append").parquet(cache)
    assert sorted(r.n_tokens for r in count_tokens(docs, file, cache).collect()) == first and len(first) == 5
