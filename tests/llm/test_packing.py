import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausewright.llm.packing import best_fit, op8_best_fit_packing, pack

FILE = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(1, 40), max_size=120), st.just(40))
@settings(max_examples=150, deadline=None)
def test_best_fit_is_brute_force_best_fit(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    bins, want = [], []
    for n in lengths:
        fits = [b for b in bins if b >= n]
        if not fits:
            bins.append(capacity)
            fits = [capacity]
        tight = min(fits)
        bins[bins.index(tight)] -= n
        want.append(tight)
    got = best_fit(lengths, capacity)
    assert [capacity - at for _, at in got] == want
    assert len({b for b, _ in got}) == len(bins)


def whole(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_round_trip_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokenizer = Tokenizer.from_file(FILE)
    want = {}
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [1], dtype="<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[r.doc_id, n] = (at, len(own), zlib.crc32(own.tobytes()))
    got = pack(docs, FILE).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    total = sum(x[1] for x in want.values())
    assert whole(got, 4096) <= -(-total // 4096) + 1


def test_edge_rows(spark):
    texts = [(1, None), (1, None), (None, ""), (2, "İstanbul ΟΔΟΣ 日本 <|endoftext|>"), (3, "It's   FINE!!'s 12 x"), (4, "word " * 9000)]
    docs = spark.createDataFrame([(*x, 5) for x in texts], "doc_id long, text string, length int")
    got = pack(docs, FILE, group_pieces=3).collect()
    assert len(got) == 5 + 3
    whole(got, 4096)
    tokenizer = Tokenizer.from_file(FILE)
    for i in (2, 3):
        ids = tokenizer.encode(texts[i + 1][1], add_special_tokens=False).ids + [1]
        assert [(r.length, r.ids_crc32) for r in got if r.doc_id == i] == [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]
    assert pack(docs.limit(0), FILE).count() == 0


def test_query_has_every_piece_once(spark):
    sf, tokenizer = "/root/testdata/sf0.001", Tokenizer.from_file(FILE)
    rows = op8_best_fit_packing(spark, sf)
    kinds = dict(rows.dtypes)
    assert [kinds[c] for c in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")] == ["int", "bigint", "bigint", "bigint", "bigint", "bigint"]
    got, want = rows.collect(), []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        want += [(r.doc_id, k, at, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == sorted(want)
    whole(got, 4096)
