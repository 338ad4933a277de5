import hashlib
import re
from collections import Counter

import pytest

from clausewright.llm import substrings
from clausewright.llm.substrings import levels, op7_doubling_substrings, removal_digests, without_repeats


def plain(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_levels_double():
    assert levels(35) == [9, 18, 35] and levels(5) == [5] and levels(100) == [7, 13, 25, 50, 100]


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: w[:3] for r, w in zip(rows, plain([r.text for r in rows], 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op7_doubling_substrings(spark, sf).collect()}
    assert got == want and any(w[1] for w in want.values())


@pytest.mark.parametrize("window", [1, 3, 20, 40])
def test_other_lengths_and_small_chunks(spark, window, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(substrings, "BLOCK", 500)
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removal_digests(docs, window).collect()}
    assert got == {r.doc_id: w[:3] for r, w in zip(rows, plain([r.text for r in rows], window), strict=True)}


def test_edge_rows(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [
        None, "", " \n\t ", "one", " ".join(base), "x " + "  ".join(base), "pre " + "\n".join(base) + " post", " ".join(base[:34]),
        "again " * 36, "again " * 35, "long " + " ".join(f"v{i % 9973}" for i in range(50_000)), "é\x85ü \x1c " * 30,
    ]
    ids = [None, 1, 1, *range(3, 3 + len(texts) - 3)]
    docs = spark.createDataFrame([(i, t, "kept", 3) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, chunk string, n_words int")
    want = plain(texts, 35)
    got = removal_digests(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter((i, *w[:3]) for i, w in zip(ids, want, strict=True))
    whole = without_repeats(docs)
    assert whole.columns == docs.columns
    expected = Counter((i, t if not w[1] else w[3], "kept", 3) for i, t, w in zip(ids, texts, want, strict=True))
    assert Counter((r.doc_id, r.text, r.chunk, r.n_words) for r in whole.collect()) == expected
    assert removal_digests(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, " ".join(base))] * 2, "doc_id long, text string")
    assert [r.n_removed for r in removal_digests(same).collect()] == [40, 40]


def test_levels_end_where_no_candidate_survives(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in removal_digests(docs).collect()} == {(i, *w[:3]) for i, w in enumerate(plain(texts, 35))}


def test_sent_hashes_fill_all_ranges_and_two_hashes_tell_apart():
    import numpy as np
    import pyarrow as pa

    words = substrings.Words(pa.array([" ".join(f"v{i * 7919 % 10007}" for i in range(20_000))], pa.string()))
    sent, _ = substrings.survivors(words, levels(35), [])
    shares = np.bincount((sent[:, 0] >> np.uint64(60)).astype(int), minlength=16) / len(sent)
    assert shares.max() < 0.09 and shares.min() > 0.04
    rows, inverse, counts = substrings._distinct(np.array([5, 5, 5, 2], np.uint64), np.array([1, 2, 1, 1], np.uint64))
    assert rows.tolist() == [[2, 1], [5, 1], [5, 2]] and inverse.tolist() == [1, 2, 1, 0] and counts.tolist() == [1, 2, 1]


def test_rewriting_a_chunk_takes_few_times_its_text():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from clausewright.llm import substrings

    texts = [" ".join(f"word{i * j % 977}" for j in range(4000)) for i in range(1, 130)]
    words = substrings.Words(pa.array(texts + ["", None, "  a \t b "]))
    repeated = np.array([0, 3, 4000], np.int64)
    tracemalloc.start()
    n_words, n_removed, out, bounds = substrings._rewritten(words, repeated, 35)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    parts = [out[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    split = [t.split() for t in texts]
    assert parts == [" ".join(split[0][38:]), " ".join(split[1][35:]), *texts[2:], "", "", "a b"]
    assert n_removed.tolist() == [38, 35] + [0] * 130 and n_words[0] == 4000
    assert peak < 20 * len(words.data), peak / len(words.data)
