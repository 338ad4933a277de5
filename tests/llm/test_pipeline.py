import corpus_pipeline
from clausewright.llm import simhash, toxicity
from tests.llm.test_decontamination import split
from tests.llm.test_shingles import plain_groups, plain_shingles
from tests.llm.test_substrings import plain


def test_stages_are_brute_force_on_their_inputs(spark):
    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages["toxicity"](spark, docs, sf).cache()
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5}

    one = stages["near_dedup"](spark, kept, sf).cache()
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    roots = plain_groups([plain_shingles(r.text.lower()) for r in rows])
    assert sorted(r.doc_id for r in one.collect()) == sorted({rows[i].doc_id for i in roots})

    cut = stages["substring_dedup"](spark, one, sf).cache()
    before = one.collect()
    want = {r.doc_id: (w[3] if w[1] else r.text) for r, w in zip(before, plain([r.text for r in before], 35), strict=True)}
    assert {r.doc_id: r.text for r in cut.collect()} == want and all(r.n_chars == len(r.text) for r in cut.collect())

    clean = stages["decontamination"](spark, cut, sf).cache()
    phrases = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r.text)
        phrases |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    leaks = {i for i, t in want.items() if any(tuple(split(t)[k : k + 10]) in phrases for k in range(len(split(t)) - 9))}
    assert {r.doc_id for r in clean.collect()} == set(want) - leaks and clean.columns == docs.columns

    packed = stages["packing"](spark, clean, sf).collect()
    assert {r.doc_id for r in packed} == set(want) - leaks


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.offset + r.length <= 4096 for r in rows)
    assert simhash.WORDS == 4


def test_edge_rows(spark, tmp_path):
    """Null ids and texts, repeats, a very long text, columns of clashing names, an empty table."""
    foul = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [(None, None), (1, ""), (2, "one short text"), (2, "one short text"), (3, "word " * 30_000), (None, "no id but words of its own here")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, 1, "x", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node int, row string, size int")
    for given in (docs, docs.limit(0), docs.select(*foul.columns)):
        out = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == given.columns
        packed = corpus_pipeline.packing(spark, out, str(tmp_path)).collect()
        kept = {r.doc_id for r in out.collect()}
        assert {r.doc_id for r in packed} == kept and (kept == {1, 2, 3, None} or not given.take(1))
