"""The stored index against plain BM25, in loads, with blocks left unread; hybrid search on its edges."""

import random

import pytest
from pyspark.sql import functions as F

from clausewright.operators import hybrid
from clausewright.operators import retrieval as rt
from clausewright.operators import search_index as si
from clausewright.session import scratch


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    some = lambda: " ".join(draw.choices(words, weights, k=draw.randrange(3, 40)))
    made = [(i, draw.choice("ab"), draw.choice(["en", "fr"]), None if i % 5 else some(), some(), 1) for i in range(1200)]
    made += [(2000, "a", "en", "only a heading", "  ", 1), (2001, "a", "en", None, None, 1), (2002, "a", "en", None, "!?", 1), (2003, None, "en", None, "w1 w150", 1), (2004, "a", "fr", None, "Élève déjà", 1), (2005, "a", "en", None, "w7 " * 30_000, 1)]
    return spark.createDataFrame(made, "text_id long, source string, lang string, heading string, body string, term int")


def plain(texts, questions, limit):
    """Best of each source by rt.keyword_search, with statistics per language."""
    body = F.concat_ws(" ", "heading", F.when(F.col("lang") == "fr", F.translate(F.lower("body"), si._ACCENTS, si._PLAIN)).otherwise(F.col("body")))
    clauses = texts.where("length(trim(body)) > 0").select(F.col("text_id").alias("key"), "lang", body.alias("body"), F.coalesce("source", F.lit("")).alias("source"))
    found = rt.keyword_search(questions, clauses, 1 << 30, by_index=True).join(clauses.select("key", "source"), "key")
    return rt.ranked(found.select("qid", "source", "key", "score"), limit, "source").where("rank <= %d" % limit)


@pytest.mark.parametrize("limit", [1, 10_000])
def test_search_is_plain_bm25(spark, texts, monkeypatch, limit):
    monkeypatch.setattr(si, "BLOCK_TEXTS", 8)
    monkeypatch.setattr(si, "RUN_TEXTS", 300)
    index = si.Index(spark, scratch(spark, "index"))
    index.add(texts.where("text_id % 3 = 0"))
    index.add(texts.where("text_id % 3 <> 2"))
    index.add(texts.limit(0))
    index.add(texts)
    asked = [(1, "en", "w150 w1"), (2, "fr", "w90 w120 w3"), (3, "en", "unheard"), (4, "en", None), (5, "fr", "eleve"), (6, "en", "W7, w199!"), (7, "xx", "w1")]
    questions = spark.createDataFrame(asked, "qid long, lang string, text string")
    found, report = index.search(questions, limit, texts)
    want = rows(plain(texts, questions, limit), "qid", "source", "key", "score")
    assert rows(found, "qid", "source", "text_id", "score") == want and any(q == 5 for q, *_ in want) and any(s == "" for _, s, *_ in want)
    told = report.first()
    assert told.blocks > 20 and told.texts == 1204 and told.texts_scored <= told.texts
    assert told.blocks_read < 0.8 * told.blocks and told.texts_scored < 0.8 * told.texts if limit == 1 else told.blocks_read <= told.blocks
    monkeypatch.setattr(si, "QUESTION_TERMS", 3)
    assert rows(index.search(questions, limit, texts)[0], "qid", "source", "text_id", "score") == want
    # Frequencies are those of all texts where only some may be found.
    few, _ = index.search(questions, limit, texts.where("text_id % 2 = 0"))
    everything = rows(plain(texts, questions, 10_000).where("key % 2 = 0"), "qid", "source", "key", "score")
    assert set(rows(few, "qid", "source", "text_id", "score")) <= set(everything) and (limit < 10_000 or rows(few, "qid", "source", "text_id", "score") == everything)


def test_texts_become_lists_where_they_are_read(spark, texts, monkeypatch):
    """No text goes through a shuffle to be indexed; each list holds its texts' terms, at most RUN_TEXTS texts a run."""
    monkeypatch.setattr(si, "RUN_TEXTS", 100)
    index, asked = si.Index(spark, scratch(spark, "index")), []
    real = si._inverted
    monkeypatch.setattr(si, "_inverted", lambda *a: asked.append(a) or real(*a))
    index.add(texts.repartition(3))
    assert [a[1:] for a in asked] == [(si.BLOCK_TEXTS, 100)]
    told = {(t, r.text_id) for r in index.postings().collect() for t in r.terms}
    held = [(r.term, i) for r in index.blocks().collect() for i in r.text_ids]
    assert len(held) == len(told) and set(held) == told
    runs = {r.run: r.n for r in index.blocks().select("run", F.explode("text_ids").alias("i")).groupBy("run").agg(F.count_distinct("i").alias("n")).collect()}
    assert max(runs.values()) <= 100 and sum(runs.values()) == index.postings().where("size(terms) > 0").count() and "run" not in index.postings().columns
    assert {r.tf for r in index.postings().where("text_id = 2003").selectExpr("explode(tfs) AS tf").collect()} == {1}


def test_meaning_by_source(spark):
    vectors = [(s, k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60) for s in ("a", None)] + [("a", 100, None), ("a", 101, [0.0, 0.0, 0.0]), ("a", 102, [1.0])]
    asked = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 1.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [2.0])]
    frame, questions = spark.createDataFrame(vectors, "source string, key long, vector array<double>").repartition(5), spark.createDataFrame(asked, "qid long, vector array<double>")
    want = []
    for q, u in asked:
        for s in ("a", None):
            cos = lambda u, v: round(sum(x * y for x, y in zip(u, v, strict=True)) / (sum(x * x for x in u) ** 0.5 * sum(x * x for x in v) ** 0.5), 6)
            near = [(-cos(u, v), k) for t, k, v in vectors if u and any(u) and t == s and v and any(v) and len(v) == len(u)]
            want += [(q, s, k, -c) for c, k in sorted(near)[:4]]
    for block in (4096, 1):
        assert rows(hybrid.meaning_by_source(questions, frame, 4, block), "qid", "source", "key", "score") == sorted(want, key=str)
    assert hybrid.meaning_by_source(questions, frame.limit(0), 4).count() == hybrid.meaning_by_source(questions.limit(0), frame, 4).count() == 0


def test_hybrid_search(spark):
    texts = spark.createDataFrame(
        [
            (1, "x:1", "en", "x", "law", 1, True, False, None, "the cat sat", "x", None), (2, "x:2", "en", "x", "law", 1, False, False, None, "a dog", "x", None), (3, "p:1", "en", "p", "policy", 1, True, False, None, "cat rules", "p", None),
            (4, "q:1", "en", "q", "policy", 1, True, False, None, "cat and dog", "q", None), (5, "x:3", "en", "x", "law", 1, True, True, None, "cat pending", "x", None), (6, "x:4", "ar", "x", "law", 1, True, False, None, "القط في البيت", "x", None),
        ],
        "text_id long, key string, lang string, pack string, kind string, version int, is_normative boolean, pending boolean, applies_until date, body string, source string, heading string",
    )
    versions = spark.createDataFrame([(d, 1, 1, "published", "2020-01-01") for d in ("x", "p", "q")], "document string, version int, number int, status string, effective string").withColumn("effective", F.to_date("effective"))
    nodes = spark.createDataFrame([("x", None, 0), ("x:1", "x", 1), ("x:2", "x", 2), ("x:4", "x", 0), ("p:1", None, 1)], "key string, parent string, place int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "text_id long, vector array<double>")
    asked = spark.createDataFrame([("x:2", [1.0, 0.0]), ("p:1", [1.0, 0.0])], "key string, vector array<double>")
    questions = spark.createDataFrame([(1, "cat", None, [1.0, 0.0]), (2, "قط", None, None), (3, "nothing here", "en", None)], "qid long, text string, lang string, vector array<double>")
    index = si.Index(spark, scratch(spark, "index"))
    index.add(texts)

    def ask(**kw):
        found, _ = hybrid.hybrid_search(questions, index, vectors, texts, versions, nodes, kw.pop("day", "2021-01-01"), today="2021-01-01", **kw)
        return {(r.qid, r.slot): r for r in found.collect()}

    plain = ask(expand="siblings")
    # The law's best match is closest, so it begins; policies are one source; what is pending isn't found.
    assert [(k, r.key, r.source) for k, r in sorted(plain.items())] == [((1, 1), "x:1", "x"), ((1, 2), "p:1", None), ((1, 3), "x:2", "x"), ((1, 4), "q:1", None), ((2, 1), "x:4", "x")]
    assert plain[1, 1].around == ["x:4", "x:2"] and plain[1, 2].around == [] and plain[1, 1].ranks.asDict() == {"keyword_rank": 1, "meaning_rank": 1, "questions_rank": None}
    assert [r.around for _, r in sorted(ask(expand="parent").items())][:2] == [["x"], []]
    lifted = ask(asked=asked)
    assert lifted[1, 3].ranks.questions_rank == 1 and lifted[1, 2].ranks.questions_rank is None
    other_day = ask(asked=asked, day="2021-01-02")
    assert all(r.ranks.questions_rank is None for r in other_day.values())
    assert {r.key for r in ask(packs=[], policies=True).values()} == {"p:1", "q:1"} and {r.key for r in ask(packs=["x"], policies=False, normative_only=True).values()} == {"x:1", "x:4"}
    assert [r.key for _, r in sorted(ask(limit=1).items())] == ["x:1", "x:4"]
    with pytest.raises(ValueError, match="expand"):
        ask(expand="cousins")
