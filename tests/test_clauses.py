"""Opened clauses on a small corpus whose answers are stated, with lost parents, cycles, no texts, empty tables."""

import datetime

import pytest

from clausewright.operators import clauses as cl

D = datetime.date


@pytest.fixture(scope="module")
def corpus(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return cl.Corpus(
        make([("p", "policy"), ("l", "law"), ("empty", "law")], "slug string, kind string"),
        make([("p", "fr", "Politique"), ("p", "de", "Regel"), ("l", "en", "Law")], "slug string, lang string, title string"),
        make(
            [("p", 10, 1, "published", D(2020, 1, 1), "v1"), ("p", 11, 2, "published", D(2021, 1, 1), "v2"), ("p", 12, 3, "published", D(2022, 1, 1), "v3"), ("p", 13, 4, "draft", D(2022, 1, 1), "v4"), ("l", 20, 1, "published", D(2020, 1, 1), "2020"), ("l", 21, 2, "published", D(2020, 1, 1), "2020b")],
            "document string, version long, number int, status string, effective date, version_label string",
        ),
        make(
            [
                (1, 10, "p:1", None, 1, "article", "1", True, 1, None), (2, 10, "p:1.1", 1, 2, "item", None, True, 2, None), (3, 10, "p:1.2", 1, 1, "item", "(b)", True, 2, None), (4, 10, "p:2", None, 2, "article", "2", True, 1, None),
                (5, 11, "p:1", None, 1, "article", "1", True, 1, 1), (6, 11, "p:2", None, 2, "article", "2", True, 1, 2), (7, 12, "p:1", None, 1, "article", "1", True, 1, 5), (8, 12, "p:3", None, 3, "article", "3", True, 1, 6), (9, 12, "p:lost", 999, 1, "item", None, False, 2, None),
                (30, 21, "l:1", None, 1, "article", "1", True, 1, None), (31, 20, "l:1", None, 1, "article", "old", True, 1, None),
            ],
            "id long, version long, key string, parent long, place int, kind string, label string, is_normative boolean, depth int, previous_id long",
        ),
        make(
            [
                (100, 1, "en", True, "One", None, "a", None, None, False, None), (101, 2, "en", True, "Sub", "1.1", "b", None, None, False, None), (102, 3, "en", True, "Second", None, "c", None, None, False, None), (104, 4, "en", True, "Two", None, "d", None, None, False, None),
                (105, 5, "en", True, "One", None, "a", None, None, False, None), (106, 6, "en", True, "Sub", None, "b", None, None, False, None), (107, 7, "en", True, "One", None, "changed", None, None, False, None), (108, 8, "en", True, "Sub", None, "b", None, None, False, None), (109, 9, "fr", False, None, None, "x", None, None, False, None),
                (130, 30, "en", True, "E", None, "first", None, D(2021, 6, 1), False, None), (131, 30, "en", True, "E", None, "later", D(2021, 6, 1), D(2022, 6, 1), False, "Act 1"), (132, 30, "fr", False, "F", None, "texte", None, None, False, None), (133, 30, "fr", False, "F", None, "à venir", None, None, True, None), (134, 30, "fr", False, "F", None, "bientôt", D(2021, 9, 1), None, False, "Act 2"),
            ],
            "text_id long, node long, lang string, is_authoritative boolean, heading string, label string, body string, applies_from date, applies_until date, pending boolean, dated_by string",
        ),
        make([(1, "p:2", "clause 2"), (1, "l:1", "Article 1"), (1, "l:1", "Art. 1")], "node long, to_key string, raw_text string"),
    )


def ask(spark, corpus, *rows, **kw):
    frame = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "request int, key string, day date, lang string, version string")
    return {r.request: r for r in cl.clause_views(frame, corpus, "2022-05-01", **kw).collect()}


def test_views(spark, corpus):
    got = ask(
        spark, corpus, ("p:1", D(2020, 5, 1), None), ("p:1.1", D(2020, 5, 1), "fr"), ("p:2", D(2021, 5, 1), "en"), ("p:3", D(2022, 5, 1), "en"), ("p:2", D(2020, 5, 1), "en"),
        ("p:lost", D(2022, 5, 1), None), ("l:1", D(2021, 1, 1), "fr"), ("l:1", D(2023, 1, 1), "en"), ("no:1", D(2021, 1, 1), "en"), ("p:1", D(2019, 1, 1), "en"), ("l:9", D(2021, 1, 1), "en"), ("empty:1", D(2021, 1, 1), "en"), ("p:1", D(2020, 5, 1), None),
    )
    one = got[0]
    assert (one.clause.key, one.clause.label, one.clause.title, one.clause.version_label, one.problem) == ("p:1", "1", "Regel", "v1", None)
    assert [(c.key, c.label) for c in one.children] == [("p:1.2", "(b)"), ("p:1.1", "1.1")] and one.breadcrumb == []
    assert [tuple(r) for r in one.cross_references] == [("l:1", "Art. 1"), ("l:1", "Article 1"), ("p:2", "clause 2")]
    assert one.now.asDict() == {"key": "p:1", "version_label": "v3", "effective": D(2022, 1, 1), "moved": False, "changed": True} and one.formerly is None
    assert got[12].clause == one.clause and got[12].request == 12
    # 1.1 became 2, then 3: followed through the version between, words unchanged.
    assert [c.key for c in got[1].breadcrumb] == ["p:1"] and (got[1].now.key, got[1].now.moved, got[1].now.changed) == ("p:3", True, False)
    # 2 named another clause before; that one went nowhere.
    assert got[2].formerly.asDict() == {"version_label": "v1", "heading": "Two", "body": "d", "now": None} and got[2].now.key == "p:3"
    assert got[3].now is None and got[3].formerly is None
    assert (got[4].now.key, got[4].now.moved, got[4].now.changed) == (None, False, True)
    assert got[5].breadcrumb == [] and got[5].clause.body == "x" and got[5].clause.lang == "fr"
    # Of two versions of one day the higher number counts; laws aren't followed.
    law = got[6].clause
    assert (law.label, law.body, law.prevailing, law.coming.body, law.coming["from"], law.in_force_from) == ("1", "texte", "first", "bientôt", D(2021, 9, 1), D(2020, 1, 1)) and got[6].now is None
    assert (got[7].clause.body, got[7].clause.in_force, got[7].clause.dates_set_by) == ("later", False, "Act 1")
    assert [got[i].problem for i in (8, 9, 10, 11)] == ["no such document", "no version in force", "not in that version", "no version in force"]
    assert got[8].clause is None and got[8].children is None


def test_deep_trees_and_cycles_are_errors(spark, corpus):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(5)], "id long, parent long")
    starts = spark.createDataFrame([(4,), (2,), (4,)], "id long")
    assert sorted(tuple(r) for r in cl.ancestors(starts, nodes, 4).collect()) == [(2, 0, 2), (2, 1, 1), (4, 0, 4), (4, 1, 3), (4, 2, 2), (4, 3, 1)]
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        cl.ancestors(starts, nodes, 2).collect()
    ring = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long")
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        cl.ancestors(spark.createDataFrame([(1,)], "id long"), ring).collect()


def test_empty_tables(spark, corpus):
    assert ask(spark, corpus) == {}
    bare = cl.Corpus(*(getattr(corpus, f).limit(0) for f in ("documents", "names", "versions", "nodes", "texts", "references")))
    assert ask(spark, bare, ("p:1", D(2020, 1, 1), None))[0].problem == "no such document"
    unread = cl.Corpus(corpus.documents, corpus.names, corpus.versions, corpus.nodes, corpus.texts.limit(0), corpus.references)
    assert ask(spark, unread, ("p:1", D(2020, 5, 1), None))[0].problem == "no stored text"
