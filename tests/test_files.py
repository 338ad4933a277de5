"""Files that come back as they were, and files that say what is wrong with them."""

import datetime
import os

import pytest

from clausewright.session import scratch
from clausewright.sources import files, packs
from clausewright.sources.named_text import read_named, write_named

CLAUSES = "file string, key string, place int, depth int, label string, heading string, body string, lang string, normative boolean"


def test_clauses_come_back(spark):
    body = 'first: line\n---\n\n# no heading\n## {#x} nor this\n\\# kept\n\\\\## kept too\n"quoted" \\ back\ttab'
    rows = [
        ("f1", "law:art-1", 0, 1, "Article 1: it", 'Scope: "general" \\ more\nnext', body, "no", False), ("f1", "law:art-1:para-1", 1, 2, "1.", None, "#", "no", False), ("f1", "law:art-1:para-1:pt-a", 2, 3, None, None, "", "no", False), ("f1", "law:art-1:para-2", 3, 2, "(2) x", None, "y", "no", False),
        ("f2", "law:art-2", 0, 1, None, None, "", "on", True), ("f3", "law:art-3", 0, 1, "123", "null", "1.0", "en", True),
    ]
    path = scratch(spark, "clauses")
    files.write_clauses(spark.createDataFrame(rows, CLAUSES).repartition(3), path)
    files.write_clauses(spark.createDataFrame([], CLAUSES), path)
    got = files.read_clauses(spark, path).collect()
    assert sorted((r.file, r.key, r.place, r.depth, r.label, r.heading, r.body, r.lang, r.normative) for r in got) == sorted(rows) and all(r.problem is None for r in got)
    assert {r.key: r.parent for r in got}["law:art-1:para-1:pt-a"] == "law:art-1:para-1"
    local = path.removeprefix("file://")
    assert not [d for d in os.listdir(local) if d.startswith("_pending")] and len(os.listdir(local)) <= 4


BROKEN = {
    "no front matter": "# text", "front matter is no YAML": "---\nkey: a: b\n---\n", "front matter has no fields": "---\n- key\n---\n", "no key or language": "---\nkey: law:art-1\n---\nx",
    "a heading without a key": "---\nkey: law:art-1\nlang: en\n---\n##\tTabbed\n", "a level left out": "---\nkey: law:art-1\nlang: en\n---\n### 1 {#para-1}\n", "a key used twice": "---\nkey: law:art-1\nlang: en\n---\n## 1 {#para-1}\n## 2 {#para-1}\n",
}


@pytest.mark.parametrize("problem", BROKEN)
def test_broken_files_are_rows(problem):
    assert files.clause_rows("f", BROKEN[problem]) == [{"file": "f", "problem": problem}]


def test_a_broken_file_leaves_the_others(spark):
    path = scratch(spark, "clauses")
    texts = [(f"{i}.md", t) for i, t in enumerate(BROKEN.values())] + [("good.md", "---\nkey: law:art-1\nlang: no\nnormative: no\n---\n##\t1.\t{#para-1}\nbody"), ("other.txt", "not read"), ("empty.md", None)]
    write_named(spark.createDataFrame(texts, "file string, value string"), path)
    got = files.read_clauses(spark, path).collect()
    assert sorted(r.problem for r in got if r.problem) == sorted(BROKEN)  # a file of no bytes has no row
    assert [(r.key, r.label, r.body, r.lang, r.normative) for r in got if not r.problem] == [("law:art-1", None, "", "no", False), ("law:art-1:para-1", "1.", "body", "no", False)]


def test_a_failed_write_leaves_nothing(spark):
    path = scratch(spark, "named")
    with pytest.raises(Exception, match="no file's name"):
        write_named(spark.createDataFrame([("a.md", "x"), ("b/c.md", "y")], "file string, value string").repartition(2), path)
    assert not os.path.exists(path.removeprefix("file://")) or not os.listdir(path.removeprefix("file://"))
    write_named(spark.createDataFrame([("a.md", "é\n")], "file string, value string"), path)
    assert [tuple(r) for r in read_named(spark, path, "*.md").collect()] == [("a.md", "é\n")]


def test_question_files(spark):
    path = scratch(spark, "questions")
    texts = [("a.yaml", "questions:\n- {id: 1, question: q, lang: en, expected_keys: [law:1]}\n- {id: b, lang: en, expected_keys: k}\n"), ("b.yaml", "questions: [\n"), ("c.yaml", "- x"), ("d.yaml", "questions: [x]"), ("e.yaml", ""), ("f.yaml", "questions:\n- {id: 1, question: again, lang: en, expected_keys: [x]}\n")]
    write_named(spark.createDataFrame(texts, "file string, value string"), path)
    got = sorted(((r.id, r.question, r.problem) for r in files.read_questions(spark, path).collect()), key=str)
    want = [("1", "q", "id used twice"), ("1", "again", "id used twice"), ("b", None, "no question"), (None, None, "no YAML"), (None, None, "no list of questions"), (None, None, "no list of questions")]
    assert got == sorted(want, key=str)


GOOD = """format: 2
slug: law
name: {en: Law, fr: Loi}
short_name: {en: L, fr: L}
jurisdiction: {en: J, fr: J}
region: Europe
version: "2026.1"
effective_date: 2018-05-25
trust_tier: verified
source_url: https://example.org
license: free
authoritative_language: fr
documents:
- slug: law
  title: {en: Law, fr: Loi}
  expected_clauses: 3
  commencement:
  - {keys: [law:art-1], from: 2020-01-01, until: 2022-01-01, source: A}
  - {keys: [law:art-1:para-1, law:art-1], until: 2021-01-01, source: B}
  - {keys: [law:art-1], from: pending, source: C}
"""
WRONG = {
    "no format": ("format: 2\n", ""), "another format": ("format: 2", "format: 3"), "missing slug, region": ("slug: law\nname", "name"), "empty license": ("license: free", "license: ' '"), "trust_tier": ("verified", "trusted"), "region": ("Europe", "europe"), "effective_date": ("2018-05-25", "'2018-05-25'"),
    "not named in each language": ("name: {en: Law, fr: Loi}\nshort", "name: {en: Law, fr: ''}\nshort"), "named in different languages": ("short_name: {en: L, fr: L}", "short_name: {en: L, fr: L, de: L}"), "no document": (GOOD[GOOD.index("documents") :], "documents: []\n"), "document": ("  expected_clauses: 3\n", ""),
    "title": ("title: {en: Law, fr: Loi}", "title: {en: Law}"), "commencement without a date": ("from: pending, ", ""), "commencement date": ("from: pending", "from: soon"), "commencement without keys": ("keys: [law:art-1], from: pending", "keys: [], from: pending"), "commencement without a source": ("source: C", "source: ''"),
    "commencement ends before it starts": ("until: 2022-01-01", "until: 2020-01-01"), "translation": ("documents:", "translations: [{lang: en}]\ndocuments:"), "translation status": ("documents:", "translations: [{lang: en, status: x, license: y}]\ndocuments:"), "translation into its own language": ("documents:", "translations: [{lang: fr, status: official, license: y}]\ndocuments:"),
}


def test_pack_descriptions(spark):
    made = {p: GOOD.replace(*change).replace("region: Europe\n", "" if p.startswith("missing") else "region: Europe\n") for p, change in WRONG.items()}
    texts = [(f"{p}.pack.yaml", t) for p, t in made.items()] + [("good.pack.yaml", GOOD), ("no YAML.pack.yaml", "a: ["), ("no fields.pack.yaml", "- a"), ("no format2.pack.yaml", None)]
    got = {r.file: r for r in packs.pack_rows(spark.createDataFrame(texts, "file string, value string")).collect()}
    assert {f.removesuffix(".pack.yaml").rstrip("2"): r.problem for f, r in got.items() if f != "good.pack.yaml"} == {p: p for p in [*WRONG, "no YAML", "no fields"]}
    good = got["good.pack.yaml"]
    assert (good.problem, good.slug, good.name, good.version, good.effective_date, good.translations) == (None, "law", {"en": "Law", "fr": "Loi"}, "2026.1", datetime.date(2018, 5, 25), [])
    assert good.documents[0].expected_clauses == 3 and good.documents[0].normative and [c.pending for c in good.documents[0].commencement] == [False, False, True]
    assert all(r.slug is None and r.documents is None for f, r in got.items() if f != "good.pack.yaml")


def test_start_and_end_are_dated_apart(spark):
    found = packs.pack_rows(spark.createDataFrame([("p", GOOD)], "file string, value string"))
    keys = spark.createDataFrame([("law", "law", k) for k in ("law:art-1", "law:art-1:para-1:pt-a", "law:art-10", "law")], "pack string, document string, key string")
    day = datetime.date
    got = {r.key: (r.starts, r.pending, r.ends, r.sources) for r in packs.dated(keys, found).collect()}
    # Of entries of one length the first counts.
    assert got == {"law:art-1": (day(2020, 1, 1), False, day(2022, 1, 1), ["A"]), "law:art-1:para-1:pt-a": (day(2020, 1, 1), False, day(2021, 1, 1), ["A", "B"]), "law:art-10": (None, False, None, []), "law": (None, False, None, [])}
    assert packs.dated(keys.limit(0), found).count() == packs.pack_rows(spark.createDataFrame([], "file string, value string")).count() == 0


def test_packs_are_spread_and_read_once(spark):
    from clausewright.plans import file_queries as fq

    sf = "/root/testdata/sf0.001"
    assert fq.pack_files(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = fq.dated_apart(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "ArrowEvalPython" not in plan


def test_the_fast_loaders_read_as_the_plain_ones():
    import yaml

    texts = ["", "a: 1\nb: 'no'\nc: no\nd: 2018-05-25\n", GOOD, "oops: [\n", "- x\n", "a: {fr: Titre, en: 'T'}\nlist:\n  - {lang: en}\n", "at: 2018-05-25 10:00:00\nn: 1e3\nl: ~\n", "d: 2018-99-99"]

    def read(text, loader):
        try:
            return yaml.load(text, loader)
        except (yaml.YAMLError, ValueError):
            return "broken"

    assert packs._LOADER is not yaml.SafeLoader and files._BASE is not yaml.BaseLoader  # PyYAML with libyaml
    for text in texts:
        assert read(text, packs._LOADER) == read(text, yaml.SafeLoader) and read(text, files._BASE) == read(text, yaml.BaseLoader)


def test_named_files_are_read_a_folder_a_task(spark, tmp_path):
    from clausewright.sources.named_text import read_named

    inside = {"a.md": "x\r\ny\n", "b/c.md": "é ", "b/d/e.md": "deep", "b/empty.md": "", "b/other.txt": "no", "_hidden/f.md": "no", "b/.g.md": "no", "z.md": "z"}
    for name, text in inside.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    plain = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(str(tmp_path), wholetext=True).selectExpr("_metadata.file_name as file", "value")
    got = read_named(spark, str(tmp_path), "*.md")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 4
    assert sorted(map(tuple, read_named(spark, f"file://{tmp_path}", "*.md").collect())) == sorted(map(tuple, got.collect()))
    (tmp_path / "many").mkdir()
    for i in range(200):
        (tmp_path / "many" / f"{i}.yaml").write_text(str(i))
    assert read_named(spark, str(tmp_path / "many"), "*.yaml").count() == 200
    assert read_named(spark, str(tmp_path), "*.yaml").rdd.getNumPartitions() == 2  # seven for Spark's reader: 32 files a task


def test_plain_lines_meet_no_pattern(monkeypatch):
    """Only lines that begin with # or a backslash are matched, and every line reads as before."""
    import re

    seen = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def match(self, line):
            seen.append(line)
            return self.pattern.match(line)

    monkeypatch.setattr(files, "_OPENS", Counted(files._OPENS))
    text = "---\nkey: law:art-1\nlang: en\n---\nplain\n\n # spaced\n\\# escaped\n\\\\# twice\n\\plain\n## 1. {#para-1}\nbelow"
    rows = files.clause_rows("f", text)
    assert [r["body"] for r in rows] == ["plain\n\n # spaced\n# escaped\n\\# twice\n\\plain", "below"]
    assert seen == ["\\# escaped", "\\\\# twice", "\\plain", "## 1. {#para-1}"] and rows[1]["key"] == "law:art-1:para-1"
    assert files.clause_rows("f", text + "\n# unkeyed")[0]["problem"] == "a heading without a key" and isinstance(files._HEADING, re.Pattern)
