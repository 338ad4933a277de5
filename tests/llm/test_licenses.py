import random
import re

from clausewright.llm.licenses import TEMPLATES, Scanner, blocks, op9_conditional_licenses, scan_licenses

#: How the documents word their licenses.
LINES = {
    "MIT": r"Released under the MIT License\.",
    "Apache": r"Licensed under the Apache License, Version \d\.\d\.",
    "GPL": r"This work is licensed under the GNU General Public License, version \d\.",
    "CC-BY-NC": r"Licensed under CC BY-NC \d\.\d\.",
}


def test_query_finds_every_worded_license(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(r.doc_id, name) for r in docs for name, line in LINES.items() if re.search(line, r.text)}
    got = op9_conditional_licenses(spark, sf).collect()
    assert {(r.doc_id, r.license) for r in got} == want and len(want) > 10
    texts = {r.doc_id: r.text for r in docs}
    assert all(re.search(LINES[r.license], texts[r.doc_id][r.block_start : r.block_end]) for r in got)
    assert all(r.missing_words == 0 == r.extra_words and r.gain > 0 for r in got)


def test_templates_find_themselves_and_not_each_other():
    scanner = Scanner()
    for name, text in TEMPLATES.items():
        found = scanner.scan(f"Some prose before.\n\n\n\n{text}\n\n\n\nSome prose after, about nothing.")
        assert [f[2] for f in found] == [name], name


def test_wording_decides():
    scanner = Scanner()
    assert scanner.scan("Licensed under CC BY-SA 4.0.")[0][2:4] == ("CC-BY-SA", "4.0")
    assert scanner.scan("The license office is closed on Sundays, and permission slips are due.") == []
    changed = TEMPLATES["MIT-text"].replace("free of charge", "without any charge").replace("publish", "print")
    assert [f[2] for f in scanner.scan(changed)] == ["MIT-text"]
    assert scanner.scan(TEMPLATES["MIT-text"][: len(TEMPLATES["MIT-text"]) // 3]) == []
    two = scanner.scan("Released under the MIT License.\n" + "prose\n" * 9 + "Licensed under CC BY 4.0.")
    assert [f[2] for f in two] == ["MIT", "CC-BY"]
    assert blocks("no such thing " * 10) == []


def test_edge_rows(spark):
    long = "word " * 50_000 + "Released under the MIT License. " + "word " * 50_000
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, long), (4, "x"), (4, "Licensed under CC BY 4.0."), (4, "Licensed under CC BY 4.0.")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, gain double")
    got = sorted(((r.doc_id, r.license) for r in scan_licenses(docs).collect()), key=str)
    assert got == sorted([(None, "MIT"), (3, "MIT"), (4, "CC-BY"), (4, "CC-BY")], key=str)
    assert scan_licenses(docs.limit(0)).count() == 0


def test_notices_inside_prose_are_those_of_a_regex():
    scanner, rng = Scanner(), random.Random(7)
    prose = [
        "The committee met under the old roof and spoke of the work that is to be released by spring.",
        "Any person may use, copy and modify this list of conditions, and the general public may do so too.",
        "A license to fish is licensed out by the county under the terms of the permission it was granted.",
        "Copyright notices and the disclaimer appear in all copies of the documentation or other materials.",
        "By and by the software was distributed, with or without changes, to the public library.",
    ]
    short = {k: re.escape(t) for k, t in TEMPLATES.items() if len(t) < 130}
    short["CC-BY"] = r"Licensed under CC BY 4\.0\."
    for _ in range(150):
        names = rng.sample(sorted(short), rng.randint(0, 4))
        parts = rng.choices(prose, k=6) + [TEMPLATES[n] for n in names]
        rng.shuffle(parts)
        text = rng.choice([" ", "\n"]).join(parts)
        want = sorted((m.start(), m.end(), n) for n, line in short.items() for m in re.finditer(line, text))
        assert [f[:3] for f in scanner.scan(text)] == want, text
    for name, text in TEMPLATES.items():
        assert [f[2] for f in scanner.scan(" ".join([*prose, text, *prose]))] == [name]


def test_adjacent_and_dual_notices_are_all_found():
    scanner = Scanner()
    both = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    assert [(f[2], both[f[0] : f[1]]) for f in scanner.scan(both)] == list(zip(["MIT", "Apache"], both.split("\n"), strict=True))
    listed = "\n".join(TEMPLATES[n] for n in TEMPLATES)
    assert [f[2] for f in scanner.scan(listed)] == list(TEMPLATES)
    twice = TEMPLATES["MIT-text"] + " Copyright of others.\n" * 40 + TEMPLATES["MIT-text"]
    assert [f[2] for f in scanner.scan(twice)] == ["MIT-text"] * 2


def names(text):
    return [f[2] for f in Scanner().scan(text)]


def test_decisive_words_are_never_let_through():
    assert names("This work is licensed under the GNU Affero General Public License, version 3.") == ["AGPL"]
    assert "GPL" not in names("GNU Affero General Public License, version 3")
    assert names("Licensed under CC BY-NC-SA 4.0.") == ["CC-BY-NC-SA"] and names("CC BY-NC-ND 4.0") == ["CC-BY-NC-ND-name"]
    assert names("Licensed under CC BY-NC-ND 4.0.") == ["CC-BY-NC-ND"]
    assert names("This work is not licensed under the GNU General Public License, version 3.") == []
    assert names("It was never released under the MIT License.") == [] and names("Not Licensed under CC BY 4.0.") == []
    assert names("There are none, no.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.") == ["MIT", "Apache"]
    assert names(TEMPLATES["BSD-3-text"]) == ["BSD-3-text"] and names(TEMPLATES["BSD-2-text"]) == ["BSD-2-text"]


def test_few_edits_are_let_through_decisive_ones_are_not():
    from clausewright.llm import licenses

    scanner, rng = Scanner(), random.Random(11)
    for name, want in ((k, licenses.plain_words(t)) for k, t in TEMPLATES.items()):
        for _ in range(12):
            words, edits = list(want), rng.randint(0, int(licenses.LEEWAY * len(want)) // 2)
            for _ in range(edits):
                at = rng.choice([i for i in range(1, len(words) - 1) if words[i] not in licenses.DECISIVE])
                words[at : at + 1] = rng.choice([[], ["zebra"], [words[at], "quick"]])
            got = [f for f in scanner.places(["old", "prose", *words, "more", "prose"]) if f[0] == name]
            assert got and min(max(f[3:5]) for f in got) <= edits and all(f[7] > 0 for f in got), (name, words)
        middle = len(want) // 2
        assert not [f for f in scanner.places(["old", *want[:middle], "not", *want[middle:], "prose"]) if f[0] == name]


def test_names_are_found_with_their_versions():
    found = {
        "License: MIT": ("MIT-name", None),
        "It is distributed under the terms of the MIT license": ("MIT-name", None),
        "Licensed under Apache 2.0": ("Apache-name", "2.0"),
        "GNU Affero General Public License, version 3": ("AGPL-name", "3"),
        "The content is licensed under a Creative Commons Attribution 4.0 International License": ("CC-BY-name", "4.0"),
        "Licensed under CC-BY-SA-4.0": ("CC-BY-SA", "4.0"),
        "Licensed under GPLv3": ("GPL-name", "3"),
        "CC BY-NC-ND 4.0": ("CC-BY-NC-ND-name", "4.0"),
        "See the CC BY-SA licence": ("CC-BY-SA-name", None),
    }
    scanner = Scanner()
    for text, want in found.items():
        for whole in (text, f"Words before it. {text}. Words after it, many of them.", "old words " * 700 + text + " new words" * 700):
            assert [f[2:4] for f in scanner.scan(whole)] == [want], whole[:80]
    assert names("He read the license. MIT is a school far from here.") == []
    assert names("The Mozilla people publish a public list.") == []


def test_denials_reach_through_their_clause():
    for text in ("Neither this nor that is Released under the MIT License.", "We never said it was Released under the MIT License."):
        assert names(text) == []
    assert names("This is not a toy, and it is Released under the MIT License.") == ["MIT"]
    assert names("It is not new but Released under the MIT License.") == ["MIT"]
    assert names("never " + "word " * 30_000 + "Licensed under CC BY 4.0 " * 50) == []


def test_nothing_is_found_but_through_compression():
    class Blind(Scanner):
        def sizes(self, template, block):
            return (10, 10) if hasattr(self, "own") else super().sizes(template, block)

    assert all(Blind().scan(t) == [] for t in TEMPLATES.values())
    scanner = Scanner()
    assert all(alone > given for alone, given in scanner.own)


def test_the_largest_reduction_takes_its_words():
    for name, text in TEMPLATES.items():
        places = Scanner().places(Scanner().words[list(TEMPLATES).index(name)])
        assert places[0][0] == name and [p[5] - p[6] for p in places] == sorted((p[5] - p[6] for p in places), reverse=True)
