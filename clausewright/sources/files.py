"""Files of the corpus: clause files in Markdown, question files, results and governance exports, read and written by Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clausewright.functions.redaction import natural_key
from clausewright.sources.named_text import read_named, write_named

CLAUSES = "file string, key string, parent string, place int, depth int, label string, heading string, body string, lang string, normative boolean, problem string"
# The format of a clause file's front matter, headings and keys.
_FRONT = re.compile(r"\A---\n(.*?)\n---\n?(.*)\Z", re.DOTALL)
_OPENS = re.compile(r"^(#{2,6})[ \t]+(.*?)[ \t]*\{#([a-z0-9][a-z0-9-]*)\}[ \t]*$")
_HEADING = re.compile(r"^#{1,6}[ \t]")
_KEY = re.compile(r"^[a-z0-9][a-z0-9-]*(?::[a-z0-9][a-z0-9-]*)+$")
_ESCAPED = re.compile(r"^\\(?=\\*#)")
_NO = ("false", "no", "off", "n")
# libyaml reads the same texts as the plain loaders, some ten times as fast.
_BASE, _SAFE = getattr(yaml, "CBaseLoader", yaml.BaseLoader), getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def clause_rows(file: str, text: str) -> list[dict]:
    """The clauses of one file in reading order, or one row that tells what is wrong with it.

    Front matter names key and lang, whose values are texts whatever they look like (``lang: no`` is Norwegian); headings of
    level 2 to 6 with a ``{#segment}`` open clauses, whose depth is the level. A body's line that begins with ``#`` is written
    with a backslash before it. Bodies are kept but for blank lines and spaces around them.
    """
    found = _FRONT.match(text)
    if not found:
        return [{"file": file, "problem": "no front matter"}]
    try:
        meta = yaml.load(found[1], _BASE) or {}
    except yaml.YAMLError:
        return [{"file": file, "problem": "front matter is no YAML"}]
    if not isinstance(meta, dict):
        return [{"file": file, "problem": "front matter has no fields"}]
    key = meta.get("key", "")
    if not isinstance(key, str) or not isinstance(meta.get("lang"), str) or not _KEY.match(key):
        return [{"file": file, "problem": "no key or language"}]
    told = {f: meta[f] if isinstance(meta.get(f), str) and meta[f] else None for f in ("label", "title")}
    common = {"file": file, "lang": meta["lang"], "normative": str(meta.get("normative", "true")).lower() not in _NO, "problem": None}
    rows = [common | {"key": key, "parent": None, "place": 0, "depth": 1, "label": told["label"], "heading": told["title"], "body": []}]
    path = [(1, key)]
    for line in found[2].split("\n"):
        if line[:1] not in ("#", "\\"):  # neither a heading nor escaped
            rows[-1]["body"].append(line)
            continue
        opens = _OPENS.match(line)
        if not opens:
            if _HEADING.match(line):
                return [{"file": file, "problem": "a heading without a key"}]
            rows[-1]["body"].append(_ESCAPED.sub("", line))
            continue
        level = len(opens[1])
        if level > path[-1][0] + 1:
            return [{"file": file, "problem": "a level left out"}]
        path = [p for p in path if p[0] < level]
        rows.append(common | {"key": f"{path[-1][1]}:{opens[3]}", "parent": path[-1][1], "place": len(rows), "depth": level, "label": opens[2] or None, "heading": None, "body": []})
        path.append((level, rows[-1]["key"]))
    if len({r["key"] for r in rows}) < len(rows):
        return [{"file": file, "problem": "a key used twice"}]
    return [r | {"body": "\n".join(r["body"]).strip()} for r in rows]


def read_clauses(spark: SparkSession, path: str) -> DataFrame:
    """CLAUSES of all clause files (``*.md``) below a path; file is the name without its ending."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for x in batch.to_pylist() for r in clause_rows(x["file"].removesuffix(".md"), x["value"])]
            yield pa.RecordBatch.from_pylist(found, schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(CLAUSES))
    return read_named(spark, path, "*.md").mapInArrow(parse, CLAUSES)


def quoted(text: Column) -> Column:
    """A text as a YAML value on one line, whatever is in it."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def write_clauses(clauses: DataFrame, path: str) -> None:
    """Clauses (file, key, place, depth, label, heading, body, lang, normative) as Markdown files ``<file>.md``, many a task.

    A file's clauses, one document's article, meet in one row. Headings below the first clause aren't kept by the format.
    """
    segment = F.element_at(F.split("key", ":"), -1)
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), quoted(value), F.lit("\n")), F.lit(""))
    front = F.concat(F.lit("---\n"), field("key", F.col("key")), field("lang", F.col("lang")), field("label", F.col("label")), field("title", F.col("heading")), F.when(F.col("normative"), "").otherwise("normative: false\n"), F.lit("---\n\n"))
    opens = F.concat(F.repeat(F.lit("#"), F.col("depth")), F.coalesce(F.concat(F.lit(" "), "label"), F.lit("")), F.lit(" {#"), segment, F.lit("}\n"))
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"(?m)^(\\*#)", r"\\$1")
    block = F.concat(F.when(F.col("depth") == 1, front).otherwise(opens), body, F.lit("\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("place", block.alias("b"))))
    whole = clauses.groupBy("file").agg(F.array_join(F.transform(parts, lambda p: p["b"]), "").alias("value"))
    write_named(whole.select(F.concat("file", F.lit(".md")).alias("file"), "value"), path)


def in_law_order(files: DataFrame, expected: DataFrame) -> DataFrame:
    """document, file, turn, problem: files (document, file) in the law's order (art-2 before art-10); problem: another count than expected (document, n)."""
    own = W.partitionBy("document")
    placed = files.select("document", "file", F.row_number().over(own.orderBy(natural_key(F.col("file")))).alias("turn"), F.count("*").over(own).alias("found"))
    return placed.join(expected, "document", "left").select("document", "file", "turn", F.when(~F.col("found").eqNullSafe(F.col("n")), "count").alias("problem"))


def unaligned(clauses: DataFrame, languages: list[str]) -> DataFrame:
    """key, lang: clauses (key, lang) that a declared language lacks."""
    every = clauses.select("key").distinct().withColumn("lang", F.explode(F.array(*[F.lit(x) for x in languages])))
    return every.join(clauses.select("key", "lang"), ["key", "lang"], "left_anti")


def coming(files: DataFrame, pack_day: str) -> DataFrame:
    """file, stem, starts, lang, problem of amended texts' names (``stem@YYYY-MM-DD[.lang].md``), which must start after the pack's day."""
    part = lambda n: F.regexp_extract("file", r"^([a-z0-9-]+)@(\d{4}-\d{2}-\d{2})(?:\.([a-z]{2}))?\.md$", n)
    named = files.select("file", F.nullif(part(1), F.lit("")).alias("stem"), F.try_to_date(part(2), "yyyy-MM-dd").alias("starts"), F.nullif(part(3), F.lit("")).alias("lang"))
    problem = F.when(F.col("stem").isNull() | F.col("starts").isNull(), "name").when(F.col("starts") <= F.lit(pack_day).cast("date"), "too early")
    return named.withColumn("problem", problem)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """id, question, lang, expected, problem of all question files (YAML) below a path; ids are used once over all of them.

    A file that is no YAML, or holds no list of questions, is a row of its problem.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                try:
                    found = yaml.load(x["value"] or "", _SAFE) or {}
                except yaml.YAMLError:
                    out.append({"problem": "no YAML"})
                    continue
                asked = found.get("questions") or [] if isinstance(found, dict) else None
                if not isinstance(asked, list) or not all(isinstance(q, dict) for q in asked):
                    out.append({"problem": "no list of questions"})
                    continue
                for q in asked:
                    lacks = [f for f in ("id", "question", "lang", "expected_keys") if not q.get(f)]
                    told = {f: None if q.get(f) is None else str(q[f]) for f in ("id", "question", "lang")}
                    keys = q.get("expected_keys") or []
                    out.append(told | {"expected": [str(k) for k in (keys if isinstance(keys, list) else [keys])], "problem": f"no {lacks[0]}" if lacks else None})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    schema = "id string, question string, lang string, expected array<string>, problem string"
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    found = read_named(spark, path, "*").select("value").mapInArrow(parse, schema)
    twice = found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").select("id", F.lit("id used twice").alias("twice"))
    return found.join(twice, "id", "left").select("id", "question", "lang", "expected", F.coalesce("problem", "twice").alias("problem"))


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores as JSON lines, fractions to four places."""
    rounded = [F.round(c, 4).alias(c) if t in ("double", "float") else F.col(c) for c, t in scores.dtypes]
    scores.select(*rounded).write.json(path)


def write_export(entries: DataFrame, path: str) -> None:
    """A governance export: entries as JSON lines in order of seq, and beside them a manifest of one line.

    entries: seq, prev_hash, entry_hash and any fields; details stay the text they are.
    """
    from clausewright.operators.governance import manifest

    entries.sort("seq").write.json(f"{path}/entries")
    manifest(entries).write.json(f"{path}/manifest")


def read_export(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Entries and manifest of an export."""
    manifest = spark.read.schema("count long, from_seq long, to_seq long, final_hash string").json(f"{path}/manifest")
    return spark.read.schema(schema).json(f"{path}/entries"), manifest
