"""A law pack's own description (pack.yaml): fields by name, checked, one row a pack."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from clausewright.sources.named_text import read_named

# The format that is read, the fields that must be there, those written once a language, where laws are listed,
# how far a pack is checked, and what a translation may be.
FORMAT = "2"
REQUIRED = ("format", "slug", "name", "short_name", "jurisdiction", "region", "version", "effective_date", "trust_tier", "source_url", "license", "authoritative_language", "documents")
NAMED = ("name", "short_name", "jurisdiction")
REGIONS = ("Africa", "Americas", "Asia Pacific", "Europe", "Middle East")
TIERS = ("verified", "community")
STATUSES = ("official", "unofficial")

_TEXTS = "map<string, string>"
_COMMENCEMENT = "struct<`from`: string, until: string, keys: array<string>, source: string>"
_FIELDS = (
    f"format string, slug string, name {_TEXTS}, short_name {_TEXTS}, jurisdiction {_TEXTS}, region string, version string, effective_date string, trust_tier string, source_url string, license string, authoritative_language string, "
    f"translations array<struct<lang: string, status: string, license: string, source_url: string>>, "
    f"documents array<struct<slug: string, title: {_TEXTS}, normative: string, expected_clauses: string, source_url: string, source_sha256: string, commencement: array<{_COMMENCEMENT}>>>"
)
_DATE = "date:"
# libyaml reads the same texts as the plain loader, some ten times as fast.
_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def _plain(value) -> str:
    """Values that JSON has no name for, so that they are told from texts."""
    return f"{_DATE}{value.isoformat()}" if isinstance(value, datetime.date) else str(value)


def _as_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        out = []
        for text in batch:
            try:
                found = yaml.load(text or "", _LOADER) or {}
                out.append(json.dumps(found if isinstance(found, dict) else {"problem": "no fields"}, default=_plain))
            except (yaml.YAMLError, ValueError, TypeError):
                out.append(json.dumps({"problem": "no YAML"}))
        yield pd.Series(out)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _problem(at: str) -> Column:
    """What is wrong with a pack, the first thing in the order in which a reader is told, or null. at: the parsed struct."""
    p = lambda name: F.col(f"{at}.{name}")
    has = lambda name: F.array_contains("given", name)
    lacking = F.array_join(F.filter(F.array(*[F.lit(f) for f in REQUIRED]), lambda f: ~F.array_contains("given", f)), ", ")
    simple = [f for f in REQUIRED if f not in (*NAMED, "documents")]
    empty = F.array_join(F.array_compact(F.array(*[F.when(_blank(p(f)), f) for f in simple])), ", ")
    languages = F.array_distinct(F.concat(F.array(p("authoritative_language")), F.coalesce(F.transform(p("translations"), lambda t: t["lang"]), F.array()), F.array(F.lit("en"))))
    worded = lambda m: F.map_filter(m, lambda k, v: ~_blank(v))
    unnamed = lambda m: m.isNull() | ~F.forall(languages, lambda x: F.map_contains_key(worded(m), x))
    keys = lambda name: F.array_sort(F.map_keys(worded(p(name))))
    bad_translation = F.exists(p("translations"), lambda t: t.isNull() | _blank(t["lang"]) | _blank(t["status"]) | _blank(t["license"]))
    bad_status = F.exists(p("translations"), lambda t: ~t["status"].isin(*STATUSES))
    own_language = F.exists(p("translations"), lambda t: t["lang"] == p("authoritative_language"))
    document = F.exists(p("documents"), lambda d: d.isNull() | d["slug"].isNull() | d["title"].isNull() | d["expected_clauses"].isNull())
    no_count = F.exists(p("documents"), lambda d: ~d["expected_clauses"].rlike(r"^\d+$"))
    untitled = F.exists(p("documents"), lambda d: unnamed(d["title"]))
    day = lambda c: F.when(c.startswith(_DATE), F.substr(c, F.lit(len(_DATE) + 1)))
    entry = lambda test: F.exists(p("documents"), lambda d: F.exists(d["commencement"], test))
    undated = entry(lambda c: c.isNull() | (c["from"].isNull() & c["until"].isNull()))
    wrong_day = entry(lambda c: (c["from"].isNotNull() & (c["from"] != "pending") & day(c["from"]).isNull()) | (c["until"].isNotNull() & day(c["until"]).isNull()))
    keyless = entry(lambda c: F.coalesce(F.size(c["keys"]), F.lit(0)) <= 0)
    sourceless = entry(lambda c: _blank(c["source"]))
    backwards = entry(lambda c: day(c["until"]) <= day(c["from"]))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(F.col("broken").isNotNull(), F.col("broken"))
        .when(~has("format"), "no format")
        .when(~yes(p("format") == FORMAT), "another format")
        .when(lacking != "", F.concat(F.lit("missing "), lacking))
        .when(empty != "", F.concat(F.lit("empty "), empty))
        .when(~p("trust_tier").isin(*TIERS), "trust_tier")
        .when(~p("region").isin(*REGIONS), "region")
        .when(~p("effective_date").startswith(_DATE), "effective_date")
        .when(yes(bad_translation), "translation")
        .when(yes(bad_status), "translation status")
        .when(yes(own_language), "translation into its own language")
        .when(unnamed(p("name")) | unnamed(p("short_name")) | unnamed(p("jurisdiction")), "not named in each language")
        .when((keys("name") != keys("short_name")) | (keys("name") != keys("jurisdiction")), "named in different languages")
        .when(F.coalesce(F.size(p("documents")), F.lit(0)) <= 0, "no document")
        .when(yes(document) | yes(no_count), "document")
        .when(yes(untitled), "title")
        .when(yes(undated), "commencement without a date")
        .when(yes(wrong_day), "commencement date")
        .when(yes(keyless), "commencement without keys")
        .when(yes(sourceless), "commencement without a source")
        .when(yes(backwards), "commencement ends before it starts")
    )


def pack_rows(files: DataFrame) -> DataFrame:
    """files (file, value) of pack descriptions as one row each: file, problem, and its fields, which are null where there is a problem.

    Only YAML becomes JSON in Python; what the fields must be is told in columns. A file that is no YAML, holds a list, or
    breaks a rule gives its problem, the first in a fixed order; the others are read all the same.
    """
    as_json = F.pandas_udf(_as_json, StringType())
    parsed = files.select("file", as_json("value").alias("json"))
    parsed = parsed.select("file", F.from_json("json", _FIELDS).alias("p"), F.coalesce(F.json_object_keys("json"), F.array()).alias("given"), F.get_json_object("json", "$.problem").alias("broken"))
    checked = parsed.withColumn("problem", _problem("p"))
    day = lambda c: F.to_date(F.substr(c, F.lit(len(_DATE) + 1)))
    commencement = lambda c: F.struct(
        F.when(c["from"].startswith(_DATE), day(c["from"])).alias("starts"), (F.coalesce(c["from"], F.lit("")) == "pending").alias("pending"), F.when(c["until"].isNotNull(), day(c["until"])).alias("ends"), c["keys"].alias("keys"), F.trim(c["source"]).alias("source")
    )
    document = lambda d: F.struct(
        d["slug"].alias("slug"), d["title"].alias("title"), (F.lower(F.coalesce(d["normative"], F.lit("true"))) != "false").alias("normative"), d["expected_clauses"].cast("int").alias("expected_clauses"),
        d["source_url"].alias("source_url"), d["source_sha256"].alias("source_sha256"), F.transform(F.coalesce(d["commencement"], F.array()), commencement).alias("commencement"),
    )
    good = lambda c: F.when(F.col("problem").isNull(), c)
    plain = [good(F.col(f"p.{f}")).alias(f) for f in REQUIRED if f not in ("format", "effective_date", "documents")]
    return checked.select(
        "file", "problem", *plain, good(day(F.col("p.effective_date"))).alias("effective_date"), good(F.coalesce("p.translations", F.array())).alias("translations"), good(F.transform("p.documents", document)).alias("documents")
    )


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """pack_rows of all files named ``*.pack.yaml`` or ``pack.yaml`` below a path."""
    return pack_rows(read_named(spark, path, "*pack.yaml"))


def dated(keys: DataFrame, packs: DataFrame) -> DataFrame:
    """key, starts, pending, ends, sources of clauses (pack, document, key): what the most specific commencement entry says of its start, and of its end.

    An entry covers its key and all below. Start and end are looked for apart: the longest key covering it that sets one. sources are
    both entries' sources, once each, the start's first. Clauses that no entry covers have nulls and no sources.
    """
    entries = packs.select("slug", F.explode("documents").alias("d")).select(F.col("slug").alias("pack"), F.col("d.slug").alias("document"), F.posexplode("d.commencement").alias("turn", "c"))
    each = entries.select("pack", "document", "turn", F.explode("c.keys").alias("prefix"), "c.starts", "c.pending", "c.ends", "c.source")
    parts = F.split("key", ":")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))
    spread = keys.select("pack", "document", "key", F.explode(prefixes).alias("prefix"))
    met = spread.join(each, ["pack", "document", "prefix"])
    order = F.struct(F.size(F.split("prefix", ":")).alias("n"), (-F.col("turn")).alias("t"), "starts", "pending", "ends", "source")
    begins, ends = F.col("starts").isNotNull() | F.col("pending"), F.col("ends").isNotNull()
    best = met.groupBy("pack", "document", "key").agg(F.max(F.when(begins, order)).alias("b"), F.max(F.when(ends, order)).alias("e"))
    told = keys.select("pack", "document", "key").join(best, ["pack", "document", "key"], "left")
    sources = F.array_distinct(F.array_compact(F.array("b.source", "e.source")))
    return told.select("pack", "document", "key", "b.starts", F.coalesce("b.pending", F.lit(False)).alias("pending"), "e.ends", sources.alias("sources"))
