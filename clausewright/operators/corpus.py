"""The corpus as readers see it: texts in force and in scope, search over them, views, marks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.operators import retrieval as rt
from clausewright.operators.asof import ended, in_force


def in_scope(packs: list[str] | None, policies: bool) -> Column:
    """Rows (kind, pack) of the named laws, and policies if wanted; no packs named: everything."""
    if packs is None:
        return F.lit(True)
    return F.col("pack").isin(packs) & (F.col("kind") == "law") | ((F.col("kind") == "policy") & F.lit(policies))


def readable(texts: DataFrame, versions: DataFrame, day: str, packs: list[str] | None = None, policies: bool = True, normative_only: bool = False) -> DataFrame:
    """Texts (pack, version, kind, body, is_normative, pending, applies_until) of versions in force on a day, in scope, worded, not ended.

    versions: as for ``asof.in_force``, a pack's documents by the pack's name.
    """
    now = F.lit(day).cast("date")
    wanted = ~F.lit(normative_only) | F.col("is_normative")
    kept = texts.where(in_scope(packs, policies) & wanted & ~F.col("pending") & ~ended(now) & (F.length(F.trim("body")) > 0))
    current = in_force(versions, day).select(F.col("document").alias("pack"), "version")
    return kept.join(current, ["pack", "version"], "left_semi")


def search(questions: DataFrame, texts: DataFrame, versions: DataFrame, day: str, limit: int = 100, **scope) -> DataFrame:
    """qid, key, lang, score, rank: BM25 over readable texts (text_id, key, lang, ...), one row a key at its best text.

    Frequencies and lengths come from all worded texts, as an index holds them; what may not be read
    is left out before anything is ranked, so that a list is never shortened afterwards.
    """
    shown = readable(texts, versions, day, **scope).select(F.col("text_id").alias("key"), F.col("key").alias("clause"), "lang")
    every = texts.select(F.col("text_id").alias("key"), "body")
    hits = rt.keyword_search(questions, every, 1 << 30, among=shown.select("key")).join(shown, "key")
    return rt.best_text_per_key(hits.select("qid", F.col("clause").alias("key"), "lang", "score"), limit)


def keyword_texts(texts: DataFrame, asked: DataFrame, day: str) -> DataFrame:
    """key, lang, words: each worded text with its clause's current questions where it applies on that day, and questions
    alone where a clause has no text in their language.

    texts: key, lang, body, pending, applies_from, applies_until; asked: key, lang, questions, current.
    """
    now, known = F.lit(day).cast("date"), asked.where("current").select("key", "lang", "questions")
    begun = F.col("applies_from").isNull() | (F.col("applies_from") <= now)
    here = ~F.col("pending") & begun & (F.col("applies_until").isNull() | (F.col("applies_until") > now))
    worded = texts.where(F.length(F.trim("body")) > 0).withColumn("here", here)
    # The residual condition joins the key of the right side's rows: texts that don't apply meet nothing.
    told = worded.join(known.withColumn("here", F.lit(True)), ["key", "lang", "here"], "left")
    own = told.select("key", "lang", F.concat_ws(" ", "body", "questions").alias("words"))
    alone = known.join(worded.select("key", "lang"), ["key", "lang"], "left_anti").select("key", "lang", F.col("questions").alias("words"))
    return own.unionByName(alone)


def marked_current(stored: DataFrame, texts: DataFrame) -> DataFrame:
    """stored (key, fingerprint) with ``current``: whether it is the fingerprint of the key's texts (key, lang, body) now."""
    now = texts.groupBy("key").agg(rt.fingerprint(F.col("lang"), F.col("body")).alias("now"))
    return stored.join(now, "key", "left").select("key", "fingerprint", F.coalesce(F.col("fingerprint") == F.col("now"), F.lit(False)).alias("current"))


def scope_problems(asked: DataFrame, loaded: DataFrame, selected: DataFrame) -> DataFrame:
    """slug, problem: laws asked for that aren't loaded (unknown) or not selected; an empty selection refuses all (nothing_selected)."""
    chosen = selected.select("slug", F.lit(True).alias("chosen")).distinct()
    here = loaded.select("slug", F.lit(True).alias("here")).distinct()
    none = selected.agg((F.count("*") == 0).alias("none"))
    rows = asked.select("slug").distinct().join(here, "slug", "left").join(chosen, "slug", "left").crossJoin(F.broadcast(none))
    problem = F.when(F.col("none"), "nothing_selected").when(F.col("here").isNull(), "unknown").when(F.col("chosen").isNull(), "not_selected")
    return rows.select("slug", problem.alias("problem")).where("problem is not null")


def newly_arrived(packs: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Packs (slug, loaded_at, selected_at) loaded after the first selection and within the last days."""
    first = packs.agg(F.min("selected_at").alias("first"))
    since = F.greatest(F.col("first"), F.lit(today).cast("timestamp") - F.expr(f"interval {days} days"))
    return packs.crossJoin(F.broadcast(first)).where(F.col("loaded_at") > since).select("slug", "loaded_at")


def titles(names: DataFrame, lang: str) -> DataFrame:
    """pack, title: of names (pack, lang, title) the one in lang, else in English, else the first by language."""
    order = F.struct(F.when(F.col("lang") == lang, 0).when(F.col("lang") == "en", 1).otherwise(2), "lang", "title")
    return names.groupBy("pack").agg(F.min(order).alias("o")).select("pack", F.col("o.title").alias("title"))


def views(texts: DataFrame, names: DataFrame, lang: str) -> DataFrame:
    """text_id, label, title, in_force_from: a text's label or its clause's, the document's name, its start unless it is pending."""
    start = F.when(~F.col("pending"), F.col("applies_from"))
    return texts.join(titles(names, lang), "pack", "left").select(
        "text_id", F.coalesce("label", "node_label").alias("label"), "title", start.alias("in_force_from")
    )


def citation(title: Column, label: Column, version: Column) -> Column:
    """``Title, label (version n)``."""
    return F.concat(F.concat_ws(", ", title, label), F.lit(" (version "), version.cast("string"), F.lit(")"))


def standing(day: str, start: Column, end: Column, pending: Column) -> Column:
    """One sentence on when a text applies."""
    now = F.lit(day).cast("date")
    return (
        F.when(pending, "Not in force yet, with no date set.")
        .when(start > now, F.concat(F.lit("In force from "), start.cast("string"), F.lit(".")))
        .when(end <= now, F.concat(F.lit("No longer in force since "), end.cast("string"), F.lit(".")))
        .when(end.isNotNull(), F.concat(F.lit("In force until "), end.cast("string"), F.lit(".")))
        .otherwise("In force.")
    )


def law_counts(clauses: DataFrame) -> DataFrame:
    """law, articles, recitals, main: counts by kind, and the document with the most articles (the first by name on ties).

    clauses: law, document, kind.
    """
    by_document = clauses.groupBy("law", "document").agg(F.count_if(F.col("kind") == "article").alias("a"), F.count_if(F.col("kind") == "recital").alias("r"))
    most = F.min(F.struct((-F.col("a")).alias("o"), "document"))["document"]
    return by_document.groupBy("law").agg(F.sum("a").alias("articles"), F.sum("r").alias("recitals"), most.alias("main"))


def dominant(rows: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """by, value: the heaviest value of each group, the first by name on ties."""
    sums = rows.groupBy(by, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(by).agg(F.min(F.struct((-F.col("w")).alias("o"), value))[value].alias(value))


def printed(text: Column) -> Column:
    """Characters a reader sees."""
    return F.length(F.regexp_replace(text, r"\s", ""))


def coverage(paragraphs: DataFrame, uses: DataFrame) -> DataFrame:
    """Per file: characters, in_clauses, set_aside, gaps (paragraphs used not exactly once).

    paragraphs: file, position, text; uses: file, position, place ('clause' or 'aside').
    """
    times = uses.groupBy("file", "position").agg(F.count_if(F.col("place") == "clause").alias("c"), F.count_if(F.col("place") == "aside").alias("s"))
    n, c, s = printed(F.col("text")), F.coalesce("c", F.lit(0)), F.coalesce("s", F.lit(0))
    return paragraphs.join(times, ["file", "position"], "left").groupBy("file").agg(
        F.sum(n).alias("characters"), F.sum(F.when(c > 0, n).otherwise(0)).alias("in_clauses"),
        F.sum(F.when(s > 0, n).otherwise(0)).alias("set_aside"), F.count_if(c + s != 1).alias("gaps"),
    )


def file_as_read(lines: DataFrame, clauses: DataFrame, aside: DataFrame) -> DataFrame:
    """file, position, text, clause, clauses, set_aside: a file's printed lines (file, position, text), each with the clauses it went to.

    clauses: file, key, depth, place, positions; aside: file, positions, reason. clause is the outermost, first in order, of
    those that name the position, clauses all of them in that order; set_aside is why a line went to none (the first reason by
    name). Blank lines are left out, as are positions that no line has. Positions are exploded, so that both joins are equi-joins.
    """
    told = clauses.select("file", "key", "depth", "place", F.explode(F.array_distinct("positions")).alias("position"))
    went = told.groupBy("file", "position").agg(F.array_sort(F.collect_list(F.struct("depth", "place", "key"))).alias("c")).select("file", "position", F.transform("c", lambda x: x["key"]).alias("clauses"))
    kept = aside.select("file", "reason", F.explode("positions").alias("position")).groupBy("file", "position").agg(F.min("reason").alias("set_aside"))
    printed_lines = lines.where(printed(F.col("text")) > 0)
    both = printed_lines.join(went, ["file", "position"], "left").join(kept, ["file", "position"], "left")
    return both.select("file", "position", "text", F.get("clauses", F.lit(0)).alias("clause"), F.coalesce("clauses", F.array().cast("array<string>")).alias("clauses"), "set_aside")


def numbering_gaps(clauses: DataFrame) -> DataFrame:
    """parent, place, what: numbered siblings (parent, place, number, null for none) that don't follow the one before.

    A list that starts again at one after something unnumbered is a new list.
    """
    own = W.partitionBy("parent").orderBy("place")
    before = F.last("number", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1))
    broken = F.lag("number").over(own).isNull()
    wrong = F.col("before").isNotNull() & (F.col("number") != F.col("before") + 1) & ~(F.col("broken") & (F.col("number") == 1))
    rows = clauses.withColumns({"before": before, "broken": broken}).where(F.col("number").isNotNull() & wrong)
    return rows.select("parent", "place", F.when(F.col("number") == F.col("before"), "repeats").otherwise("gap").alias("what"))


def outline(nodes: DataFrame, names: DataFrame, lang: str) -> DataFrame:
    """id, name, children: top-level nodes (id, parent, place) in order, named in lang or else as the source words it, with child counts.

    names: id, lang, name, is_authoritative.
    """
    order = F.struct(F.when(F.col("lang") == lang, 0).otherwise(1), "lang", "name")
    named = names.where((F.col("lang") == lang) | F.col("is_authoritative")).groupBy("id").agg(F.min(order)["name"].alias("name"))
    counts = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    top = nodes.where("parent is null").select("id", "place")
    return top.join(named, "id", "left").join(counts, "id", "left").select("id", "place", "name", F.coalesce("children", F.lit(0)).alias("children"))
