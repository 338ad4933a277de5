"""Clauses as readers open them: one row a request, with all that is around the clause nested in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.operators.asof import applies, ended
from clausewright.operators.matching import chained
from clausewright.session import cut

#: Levels that a clause tree may have; a deeper one, or a cycle, is an error.
MOST_LEVELS = 32


@dataclass(frozen=True)
class Corpus:
    """documents: slug, kind (law or policy). names: slug, lang, title. versions: document (a slug), version, number (once a
    document), status, effective, version_label. nodes: id, version, key, parent, place, kind, label, is_normative, depth,
    previous_id. texts: text_id, node, lang, is_authoritative, heading, label, body, applies_from, applies_until, pending,
    dated_by. references: node, to_key, raw_text. Other columns aren't read."""

    documents: DataFrame
    names: DataFrame
    versions: DataFrame
    nodes: DataFrame
    texts: DataFrame
    references: DataFrame


def ancestors(starts: DataFrame, nodes: DataFrame, levels: int = MOST_LEVELS) -> DataFrame:
    """id, ancestor, height (1 for the parent) of every id of starts, by one recursive query over nodes (id, parent).

    A parent that isn't among nodes ends the way up. More than ``levels`` levels, as in a cycle, are an error.
    """
    return starts.sparkSession.sql(
        f"""WITH RECURSIVE up (id, ancestor, parent, height) MAX RECURSION LEVEL {levels + 1} AS (
          SELECT s.id, p.id, p.parent, 1 FROM (SELECT DISTINCT id FROM {{starts}}) s JOIN {{nodes}} n ON n.id = s.id JOIN {{nodes}} p ON p.id = n.parent
          UNION ALL
          SELECT up.id, p.id, p.parent, up.height + 1 FROM up JOIN {{nodes}} p ON p.id = up.parent)
        SELECT id, ancestor, height FROM up LIMIT ALL""",
        starts=starts,
        nodes=nodes.select("id", "parent"),
    )


def versions_on(days: DataFrame, versions: DataFrame) -> DataFrame:
    """days (document, day) with the published version in force on each day: latest start, then highest number."""
    known = versions.where("status = 'published'").select("document", "effective", "number", "version", "version_label")
    met = days.select("document", "day").distinct().join(known, "document").where("effective <= day")
    best = met.groupBy("document", "day").agg(F.max(F.struct("effective", "number", "version", "version_label")).alias("v"))
    return best.select("document", "day", "v.*")


def texts_shown(points: DataFrame, texts: DataFrame) -> DataFrame:
    """points (id, day, lang) with the texts to show there: ``shown``, ``prevailing`` (null if it is shown itself), ``coming``.

    In lang if the clause has it, else the authoritative one, else any. Of several: one that applies (latest start), else the
    earliest that hasn't ended (not pending first, no date last), else the one that ended last; ties to the least text_id.
    coming: the earliest other text of the language shown that starts later. One join, one aggregate.
    """
    far, early = F.lit("9999-12-31").cast("date"), F.lit("0001-01-01").cast("date")
    day, start = F.col("day"), F.col("applies_from")
    tier = F.when(applies(day), 0).when(~ended(day), 1).otherwise(2)
    at = F.when(tier == 0, -F.unix_date(F.coalesce(start, early))).when(tier == 1, F.unix_date(F.coalesce(start, far))).otherwise(-F.unix_date("applies_until"))
    text = F.struct("text_id", F.col("lang_").alias("lang"), "is_authoritative", "heading", "label", "body", "applies_from", "applies_until", "pending", "dated_by")
    order = F.struct(tier.alias("tier"), F.when((tier == 1) & F.col("pending"), 1).otherwise(0).alias("waits"), at.alias("at"), "text_id", text.alias("text"))
    later = F.when(start > day, F.struct("applies_from", "text_id", text.alias("text")))
    met = points.select("id", "day", "lang").join(texts.withColumnsRenamed({"lang": "lang_", "node": "id"}), "id")
    found = met.groupBy("id", "day", "lang").agg(
        F.min(F.when(F.col("lang_") == F.col("lang"), order))["text"].alias("own"),
        F.coalesce(F.min(F.when(F.col("is_authoritative"), order)), F.min(order))["text"].alias("source"),
        F.collect_list(later).alias("later"),
    )
    shown = F.coalesce("own", "source")
    coming = F.array_min(F.filter("later", lambda x: (x["text"]["lang"] == F.col("shown.lang")) & (x["text_id"] != F.col("shown.text_id"))))
    found = found.withColumn("shown", shown)
    return found.select("id", "day", "lang", "shown", F.when(F.col("source.text_id") != F.col("shown.text_id"), F.col("source")).alias("prevailing"), coming["text"].alias("coming"))


def _titled(names: DataFrame) -> DataFrame:
    return names.groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("lang", "title"))).alias("titles"), F.min(F.struct("lang", "title"))["title"].alias("first_title"))


def views(points: DataFrame, corpus: Corpus) -> DataFrame:
    """points (id, day, lang) with ``view``, the clause as a reader sees it on that day in that language, title included."""
    published = corpus.versions.select("version", "document", "version_label", "effective")
    node = corpus.nodes.select("id", "version", "key", F.col("kind").alias("clause_kind"), F.col("label").alias("node_label"), "is_normative", "depth")
    told = texts_shown(points, corpus.texts).join(node, "id").join(published, "version").join(_titled(corpus.names).withColumnRenamed("slug", "document"), "document", "left")
    title = F.coalesce(F.try_element_at("titles", F.col("shown.lang")), F.try_element_at("titles", F.lit("en")), F.col("first_title"))
    from_day = F.when(~F.col("shown.pending"), F.coalesce("shown.applies_from", "effective"))
    begun = F.col("shown.applies_from").isNull() | (F.col("shown.applies_from") <= F.col("day"))
    here = ~F.col("shown.pending") & begun & (F.col("shown.applies_until").isNull() | (F.col("shown.applies_until") > F.col("day")))
    view = F.struct(
        "key", "clause_kind", F.coalesce("shown.label", "node_label").alias("label"), F.col("shown.heading").alias("heading"), F.col("shown.body").alias("body"),
        F.col("shown.lang").alias("lang"), F.col("shown.is_authoritative").alias("is_authoritative"), "is_normative", "depth", title.alias("title"), "document", "version_label",
        "effective", here.alias("in_force"), from_day.alias("in_force_from"), F.col("shown.applies_until").alias("in_force_until"), F.col("shown.dated_by").alias("dates_set_by"),
        F.when(F.col("coming").isNotNull(), F.struct(F.col("coming.applies_from").alias("from"), F.col("coming.heading").alias("heading"), F.col("coming.body").alias("body"), F.col("coming.dated_by").alias("dates_set_by"))).alias("coming"),
        F.col("prevailing.body").alias("prevailing"),
    )
    return told.select("id", "day", "lang", view.alias("view"))


def _authoritative(texts: DataFrame) -> DataFrame:
    one = F.min(F.struct("text_id", "heading", "body"))
    return texts.where("is_authoritative").groupBy("node").agg(one.alias("t")).select("node", "t.heading", "t.body")


def _numbered(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Published versions of documents (document), numbered without gaps."""
    own = versions.where("status = 'published'").join(documents.select("document").distinct(), "document", "left_semi")
    return own.select("document", "version", "number", "version_label", F.row_number().over(W.partitionBy("document").orderBy("number")).alias("seq"))


def standing_today(found: DataFrame, corpus: Corpus, today: str) -> DataFrame:
    """request, now of policy clauses read (found: request, id, document, version, number) in another version than today's.

    Clauses are followed through every published version in between; key null: lost on the way. changed: heading or body of the
    authoritative text. Where today's version comes before the one read, the last version is looked at.
    """
    current = versions_on(found.select("document", F.lit(today).cast("date").alias("day")), corpus.versions).select(
        "document", F.col("version").alias("today_version"), F.col("number").alias("today_number"), F.col("version_label").alias("today_label"), F.col("effective").alias("today_effective")
    )
    order = _numbered(found, corpus.versions)
    last = order.groupBy("document").agg(F.max_by("version", "seq").alias("last_version"))
    away = found.join(current, "document").where("version <> today_version").join(last, "document")
    away = away.withColumn("aim", F.when(F.col("today_number") > F.col("number"), F.col("today_version")).otherwise(F.col("last_version")))
    # Only links to the version just before count: a clause is followed a version at a time.
    own = corpus.nodes.join(order.select("version", "seq"), "version").select("id", "version", "key", "previous_id", "seq")
    before = own.select(F.col("id").alias("previous_id"), (F.col("seq") + 1).alias("seq"), F.lit(True).alias("linked"))
    linked = own.join(before, ["previous_id", "seq"], "left").select("id", "version", "key", F.when(F.col("linked"), F.col("previous_id")).alias("previous_id"))
    chains = cut(chained(cut(linked), carry=["id"]))
    there = chains.groupBy("origin", F.col("version").alias("aim")).agg(F.min(F.struct("key", "id")).alias("t"))
    reached = away.join(chains.select("id", "origin"), "id").join(there, ["origin", "aim"], "left")
    words = _authoritative(corpus.texts)
    was = words.select(F.col("node").alias("id"), F.struct("heading", "body").alias("was"))
    now = words.select(F.col("node").alias("now_id"), F.struct("heading", "body").alias("now"))
    told = reached.withColumn("now_id", F.col("t.id")).join(was, "id", "left").join(now, "now_id", "left").join(corpus.nodes.select("id", F.col("key").alias("own_key")), "id")
    same = F.col("was").isNotNull() & F.col("now").isNotNull() & F.col("was").eqNullSafe(F.col("now"))
    moved = F.coalesce(F.col("t.key") != F.col("own_key"), F.lit(False))
    return told.select("request", F.struct(F.col("t.key").alias("key"), F.col("today_label").alias("version_label"), F.col("today_effective").alias("effective"), moved.alias("moved"), (~same).alias("changed")).alias("now"))


def formerly_named(found: DataFrame, corpus: Corpus) -> DataFrame:
    """request, formerly: the other clause that had the key in the published version before, and where that went."""
    order = _numbered(found, corpus.versions)
    before = order.select("document", (F.col("seq") + 1).alias("seq"), F.col("version").alias("old_version"), F.col("version_label").alias("old_label"))
    old = corpus.nodes.select(F.col("version").alias("old_version"), "key", F.col("id").alias("old_id"))
    asked = found.join(order.select("version", "seq"), "version").join(before, ["document", "seq"]).join(old, ["old_version", "key"])
    other = asked.where(~F.col("old_id").eqNullSafe(F.col("previous_id")))
    went = corpus.nodes.groupBy("version", F.col("previous_id").alias("old_id")).agg(F.min("key").alias("went"))
    words = _authoritative(corpus.texts).withColumnRenamed("node", "old_id")
    told = other.join(words, "old_id", "left").join(went, ["version", "old_id"], "left")
    return told.select("request", F.struct(F.col("old_label").alias("version_label"), "heading", F.coalesce("body", F.lit("")).alias("body"), F.col("went").alias("now")).alias("formerly"))


def clause_views(requests: DataFrame, corpus: Corpus, today: str, levels: int = MOST_LEVELS) -> DataFrame:
    """request, problem, clause, breadcrumb, children, cross_references, now, formerly for each of requests (request, key, day, lang).

    request names a row of requests and is used once. The document is the key up to its first colon; day says which version is
    read and which texts apply; lang may be null. breadcrumb goes from the root down, children are in their order, both arrays
    of views like clause; cross_references are (to_key, raw_text). now and formerly are told of policies only. problem says
    why a request has no clause: no such document, no version in force, not in that version, no stored text.
    Ancestors and children without texts are left out, as is what lies above a lost parent.
    """
    asked = requests.select("request", "key", "day", F.coalesce("lang", F.lit("")).alias("lang"), F.substring_index("key", ":", 1).alias("document"))
    here = corpus.documents.select(F.col("slug").alias("document"), F.col("kind").alias("document_kind"))
    in_force = versions_on(asked, corpus.versions).select("document", "day", "version", "number")
    node = corpus.nodes.select("version", "key", "id", "previous_id")
    found = cut(asked.join(here, "document", "left").join(in_force, ["document", "day"], "left").join(node, ["version", "key"], "left"))
    at = found.where("id is not null").select("request", "id", "day", "lang")
    up = cut(ancestors(at.select("id"), corpus.nodes, levels))
    above = at.join(up, "id").select("request", F.col("ancestor").alias("id"), "day", "lang", F.lit("above").alias("role"), (-F.col("height")).alias("place"))
    own_children = corpus.nodes.where("parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("child"), F.col("place").cast("int").alias("place"))
    below = at.join(own_children, "id").select("request", F.col("child").alias("id"), "day", "lang", F.lit("below").alias("role"), "place")
    around = at.select("*", F.lit("own").alias("role"), F.lit(0).alias("place")).unionByName(above).unionByName(below)
    around = cut(around)
    seen = around.join(views(around.select("id", "day", "lang").distinct(), corpus), ["id", "day", "lang"])
    role = lambda r: F.collect_list(F.when(F.col("role") == r, F.struct("place", "id", "view")))
    in_order = lambda c: F.transform(F.array_sort(c), lambda x: x["view"])
    nested = seen.groupBy("request").agg(
        F.max_by("view", F.when(F.col("role") == "own", 1)).alias("clause"), in_order(role("above")).alias("breadcrumb"), in_order(role("below")).alias("children"), F.max(F.col("role") == "own").alias("worded")
    )
    link = F.array_sort(F.collect_list(F.struct("to_key", "raw_text")))
    links = at.select("request", "id").join(corpus.references.withColumnRenamed("node", "id"), "id").groupBy("request").agg(link.alias("cross_references"))
    policies = found.where("document_kind = 'policy' and id is not null")
    out = found.join(nested, "request", "left").join(links, "request", "left")
    out = out.join(standing_today(policies, corpus, today), "request", "left").join(formerly_named(policies, corpus), "request", "left")
    worded = F.coalesce("worded", F.lit(False))
    problem: Column = (
        F.when(F.col("document_kind").isNull(), "no such document").when(F.col("version").isNull(), "no version in force").when(F.col("id").isNull(), "not in that version").when(~worded, "no stored text")
    )
    kept = lambda c: F.when(worded, F.col(c)).alias(c)
    some = lambda c: F.when(worded, F.coalesce(c, F.array())).alias(c)
    return out.select("request", problem.alias("problem"), kept("clause"), kept("breadcrumb"), kept("children"), some("cross_references"), kept("now"), kept("formerly"))
