"""Point-in-time resolution: which version of a document is in force, which text applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.functions.redaction import natural_key
from clausewright.session import dealt


def in_force(versions: DataFrame, as_of: str) -> DataFrame:
    """Of each document the published version of latest effective date up to as_of, highest number on ties.

    versions: document, version, number, status, effective. An aggregate of structs: combined before
    the shuffle, no sort.
    """
    known = versions.where((F.col("status") == "published") & (F.col("effective") <= F.lit(as_of).cast("date")))
    best = known.groupBy("document").agg(F.max(F.struct("effective", "number", "version")).alias("v"))
    return best.select("document", "v.version", "v.number", "v.effective")


def lifecycles(versions: DataFrame) -> DataFrame:
    """Published versions with the day the next one takes over; of versions of one day the highest number counts."""
    one = versions.where(F.col("status") == "published").groupBy("document", "effective").agg(F.max(F.struct("number", "version")).alias("v"))
    after = F.lead("effective").over(W.partitionBy("document").orderBy("effective"))
    return one.select("document", "v.version", "v.number", "effective", after.alias("next_effective"))


def in_force_on_days(versions: DataFrame, days: DataFrame) -> DataFrame:
    """in_force for many days at once: a range join of lifecycles with days (day), as an equi-join on the years that both lie in.

    A lifecycle is spread over its years, of those that days lie in only; repeated days give repeated rows, null days none.
    """
    known = days.where("day is not null").select("day", F.year("day").alias("year"))
    ends = known.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    life = lifecycles(versions).crossJoin(F.broadcast(ends))
    from_year, to_year = F.greatest(F.year("effective"), F.col("first")), F.least(F.coalesce(F.year("next_effective"), F.col("last")), F.col("last"))
    spread = life.where(from_year <= to_year).withColumn("year", F.explode(F.sequence(from_year, to_year)))
    here = (F.col("effective") <= F.col("day")) & (F.col("next_effective").isNull() | (F.col("day") < F.col("next_effective")))
    return known.join(spread, "year").where(here).select("day", "document", "version", "number", "effective")


def states(versions: DataFrame, today: str) -> DataFrame:
    """Each published version as scheduled, in_force or replaced, with the last day it holds."""
    now = F.lit(today).cast("date")
    until = F.date_sub("next_effective", 1)
    state = F.when(F.col("effective") > now, "scheduled").when(F.col("next_effective") <= now, "replaced").otherwise("in_force")
    return lifecycles(versions).select("document", "version", "effective", until.alias("until"), state.alias("state"))


def applies(as_of: Column) -> Column:
    """A text (applies_from, applies_until, pending) applies: a half-open interval, pending ones never."""
    begun = F.col("applies_from").isNull() | (F.col("applies_from") <= as_of)
    return ~F.col("pending") & begun & (F.col("applies_until").isNull() | (F.col("applies_until") > as_of))


def ended(as_of: Column) -> Column:
    """A text whose end has come."""
    return F.coalesce(F.col("applies_until") <= as_of, F.lit(False))


def text_on(texts: DataFrame, as_of: str, *keys: str) -> DataFrame:
    """The text to show for each key: one that applies (latest start), else the earliest that hasn't ended
    (not pending first, no date last), else the one that ended last; ties to the least text_id.

    One aggregate over a struct that orders the three tiers.
    """
    now = F.lit(as_of).cast("date")
    tier = F.when(applies(now), 0).when(~ended(now), 1).otherwise(2)
    start, far = F.col("applies_from"), F.lit("9999-12-31").cast("date")
    days = lambda c: F.datediff(c, F.lit("1970-01-01"))
    order = (
        F.when(tier == 0, -days(F.coalesce(start, F.lit("0001-01-01").cast("date"))))
        .when(tier == 1, days(F.coalesce(start, far)))
        .otherwise(-days(F.col("applies_until")))
    )
    waits = F.when((tier == 1) & F.col("pending"), 1).otherwise(0)
    pick = F.min(F.struct(tier.alias("tier"), waits.alias("waits"), order.alias("at"), F.col("text_id")))
    return texts.groupBy(*keys).agg(pick.alias("p")).select(*keys, "p.tier", "p.text_id")


def texts_for(texts: DataFrame, as_of: str, lang: str) -> DataFrame:
    """Per node: the shown text (in lang, else the authoritative one), the one that prevails where a
    translation is shown, and the start of the earliest coming text in the language shown."""
    now = F.lit(as_of).cast("date")
    wanted = text_on(texts.where(F.col("lang") == lang), as_of, "node").select("node", F.col("text_id").alias("own"))
    source = text_on(texts.where("is_authoritative"), as_of, "node").select("node", F.col("text_id").alias("source"))
    both = wanted.join(source, "node", "full").select("node", F.coalesce("own", "source").alias("text_id"), "source")
    facts = texts.select("text_id", F.col("lang").alias("shown_lang"), F.col("is_authoritative").alias("original"))
    shown = both.join(facts, "text_id")
    coming = texts.where(~F.col("pending") & (F.col("applies_from") > now)).groupBy("node", "lang").agg(F.min("applies_from").alias("coming_from"))
    named = coming.withColumnRenamed("lang", "shown_lang")
    return shown.join(named, ["node", "shown_lang"], "left").select(
        "node", "text_id", "shown_lang", F.when(~F.col("original"), F.col("source")).alias("prevailing"), "coming_from"
    )


def slices(texts: DataFrame) -> DataFrame:
    """Validity cut into disjoint slices per node and language: each start ends what came before it."""
    next_start = F.lead("applies_from").over(W.partitionBy("node", "lang").orderBy("applies_from", "text_id"))
    until = F.least(F.coalesce("applies_until", F.lit("9999-12-31").cast("date")), F.coalesce(next_start, F.lit("9999-12-31").cast("date")))
    cut = texts.where("not pending and applies_from is not null").withColumn("until", until)
    return cut.where("applies_from < until").select("node", "lang", "text_id", "applies_from", "until")


def most_specific(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """For each key (colon path) the entry (entry, begins, source) of the longest path covering it.

    Keys are spread over their own prefixes, so that the prefix join is an equi-join.
    """
    parts = F.split("key", ":")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))
    spread = keys.select("key", F.explode(prefixes).alias("entry"))
    found = spread.join(entries, "entry").groupBy("key").agg(F.max(F.struct(F.size(F.split("entry", ":")).alias("n"), "entry", "begins")).alias("e"))
    return found.select("key", "e.entry", "e.begins")


def amended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old texts (node, text_id, applies_from, applies_until) once new ones (node, new_from) come: they end
    that day, and those that would never have applied are dropped."""
    first = new.groupBy("node").agg(F.min("new_from").alias("new_from"))
    ends = F.least("applies_until", "new_from")
    kept = old.join(first, "node", "left").withColumn("applies_until", ends)
    return kept.where("applies_until is null or applies_from < applies_until").select("node", "text_id", "applies_from", "applies_until")


def placed(old: DataFrame, new: DataFrame) -> DataFrame:
    """parent, key, turn, added: old siblings (parent, key, place) in their order, and new ones (parent, key) where they belong among them.

    A new clause stands before the first old one, in the old ones' order, whose last segment comes after its own in natural
    order (art-5-bis after art-5, before art-6), at the end if there is none; several at one place in natural order. Keys that
    the parent has already aren't added. One shuffle, sorts within a parent, no pairs of siblings.
    """
    given = old.select("parent", "key", F.col("place").cast("long").alias("place"), F.lit(True).alias("old")).unionByName(
        new.select("parent", "key", F.lit(None).cast("long").alias("place"), F.lit(False).alias("old"))
    )
    # Both are counted first, so that what a task sorts doesn't grow with the tables; all that follows stays in a parent's task.
    every = dealt(given, old.count() + new.count(), "parent")
    same = W.partitionBy("parent", "key").orderBy(F.desc("old"))
    once = every.withColumns({"known": F.first("old").over(same), "n": F.row_number().over(same)}).where(F.col("old") | (~F.col("known") & (F.col("n") == 1)))
    # As one string, less than half as long in a sort as the array: no digit or letter comes before what parts the runs.
    natural = F.array_join(natural_key(F.element_at(F.split("key", ":"), -1)), "\0")
    every = once.select("parent", "key", "place").withColumn("natural", natural)
    greater = F.min("place").over(W.partitionBy("parent").orderBy(F.desc("natural"), F.desc("key")).rowsBetween(W.unboundedPreceding, -1))
    at = F.coalesce("place", greater, F.lit((1 << 63) - 1))
    anchored = every.withColumn("at", at)
    turn = F.row_number().over(W.partitionBy("parent").orderBy("at", F.col("place").isNotNull(), "natural", "key"))
    return anchored.select("parent", "key", turn.alias("turn"), F.col("place").isNull().alias("added"))


def changed_after_publication(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Published rows of before that now lacks or holds otherwise: the immutability rule's violations."""
    columns = [c for c in before.columns if c != key]
    left = before.where(F.col("status") == "published").select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("was"))
    right = now.select(key, F.sha2(F.to_json(F.struct(*columns)), 256).alias("is"))
    joined = left.join(right, key, "left")
    return joined.where("`is` is null or was <> `is`").select(key, F.when(F.col("is").isNull(), "missing").otherwise("changed").alias("problem"))


def listed_versions(versions: DataFrame, flags: DataFrame, today: str, drafts: bool = True) -> DataFrame:
    """document, version, number, effective, until, state, flags, open: a document's published versions with their states, and its drafts.

    flags: version, accepted, resolved. A draft's state is draft; flags counts all of its flags, open those neither accepted nor
    resolved; both are null for published versions. Of versions of one day the highest number counts, the others are replaced by it at
    once, their last day before their first. Discarded versions aren't listed.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    after = F.lead("effective").over(W.partitionBy("document").orderBy("effective", "number", "version"))
    shown = versions.where("status = 'published'").withColumn("after", after)
    now = F.lit(today).cast("date")
    state = F.when(F.col("effective") > now, "scheduled").when(F.col("after") <= now, "replaced").otherwise("in_force")
    out = shown.select("document", "version", "number", "effective", F.date_sub("after", 1).alias("until"), state.alias("state"), none("long", "flags"), none("long", "open"))
    if not drafts:
        return out
    own = versions.where("status = 'draft'").select("document", "version", "number", "effective")
    count = flags.groupBy("version").agg(F.count("*").alias("flags"), F.count_if(F.col("accepted").isNull() & F.col("resolved").isNull()).alias("open"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    added = own.join(count, "version", "left").select(
        "document", "version", "number", "effective", none("date", "until"), F.lit("draft").alias("state"), zero("flags"), zero("open")
    )
    return out.unionByName(added)
