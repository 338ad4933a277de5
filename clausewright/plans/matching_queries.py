"""Versions compared, on parts (short texts by brand) and lineitem (clauses in three versions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.operators import matching as mt
from clausewright.plans.catalog import query
from clausewright.plans.corpus_queries import _CLAUSES, _clauses
from clausewright.session import cut, table


def _two_versions(spark, sf_dir):
    i, text = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type", (F.col("p_partkey") % 97).cast("string"), (F.col("p_size") % 7).cast("string"))
    p = table(spark, sf_dir, "part").withColumn("document", F.col("p_brand"))
    earlier = p.where(i % 13 != 0).select("document", i.alias("earlier_id"), F.concat(F.lit("r-"), i.cast("string")).alias("key"), i.alias("place"), mt.words(F.lit(None).cast("string"), text).alias("words"))
    worded = F.when(i % 5 == 0, F.concat(text, F.lit(" as amended"))).when(i % 17 == 0, F.lit("wholly new words")).otherwise(text)
    key = F.concat(F.lit("r-"), (i + F.when(i % 7 == 0, 100_000).otherwise(0)).cast("string"))
    later = p.where(i % 11 != 0).select("document", key.alias("key"), i.alias("place"), mt.words(F.lit(None).cast("string"), worded).alias("words"))
    return earlier, later


@query("vr2_matched_versions")
def matched_versions(spark, sf_dir):
    """VR1, VR2, JN9: what each clause of a new version continues; the tests hold it to a plain loop."""
    return mt.match(*_two_versions(spark, sf_dir))


@query("vr3_questions")
def middling_pairs(spark, sf_dir):
    """VR3, VR8: pairs to ask a reviewer about, with how many words they share; held to a plain loop by the tests."""
    earlier, later = _two_versions(spark, sf_dir)
    found = mt.questions(cut(mt.match(earlier, later)), earlier, later)
    return found.withColumn("band", mt.band(F.col("score")))


@query("vr4_reused_keys")
def reused_keys(spark, sf_dir):
    """VR4: keys that name another clause than before; held to a plain loop by the tests."""
    earlier, later = _two_versions(spark, sf_dir)
    return mt.reused(cut(mt.match(earlier, later)), earlier)


@query("ag16_change_counts")
def change_counts(spark, sf_dir):
    """AG16: changes of each document by kind; held to a plain loop by the tests."""
    return mt.change_counts(mt.match(*_two_versions(spark, sf_dir)))


@query("vr7_word_differences")
def word_differences(spark, sf_dir):
    """VR7: words kept, removed and added; the tests read both texts back out of them."""
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    after = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_brand")).otherwise(F.concat(text, F.lit(", amended.")))
    found = mt.differences(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), text.alias("before"), after.alias("after")))
    return found.select("key", F.array_join(F.transform("changes", lambda c: F.concat(F.substring(c["change"], 1, 1), F.lit(":"), c["text"])), " ").alias("changes"))


_CHAINS = f"""{_CLAUSES}, u AS (SELECT version, key, ((key // 10) * 1000000000 + id) * 4 + version AS uid, CASE WHEN previous_id IS NOT NULL THEN ((key // 10) * 1000000000 + id) * 4 + version - 1 END AS prev FROM clauses),
c AS (SELECT u.version, u.key, u.uid, p.uid AS prev FROM u LEFT JOIN u p ON p.uid = u.prev),
o AS (SELECT c.version, c.key, coalesce(p.prev, p.uid, c.uid) AS origin FROM c LEFT JOIN c p ON p.uid = c.prev)"""


def _chains(spark, sf_dir):
    uid = (F.floor(F.col("key") / 10) * 1_000_000_000 + F.col("id")) * 4 + F.col("version")
    rows = cut(_clauses(spark, sf_dir).select("version", "key", uid.alias("id"), F.when(F.col("previous_id").isNotNull(), uid - 1).alias("previous")))
    known = rows.select(F.col("id").alias("previous"), F.col("id").alias("previous_id"))
    return mt.chained(rows.join(known, "previous", "left").select("version", "key", "id", "previous_id"))


@query(
    "vr5_compared_versions",
    f"""WITH {_CHAINS}, a AS (SELECT origin, key AS old_key FROM o WHERE version = 1), b AS (SELECT origin, key AS new_key FROM o WHERE version = 3)
    SELECT coalesce(a.origin, b.origin) AS origin, old_key, new_key, CASE WHEN old_key IS NULL THEN 'added' WHEN new_key IS NULL THEN 'removed' WHEN old_key <> new_key THEN 'moved' ELSE 'same_place' END AS change FROM a FULL JOIN b ON a.origin = b.origin""",
)
def compared_versions(spark, sf_dir):
    """VR5: the first and the third version, by way of the second."""
    return mt.compared(_chains(spark, sf_dir), 1, 3)


@query(
    "tr4_continued_to_today",
    f"""WITH {_CHAINS}, now AS (SELECT origin, key AS today FROM o WHERE version = 3) SELECT o.version, o.key, today, coalesce(today <> o.key, false) AS moved FROM o LEFT JOIN now USING (origin) WHERE o.version < 3""",
)
def continued_to_today(spark, sf_dir):
    """TR4: where a clause of an old version stands today; null once it is lost."""
    chains = cut(_chains(spark, sf_dir))
    now = chains.where("version = 3").select("origin", F.col("key").alias("today"))
    return chains.where("version < 3").join(now, "origin", "left").select("version", "key", "today", F.coalesce(F.col("today") != F.col("key"), F.lit(False)).alias("moved"))
