"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key, scaled by its quality weight. A source's budget first takes the
source whole, as often as it fits (complete epochs); what is left of it goes to the documents of the
smallest keys, up to the budget (the fractional epoch). Sorting within a source is in two levels: sums of
words by cells of the keys' logarithm say in which cell the budget ends, and only that cell is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: A target is at most so many times its source's size.
MOST_EPOCHS = 3
#: Sources weigh 1 up to this number, in turn.
TURN = 3
#: Cells a unit of the keys' logarithm: a cell holds under 0.04 % of a source's documents, whatever they weigh.
CELLS = 1024
#: Sources of which up to so many rows (some 60 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_SOURCES = 500_000
SEED = 42
LEAST_WEIGHT = 0.05
_NOISE = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha())


def quality_weight(text: Column) -> Column:
    """Squared share of characters that are no ASCII digits or marks, at least LEAST_WEIGHT."""
    share = F.length(F.translate(text, _NOISE, "")) / F.nullif(F.length(text), F.lit(0))
    return F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(share * share, F.lit(0.0)))


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight with u uniform in (0, 1), fixed by seed, id and text."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name of sums, the sum over all rows before in the given total order.

    Rows are dealt in ranges of the order; totals of ranges, a row each, are added up before.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    per = ranged.groupBy("range").agg(*[F.sum(c).alias(f"in_{k}") for k, c in sums.items()])
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    base = per.select("range", *[F.coalesce(F.sum(f"in_{k}").over(earlier), F.lit(0)).alias(f"base_{k}") for k in sums])
    within = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(base), "range")
    return out.select(*df.columns, *[(F.col(f"base_{k}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(k) for k, c in sums.items()])


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of sizes (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3 in turn; a source over its bound gives its excess to the others.
    """
    turn = running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    weighed = turn.select("source", "source_size", (F.col("place") % TURN + 1).alias("weight"))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w"))
    # From the source that its bound holds soonest on: each is capped if its share of what the ones before leave is over its bound.
    soonest = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    met = running(weighed, soonest, {"gone": F.col("source_size") * MOST_EPOCHS, "by": F.col("weight")}).crossJoin(F.broadcast(total))
    bound = F.col("source_size") * MOST_EPOCHS
    capped = written(met.withColumn("capped", bound * (F.col("w") - F.col("by")) <= F.col("weight") * (F.col("t") - F.col("gone"))), "capped")
    left = capped.agg(
        (F.max("t") - F.sum(F.when(F.col("capped"), bound).otherwise(0))).alias("left"), (F.max("w") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0))).alias("among")
    )
    share = F.col("weight") * F.col("left").cast("double") / F.col("among")
    return capped.crossJoin(F.broadcast(left)).select("source", "source_size", F.when(F.col("capped"), bound.cast("double")).otherwise(share).alias("target"))


def _same_source(left: str, right: str) -> Column:
    return F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))


def mix(docs: DataFrame, weight: Column | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, extra, taken for every row of docs (doc_id, text, source).

    weight: a document's quality weight (a null or one that isn't positive counts as a millionth). epochs: how often
    the source is taken whole. extra: words from the fractional epoch: a document's size, or, for the one document of
    a source on which the budget ends, its first words only, so that a source gives its rounded target exactly.
    A null text has no words and is never drawn from; null ids and sources are values like others; repeated rows get
    keys of equal value and are each drawn for themselves; an empty table gives an empty result. Texts are read whole.
    Other columns aren't read.
    """
    weight = quality_weight(F.col("text")) if weight is None else weight
    weight = F.when(weight > 0, weight).otherwise(F.lit(1e-6))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = exponential_key(F.col("doc_id"), F.col("text"), weight, seed)
    slim = docs.select("doc_id", "source", size.alias("size"), key.alias("key"))
    slim = written(slim.withColumn("cell", F.floor((F.log("key") + 40) * CELLS)), "mix-keys")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.floor(F.col("target") + 0.5).cast("long")
    planned = targets(sizes).select(
        "*",
        F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(0).alias("epochs"),
        F.when(F.col("source_size") > 0, whole % F.col("source_size")).otherwise(0).alias("budget"),
    )
    planned = written(planned, "mix-targets")
    # The cell in which the budget ends, by the words of the cells before.
    cells = slim.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).alias("c")
    ends = cells.join(planned.alias("p"), _same_source("c", "p")).where("before < budget and before + words >= budget")
    ends = ends.select("p.source", F.col("cell").alias("last_cell"), "before").alias("e")
    known = planned.alias("p").join(ends, _same_source("p", "e"), "left").select("p.*", "last_cell", "before")
    known = written(known, "mix-ends")
    known = (F.broadcast(known) if known.count() <= BROADCAST_SOURCES else known).alias("k")
    rows = slim.alias("s").join(known, _same_source("s", "k")).select("s.*", "source_size", "target", "epochs", "budget", "last_cell", "before")
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs"]
    outside = rows.where("last_cell is null or cell <> last_cell")
    outside = outside.select(*columns, F.when(F.col("cell") < F.col("last_cell"), F.col("size")).otherwise(0).alias("extra"))
    by_key = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    room = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(by_key), F.lit(0))
    inside = rows.where("cell = last_cell").withColumn("extra", F.least("size", F.greatest(F.lit(0), room)))
    found = outside.unionByName(inside.select(*columns, "extra"))
    return found.withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))


def copies(mixed: DataFrame) -> DataFrame:
    """A row of mixed for each time that a document is taken: its epoch (from 1) and the words that it gives there."""
    times = F.sequence(F.lit(1), F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0))
    taken = mixed.where("taken > 0").withColumn("epoch", F.explode(times))
    return taken.withColumn("words", F.when(F.col("epoch") <= F.col("epochs"), F.col("size")).otherwise(F.col("extra")))


def op11_exponential_mix(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, repeats counted."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         length(translate(text, '{_NOISE.replace("'", "''")}', '')) / nullif(length(text), 0)::DOUBLE AS share,
         greatest({LEAST_WEIGHT}, coalesce(share * share, 0)) AS weight,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {TURN} + 1 AS weight FROM d GROUP BY source),
g AS (
  SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS w, coalesce(sum({MOST_EPOCHS} * source_size) OVER before, 0) AS gone, coalesce(sum(weight) OVER before, 0) AS gone_weight
  FROM s WINDOW before AS (ORDER BY source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, {MOST_EPOCHS} * source_size * (w - gone_weight) <= weight * (t - gone) AS capped FROM g),
l AS (
  SELECT max(t) - coalesce(sum({MOST_EPOCHS} * source_size) FILTER (capped), 0) AS remaining, max(w) - coalesce(sum(weight) FILTER (capped), 0) AS among FROM c),
p AS (
  SELECT source, source_size, CASE WHEN capped THEN ({MOST_EPOCHS} * source_size)::DOUBLE ELSE weight * remaining::DOUBLE / among END AS target FROM c, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS budget FROM p),
o AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target, (epochs * size + least(size, greatest(0, budget - before)))::BIGINT AS taken FROM o
"""
