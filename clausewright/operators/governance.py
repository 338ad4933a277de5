"""The governance log's hash chain, as columns and equi-joins: no window over the whole log, no single writer."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.session import cut

FIELDS = ["occurred_at", "actor", "token", "action", "target_type", "target_id", "details"]


def _field(value: Column) -> Column:
    size = F.unhex(F.lpad(F.hex(F.octet_length(value).cast("long")), 16, "0"))
    return F.concat(size, value)


def timestamp_text(at: Column) -> Column:
    """UTC, always six digits of a second's fraction."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def entry_hash(prev_hash: Column, *fields: Column, version: str = "1") -> Column:
    """Hex SHA-256 over version, prev_hash (binary) and the text fields, each behind its length in 8 bytes; null is empty."""
    text = [F.encode(F.coalesce(f, F.lit("")), "UTF-8") for f in fields]
    return F.sha2(F.concat(*[_field(f) for f in (F.encode(F.lit(version), "UTF-8"), prev_hash, *text)]), 256)


def verify(entries: DataFrame, genesis: str) -> DataFrame:
    """seq, problem for entries (seq, prev_hash, entry_hash, fields) that break the chain; none if it holds.

    altered: the fields don't give entry_hash. orphan: nothing has prev_hash (nor is it genesis).
    forked: several entries have the same predecessor. out_of_order: the predecessor comes later. Where
    none of these holds, the entries are one path from genesis in order of seq. Hashes are hex strings;
    every check is a map, a grouping or an equi-join on hashes, which are never skewed unless forked.
    """
    altered = entries.where(entry_hash(F.unhex("prev_hash"), *map(F.col, FIELDS)) != F.col("entry_hash")).select("seq", F.lit("altered").alias("problem"))
    own = entries.select("seq", "prev_hash")
    many = own.groupBy("prev_hash").agg(F.count("*").alias("n"), F.min("seq").alias("first")).where("n > 1")
    forked = own.join(many, "prev_hash").where("seq <> first").select("seq", F.lit("forked").alias("problem"))
    before = entries.groupBy(F.col("entry_hash").alias("prev_hash")).agg(F.min("seq").alias("before"))
    linked = own.where(F.col("prev_hash") != genesis).join(before, "prev_hash", "left")
    broken = linked.where("before is null or before >= seq").select("seq", F.when(F.col("before").isNull(), "orphan").otherwise("out_of_order").alias("problem"))
    return altered.unionByName(forked).unionByName(broken)


def manifest(entries: DataFrame) -> DataFrame:
    """An export's manifest: count, first and last seq, the last hash."""
    last = F.max(F.struct("seq", "entry_hash"))
    return entries.agg(F.count("*").alias("count"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), last["entry_hash"].alias("final_hash"))


def chained(entries: DataFrame, chain: str) -> DataFrame:
    """entries (``chain``, seq, FIELDS) with prev_hash and entry_hash (hex): each entry's predecessor is the one before it in its chain.

    The first predecessor is the SHA-256 of the chain's name. A chain is sequential by its nature: one chain is one
    group, held by one task as it is appended to by one writer; many chains run side by side.
    """
    columns = [chain, "seq", *FIELDS]
    schema = f"{chain} {entries.schema[chain].dataType.simpleString()}, seq long, prev_hash string, entry_hash string"

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        before, out = hashlib.sha256(str(rows[chain].iloc[0]).encode()).digest(), []
        for seq, *fields in zip(rows["seq"], *(rows[f] for f in FIELDS), strict=True):
            parts = [b"1", before, *("" if pd.isna(f) else f for f in fields)]
            data = b"".join(len(p).to_bytes(8, "big") + p for p in (x if isinstance(x, bytes) else x.encode() for x in parts))
            own = hashlib.sha256(data).digest()
            out.append((rows[chain].iloc[0], seq, before.hex(), own.hex()))
            before = own
        return pd.DataFrame(out, columns=[chain, "seq", "prev_hash", "entry_hash"])

    return entries.select(*columns).groupBy(chain).applyInPandas(link, schema)


def walked(entries: DataFrame, genesis: DataFrame) -> DataFrame:
    """chain, seq, turn: where each entry (chain, seq, prev_hash, entry_hash) stands on the way from its chain's genesis (chain, genesis), null if it doesn't.

    Entries that follow each other by seq as well are one run, found by a window; only runs are linked by an equi-join, and
    their pointers doubled with the steps they stand for: log n small joins of numbers, however many chains there are, for n
    runs. What still points on after that goes in a circle. Of entries that share a predecessor, the first is on the way.
    """
    own = W.partitionBy("chain", "prev_hash").orderBy("seq")
    first = entries.select("chain", "seq", "prev_hash", "entry_hash").withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")
    one = first.groupBy("chain", "entry_hash").agg(F.min(F.struct("seq", "prev_hash")).alias("e")).select("chain", "entry_hash", "e.seq", "e.prev_hash")
    by_seq = W.partitionBy("chain").orderBy("seq", "entry_hash")
    follows = F.coalesce(F.col("prev_hash") == F.lag("entry_hash").over(by_seq), F.lit(False))
    parted = one.withColumn("fresh", (~follows).cast("long")).withColumn("run", F.sum("fresh").over(by_seq.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy("chain", "run").orderBy("seq", "entry_hash")).cast("long")
    runs = cut(parted.select("chain", "seq", "entry_hash", "prev_hash", "run", place.alias("place")))
    # From a run's first entry to the first one of the run that holds its predecessor, or to something that is no entry (end).
    heads = runs.where("place = 1").select("chain", "run", F.col("prev_hash").alias("far"))
    held = runs.select("chain", F.col("entry_hash").alias("far"), F.col("run").alias("to"), F.col("place").alias("steps"))
    links = heads.join(held, ["chain", "far"], "left").select("chain", "run", "to", F.coalesce("steps", F.lit(1)).alias("steps"), F.when(F.col("to").isNull(), F.col("far")).alias("end"))
    links = cut(links)
    for _ in range(links.count().bit_length() + 1):
        if links.where("to is not null").isEmpty():
            break
        next_ = links.select("chain", F.col("run").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"), F.col("end").alias("there"))
        moved = links.where("to is not null").drop("end").join(next_, ["chain", "to"]).select("chain", "run", F.col("further").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("end"))
        links = cut(moved.unionByName(links.where("to is null")))
    started = links.where("to is null").join(genesis.select("chain", F.col("genesis").alias("end")), ["chain", "end"]).select("chain", "run", "steps")
    placed = runs.join(started, ["chain", "run"], "left").select("chain", "seq", (F.col("steps") + F.col("place") - 1).alias("turn"))
    return entries.select("chain", "seq").join(placed, ["chain", "seq"], "left")


def verified_chains(entries: DataFrame, genesis: DataFrame, known_versions: tuple[str, ...] = ("1",)) -> DataFrame:
    """chain, entries, bad_seq, reason, out_of_order of chains of entries (chain, seq, hash_version, prev_hash, entry_hash, FIELDS).

    The first thing that is wrong with a chain, in this order: by seq, an unknown version or an entry whose fields don't give its
    hash; two entries of one predecessor; the least entry that the way from genesis (chain, genesis) doesn't reach. reason is null
    where all of that holds; out_of_order then says whether the way is another order than that of seq. Null hashes are wrong ones.
    """
    right = F.coalesce(entry_hash(F.unhex("prev_hash"), *map(F.col, FIELDS)) == F.col("entry_hash"), F.lit(False))
    unknown = ~F.coalesce(F.col("hash_version").isin(*known_versions), F.lit(False))
    own = W.partitionBy("chain", "prev_hash").orderBy("seq")
    told = entries.withColumns({"broken": F.when(unknown, "unknown version").when(~right, "altered"), "again": F.row_number().over(own) > 1})
    way = walked(entries, genesis)
    each = told.select("chain", "seq", "broken", "again").join(way, ["chain", "seq"])
    # Turns have no gaps: the entry before is the one of the turn before.
    before = F.lag("seq").over(W.partitionBy("chain").orderBy(F.asc_nulls_first("turn")))
    each = each.withColumn("before", F.when(F.col("turn") > 1, before))
    least = lambda test, reason: F.min(F.when(test, F.struct("seq", reason.alias("reason"))))
    found = each.groupBy("chain").agg(
        F.count("*").alias("entries"), least(F.col("broken").isNotNull(), F.col("broken")).alias("a"), least(F.col("again"), F.lit("same predecessor")).alias("b"), least(F.col("turn").isNull(), F.lit("not linked")).alias("c"),
        F.count("turn").alias("reached"), F.coalesce(F.bool_or(F.col("before") > F.col("seq")), F.lit(False)).alias("mixed"),
    )
    unlinked = F.struct(F.col("c.seq").alias("seq"), F.when(F.col("reached") == 0, "wrong start").otherwise(F.col("c.reason")).alias("reason"))
    worst = F.coalesce("a", "b", F.when(F.col("c").isNotNull(), unlinked))
    return found.select("chain", "entries", worst["seq"].alias("bad_seq"), worst["reason"].alias("reason"), (F.col("mixed") & worst.isNull()).alias("out_of_order"))


def verify_exports(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """export, problem for exports that their manifest doesn't fit; none where all hold (``verify`` tells about the entries themselves).

    entries: export, seq, prev_hash, entry_hash; manifests: export, entries, anchored, genesis_hash, first_prev_hash,
    final_entry_hash. count: another number of entries; start: the first predecessor isn't the one named (genesis
    where anchored); end: the last hash is another.
    """
    ends = entries.groupBy("export").agg(
        F.count("*").alias("n"), F.min(F.struct("seq", "prev_hash"))["prev_hash"].alias("start"), F.max(F.struct("seq", "entry_hash"))["entry_hash"].alias("end"),
    )
    wanted = F.when(F.col("anchored"), F.col("genesis_hash")).otherwise(F.col("first_prev_hash"))
    both = manifests.join(ends, "export", "left")
    problem = (
        F.when(F.coalesce("n", F.lit(0)) != F.col("entries"), "count").when(F.col("n").isNull(), None).when(~F.col("start").eqNullSafe(wanted), "start")
        .when(F.col("end") != F.col("final_entry_hash"), "end")
    )
    return both.select("export", problem.alias("problem")).where("problem is not null")


def loaded(old: DataFrame, new: DataFrame) -> DataFrame:
    """document, version, outcome, number of releases new (document, version, source_ref) that old doesn't hold by source_ref.

    Newer ones than any of their document are loaded with the numbers that follow, in order; older ones are refused.
    """
    last = old.groupBy("document").agg(F.max("version").alias("last"), F.count("*").alias("n"))
    fresh = new.join(old.select("source_ref"), "source_ref", "left_anti").join(last, "document", "left")
    older = F.coalesce(F.col("version") < F.col("last"), F.lit(False))
    turn = F.row_number().over(W.partitionBy("document", older).orderBy("version"))
    return fresh.select("document", "version", F.when(older, "older").otherwise("loaded").alias("outcome"), F.when(~older, F.coalesce("n", F.lit(0)) + turn).alias("number"))


def entry_page(entries: DataFrame, users: DataFrame, tokens: DataFrame, limit: int, before: int | None = None) -> DataFrame:
    """The newest entries (seq, actor, actor_token, target_type, target, ...) first, at most limit of them below ``before``, with the names of whom they speak.

    users and tokens: id, name; a target is one of them by its target_type (user, token), its id being a number, else it has no
    name. Names are looked up for the page alone. total: of all entries, whatever the page; next_before: where the next page
    begins, null on the last. seq is unique; an empty page has no rows.
    """
    left = entries if before is None else entries.where(F.col("seq") < before)
    some = left.orderBy(F.desc("seq")).limit(limit + 1)
    # limit + 1 rows
    turn, n = F.row_number().over(W.orderBy(F.desc("seq"))), F.count("*").over(W.partitionBy())
    page = some.withColumns({"turn": turn, "n": n}).where(F.col("turn") <= limit)
    page = page.withColumn("next_before", F.when(F.col("n") > limit, F.min("seq").over(W.partitionBy()))).drop("n")
    aimed = lambda kind: F.when(F.col("target_type") == kind, F.col("target").try_cast("long"))
    page = page.withColumns({"target_user": aimed("user"), "target_token": aimed("token")})

    named = page
    for people, columns in ((users, ("actor", "target_user")), (tokens, ("actor_token", "target_token"))):
        asked = page.select(F.explode(F.array(*columns)).alias("id"))  # two a row of the page
        known = people.join(F.broadcast(asked), "id", "left_semi")
        for column in columns:
            named = named.join(F.broadcast(known.select(F.col("id").alias(column), F.col("name").alias(f"{column}_name"))), column, "left")
    return named.drop("target_user", "target_token").crossJoin(F.broadcast(entries.agg(F.count("*").alias("total"))))


def latest_of(entries: DataFrame, users: DataFrame, tokens: DataFrame, *actions: str) -> DataFrame:
    """The newest entry with one of these actions, as a page of one; no row if there is none."""
    return entry_page(entries.where(F.col("action").isin(*actions)), users, tokens, 1)
