"""Hybrid search in one call: each source ranked by itself by words, meaning and questions, fused, sources in turns, clauses around a match."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.operators import corpus as cp
from clausewright.operators import retrieval as rt
from clausewright.operators.search_index import Index
from clausewright.session import cut

#: Questions whose vectors every task holds at once.
QUESTION_BLOCK = 4096


def meaning_by_source(questions: DataFrame, vectors: DataFrame, limit: int = rt.CANDIDATES, block: int = QUESTION_BLOCK) -> DataFrame:
    """qid, source, key, score: the limit vectors (source, key, vector) of each source closest to each of questions (qid, vector).

    Exact cosine as matrix products, questions in blocks of a stated size against all rows; each batch hands on its best
    of each source only. Null and zero vectors, and those of another length, take no part.
    """
    numbered = questions.where("vector is not null").select("qid", "vector")
    blocks = max(1, -(-numbered.count() // block))
    kinds = {f.name: f.dataType.simpleString() for f in [*questions.schema, *vectors.schema]}
    schema = f"qid {kinds['qid']}, source {kinds['source']}, key {kinds['key']}, score double"
    found = None
    for b in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        best = vectors.where("vector is not null").select("source", "key", "vector").mapInPandas(_closest([(r.qid, r.vector) for r in rows], limit), schema)
        found = best if found is None else found.unionByName(best)
    order = W.partitionBy("qid", "source").orderBy(F.desc("score"), "key")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


def _closest(asked: list[tuple], limit: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.array([q for q, _ in asked])
        units = [np.asarray(v, np.float64) for _, v in asked]
        for rows in batches:
            for source, own in rows.groupby("source", dropna=False):
                for width, same in own.groupby(own["vector"].map(len)):
                    at = [i for i, u in enumerate(units) if len(u) == width and u.any()]
                    matrix = np.stack(same["vector"].to_list()).astype(np.float64)
                    sizes = np.sqrt((matrix * matrix).sum(axis=1))
                    kept = sizes > 0
                    if not at or not kept.any():
                        continue
                    keys, q = same["key"].to_numpy()[kept], np.stack([units[i] for i in at])
                    scores = np.round((matrix[kept] @ q.T) / sizes[kept][:, None] / np.sqrt((q * q).sum(axis=1))[None, :], 6)
                    n = min(limit, len(keys))
                    # All that tie with the last one of the batch's best are handed on: keys settle ties.
                    least = np.partition(scores, len(keys) - n, axis=0)[len(keys) - n]
                    key_at, question_at = np.nonzero(scores >= least[None, :])
                    named = pd.Series([None if pd.isna(source) else source] * len(key_at), dtype=object)
                    yield pd.DataFrame({"qid": ids[np.array(at)[question_at]], "source": named, "key": keys[key_at], "score": scores[key_at, question_at]})

    return find


def _listed(scores: DataFrame, retriever: str, order: list) -> DataFrame:
    """qid, source, retriever, key, score, rank: one row a key at its best text."""
    one = scores.groupBy("qid", "source", "key").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("qid", "source").orderBy(*order))
    return one.select("qid", "source", F.lit(retriever).alias("retriever"), "key", "score", rank.alias("rank"))


def expanded(found: DataFrame, nodes: DataFrame, expand: str) -> DataFrame:
    """found with ``around``: keys of the parent, or of the other clauses below it, in order of their places; empty for a root.

    nodes: key, parent (a key), place; those of the versions that are read. expand: none, parent or siblings.
    """
    if expand not in ("none", "parent", "siblings"):
        raise ValueError(f"expand is none, parent or siblings, not {expand!r}")
    if expand == "none":
        return found.withColumn("around", F.array().cast("array<string>"))
    own = found.select("key").distinct().join(nodes.select("key", "parent"), "key")
    if expand == "parent":
        near = own.join(nodes.select(F.col("key").alias("parent")).distinct(), "parent", "left_semi").select("key", F.array("parent").alias("around"))
    else:
        others = nodes.select("parent", F.col("key").alias("other"), "place")
        beside = own.join(others, "parent").where("other <> key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "other"))).alias("o"))
        near = beside.select("key", F.col("o.other").alias("around"))
    return found.join(near, "key", "left").withColumn("around", F.coalesce("around", F.array().cast("array<string>")))


def hybrid_search(
    questions: DataFrame, index: Index, vectors: DataFrame, texts: DataFrame, versions: DataFrame, nodes: DataFrame, day: str, *, today: str, limit: int = 10, packs: list[str] | None = None,
    policies: bool = True, normative_only: bool = False, fusion: str = "convex", asked: DataFrame | None = None, expand: str = "none", depth: int = rt.CANDIDATES,
    analyzers: dict[str, Callable[[Column], Column]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """qid, slot, source, key, score, ranks (by retriever), around: the clauses that answer questions (qid, text, lang, vector); and the index's report.

    lang null: the question's script says it. texts: text_id, key, lang, pack, kind, version, is_normative, pending,
    applies_until, body; only those that a reader may have on that day, in scope, are ranked. vectors: text_id, vector. asked:
    key, vector of search questions, which count for laws and only where day is today. A source is a pack, or all policies
    together. Within one: words and meaning are ranked to depth each, questions lift meaning, the two are fused; its strength is
    its best raw meaning or question score. Sources then take turns. Everything is done for all questions at once.
    """
    spoken = questions.select("qid", "text", F.coalesce("lang", rt.language_of(F.col("text"))).alias("lang"), "vector")
    source = F.when(F.col("kind") == "policy", F.lit(None)).otherwise(F.col("pack")).cast("string").alias("source")
    shown = cut(cp.readable(texts, versions, day, packs=packs, policies=policies, normative_only=normative_only).select("text_id", "key", "lang", source, "is_normative"))
    named = shown.select("text_id", "key", F.coalesce("source", F.lit("")).alias("source"))
    by_score = [F.desc("score"), F.asc("key")]
    words, report = index.search(spoken, depth, shown, analyzers)
    # Both the fusion and the ranks told read it: texts are scored once.
    keyword = cut(_listed(words.drop("source").join(named, "text_id"), "keyword", by_score))
    close = meaning_by_source(spoken, vectors.join(named, "text_id").select("source", F.col("text_id").alias("key"), "vector"), depth)
    meaning = cut(_listed(close.select("qid", F.col("key").alias("text_id"), "score").join(named, "text_id"), "meaning", by_score))
    lists = keyword.unionByName(meaning)
    strong = meaning
    if asked is not None and day == today:
        laws = shown.where("source is not null").select("key", "source").distinct()
        near = meaning_by_source(spoken, asked.join(laws, "key").select("source", "key", "vector"), depth)
        near = cut(_listed(near, "questions", by_score))
        strong = meaning.unionByName(near)
        both = strong.select(F.struct("qid", "source").alias("qid"), "retriever", "key", "score", "rank")
        lifted = rt.z_scores(both).groupBy("qid", "key").agg(F.max("z").alias("lifted"))
        alone = near.select(F.struct("qid", "source").alias("qid")).distinct().withColumn("blended", F.lit(True))
        plain = both.where("retriever = 'meaning'").select("qid", "key", "score")
        # Where a source has no near questions, its meaning list stays as it is.
        mixed = lifted.join(plain, ["qid", "key"], "left").join(alone, "qid", "left")
        score = F.when(F.col("blended"), F.round("lifted", 5)).otherwise(F.col("score"))
        blended = mixed.select("qid.qid", "qid.source", F.lit("meaning").alias("retriever"), "key", score.alias("score"), F.lit(0).alias("rank"))
        lists = keyword.unionByName(blended)
        own_rank = F.row_number().over(W.partitionBy("qid", "source", "retriever").orderBy(*by_score))
        lists = lists.withColumn("rank", own_rank)
    grouped = lists.select(F.struct("qid", "source").alias("qid"), "retriever", "key", "score", "rank")
    fused = rt.fusion(fusion)(grouped)
    ranked = rt.ranked(fused, 1 << 30).select("qid.qid", "qid.source", "key", "score", "rank")
    strength = strong.groupBy("qid", "source").agg(F.max("score").alias("strength"))
    normative = shown.groupBy("key").agg(F.max("is_normative").alias("is_normative"))
    candidates = ranked.join(strength, ["qid", "source"], "left").join(normative, "key").select(
        "qid", "source", "key", "score", "rank", F.coalesce("strength", F.lit(0.0)).alias("strength"), (F.col("source") == "").alias("is_policy"), "is_normative"
    )
    turned = rt.in_turns(cut(candidates), limit)
    placed = keyword.unionByName(strong) if strong is not meaning else keyword.unionByName(meaning)
    ranks = placed.groupBy("qid", "source", "key").agg(*[F.max(F.when(F.col("retriever") == r, F.col("rank"))).alias(f"{r}_rank") for r in ("keyword", "meaning", "questions")])
    out = turned.join(ranks, ["qid", "source", "key"], "left")
    around = expanded(out, nodes, expand)
    ranked_by = F.struct("keyword_rank", "meaning_rank", "questions_rank").alias("ranks")
    return around.select("qid", "slot", F.nullif("source", F.lit("")).alias("source"), "key", "score", ranked_by, "around"), report
