"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

A term's list holds its documents by falling impact (what one query term of weight 1 gives them). First the
heads of the lists are fetched and their documents scored, which bounds each query's k-th best score from
below. No document can reach that bound with less than an equal part of it in every list; so, second, each
list sends what is at or over that part, and upper bounds drop candidates. Third, the exact scores of the
candidates that are left are looked up in the documents' slices.

A frequent word's list is no single group: it is kept in runs, one for each slice of up to SLICE_DOCS documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.llm.shared import tidy, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents, and postings of query terms, that close a slice.
SLICE_DOCS, SLICE_POSTINGS = 4096, 1_000_000
#: Entries of a list's head.
HEAD = 20
#: Queries are answered in blocks of about so many (query, term) pairs; a block's pairs are known to every task.
BLOCK_TERMS = 200_000
#: UTF-8 bytes: A-Z to a-z, what belongs to no term to a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_SLICE = "slice long, doc_ids array<long>, n array<int>, terms array<int>, starts array<int>, docs array<int>, tfs array<int>"
_LISTS = "term int, slice long, docs array<int>, impacts array<long>"
_ARROW = pa.schema([("term", pa.int32()), ("slice", pa.int64()), ("docs", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64()))])


def query_terms(items: DataFrame) -> DataFrame:
    """query (a number of its own for each row of items), item_id, term, repeats."""
    own = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))
    numbered = written(items.select("item_id", own.alias("own")).withColumn("query", F.monotonically_increasing_id()), "queries")
    each = numbered.select("query", "item_id", F.explode("own").alias("term"))
    return written(each.groupBy("query", "item_id", "term").agg(F.count("*").alias("repeats")), "query-terms")


def _slices(number: dict[bytes, int]):
    """Documents of at least one term, in slices: their lengths, and where and how often they hold numbered terms, by term."""

    def build(batches):
        first, made = TaskContext.get().partitionId() << 33, 0
        rows: list[tuple] = []
        held = 0

        def closed():
            terms = np.concatenate([np.fromiter((number[w] for w in c), np.int32, len(c)) for _, _, c in rows])
            tfs = np.concatenate([np.fromiter(c.values(), np.int32, len(c)) for _, _, c in rows])
            docs = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for _, _, c in rows])
            by_term = np.lexsort((docs, terms))
            kept, starts = np.unique(terms[by_term], return_index=True)
            columns = [[first + made], [[x[0] for x in rows]], [[x[1] for x in rows]], [kept], [starts.astype(np.int32)], [docs[by_term]], [tfs[by_term]]]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SLICE.split(", ")])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = (text.as_py() or b"").translate(_BYTES).split()
                if not words:
                    continue
                counts = Counter(filter(number.__contains__, words))
                rows.append((doc_id, len(words), counts))
                held += len(counts)
                if len(rows) >= SLICE_DOCS or held >= SLICE_POSTINGS:
                    yield closed()
                    made, held, rows = made + 1, 0, []
        if rows:
            yield closed()

    return tidy(build)


def _impacts(tfs, docs, lengths, n_docs: int, n_terms: int):
    length = 75 + (25 * lengths.astype(np.int64) * n_docs) // n_terms
    tfs = tfs.astype(np.int64)
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * length[docs])


def _term_lists(n_docs: int, n_terms: int):
    """The runs of lists that a slice holds, each by falling impact."""

    def build(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                number, lengths, terms, starts, docs, tfs = (batch.column(c)[row] for c in ("slice", "n", "terms", "starts", "docs", "tfs"))
                lengths, terms, starts, docs, tfs = (x.values.to_numpy(zero_copy_only=False) for x in (lengths, terms, starts, docs, tfs))
                if not len(terms):
                    continue
                impacts = _impacts(tfs, docs, lengths, n_docs, n_terms)
                order = np.lexsort((docs, -impacts, np.repeat(terms, np.diff(np.append(starts, len(docs))))))
                offsets = pa.array(np.append(starts, len(docs)).astype(np.int32))
                runs = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (docs.astype(np.int32), impacts)]
                yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(np.full(len(terms), number.as_py())), *runs], schema=_ARROW)

    return tidy(build)


def _over(least: dict[int, int]):
    """The heads of runs down to the least impact that a query asks for."""

    def cut(batches):
        for batch in batches:
            terms, ends = batch.column("term").to_pylist(), batch.column("impacts").offsets.to_numpy()
            impacts, docs = batch.column("impacts").values.to_numpy(), batch.column("docs").values.to_numpy()
            asked = np.array([least.get(t, 1 << 62) for t in terms], np.int64)
            kept = impacts >= np.repeat(asked, np.diff(ends)) if len(terms) else np.zeros(0, bool)
            kept = np.concatenate([np.zeros(ends[0], bool), kept, np.zeros(len(impacts) - ends[-1], bool)]) if len(terms) else kept
            counts = np.concatenate([[0], np.cumsum(kept)])[ends]
            some = np.flatnonzero(np.diff(counts))
            offsets = pa.array(np.append(counts[some], counts[-1]).astype(np.int32) - np.int32(counts[0]))
            runs = [pa.ListArray.from_arrays(offsets, pa.array(x[kept])) for x in (docs, impacts)]
            yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(some)), batch.column("slice").take(pa.array(some)), *runs], schema=_ARROW)

    return tidy(cut)


def _candidates(queries: dict[int, list[tuple[int, int]]], bound: dict[int, int], highest: dict[int, int], k: int):
    """Documents of a slice that may be among a query's k best, by what its lists sent."""

    def find(runs: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(runs["term"], zip(runs["docs"], runs["impacts"], strict=True), strict=True))
        size, out = 1 + max(int(d.max()) for d in runs["docs"]), []
        for query, terms in queries.items():
            floor, partial, reach = bound[query], np.zeros(size, np.int64), np.zeros(size, np.int64)
            rest = 0
            for term, weight in terms:
                # What an entry that wasn't sent can give at most.
                unsent = min(weight * highest[term], max(0, (floor - 1) // len(terms)))
                rest += unsent
                if term in of:
                    docs, impacts = of[term]
                    given = weight * impacts
                    sent = docs[given * len(terms) >= floor]
                    partial[sent] += given[: len(sent)]
                    reach[sent] += given[: len(sent)] - unsent
            met = np.flatnonzero(partial)
            if len(met) > k:
                floor = max(floor, int(np.partition(partial[met], -k)[-k]))
            left = met[reach[met] + rest >= floor]
            if len(left):
                out.append((runs["slice"].iloc[0], query, left.astype(np.int32)))
        return pd.DataFrame(out, columns=["slice", "query", "docs"])

    return find


def _exact(queries: dict[int, list[tuple[int, int]]], n_docs: int, n_terms: int, k: int):
    """The k best of a slice's candidates for each query, by their exact scores."""

    def score(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            ids = pd.array(row.doc_ids, dtype="Int64")
            impacts = _impacts(row.tfs, row.docs, np.asarray(row.n), n_docs, n_terms)
            ends = np.append(row.starts, len(row.docs))
            of = {t: (row.docs[a:b], impacts[a:b]) for t, a, b in zip(row.terms, ends, ends[1:], strict=False)}
            for query, docs in zip(asked["query"], asked["docs"], strict=True):
                total = np.zeros(len(row.n), np.int64)
                for term, weight in queries[query]:
                    if term in of:
                        total[of[term][0]] += weight * of[term][1]
                best = pd.DataFrame({"doc_id": ids[docs], "score": total[docs]})
                best = best[best["score"] > 0].sort_values(["score", "doc_id"], ascending=[False, True]).head(k)
                out.append(best.assign(query=query))
        return pd.concat(out)[["query", "doc_id", "score"]] if out else pd.DataFrame({"query": [], "doc_id": [], "score": []})

    return score


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """query, rank, doc_id, score for a block of queries (query, term, repeats), whose pairs every task holds."""
    pairs = [tuple(r) for r in terms.select("query", "term", "repeats").collect()]
    number = {t: i for i, t in enumerate(sorted({t for _, t, _ in pairs}))}
    slices = written(docs.select("doc_id", "text").mapInArrow(_slices({t.encode(): i for t, i in number.items()}), _SLICE), "search-slices")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n_docs, n_terms = slices.agg(total(F.size("n")), total(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_terms = n_terms or 1
    lists = slices.mapInArrow(_term_lists(n_docs, n_terms), _LISTS)
    lists = written(lists.repartitionByRange("term", "slice").sortWithinPartitions("term", "slice"), "search-lists")
    held = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(F.col("impacts")[0]).alias("highest")).collect()
    weigh = {r.term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in held}
    highest = {r.term: r.highest for r in held}
    queries: dict[int, list[tuple[int, int]]] = {}
    for query, term, repeats in pairs:
        if weigh.get(number[term], 0) > 0:
            queries.setdefault(query, []).append((number[term], repeats * weigh[number[term]]))
    lookup = lambda asked: (
        asked.groupBy("slice").cogroup(slices.groupBy("slice")).applyInPandas(_exact(queries, n_docs, n_terms, k), "query long, doc_id long, score long")
    )
    # Phase 1: heads, and the k-th best of their documents.
    spark = docs.sparkSession
    asking = spark.createDataFrame([(q, t) for q, own in queries.items() for t, _ in own], "query long, term int")
    top = lists.select("term", "slice", F.explode(F.arrays_zip(F.slice("docs", 1, HEAD).alias("doc"), F.slice("impacts", 1, HEAD).alias("impact"))).alias("e"))
    by_impact = W.partitionBy("term").orderBy(F.desc("e.impact"), "slice", "e.doc")
    heads = top.withColumn("place", F.row_number().over(by_impact)).where(F.col("place") <= HEAD).select("term", "slice", "e.doc")
    heads = heads.join(asking, "term").groupBy("slice", "query").agg(F.collect_set("doc").alias("docs"))
    kth = _ranked(lookup(heads), k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
    bound = dict.fromkeys(queries, 0) | {r["query"]: r["score"] for r in kth.collect()}
    # Phase 2: what is at or over an equal part of that in each list.
    least: dict[int, int] = {}
    for query, own in queries.items():
        for term, weight in own:
            part = -(-bound[query] // (len(own) * weight))
            least[term] = min(least.get(term, part), part)
    sent = lists.mapInArrow(_over(least), _LISTS)
    kept = sent.groupBy("slice").applyInPandas(_candidates(queries, bound, highest, k), "slice long, query long, docs array<int>")
    # Phase 3: exact scores of the candidates.
    return _ranked(lookup(kept), k).select("query", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of docs (doc_id, text) for each row of items (item_id, text).

    Null texts and texts without terms are in no list and ask for nothing. Equal scores go by id, null ids last; rows
    of one id are ranked each. Repeated items are answered each. Fewer than k documents that share a term of any weight:
    all of them. Texts are read whole. Empty tables give an empty result. Other columns aren't read. Queries of any
    number are answered in blocks; every block reads the documents once.
    """
    terms = query_terms(items)
    blocks = max(1, -(-terms.count() // block_terms))
    found = None
    for b in range(blocks):
        own = search_block(docs, terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), k)
        found = own if found is None else found.unionByName(own)
    names = terms.select("query", "item_id").distinct()
    return found.join(names, "query").select("item_id", "rank", "doc_id", "score")


def op13_threshold_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH q AS (
  SELECT query, item_id, term, count(*) AS repeats
  FROM (SELECT query, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS query, * FROM benchmark))
  GROUP BY ALL),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
t AS (
  SELECT query, item_id, doc_id, rid, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (rid), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM t WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
