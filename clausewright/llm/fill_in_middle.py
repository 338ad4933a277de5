"""Fill-in-middle by an index of distinct texts.

Documents of identical text are grouped, once by digest and then by the text itself. For each distinct text
the ends of its units are listed once, as an Elias-Fano list; back at its documents, each seeded cut is two
selects in that list.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Units: whitespace with the word that it leads to, or whitespace alone.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SEED = 42
#: Of 100 documents, so many are transformed, and of 100 transformed ones, so many put the suffix first.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of one text that an index row holds at most (in expectation), or a 100,000th of all, if that is more.
GROUP_DOCS, MOST_GROUPS = 10_000, 100_000
_HEADER = struct.Struct("<QQ")


def _low_bits(n: int, universe: int) -> int:
    return max(0, (universe // n).bit_length() - 1) if n else 0


def elias_fano(values: np.ndarray, universe: int) -> bytes:
    """An ascending list of integers below or at universe: low bits packed, high bits in unary."""
    n, low = len(values), _low_bits(len(values), universe)
    lows = (values[:, None] >> np.arange(low)) & 1
    high = np.zeros(n + (universe >> low) + 1, np.uint8)
    high[(values >> low) + np.arange(n)] = 1
    packed = [np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes() for x in (lows, high)]
    return _HEADER.pack(n, universe) + b"".join(packed)


def selected(packed: bytes, i: int) -> int:
    """The i-th value (from 0) of an Elias-Fano list."""
    n, universe = _HEADER.unpack_from(packed)
    low = _low_bits(n, universe)
    lows = (n * low + 7) // 8
    high = np.frombuffer(packed, np.uint8, offset=_HEADER.size + lows)
    ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    byte = int(np.searchsorted(ones, i + 1))
    left = i - (int(ones[byte - 1]) if byte else 0)
    place = 8 * byte + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))[left])
    first, last = i * low // 8, (i * low + low + 7) // 8
    bits = int.from_bytes(packed[_HEADER.size + first : _HEADER.size + last], "little") >> (i * low % 8)
    return (place - i) << low | bits & ((1 << low) - 1)


def unit_ends(text: str) -> np.ndarray:
    """Where the units of a text end, in code points."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    after = np.append(blank[1:], True)
    ends = np.flatnonzero(~blank & after) + 1
    return np.append(ends, len(points)) if len(points) and blank[-1] else ends


def _boundary_lists(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        ends = unit_ends(text)
        out.append((len(ends), elias_fano(ends, len(text))))
    return pd.DataFrame(out, columns=["n", "ends"])


def _ends_at(lists: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([selected(x, i - 1) if i else 0 for x, i in zip(lists, at, strict=True)], dtype="int64")


def text_index(docs: DataFrame) -> DataFrame:
    """text, ids (array of struct doc_id), units (n, ends): a row for each distinct text of docs.

    Texts meet by SHA-256 and are then compared as they are: two different ones of equal digest are an error. A text of
    very many documents has several rows, each with a bounded part of them.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    most = max(GROUP_DOCS, docs.count() // MOST_GROUPS)
    # At most MOST_GROUPS digests have more documents than that, so they can be broadcast.
    hot = rows.groupBy("digest").count().where(F.col("count") > most).select("digest", F.ceil(F.col("count") / most).alias("parts"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(0)
    dealt = rows.join(F.broadcast(hot), "digest", "left").select("digest", part.alias("part"), "doc_id", "text")
    groups = dealt.groupBy("digest", "part").agg(F.collect_set("text").alias("texts"), F.collect_list(F.struct("doc_id")).alias("ids"))
    text = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.lit("different texts of one SHA-256")))
    lists = F.pandas_udf(_boundary_lists, StructType([StructField("n", LongType()), StructField("ends", BinaryType())]))
    return groups.select(text.alias("text"), "ids").withColumn("units", lists("text"))


def _drawn(doc_id: Column, i: int) -> Column:
    """The i-th number (from 0) that seed and id give."""
    hexed = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, output for every row of docs (doc_id, text).

    A null text is an empty one, which stays plain, as do texts that hold a sentinel; a null id draws as an empty one.
    Repeated rows and copies are each cut for themselves, by their ids. Texts are read whole. An empty table gives an
    empty result. Other columns aren't read.
    """
    each = text_index(docs).select("text", "units", F.explode("ids").alias("id")).select("text", "units", "id.doc_id")
    n = F.col("units.n")
    one, other = (_drawn(F.col("doc_id"), i) % (n + 1) for i in (0, 1))
    holds = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | holds | (_drawn(F.col("doc_id"), 2) % 100 >= RATE)
    form = F.when(plain, "plain").when(_drawn(F.col("doc_id"), 3) % 100 < SPM_RATE, "spm").otherwise("psm")
    cuts = each.select("doc_id", "text", "units", n.alias("n"), form.alias("form"), F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))
    end = F.pandas_udf(_ends_at, LongType())
    at = lambda c: end(F.col("units.ends"), F.when(F.col("form") == "plain", 0).otherwise(F.col(c)).cast("long"))
    cuts = cuts.withColumns({"first": at("a"), "second": at("b")})
    prefix = F.substr("text", F.lit(1), F.col("first").cast("int"))
    middle = F.substr("text", (F.col("first") + 1).cast("int"), (F.col("second") - F.col("first")).cast("int"))
    suffix = F.substr("text", (F.col("second") + 1).cast("int"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut = F.col("form") != "plain"
    return cuts.select(
        "doc_id", "text", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"),
        F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made from."""
    _, first, second, third = (F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}"), F.lit(i)) for i in range(4))
    psm, spm = F.concat(first, third, second), F.concat(second, third, first)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_boundary_index(spark, sf_dir: str) -> DataFrame:
    """Every document cut for filling in the middle, and what is rebuilt from that."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
r AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 :], '') AS suffix
  FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
