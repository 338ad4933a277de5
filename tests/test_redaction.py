"""Redaction against worked cases, the hash chain against an altered entry."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from clausewright.functions import redaction as rd
from clausewright.operators import governance as gv

CASES = [
    (None, None, []),
    ("", "", []),
    ("write to a.b+c@law.example, please", "write to [redacted:email], please", ["email"]),
    ("card 4111 1111 1111 1111 now", "card [redacted:card] now", ["card"]),
    ("iban GB82WEST12345698765432 ok", "iban [redacted:iban] ok", ["iban"]),
    ("iban GB83WEST12345698765432 ok", "iban GB83WEST12345698765432 ok", []),
    ("id 784-1234-1234567-1", "id [redacted:emirates_id]", ["emirates_id"]),
    ("call +971 50 123 4567 today", "call [redacted:phone] today", ["phone"]),
    ("version 5.2.1 of 2018", "version 5.2.1 of 2018", []),
    ("ticket T-77 of x@y.example", "ticket [redacted:ticket] of [redacted:email]", ["ticket", "email"]),
]


def test_redaction(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    found = {r.i: r.r for r in rows.select("i", rd.redact(F.col("text"), {"ticket": r"T-\d+"}).alias("r")).collect()}
    for i, (_, text, types) in enumerate(CASES):
        assert found[i].text == text
        assert list(found[i].types) == types


def test_custom_patterns_are_checked(spark):
    for name, pattern in (("a b", "x"), ("x", "y*"), ("x", "y" * 201)):
        with pytest.raises(ValueError):
            rd.redact(F.lit("x"), {name: pattern})


def test_chain(spark):
    def digest(prev, *fields):
        data = b"".join(len(f).to_bytes(8, "big") + f for f in (b"1", prev, *[x.encode() for x in fields]))
        return sha256(data).hexdigest()

    prev, rows = sha256(b"instance").hexdigest(), []
    genesis = prev
    for seq in range(1, 30):
        fields = [f"t{seq}", "", "", "a", "b", "ü", "{}"]
        own = digest(bytes.fromhex(prev), *fields)
        rows.append((seq, prev, own, *[f or None for f in fields]))
        prev = own
    schema = "seq int, prev_hash string, entry_hash string, " + ", ".join(f"{f} string" for f in gv.FIELDS)
    good = spark.createDataFrame(rows, schema)
    assert gv.verify(good, genesis).count() == 0
    altered = good.withColumn("action", F.when(F.col("seq") == 7, "other").otherwise(F.col("action")))
    assert [(r.seq, r.problem) for r in gv.verify(altered, genesis).collect()] == [(7, "altered")]
    assert [(r.seq, r.problem) for r in gv.verify(good.where("seq <> 9"), genesis).collect()] == [(10, "orphan")]
