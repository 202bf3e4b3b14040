"""The hash chain against a plain sequential one, and every way of tampering with it."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from intakeforge.operators import audit


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_chain(payloads: list[str], block: int) -> list[str]:
    out, seed = [], audit.GENESIS
    for k in range(0, len(payloads), block):
        last = seed
        for p in payloads[k : k + block]:
            last = digest(last + p)
            out.append(last)
        seed = digest(seed + digest("".join(payloads[k : k + block])))
    return out


def entries(spark):  # noqa: ANN001, ANN201
    rows = [(i, "ab"[i % 2], f"text {i}" if i % 5 else None, "é" * (i % 3)) for i in range(41)] + [(99, None, "alone", "")]
    return spark.createDataFrame(rows, "id long, span string, a string, b string")


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_chain_is_the_sequential_one(spark, block: int) -> None:  # noqa: ANN001
    got = audit.chain(entries(spark), "id", ["a", "b"], "span", block).orderBy("id").collect()
    assert len(got) == 42
    for span in ("a", "b", None):
        own = [r for r in got if r.span == span]
        assert [r.hash for r in own] == plain_chain([r.payload for r in own], block)
    assert audit.broken_entries(audit.chain(entries(spark), "id", ["a", "b"], "span", block), "id", ["a", "b"], "span", block).count() == 0


@pytest.mark.parametrize("block", [4, 1000])
def test_tampering_shows(spark, block: int) -> None:  # noqa: ANN001
    chained = audit.chain(entries(spark), "id", ["a", "b"], "span", block)
    anchors = audit.chain_heads(chained, "id", "span")
    reasons = lambda df: {r.id: r.reason for r in audit.broken_entries(df, "id", ["a", "b"], "span", block).collect()}
    changed = F.when(F.col("id") == 10, "forged").otherwise(F.col("a"))
    assert reasons(chained.withColumn("a", changed)) == {10: "payload"}
    # Changed with its own hash renewed: the entry after it does not follow any more.
    renewed = chained.withColumn("a", changed).withColumn("payload", audit.payload_hash(["a", "b"])).withColumn("hash", F.when(F.col("id") == 10, audit.link_hash(F.col("previous"), F.col("payload"))).otherwise(F.col("hash")))
    assert min(i for i, r in reasons(renewed).items() if r == "previous") == 12
    assert 12 in reasons(chained.filter("id <> 10"))
    # Everything after it renewed too: only the anchored head tells.
    forged = audit.chain(entries(spark).withColumn("a", changed), "id", ["a", "b"], "span", block)
    assert reasons(forged) == {}
    moved = lambda df: {r.span: r.reason for r in audit.moved_heads(audit.chain_heads(df, "id", "span"), anchors, "span").collect()}
    assert moved(forged) == {"a": "other"} and moved(chained) == {}
    assert moved(chained.filter("id < 40")) == {"a": "shorter", None: "shorter"}
    assert audit.chain(entries(spark).limit(0), "id", ["a"], "span").count() == 0
