"""Append-only logs: a hash chain over entries, its verification, and counts of distinct actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def actor_key(c: Column) -> Column:
    """An actor without case and outer or repeated spaces."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^ | $", "")), F.lit(""))


def payload_hash(fields: list[str]) -> Column:
    """SHA-256 over the fields in order, NULLs told apart from empty text and lengths kept, so that no two rows run together."""
    part = lambda f: F.coalesce(F.concat(F.length(F.col(f).cast("string")).cast("string"), F.lit(":"), F.col(f).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", *[part(f) for f in fields]), 256)


def link_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, payload), 256)


def _fold(first: Column, payloads: Column) -> Column:
    """The hash after each payload of an array, in order: hash to hash, from ``first`` on."""
    none = F.array().cast("array<string>")
    step = lambda acc, p: F.struct(link_hash(acc["last"], p).alias("last"), F.array_append(acc["out"], link_hash(acc["last"], p)).alias("out"))
    return F.aggregate(payloads, F.struct(first.alias("last"), none.alias("out")), step, lambda acc: acc["out"])


BLOCK = 1024


def _block_seeds(payloads: DataFrame, span: str) -> DataFrame:
    """(span, block, seed): the hash from which each block of entries starts, over the digests of all blocks before it.

    ``payloads``: span, block and the array of its payloads in order. A span holds one digest per block here.
    """
    digest = payloads.select(span, "block", F.sha2(F.array_join("payloads", ""), 256).alias("digest"))
    per = digest.groupBy(span).agg(F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("blocks"))
    seeds = F.concat(F.array(F.lit(GENESIS)), _fold(F.lit(GENESIS), F.transform("blocks", lambda b: b["digest"])))
    per = per.withColumn("seeds", seeds)
    return per.select(span, F.explode(F.transform("blocks", lambda b, i: F.struct(b["block"].alias("block"), F.get("seeds", i).alias("seed")))).alias("x")).select(span, "x.block", "x.seed")


def _placed(entries: DataFrame, id_: str, span: str, block: int) -> DataFrame:
    """Adds the block and the place of each entry in its span, by id."""
    w = Window.partitionBy(span).orderBy(id_)
    at = F.row_number().over(w) - 1
    return entries.withColumn("_at", at).withColumn("_block", F.floor(F.col("_at") / block))


def chain(entries: DataFrame, id_: str, fields: list[str], span: str, block: int = BLOCK) -> DataFrame:
    """Entries with payload, previous and own hash: each hash covers all entries of its ``span`` up to it.

    Within a block of entries the hashes are chained one by one; a block starts from a hash over the digests of all blocks
    before it. So a span of any length is chained block by block beside each other, and a changed entry changes the head. With
    up to ``block`` entries this is the plain chain from the genesis hash. Ids are expected to be unique in a span.
    """
    p = _placed(entries.withColumn("payload", payload_hash(fields)), id_, span, block)
    packed = p.groupBy(F.col(span).alias("_span"), F.col("_block").alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), "payload"))).alias("e")).select("_span", "block", F.transform("e", lambda x: x["payload"]).alias("payloads"))
    seeds = _block_seeds(packed.withColumnRenamed("_span", "span"), "span").toDF("_span", "block", "seed")
    on = lambda a, b: a["_span"].eqNullSafe(b["_span"]) & (a["block"] == b["block"])
    folded = packed.join(seeds, on(packed, seeds)).select(packed["_span"], packed["block"], F.concat(F.array("seed"), _fold(F.col("seed"), F.col("payloads"))).alias("hashes"))
    j = p.join(folded, p[span].eqNullSafe(folded["_span"]) & (p["_block"] == folded["block"]))
    at = (F.col("_at") - F.col("_block") * block).cast("int")
    return j.select(*[p[c] for c in entries.columns], "payload", F.get("hashes", at).alias("previous"), F.get("hashes", at + 1).alias("hash"))


def broken_entries(chained: DataFrame, id_: str, fields: list[str], span: str, block: int = BLOCK) -> DataFrame:
    """(id, span, reason) of entries that do not hold: ``payload`` where the entry was changed after it was chained, ``previous``
    where it does not follow the hash before it (an entry before it was changed, removed or put in), ``hash`` where its own
    hash is not that of its parts. A tail that was cut off or wholly rehashed shows at the head (`chain_heads`, `moved_heads`)."""
    c = _placed(chained, id_, span, block)
    w = Window.partitionBy(span).orderBy(id_)
    c = c.withColumn("_now", payload_hash(fields)).withColumn("_before", F.lag("hash").over(w))
    packed = c.groupBy(F.col(span).alias("_span"), F.col("_block").alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("payload").alias("payload")))).alias("e")).select("_span", "block", F.transform("e", lambda x: x["payload"]).alias("payloads"))
    seeds = _block_seeds(packed.withColumnRenamed("_span", "span"), "span").toDF("_span", "block", "seed")
    c = c.join(seeds, c[span].eqNullSafe(seeds["_span"]) & (c["_block"] == seeds["block"]))
    before = F.when(F.col("_at") % block == 0, F.col("seed")).otherwise(F.col("_before"))
    reason = F.when(F.col("_now") != F.col("payload"), "payload").when(before != F.col("previous"), "previous").when(link_hash(F.col("previous"), F.col("payload")) != F.col("hash"), "hash")
    return c.select(id_, span, reason.alias("reason")).filter("reason IS NOT NULL")


def chain_heads(chained: DataFrame, id_: str, span: str) -> DataFrame:
    """Last hash and number of entries per span: the anchor against a cut-off or rehashed tail."""
    return chained.groupBy(span).agg(F.max_by("hash", id_).alias("head"), F.count(F.lit(1)).alias("entries"))


def tail(entries: DataFrame, id_: str, span: str, k: int) -> DataFrame:
    """The last ``k`` entries of each span with ``back``, 1 for the last; a report, ``k`` is part of it."""
    w = Window.partitionBy(span).orderBy(F.desc(id_))
    return entries.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= k)


def moved_heads(heads: DataFrame, anchors: DataFrame, span: str) -> DataFrame:
    """(span, reason) of spans whose head is not the anchored one: ``shorter``, ``longer`` or ``other``; NULL spans are told apart."""
    old = anchors.select(F.col(span).alias("_span"), F.col("head").alias("_head"), F.col("entries").alias("_entries"))
    j = heads.join(old, heads[span].eqNullSafe(F.col("_span")), "full_outer")
    n, o = F.coalesce("entries", F.lit(0)), F.coalesce("_entries", F.lit(0))
    reason = F.when(n < o, "shorter").when(n > o, "longer").when(F.col("head") != F.col("_head"), "other")
    return j.select(F.coalesce(span, "_span").alias(span), reason.alias("reason")).filter("reason IS NOT NULL")


def distinct_actors(rows: DataFrame, by: str, actor: str, but: str | None = None) -> DataFrame:
    """Distinct actors per group, without the one in column ``but``."""
    k = actor_key(F.col(actor))
    if but:
        k = F.when(~k.eqNullSafe(actor_key(F.col(but))), k)
    return rows.groupBy(by).agg(F.count_distinct(k).alias("actors"))
