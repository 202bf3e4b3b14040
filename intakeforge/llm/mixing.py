"""Sources mixed to target shares: Sainte-Lague apportionment of equal-token blocks, then seeded selection per shard."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intakeforge.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Sources of the mix, which are apportioned on the driver; more is an error, not a cut.
MAX_SOURCES = 10_000
BLOCK_TOKENS, SHARD_TOKENS = 256, 4_000_000
#: Shards of a source at most, which are ranked together; beyond, shards grow instead.
MAX_SHARDS = 65_536

_ENCODERS: dict = {}


def encoder(path: str):  # noqa: ANN201
    """The byte-level BPE of a ranks file that was shipped to the workers, once per worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Adds ``n_tokens`` of the whole text, 0 for NULL or empty text; text that looks like a special token is plain text.

    The tokenizer's file is read by the driver only and goes to the workers with the job.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    docs = documents.select(*keep, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.mapInArrow(run, f"{schema}, n_tokens long")


def sainte_lague(weights: dict, seats: int, caps: dict) -> dict:
    """Seats by highest quotients weight / (2 k + 1), ties by name; no key gets more than its cap.

    The bulk is given at once by rounding down, which the method never undercuts by more than a seat per key; only the rest is
    handed out by quotients.
    """
    total = sum(weights.values())
    out = {k: 0 for k in weights}
    if total <= 0 or seats <= 0:
        return out
    for k, w in weights.items():
        out[k] = max(0, min(caps[k], int(seats * w / total) - 1))
    heap = [(-w / (2 * out[k] + 1), k) for k, w in weights.items() if w > 0 and out[k] < caps[k]]
    heapq.heapify(heap)
    left = seats - sum(out.values())
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        out[k] += 1
        left -= 1
        if out[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * out[k] + 1), k))
    return out


def apportion(sources: list[dict], total_tokens: int | None, block: int) -> dict[str, int]:
    """Blocks of each source. ``sources``: source, target_share, max_repeats, n_tokens.

    Without a total, the mix is the largest one in which every source with tokens can have its share within its repeats.
    Shares of sources without tokens cannot be met and are left open.
    """
    live = [s for s in sources if s["n_tokens"] > 0 and s["target_share"] > 0 and s["max_repeats"] > 0]
    if not live:
        return {}
    capacity = {s["source"]: s["n_tokens"] * s["max_repeats"] // block for s in live}
    whole = sum(s["target_share"] for s in live)
    if total_tokens is None:
        seats = int(min(s["n_tokens"] * s["max_repeats"] / (s["target_share"] / whole) for s in live) // block)
    else:
        seats = total_tokens // block
    return sainte_lague({s["source"]: s["target_share"] for s in live}, seats, capacity)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK_TOKENS, seed: int = 42, tokenizer: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document that is used, ``copies`` times and at most max_repeats.

    A source's documents are split into shards of about ``shard_tokens`` by a seeded hash, so that a source of any size is no
    single group. Its blocks are apportioned to the shards by their tokens, again by highest quotients. In a shard the
    documents lie on a line in seeded order; the line is taken whole as often as the quota holds it, and once more up to the
    rest, where a document belongs to the side on which its middle is. Documents without text, or of unlisted or NULL
    source, take no part. Repeated target rows count once (the greatest share); repeated documents are documents of their own.
    """
    spark = documents.sparkSession
    t = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    counted = cut(count_tokens(documents.filter("source IS NOT NULL"), tokenizer).filter("n_tokens > 0").join(t.select("source"), "source", "left_semi").select("doc_id", "source", "n_tokens"))
    sizes = t.join(counted.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")), "source", "left").fillna(0, ["n_tokens"]).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = [{"source": r.source, "target_share": r.target_share or 0.0, "max_repeats": r.max_repeats or 0, "n_tokens": r.n_tokens} for r in sizes]
    blocks = apportion(rows, total_tokens, block)
    plan = [(r["source"], min(MAX_SHARDS, max(1, -(-r["n_tokens"] // shard_tokens))), blocks.get(r["source"], 0), r["max_repeats"], r["n_tokens"]) for r in rows]
    quota = spark.createDataFrame(plan, "source string, shards long, blocks long, max_repeats int, source_tokens long")
    d = counted.join(quota, "source").filter("blocks > 0")
    d = cut(d.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards"))).select("doc_id", "source", "n_tokens", "shard"))
    # Sainte-Lague over shards: the quotients of one weight are ranked over all shards of the source. Rounding down leaves
    # fewer blocks than shards, so only the first quotients past that point compete.
    shard = d.groupBy("source", "shard").agg(F.sum("n_tokens").alias("shard_tokens")).join(quota, "source")
    base = F.greatest(F.lit(0), F.floor(F.col("blocks") * F.col("shard_tokens") / F.col("source_tokens")) - 1)
    cap = F.floor(F.col("shard_tokens") * F.col("max_repeats") / block)
    shard = shard.withColumn("base", F.least(base, cap)).withColumn("cap", cap)
    bids = shard.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter("base + k < cap").withColumn("quotient", F.col("shard_tokens") / (2 * (F.col("base") + F.col("k")) + 1))
    won = Window.partitionBy("source").orderBy(F.desc("quotient"), "shard", "k")
    given = shard.groupBy("source").agg(F.sum("base").alias("given"))
    extra = bids.withColumn("rank", F.row_number().over(won)).join(given, "source").filter("rank <= blocks - given").groupBy("source", "shard").agg(F.count(F.lit(1)).alias("extra"))
    shard = shard.join(extra, ["source", "shard"], "left").select("source", "shard", "shard_tokens", "max_repeats", ((F.col("base") + F.coalesce("extra", F.lit(0))) * block).alias("quota"))
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = d.withColumn("upto", F.sum("n_tokens").over(line)).join(shard, ["source", "shard"])
    whole = F.floor(F.col("quota") / F.col("shard_tokens"))
    rest = F.col("quota") - whole * F.col("shard_tokens")
    more = (F.col("upto") - F.col("n_tokens") / 2 <= rest).cast("long")
    copies = F.least(F.col("max_repeats").cast("long"), whole + F.when(rest > 0, more).otherwise(0))
    return placed.withColumn("copies", copies.cast("int")).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mix_shares(documents: DataFrame, targets: DataFrame, **options: object) -> DataFrame:
    """Per listed source: target_share, max_repeats, documents and tokens there are, documents used, tokens taken, share."""
    used = cut(mix(documents, targets, **options))
    total = used.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total"))
    per = used.groupBy("source").agg(F.count(F.lit(1)).alias("documents_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_taken"), F.max("copies").alias("most_copies"))
    t = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = t.join(per, "source", "left").fillna(0, ["documents_used", "tokens_taken", "most_copies"]).crossJoin(F.broadcast(total))
    return j.select("source", "target_share", "max_repeats", "documents_used", "most_copies", "tokens_taken", F.when(F.col("total") > 0, F.col("tokens_taken") / F.col("total")).otherwise(0.0).alias("share"))
