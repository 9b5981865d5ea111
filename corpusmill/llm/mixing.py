"""Mixing sources so that each holds its target share of all tokens, by Pfair scheduling.

The mixture is a row of equal blocks of tokens. Source s with weight w (its permille over their sum)
has block k released at floor(k / w) and due at ceil((k + 1) / w); the earliest due of the released
blocks goes next. This keeps every prefix of the mixture within one block of every target. The
schedule of one period (as many slots as the weights sum to, 1000 for permille) is computed once and
repeats, so the slot of any block is a formula and no schedule grows with the data.

A source's stream is its documents in an order of seeded hashes, passed over as often as needed, at
most max_repeats times; block k holds the documents that begin within its tokens. The total size is
the largest that all sources can fill (`total` overrides it: then sources that run out give what they
have, and the report says so).

Documents with null or empty text hold no tokens and are left out; so are sources without a target or
with a target of zero, and documents whose source is null. A source without documents contributes
nothing, and is left out of the bound. Documents longer than a block span several. Repeated rows count
as documents. Ties of the hash are broken by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusmill.session import checkpointed

from . import encoding, ranks

SEED = 42
#: Tokens of a block.
BLOCK_TOKENS = 4096


def period(weights: dict[str, int]) -> list[str]:
    """The source of each slot of one period, by earliest deadline among the released blocks."""
    weights = {s: int(w) for s, w in sorted(weights.items()) if w and w > 0}
    if not weights:
        return []
    divisor = reduce(math.gcd, weights.values())
    weights = {s: w // divisor for s, w in weights.items()}
    slots = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    out = []
    for t in range(slots):
        ready = [s for s, w in weights.items() if done[s] < w and done[s] * slots // w <= t]
        best = min(ready, key=lambda s: (-(-(done[s] + 1) * slots // weights[s]), -weights[s], s))
        out.append(best)
        done[best] += 1
    return out


def plan(counted: DataFrame, sources: DataFrame, total: int | None = None) -> DataFrame:
    """Per source with a target: tokens, max_repeats, target_permille, quota (tokens it gives), total.

    counted(source, n_tokens). One aggregation; then a table of sources, which does not grow."""
    held = counted.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    wanted = sources.where("target_permille > 0").groupBy("source").agg(F.max("target_permille").cast("long").alias("target_permille"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).cast("long").alias("max_repeats"))
    table = wanted.join(held, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    room = F.when(F.col("tokens") > 0, F.col("tokens") * F.col("max_repeats") / F.col("target_permille"))
    sums = table.agg(F.min(room).alias("_room"), F.sum("target_permille").alias("sum_permille"))
    table = table.join(F.broadcast(sums))
    size = F.floor(F.col("_room") * F.col("sum_permille")).cast("long") if total is None else F.lit(int(total)).cast("long")
    table = table.withColumn("total", F.coalesce(size, F.lit(0)))
    quota = F.floor(F.col("total") * F.col("target_permille") / F.col("sum_permille")).cast("long")
    return table.withColumn("quota", F.least(quota, F.col("tokens") * F.col("max_repeats"))).drop("_room")


def _slots(sources: DataFrame) -> DataFrame:
    """source, per_period, positions (slots of its blocks in a period), period. From the table of sources alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        order = period(dict(zip(rows["source"], rows["target_permille"])))
        places: dict[str, list[int]] = {}
        for i, s in enumerate(order):
            places.setdefault(s, []).append(i)
        yield pd.DataFrame({"source": list(places), "positions": list(places.values()), "period": [len(order)] * len(places)})

    wanted = sources.where("target_permille > 0 and source is not null").groupBy("source").agg(F.max("target_permille").cast("long").alias("target_permille"))
    return wanted.coalesce(1).mapInPandas(run, "source string, positions array<int>, period int")


def mix(documents: DataFrame, sources: DataFrame, key: str = "doc_id", total: int | None = None, block: int = BLOCK_TOKENS, seed: int = SEED, counted: DataFrame | None = None) -> DataFrame:
    """slot, source, block, place (tokens of the source before it), doc_id, copy (from 0), n_tokens: the mixture, whose order is that of slot and place (rows come in none).

    A document belongs to the mixture if more than half of it lies inside its source's quota."""
    # the counts, narrow rows, are read several times: they are written once and no text is encoded twice
    counted = counted if counted is not None else checkpointed(encoding.token_counts(documents, [key, "source"]))
    counted = counted.where("n_tokens > 0 and source is not null")
    table = plan(counted, sources, total).where("quota > 0").select("source", "quota", "tokens", "max_repeats")
    placed = ranks.ranked(counted, ["source"], ranks.order_hash(seed, F.col(key)), [key], weight="n_tokens")
    passes = F.sequence(F.lit(0), F.least(F.ceil(F.col("quota") / F.col("tokens")), F.col("max_repeats")).cast("int") - 1)
    copies = placed.select(key, "source", "n_tokens", "_before").join(table, "source").select(key, "source", "n_tokens", "quota", F.col("_before"), F.col("tokens"), F.explode(passes).alias("copy"))
    copies = copies.withColumn("place", F.col("_before") + F.col("copy") * F.col("tokens")).where(F.col("place") + F.col("n_tokens") / 2 <= F.col("quota"))
    slotted = copies.withColumn("block", F.floor(F.col("place") / block).cast("long")).join(_slots(sources), "source")
    per = F.size("positions")
    slot = F.floor(F.col("block") / per) * F.col("period") + F.element_at("positions", (F.col("block") % per + 1).cast("int"))
    return slotted.select(slot.cast("long").alias("slot"), "source", "block", "place", key, "copy", "n_tokens")


def report(mixture: DataFrame, counted: DataFrame, sources: DataFrame, total: int | None = None) -> DataFrame:
    """source, target_permille, max_repeats, source_tokens, n_documents, mixed_tokens, reached_permille, largest_copy, short."""
    got = mixture.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("mixed_tokens"), F.max("copy").alias("largest_copy"))
    table = plan(counted, sources, total).join(got, "source", "left")
    mixed = F.coalesce("mixed_tokens", F.lit(0))
    all_tokens = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    return table.join(F.broadcast(all_tokens)).select(
        "source",
        "target_permille",
        "max_repeats",
        F.col("tokens").alias("source_tokens"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        mixed.alias("mixed_tokens"),
        F.round(1000 * mixed / F.greatest(F.coalesce("all_tokens", F.lit(0)), F.lit(1)), 3).alias("reached_permille"),
        "largest_copy",
        (F.col("quota") < F.floor(F.col("total") * F.col("target_permille") / F.col("sum_permille"))).alias("short"),
    )
