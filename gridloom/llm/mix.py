"""Mixing sources to target shares of all tokens (problem 9).

Each source's documents fall into blocks at random (by hash). Whole blocks are the units that a
multivariate-hypergeometric splitting tree shares out among the output shards: every node draws, without
replacement, how many blocks of each source go to its left half, so the quotas stay exact and each shard is a random
sample of the whole mix. Shards then take disjoint stretches of each source's permuted blocks and shuffle
their documents locally.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import materialize

#: Tokens a block should hold: a hundredth of a shard, so that shards are alike. A source has MIN_BLOCKS to MAX_BLOCKS of them: with the number of sources, the bound of all
#: that the driver holds.
BLOCK_TOKENS, MIN_BLOCKS, MAX_BLOCKS = 20_000, 16, 16_384
#: Tokens an output shard should hold; there are at most MAX_SHARDS.
SHARD_TOKENS, MAX_SHARDS = 2_000_000, 4_096
#: Blocks of all sources, at most: with many sources their blocks get larger.
MAX_UNITS = 1_000_000
#: Listed sources, at most; more are refused, as their plan is made on the driver.
MAX_SOURCES = 10_000


def source_key(c: Column) -> Column:
    """A source's name regardless of letter case, outer blanks and `-` for `_`."""
    return F.translate(F.lower(F.trim(c)), "-", "_")


@dataclass(frozen=True)
class Quota:
    """What one source gives: `wanted` tokens of `available`, in whole passes and a part of one more."""

    source: str
    share: float
    repeats: int
    available: int
    wanted: float


def quotas(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | None = None) -> list[Quota]:
    """Tokens wanted from each source.

    Without `total` it is the most at which every source that exists can fill its share within its repeats; so the
    shares come out as wanted, those of absent sources being spread over the others in proportion. With `total`, sources
    that can't fill their share give all they may, and the rest goes to the others in proportion.
    """
    there = [(s, w, r, available.get(s, 0)) for s, w, r in targets]
    usable = [x for x in there if x[1] > 0 and x[2] > 0 and x[3] > 0]
    whole = sum(x[1] for x in usable)
    if total is None:
        total = min((r * n * whole / w for _, w, r, n in usable), default=0.0)
    wanted: dict[str, float] = {}
    open_, left = usable, float(total)
    while open_:
        whole = sum(x[1] for x in open_)
        full = [x for x in open_ if left * x[1] / whole > x[2] * x[3] + 1e-6]
        if not full:
            wanted |= {s: left * w / whole for s, w, _, _ in open_}
            break
        for s, _, r, n in full:
            wanted[s] = float(r * n)
            left -= r * n
        open_ = [x for x in open_ if x[0] not in wanted]
    return [Quota(s, w, r, n, wanted.get(s, 0.0)) for s, w, r, n in there]


def split_tree(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard (shards x sources), by recursive draws without replacement."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(counts)), np.int64)

    def halve(left: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[first] = left
            return
        half = n // 2
        draw = rng.multivariate_hypergeometric(left, int(left.sum()) * half // n, method="marginals") if left.sum() else left
        halve(draw, first, half)
        halve(left - draw, first + half, n - half)

    halve(counts.astype(np.int64), 0, shards)
    return out


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | None = None, seed: int = 7, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix: shard, position, key, source_name, pass_no, n_tokens; one row per use of a document.

    `sized` has key, source and n_tokens; `targets` source_name, target_share, max_repeats.

    * Names are compared by `source_key`; documents of other or null sources, and those without tokens, are not used.
      Repeated target rows: the greatest share and repeats. A null or non-positive share or repeat count takes nothing.
    * A document is used at most max_repeats times, once per pass; a whole pass is used before the next begins.
    * Within a source's last pass whole blocks are taken in permuted order and, of the block at which the quota is reached,
      documents up to the one that comes nearest: a share is met to within half a document.
    * No usable source gives an empty mix.
    """
    spark = sized.sparkSession
    rows = targets.groupBy(source_key(F.col("source_name")).alias("s")).agg(F.max("target_share"), F.max("max_repeats")).where("s IS NOT NULL").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in a mix")
    wishes = [(r[0], r[1] or 0.0, r[2] or 0) for r in sorted(rows, key=lambda r: r[0])]
    known = spark.createDataFrame([(w[0],) for w in wishes], "source_name string")
    listed = sized.where("n_tokens > 0").withColumn("source_name", source_key(F.col("source"))).join(F.broadcast(known), "source_name", "left_semi")
    totals = listed.groupBy("source_name").agg(F.sum("n_tokens").alias("tokens"))
    most = min(MAX_BLOCKS, max(MIN_BLOCKS, MAX_UNITS // max(len(wishes), 1)))
    cuts = totals.select("source_name", F.least(F.lit(most), F.greatest(F.lit(MIN_BLOCKS), F.floor(F.col("tokens") / block_tokens))).cast("int").alias("blocks"))
    docs = (
        listed.join(F.broadcast(cuts), "source_name")  # one row per listed source
        .select(key, "source_name", "n_tokens", "blocks", F.xxhash64(F.lit(seed), F.col(key)).alias("order"))
        .withColumn("block", F.pmod(F.xxhash64("order"), F.col("blocks")).cast("int"))
    )
    sums = docs.groupBy("source_name", "block").agg(F.sum("n_tokens").alias("tokens")).collect()  # sources x MAX_BLOCKS at most
    by: dict[str, dict[int, int]] = {}
    for r in sums:
        by.setdefault(r["source_name"], {})[r["block"]] = r["tokens"]
    plan = quotas(wishes, {s: sum(b.values()) for s, b in by.items()}, total)
    rng = np.random.default_rng(seed)
    units: list[tuple[str, int, int, float | None]] = []  # source, pass, block, tokens wanted of it (null: all)
    counts = []
    for q in plan:
        mine: list[tuple[str, int, int, float | None]] = []
        left, pass_no = q.wanted, 0
        while left > 0.5 and pass_no < q.repeats and q.available:
            for block in rng.permutation(sorted(by[q.source])):
                if left <= 0.5:
                    break
                size = by[q.source][block]
                mine.append((q.source, pass_no, int(block), None if size <= left + 0.5 else float(left)))
                left -= size
            pass_no += 1
        counts.append(len(mine))
        units += [mine[i] for i in rng.permutation(len(mine))]
    shards = int(min(MAX_SHARDS, max(1, round(sum(q.wanted for q in plan) / shard_tokens))))
    given = split_tree(np.array(counts, np.int64), shards, seed)
    shard_of = np.concatenate([np.repeat(np.arange(shards), given[:, i]) for i in range(len(counts))]) if counts else np.zeros(0, int)
    table = spark.createDataFrame([(*u, int(k)) for u, k in zip(units, shard_of)], "source_name string, pass_no int, block int, wanted double, shard int")
    # At most sources x MAX_BLOCKS x repeats rows: a bound that doesn't grow with the documents.
    used = docs.join(F.broadcast(table) if len(units) <= 200_000 else table, ["source_name", "block"])
    whole = used.where("wanted IS NULL")
    # The cumulated size within the one block of a source at which its quota is reached.
    so_far = Window.partitionBy("source_name", "pass_no", "block").orderBy("order", key).rowsBetween(Window.unboundedPreceding, -1)
    part = used.where("wanted IS NOT NULL").withColumn("before", F.coalesce(F.sum("n_tokens").over(so_far), F.lit(0))).where("before + n_tokens / 2.0 <= wanted").drop("before")
    place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), F.col("order"), F.col("pass_no")), key, "pass_no"))
    return whole.unionByName(part).withColumn("position", place).select("shard", "position", key, "source_name", "pass_no", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The report: source_name, target_share, tokens, actual_share, uses, passes; one row per target source."""
    got = mixed.groupBy("source_name").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), (F.max("pass_no") + 1).alias("passes"))
    want = targets.groupBy(source_key(F.col("source_name")).alias("source_name")).agg(F.max("target_share").alias("target_share")).where("source_name IS NOT NULL")
    out = want.join(got, "source_name", "left").fillna(0, ["tokens", "uses", "passes"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    return out.select("source_name", "target_share", "tokens", F.round(F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0), 6).alias("actual_share"), "uses", "passes")


def listed_tokens(sized: DataFrame, targets: DataFrame) -> int:
    """Tokens of all documents of the listed sources, as a total that lets scarce sources fall short."""
    names = targets.where("target_share > 0 AND max_repeats > 0").select(source_key(F.col("source_name")).alias("s")).distinct()
    return sized.where("n_tokens > 0").withColumn("s", source_key(F.col("source"))).join(names, "s", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0


def sized_once(counts: DataFrame) -> DataFrame:
    """Token counts written once, as a mix reads them twice."""
    return materialize(counts, "token-counts")
