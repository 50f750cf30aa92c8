"""Mixing sources to target weights with a low-discrepancy schedule, DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.llm.common import stage

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: frac(k * GOLDEN) is the schedule's k-th point.
GOLDEN = (math.sqrt(5) - 1) / 2
#: Documents of a source are dealt over one shard for so many words, so that a hot source is many tasks.
SHARD_WORDS = 2_000_000


def targets(sizes: DataFrame, max_repeat: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Targets share the sum of all sizes by weight; one above max_repeat times its source's
    size stops there and its excess goes to the others by weight until none is above. That
    fixed point is a water level: target = min(cap, level * weight), found from the sums
    over sources ordered by cap / weight.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", pick).withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumns({"total": F.sum("source_size").over(every).cast("double"), "weights": F.sum("weight").over(every), "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "full_w": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    # The level, were exactly the sources before this one at their cap; the first that holds is the true one.
    s = s.withColumn("level", (F.col("total") - F.col("full")) / (F.col("weights") - F.col("full_w")))
    s = s.withColumn("no", F.row_number().over(by_ratio)).withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("no"))).over(every))
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _laid_out(docs: DataFrame, key: str, text: str, source: str, block_words: int, max_repeat: int, weights: tuple[int, ...], seed: int, row: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows with their place in the source's words, slots of the schedule); see schedule."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text))).alias("h"), *([F.col(row).alias("row")] if row else []))
    d = stage(d, "mix-docs")
    plan = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), max_repeat, weights)
    blocks = F.ceil(F.col("source_size") / F.lit(float(block_words)))
    wanted = F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long")
    plan = plan.withColumn("n_blocks", blocks).withColumn("slots", F.when(F.col("n_blocks") > 0, F.least(wanted, F.lit(max_repeat) * F.col("n_blocks"))).otherwise(F.lit(0).cast("long")))
    in_order = W.orderBy(F.col("source").isNull(), "source")
    plan = stage(plan.withColumn("sid", F.row_number().over(in_order)).withColumn("ends", F.sum("slots").over(in_order.rowsBetween(W.unboundedPreceding, 0))), "mix-plan")
    n_slots, n_sources = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()

    # Words of each source in hash order: shards by hash range, then sums within and over shards.
    p = plan.select("sid", F.col("source").alias("s_"), "source_size", "target", "n_blocks", "slots")
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / F.lit(float(SHARD_WORDS))))
    place = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))
    d = d.join(p, F.col("source").eqNullSafe(F.col("s_"))).drop("s_").withColumn("shard", F.floor(place * shards))
    per_shard = d.groupBy("sid", "shard").agg(F.sum("size").alias("in_shard"))
    earlier = W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    per_shard = per_shard.withColumn("base", F.coalesce(F.sum("in_shard").over(earlier), F.lit(0))).drop("in_shard")
    within = W.partitionBy("sid", "shard").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(per_shard, ["sid", "shard"])
    d = d.withColumn("lo", F.col("at") + F.col("base")).withColumn("hi", F.col("lo") + F.col("size"))
    if row is None:
        d = d.withColumn("row", F.monotonically_increasing_id())
    d = stage(d.select("row", "doc_id", "source", "sid", "size", "source_size", "target", "n_blocks", "lo", "hi"), "mix-rows")

    # Slots: point -> grid cell -> the source whose share covers the point -> rank within the source.
    n_points = int(n_slots * 1.02) + 64 if n_slots else 0
    cells = max(64, 2 * n_sources)
    whole = F.lit(float(n_slots or 1))
    shares = plan.where("slots > 0").select("sid", "n_blocks", "slots", ((F.col("ends") - F.col("slots")) / whole).alias("from_"), (F.col("ends") / whole).alias("to_"))
    covers = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from_") * cells), F.least(F.floor(F.col("to_") * cells), F.lit(cells - 1)))))
    points = spark.range(n_points).withColumn("x", (F.col("id") * F.lit(GOLDEN)) % 1.0).withColumn("cell", F.floor(F.col("x") * cells)).withColumn("segment", F.floor(F.col("id") / 65536))
    drawn = points.join(covers, "cell").where("x >= from_ and x < to_").select("id", "segment", "sid")
    before = W.partitionBy("sid").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    per_segment = drawn.groupBy("sid", "segment").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = drawn.withColumn("r", F.row_number().over(W.partitionBy("sid", "segment").orderBy("id")) - 1).join(per_segment.drop("n"), ["sid", "segment"])
    ranked = ranked.select("sid", (F.col("r") + F.col("base")).alias("rank"), F.col("id").alias("slot"))
    had = per_segment.groupBy("sid").agg(F.sum("n").alias("had"))
    short = shares.select("sid", "slots").join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    short = short.select("sid", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("rank"), "had")
    short = short.select("sid", "rank", (F.lit(n_points) + (F.col("rank") - F.col("had")) * F.lit(n_sources) + F.col("sid") - 1).alias("slot"))
    slots = ranked.union(short).join(shares.select("sid", "n_blocks", "slots"), "sid").where("rank < slots")
    return d, slots.select("sid", "slot", F.pmod("rank", "n_blocks").alias("block"))


def _pieces(d: DataFrame, slots: DataFrame) -> DataFrame:
    """(slot, sid, block, row, first_word, words): the words of each row that a slot's block holds."""
    first = lambda pos: F.floor((pos * F.col("n_blocks")) / F.col("source_size")).cast("long")
    edge = lambda j: F.ceil(j * F.col("source_size") / F.col("n_blocks")).cast("long")
    near = F.sequence(F.greatest(first(F.col("lo")) - 1, F.lit(0)), F.least(first(F.col("hi") - 1) + 1, F.col("n_blocks") - 1))
    parts = d.where("size > 0").withColumn("block", F.explode(near)).withColumn("from_", F.greatest("lo", edge(F.col("block"))))
    parts = parts.withColumn("words", F.least("hi", edge(F.col("block") + 1)) - F.col("from_")).where("words > 0")
    return slots.join(parts.select("row", "sid", "block", (F.col("from_") - F.col("lo")).alias("first_word"), "words"), ["sid", "block"])


def schedule(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, block_words: int = 128, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """(slot, source, block, doc_id, first_word, words): the mix itself, block by block.

    The words of a source, its documents in hash order, are cut into equal blocks of about
    block_words. Points frac(k * golden ratio) fall into the sources' shares of the slots;
    the r-th slot of a source takes its block r mod (number of blocks). Slots beyond a
    source's count are left out and those that the points left short follow at the end, so
    each source gets exactly its number of slots, at most max_repeat per block. Ordered by
    slot, any stretch of the mix holds the sources near their shares. A row is the part of a
    document that the slot's block holds: words from first_word (0 is the first) on.
    Nulls and empty tables as in mix; rows without words are in no block.
    """
    d, slots = _laid_out(docs, key, text, source, block_words, max_repeat, weights, seed, None)
    return _pieces(d, slots).join(d.select("row", "doc_id", "source"), "row").select("slot", "source", "block", "doc_id", "first_word", "words")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, block_words: int = 128, max_repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, row: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source): what the schedule takes of each document.

    Null text: size 0. Null source: a source of its own, last. Null or repeated keys: each
    row counts by itself. Documents without words, and so sources without any, take 0.
    Equal rows are told apart by nothing and may swap. Empty table: no rows. A column of distinct
    long ids named by `row` is kept as the last one, by which counts join the rows they are of.
    """
    d, slots = _laid_out(docs, key, text, source, block_words, max_repeat, weights, seed, row)
    taken = _pieces(d, slots).groupBy("row").agg(F.sum("words").alias("taken"))
    out = d.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", *([F.col("row").alias(row)] if row else []))
