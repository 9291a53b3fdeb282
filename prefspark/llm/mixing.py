"""Mixing sources to target weights.

The words of each source, in doc_id order, are packed into blocks of a fixed
length.  A source's target gives the number of blocks to draw from it.  Every
output shard draws the multinomial counts of its slots over the sources, each
in proportion to its draws; the counts follow from the seed, the shard and the
sources alone.  The slots of a source are numbered in shard order.  The few
beyond a source's draws go, one for one, to the sources that came out short, so
every shard keeps its length and every source meets its target.  Slots are
mapped through a pseudorandom permutation of the source's blocks, one
permutation per pass, and joined to the blocks by (source, index).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.llm.common import running_total, table, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
BLOCK = 128
SHARD_SLOTS = 8192
GROUP = 16  # shards a row stands for before its slots are made
BINS = 4096  # bins of draws at least
RUN_SLOTS = 1 << 20  # slots permuted at once
MAX_BROADCAST = 64 << 20
SEED = 20240607


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """Position of each index under a pseudorandom permutation of range(n).

    Four Feistel rounds over the least even number of bits that holds n;
    values outside the range walk on until they fall inside.
    """
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & low)
        out[walk] = x = (left << half) | right
        walk = walk[x >= np.uint64(n)]
    return out.astype(np.int64)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: float = PASSES) -> DataFrame:
    """source, rank, source_size, target: one row per source.

    Sources in code point order (null last) take the weights in turn.  The
    common level is the greatest of those that arise as sources reach their
    caps in order of cap per weight; a target is the level times the weight,
    or the cap.  The windows run over one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))))
    sources = sources.withColumns({"w": weight, "cap": F.col("source_size") * float(passes)})
    full = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(full), F.lit(0.0)))
             / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(full), F.lit(0.0))))
    sources = sources.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return sources.select("source", "rank", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def with_draws(sources: DataFrame, block: int, passes: float) -> DataFrame:
    """Add n_blocks and draws: the target over the mean length of a block,
    never more than ``passes`` times the blocks."""
    n = F.ceil(F.col("source_size") / block)
    draws = F.least(F.round(F.col("target") * n / F.greatest("source_size", F.lit(1))), n * F.lit(float(passes)))
    return sources.withColumns({"n_blocks": n.cast("long"), "draws": F.floor(draws).cast("long")})


def small_side(rows: DataFrame, width: int) -> DataFrame:
    """Broadcast ``rows`` of ``width`` bytes if their counted size allows it;
    else they are sorted and merged."""
    return rows.hint("broadcast" if rows.count() * width <= MAX_BROADCAST else "merge")


def shard_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, rank, count: the multinomial counts of every shard's slots.

    A slot's hash falls on one of all draws, and the source that holds this
    draw gets the slot.  Sources and slots meet in bins of draws, about four a
    source at the least, so no slot is compared with all sources.
    """
    everything = Window.partitionBy(F.lit(0))
    upto = F.sum("draws").over(Window.orderBy("rank"))
    given = sources.where("draws > 0").select(
        "rank", (upto - F.col("draws")).alias("lo"), upto.alias("hi"), F.sum("draws").over(everything).alias("total"),
        F.count(F.lit(1)).over(everything).alias("n"))
    given = given.withColumn("width", F.ceil(F.col("total") / (BINS + 4 * F.col("n"))).cast("long"))
    bins = given.select("rank", "lo", "hi", F.explode(F.expr("sequence(lo div width, (hi - 1) div width)")).alias("bin"))
    slot = given.agg(F.max("total").alias("total"), F.max("width").alias("width"))
    slot = slot.withColumn("shards", F.ceil(F.col("total") / shard_slots).cast("long"))
    slot = slot.select("*", F.explode(F.expr(f"sequence(0L, (shards - 1) div {GROUP})")).alias("grp"))
    # with a number, as the planner would merge the few small rows to one task, which then made every draw
    slot = slot.repartition(4 * sources.sparkSession.sparkContext.defaultParallelism, "grp")
    slot = slot.select("*", F.explode(F.expr(f"sequence(grp * {GROUP}, least((grp + 1) * {GROUP}, shards) - 1)")).alias("shard"))
    slot = slot.select("*", F.explode(F.expr(
        f"sequence(0L, least({shard_slots}L, total - shard * {shard_slots}) - 1)")).alias("slot"))
    slot = slot.select("shard", "width", F.pmod(F.xxhash64(F.lit(seed).cast("long"), "shard", "slot"), "total").alias("at"))
    slot = slot.withColumn("bin", F.expr("at div width"))
    held = (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
    # all slots come from one row, so the planner would take them for the small side
    return slot.join(small_side(bins, 5 * 8), "bin").where(held).groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("count"))


def slot_runs(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """rank, n_blocks, shard, first, n: runs of a source's slot numbers, which
    add up to exactly ``draws`` of every source and ``shard_slots`` of every
    shard (the last one takes the rest)."""
    counts = running_total(shard_counts(sources, shard_slots, seed), ["rank"], ["shard"], "count", "start")
    got = counts.groupBy(F.col("rank").alias("_rank")).agg(F.sum("count").alias("got"))
    all_got = sources.where("draws > 0").join(got, F.col("rank") == F.col("_rank"), "left")
    all_got = all_got.select("rank", "n_blocks", "draws", F.coalesce("got", F.lit(0)).alias("got"))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # one row a source
    all_got = all_got.withColumns({"over": F.greatest(F.col("got") - F.col("draws"), F.lit(0)),
                                   "short": F.greatest(F.col("draws") - F.col("got"), F.lit(0))})
    all_got = all_got.withColumns({"over_at": F.coalesce(F.sum("over").over(before), F.lit(0)),
                                   "short_at": F.coalesce(F.sum("short").over(before), F.lit(0))})
    runs = counts.join(all_got.select("rank", "n_blocks", "draws", "over_at"), "rank")
    runs = runs.withColumn("n", F.greatest(F.least(F.col("draws") - F.col("start"), F.col("count")), F.lit(0)))
    own = runs.where("n > 0").select("rank", "n_blocks", "shard", F.col("start").alias("first"), "n")
    spare = runs.where("n < count").select("shard", F.explode(F.expr(
        "sequence(over_at + greatest(start - draws, 0), over_at + start + count - draws - 1)")).alias("unit"))
    wanted = all_got.where("short > 0").select("rank", "n_blocks", "got", "short_at", F.explode(
        F.expr("sequence(short_at, short_at + short - 1)")).alias("unit"))
    moved = spare.join(wanted.hint("merge"), "unit").select("rank", "n_blocks", "shard", F.expr("got + unit - short_at").alias("first"),
                                              F.lit(1).cast("long").alias("n"))
    return own.unionByName(moved)


def slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """All draws: rank, block, pass, shard.  A run holds one shard's slots of a
    source at most, so a large source is many runs."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (rank, _), part in frame.groupby(["rank", frame.n.cumsum() // RUN_SLOTS]):
                n, blocks = part.n.to_numpy(), int(part.n_blocks.iloc[0])
                number = np.repeat(part["first"].to_numpy() - np.cumsum(n) + n, n) + np.arange(n.sum())
                turn = number // blocks
                index = np.empty(len(number), np.int64)
                for p in np.unique(turn):
                    index[turn == p] = permuted(number[turn == p] % blocks, blocks, (seed, int(rank), int(p)))
                yield pd.DataFrame({"rank": np.full(len(number), rank, np.int32), "block": index,
                                    "pass": turn.astype(np.int32), "shard": np.repeat(part.shard.to_numpy(), n)})
    tasks = 4 * sources.sparkSession.sparkContext.defaultParallelism
    return slot_runs(sources, shard_slots, seed).repartition(tasks, "rank", "shard").mapInPandas(
        run, "rank int, block long, pass int, shard long")


def packed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: float = PASSES, block: int = BLOCK
           ) -> tuple[DataFrame, DataFrame]:
    """(documents with size, rank, offset and targets; sources with draws)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
                        F.xxhash64(text).alias("text_hash"))
    placed = running_total(sized, ["source"], ["doc_id", "text_hash", "size"], "size", "offset")
    sources = with_draws(source_targets(placed, weights, share, passes), block, passes)
    named = sources.select(F.col("source").alias("__source"), "rank", "source_size", "target")
    return placed.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source"), sources


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """One row per document and block it lies in: words ``first`` to
    ``first + n - 1`` of the document (from 0)."""
    end = F.col("offset") + F.col("size")
    rows = placed.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("offset") / block).cast("long"), F.floor((end - 1) / block).cast("long"))))
    start = F.greatest(F.col("offset"), F.col("block") * block)
    stop = F.least(end, (F.col("block") + 1) * block)
    return rows.withColumns({"first": start - F.col("offset"), "n": stop - start})


def mix_sizes(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: float = PASSES, block: int = BLOCK,
              shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    Null and empty texts have size 0 and nothing taken; a null source is a
    source of its own, last; repeated rows are documents of their own; an
    empty table gives no rows; other columns are not read.
    """
    placed, sources = packed(docs, weights, share, passes, block)
    often = slots(sources, shard_slots, seed).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    # the draws come from a few rows, so the planner would take their table for a small one
    parts = pieces(placed, block).join(often.hint("merge"), ["rank", "block"], "left")
    taken = parts.groupBy("rank", "offset", "doc_id", "source", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*cols).unionByName(empty.select(*cols))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: float = PASSES, block: int = BLOCK,
                  shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mixed corpus, in the columns of ``docs``.

    A document appears once per pass that drew any of its words, with the
    words drawn in that pass (its text unchanged if all were) and n_chars, if
    there is such a column, of the new text.  Documents without a drawn word,
    null and empty texts among them, are gone.  A null source is a source of
    its own; rows that repeat id, source and text are documents of their own;
    texts of any length are cut by blocks; an empty table stays empty; other
    columns may have any name and come through as they are.
    """
    placed, sources = packed(docs, weights, share, passes, block)
    drawn = slots(sources, shard_slots, seed).select("rank", "block", "pass")
    parts = pieces(placed, block).join(drawn.hint("merge"), ["rank", "block"])
    rows = parts.groupBy("rank", "offset", "doc_id", "source", "text_hash", "pass").agg(
        F.sort_array(F.collect_list(F.struct("first", "n"))).alias("parts"), F.sum("n").alias("kept"))
    per_doc = rows.groupBy("rank", "offset", "doc_id", "source", "text_hash").agg(
        F.collect_list(F.struct("parts", "kept")).alias("passes"))
    # rows alike in id, source and text are told apart by a number
    same = ["doc_id", "source", "text_hash"]
    per_doc = per_doc.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("offset")))
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), F.col("source"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    full = full.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
    right = per_doc.select(*[F.col(c).alias(f"__{c}") for c in (*same, "copy")], F.explode("passes").alias("_take"))
    cond = F.col("copy") == F.col("__copy")
    for c in same:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    text = F.col("_row")["text"]
    some = F.array_join(F.flatten(F.transform(F.col("_take")["parts"], lambda p: F.slice(
        F.col("_words"), (p["first"] + 1).cast("int"), p["n"].cast("int")))), " ")
    out = full.join(right.hint("merge"), cond).withColumn("_words", words(text))
    out = out.withColumn("_text", F.when(F.col("_take")["kept"] == F.size("_words"), text).otherwise(some))
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.length("_text").cast(t).alias(c)
                        if c == "n_chars" else F.col("_row")[c].alias(c) for c, t in docs.dtypes])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))
