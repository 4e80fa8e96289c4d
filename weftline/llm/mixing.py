"""Mixing sources to target weights.

Each source's tokens are one stream, by doc_id, cut into blocks of fixed length. An epoch of a source is
a pseudorandom permutation of its blocks (rank of a keyed hash); slot k is the block of rank k modulo the
blocks, in epoch k divided by them. A source fills whole epochs while its target lasts and then a part
of one more, and the last slot is cut to the target.

The mix is dealt into output shards of SHARD_BLOCKS blocks. The sources' counts of each shard are drawn
first: a multinomial draw given that the sources' totals meet the targets, made by a random order of all
slots that is cut into shards. The n-th place of a source, in order of
shards, takes its slot n, and blocks join by that index. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import columns, discard, free, prefix_sum, spread_join, staged

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all tokens that the mix holds; most times that a source is repeated.
SHARE, REPEATS = 1.5, 2
BLOCK = 256
#: Blocks of an output shard.
SHARD_BLOCKS = 256
SEED = 20_240_117


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to source, skey, source_size, target.

    skey counts sources by code point from 0, null last. Weights cap at REPEATS times the size; the
    excess is reshared by weight, which ends at target = min(cap, level * weight), where level is
    the largest trial level whose source isn't capped at it.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("skey") % len(WEIGHTS) + 1).cast("int"))
    capped = (
        sizes.withColumn("skey", (F.row_number().over(ordered) - 1).cast("long"))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", (F.col("source_size") * REPEATS).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "skey").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(SHARE)
    trial = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = capped.withColumn("trial", trial)
    level = F.max(F.when(F.col("ratio") >= F.col("trial"), F.col("trial"))).over(everything)
    return levelled.withColumn("target", F.least("cap", level * F.col("weight"))).select("source", "skey", "source_size", "target")


def draw_counts(slots: DataFrame, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(skey, slot) of all slots to (shard, skey, n, base): the drawn counts, and the source's slots in earlier shards.

    A random order of all slots, by a keyed hash, is cut every ``shard_blocks`` places: how many of each
    source fall into a shard is a multinomial draw given the sources' totals.
    """
    drawn = slots.select("skey", "slot", F.lit(0).alias("all"), F.md5(F.concat_ws(":", F.lit(seed), F.lit("draw"), "skey", "slot").cast("binary")).alias("drawn"))
    ranked = prefix_sum(drawn, ["all"], ["drawn"], F.lit(1), "rank")
    shard = F.floor(F.col("rank") / shard_blocks).cast("long").alias("shard")
    counts = staged(ranked.groupBy(shard, "skey").agg(F.count("*").alias("n")), "mix-counts")
    return prefix_sum(counts, ["skey"], ["shard"], F.col("n"), "base")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs`` (doc_id, text, source); returns (spans, slots).

    spans: doc_id, source, size, source_size, target, skey, start (the document's first token in its
    source's stream), block (one row per block that it touches; null if it has no tokens).
    slots: skey, epoch, rank, block, words (taken from the block's front), shard, pick (order in the shard).

    A null or empty text has no tokens. A null source is a source of its own, last. Rows repeated in
    full count each; null doc_ids are ids like any other, last; other columns are ignored.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = staged(rows, "mix-rows")
    spans = staged(_spans(_streams(rows), block), "mix-spans")

    # A block belongs to the document that holds its first token.
    blocks = spans.where(F.col("start") <= F.col("block") * block).select("skey", "source_size", F.round("target").cast("long").alias("goal"), "block")
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.greatest("goal", F.lit(1)) - 1) / F.greatest("source_size", F.lit(1))).cast("int"))))
    hashed = blocks.withColumn("hash", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "skey", "block").cast("binary")))
    ranked = staged(prefix_sum(hashed, ["skey", "epoch"], ["hash", "block"], F.lit(1), "rank").drop("hash"), "mix-ranks")
    # Only a source's last block can be short; slots after it begin so much earlier.
    last = F.floor((F.col("source_size") - 1) / block)
    short = ranked.where(F.col("block") == last).select("skey", "epoch", F.col("rank").alias("short_rank"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    missing = F.when(F.col("rank") > F.col("short_rank"), (last + 1) * block - F.col("source_size")).otherwise(0)
    begins = F.col("epoch") * F.col("source_size") + F.col("rank") * block - missing
    slots = ranked.join(F.broadcast(short), ["skey", "epoch"]).withColumn("words", F.greatest(F.lit(0), F.least(length, F.col("goal") - begins)).cast("long"))
    slots = slots.where("words > 0").select("skey", "epoch", "rank", "block", "words", (F.col("epoch") * (last + 1) + F.col("rank")).alias("slot"))
    slots = staged(slots, "mix-slots")
    discard(ranked)

    counts = draw_counts(slots.select("skey", "slot"), seed, shard_blocks)
    drawn = counts.select("shard", "skey", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("slot"))
    pick = F.xxhash64(F.lit(seed), "skey", "slot").alias("pick")
    return spans, slots.join(drawn, ["skey", "slot"]).select("skey", "epoch", "rank", "block", "words", "shard", pick)


def _streams(rows: DataFrame) -> DataFrame:
    """Rows with doc_id, source, size: their source's skey, source_size and target, and start."""
    sources = staged(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    keyed = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.skey", "s.source_size", "s.target")
    return prefix_sum(keyed, ["skey"], ["doc_id", "size"], F.col("size"), "start")


def _touched(block: int) -> Column:
    """Blocks that a document's tokens touch; null if it has none."""
    return F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))


def _spans(streams: DataFrame, block: int) -> DataFrame:
    return streams.withColumn("block", F.explode_outer(_touched(block)))


def taken_words(spans: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Words of each document that the mix takes, repeats counted, and the first shard that holds any; one row per input row."""
    taken = slots.groupBy("skey", "block", "words").agg(F.count("*").alias("times"), F.min("shard").alias("least"))
    met = spans.join(taken, ["skey", "block"], "left")
    first = F.greatest(F.col("start"), F.col("block") * block)
    after = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    words = F.coalesce(F.greatest(F.lit(0), after - first) * F.col("times"), F.lit(0))
    # Of rows with tokens, (skey, start) tells them apart; others may be equal rows and keep their number.
    key = ["doc_id", "source", "size", "source_size", "target", "skey", "start"]
    totals = met.where("size > 0").groupBy(*key).agg(F.sum(words).cast("long").alias("taken"), F.min(F.when(words > 0, F.col("least"))).alias("first_shard"))
    kept = ["doc_id", "size", "source_size", "target", "taken", "first_shard"]
    none = spans.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_shard", F.lit(None).cast("long"))
    return totals.select("source", *kept).unionByName(none.select("source", *kept))


def mixed_blocks(docs: DataFrame, block: int = BLOCK, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix itself: shard, pick (order in the shard), source, tokens (``block`` at most).

    A document's tokens are sliced by block before they are dealt, and each slice moves once to its
    block and once for each slot that takes the block. Only a source's last block, and the slot that
    ends its target, hold fewer than ``block`` tokens.
    """
    _, slots = mix(docs, block, seed, shard_blocks)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", "source", words.alias("tokens")).withColumn("size", F.size("tokens").cast("long"))
    at = lambda b: F.greatest(b * block - F.col("start"), F.lit(0))
    upto = lambda b: F.least((b + 1) * block - F.col("start"), F.col("size"))
    cut = F.transform(_touched(block), lambda b: F.struct(b.alias("block"), at(b).alias("at"), F.slice("tokens", (at(b) + 1).cast("int"), (upto(b) - at(b)).cast("int")).alias("tokens")))
    pieces = _streams(rows).select("skey", "source", "start", F.explode(cut).alias("piece"))
    held = pieces.groupBy("skey", "source", "piece.block").agg(F.array_sort(F.collect_list(F.struct("start", "piece.tokens"))).alias("pieces"))
    whole = held.select("skey", "source", "block", F.flatten(F.transform("pieces", lambda p: p["tokens"])).alias("tokens"))
    return slots.join(whole, ["skey", "block"]).select("shard", "pick", "source", F.slice("tokens", F.lit(1), F.col("words").cast("int")).alias("tokens"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes its tokens: whole times, and once more with the chance that the rest asks for.

    The chance is a hash of doc_id and text, so reruns agree, and sums of sizes stay near the targets. Rows
    without tokens come once. All columns stay; a text moves only in one join, by doc_id and text.
    """
    key = F.struct(docs["doc_id"].alias("id"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("md5"))
    spans, slots = mix(docs.select(key.alias("doc_id"), "text", "source"))
    mixed, times, rows, copy = free(docs, "_mixed", "_times", "_rows", "_copy")
    taken = taken_words(spans, slots).groupBy(F.col("doc_id").alias(mixed)).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"), F.count("*").alias(rows))
    chance = F.pmod(F.xxhash64(F.lit(SEED), f"{mixed}.id", f"{mixed}.md5"), F.lit(1 << 20)) / (1 << 20)
    often = F.when(F.col("_size") == 0, 1).otherwise(F.floor(F.col("_taken") / F.greatest("_size", F.lit(1)) + chance)).cast("int")
    copies = staged(taken.select(mixed, often.alias(times), rows).where(F.col(times) > 0), "mix-copies")
    joined = spread_join(docs.withColumn(mixed, key), copies, mixed, rows)
    out = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
    return out.select(*columns(out, docs.columns))
