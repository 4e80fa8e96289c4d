"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A seed is a short window of tokens of which a fixed mask inspects some and ignores the rest, so a
substituted token breaks only the seeds that inspect it. Masks go by the item's length, and are chosen so
that no choice of 20 % of an item's tokens breaks all its seeds: however the substitutions lie, some
window of some mask is free of them (a test walks all patterns). Seeds of items meet seeds of every
document position in an equi-join on their hash; each meeting names a diagonal (document position minus
item position). Around the hit the item is laid over the document: it counts whole if enough of its
tokens agree, or by its best stretch, the one that scores most at +1 for a token that agrees and -2 for
one that doesn't.

Items are broadcast, in blocks of bounded size, so no text is shuffled: hits are verified where the
document was read, and only once for each run of hits along a diagonal.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import free, staged

#: Fixed masks: least and most tokens of an item, offsets of the inspected tokens.
CLASSES = (
    (21, 1 << 30, ((0, 1, 2, 5, 6, 8), (0, 1, 3, 5, 6, 7))),
    (11, 20, ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8))),
    (5, 10, ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))),
)
MASKS = tuple(m for _, _, masks in CLASSES for m in masks)
#: Items of fewer tokens have no seeds.
SHORTEST = 5
#: Share of tokens that agree, of a whole item or of a stretch of it.
MIN_SHARE = 0.8
#: Tokens that agree in a stretch: at least so many, and this share of the item.
MIN_WORDS, MIN_COVER = 12, 0.4
#: Seeds of a block of items, rows of 24 bytes; the bound on what is broadcast.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased words without punctuation at their ends; never null."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\p{Punct}\s]+(\s|$)|(^|\s)[\p{Punct}\s]+|\s+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def seed_hash(words: str, at: Column, mask: int) -> Column:
    """Hash of the tokens that the mask inspects from ``at`` on; null where the words end before."""
    looked = F.xxhash64(F.lit(mask), *(F.get(F.col(words), at + offset) for offset in MASKS[mask]))
    return F.when(at + MASKS[mask][-1] < F.size(words), looked)


def seeds(df: DataFrame, keep: list[str], at: str, masks: list[int]) -> DataFrame:
    """``df`` (keep, words) to one row for each mask and window: keep, words, ``at``, mask, seed."""
    span = min(MASKS[m][-1] for m in masks)
    windows = df.where(F.size("words") > span).withColumn(at, F.explode(F.sequence(F.lit(0), F.size("words") - span - 1)))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), seed_hash("words", F.col(at), m).alias("seed")) for m in masks))).alias("s")
    return windows.select(*keep, "words", at, each).select(*keep, "words", at, "s.mask", "s.seed").where("seed is not null")


def item_class(size: Column) -> Column:
    """Place of an item's class in CLASSES; null if it has no seeds."""
    return reduce(lambda made, x: made.when(size >= x[1][0], x[0]), enumerate(CLASSES[1:], 1), F.when(size >= CLASSES[0][0], 0))


def _follows(doc: str, item: str) -> Column:
    """Whether the same mask hits one token earlier on the diagonal too."""
    agree = lambda m: reduce(lambda a, b: a & b, (F.get(F.col(doc), F.col("doc_at") - 1 + o) == F.get(F.col(item), F.col("item_at") - 1 + o) for o in MASKS[m]))
    by_mask = reduce(lambda made, m: made.when(F.col("mask") == m, agree(m)), range(1, len(MASKS)), F.when(F.col("mask") == 0, agree(0)))
    return (F.col("doc_at") > 0) & (F.col("item_at") > 0) & by_mask


def _best_stretch(agree: Column) -> Column:
    """(score, start, length) of the stretch with the highest score; ties to the earlier end, then to the longer."""
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("since"), F.lit(0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).alias("total"))

    def step(s: Column, hit: Column) -> Column:
        run = s["run"] + F.when(hit, 1).otherwise(-2)
        more = run > s["score"]
        return F.struct(
            (s["at"] + 1).alias("at"), F.greatest(run, F.lit(0)).alias("run"), F.when(run < 0, s["at"] + 1).otherwise(s["since"]).alias("since"), F.greatest(run, s["score"]).alias("score"),
            F.when(more, s["since"]).otherwise(s["start"]).alias("start"), F.when(more, s["at"] + 1 - s["since"]).otherwise(s["length"]).alias("length"), (s["total"] + hit.cast("int")).alias("total"),
        )

    return F.aggregate(agree, state, step)


def _verified(docs: DataFrame, items: DataFrame, masks: list[int], min_words: int, min_share: float, min_cover: float) -> DataFrame:
    """(doc_id, item_id, doc_start, overlap, matched, item_words) of one block of items; a row for each run of hits that counts."""
    sized = items.withColumn("class", item_class(F.size("words")))
    parts = []
    for c, (_, _, own) in enumerate(CLASSES):
        if mine := [m for m in (MASKS.index(x) for x in own) if m in masks]:
            parts.append(seeds(sized.where(F.col("class") == c), ["item"], "item_at", mine).select("seed", "item", "item_at"))
    near = F.broadcast(reduce(DataFrame.unionByName, parts))
    met = seeds(docs, ["doc_id"], "doc_at", masks).join(near, "seed")
    laid = met.join(F.broadcast(items.select("item", "item_id", F.col("words").alias("item_words"))), "item").where(~F.coalesce(_follows("words", "item_words"), F.lit(False)))
    start = F.col("doc_at") - F.col("item_at")
    skipped, first = F.greatest(-start, F.lit(0)), F.greatest(start, F.lit(0))
    over = F.least(F.size("item_words") - skipped, F.size("words") - first)
    agree = F.zip_with(F.slice("item_words", skipped + 1, over), F.slice("words", first + 1, over), lambda a, b: a == b)
    scored = laid.select("doc_id", "item_id", first.alias("first"), over.alias("over"), F.size("item_words").alias("item_words"), _best_stretch(agree).alias("s"))
    whole = (F.col("over") == F.col("item_words")) & (F.col("s.total") >= F.col("item_words") * min_share)
    matched = ((F.col("s.score") + 2 * F.col("s.length")) / 3).cast("int")
    part = (matched >= min_words) & (matched >= F.col("item_words") * min_cover) & (matched >= F.col("s.length") * min_share)
    pick = lambda a, b: F.when(whole, a).otherwise(b)
    return scored.where(whole | part).select(
        "doc_id", "item_id", pick(F.col("first"), F.col("first") + F.col("s.start")).alias("doc_start"), pick(F.col("over"), F.col("s.length")).alias("overlap"), pick(F.col("s.total"), matched).alias("matched"), "item_words"
    )


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, min_cover: float = MIN_COVER, block_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, doc_start, overlap, matched, item_words.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. An item of SHORTEST tokens or more counts
    whole, if ``min_share`` of its tokens agree in their places, or by a stretch in which as large a share
    agrees, ``min_words`` tokens at least and ``min_cover`` of the item; so an excerpt counts, and an item
    with a token put in or left out. Whole items are never missed, nor stretches of 21 tokens; a shorter
    stretch needs one unbroken seed. Items of fewer tokens count where they are a document's whole
    token list. One row per document and item, that of the most matched tokens (ties: earliest in the document,
    shortest); doc_start is the first token of the overlap. Null or empty texts hold nothing; equal
    ids share their rows; other columns are ignored; empty tables give an empty result.
    """
    made = benchmark.select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = staged(made.withColumn("item", F.monotonically_increasing_id()), "bench-items")
    by_class = {r["class"]: r["n"] for r in items.groupBy(item_class(F.size("words")).alias("class")).agg(F.sum(F.size("words")).alias("n")).collect()}  # a row for each class
    masks = [MASKS.index(m) for c, (_, _, own) in enumerate(CLASSES) if c in by_class for m in own]
    count = sum(n * (1 if c is None else len(CLASSES[c][2])) for c, n in by_class.items())
    blocks = max(1, math.ceil(count / block_seeds))
    texts = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    found = []
    for b in range(blocks):
        some = items.where(F.pmod("item", F.lit(blocks)) == b) if blocks > 1 else items
        if masks:
            found.append(_verified(texts, some, masks, min_words, min_share, min_cover))
        if None in by_class or not masks:
            short = F.broadcast(some.where(F.size("words") < SHORTEST).select("item_id", "words"))
            n = F.size("words")
            same = texts.where(n.between(1, SHORTEST - 1)).join(short, "words")
            found.append(same.select("doc_id", "item_id", F.lit(0).alias("doc_start"), n.alias("overlap"), n.alias("matched"), n.alias("item_words")))
    best = F.max_by(F.struct("doc_start", "overlap", "matched"), F.struct("matched", -F.col("doc_start"), -F.col("overlap")))
    grouped = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best.alias("best"), F.max("item_words").alias("item_words"))
    return grouped.select("doc_id", "item_id", "best.*", "item_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; rows are told apart by doc_id, null or not, and text."""
    key = F.struct(docs["doc_id"].alias("id"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("md5"))
    (hit,) = free(docs, "_hit")
    hits = find_overlaps(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(hits, key == hits[hit], "left_anti")
