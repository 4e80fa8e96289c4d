"""Collocations mined by pivot partitioning.

Phrases of two or three words are counted within pieces of texts. The pivot of an n-gram is its rarest
word (the leftmost, if that comes twice). Each place of a text where a word can be a pivot becomes a
fragment: the word and up to two words on either side, rewritten so that it ends before any word rarer
than the pivot and before any word too rare for a candidate. Fragments travel to their pivot, equal
ones of a batch as one row with a count; there the n-grams that hold the pivot are counted, and no other.

"Rarest" is told by a table of BUCKETS hashed counts of the words that are frequent enough; it has the
same size for every corpus. Words that share a bucket only make fragments longer; counts stay exact, as
any one order of words gives every n-gram just one pivot. Pivots of many occurrences are dealt over
several tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import ship, staged
from weftline.llm.toxicity import slices
from weftline.llm.wordhash import mix64, word_hashes

#: Fixed values of the task: least count, share of a phrase's occurrences inside a longer candidate that drops it, rows for each language.
LEAST, INSIDE, TOP = 10, 50, 2_000
BUCKETS = 1 << 22
#: Occurrences of a pivot that one task takes at most, about.
PIVOT_ROWS = 200_000
#: Runs that a language's candidates are ranked in first.
RUNS = 64
#: Characters whose words and fragments are counted together before they leave a task.
CHARS = 1 << 22

# A-Z to lower case, the ends of pieces to line feeds, tabs to spaces; other bytes stay.
_PLAIN = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit("und"))


def _by_language(part: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], list[int]]]:
    """Languages of a batch in slices of bounded size: all words, and the number of words of each piece."""
    langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
    for some in slices(texts, CHARS):
        held: dict[str, list[bytes]] = {}
        for lang, text in zip(langs[some], texts[some], strict=True):
            held.setdefault(lang, []).append((text or "").encode().translate(_PLAIN))
        for lang, plain in held.items():
            whole = b"\n".join(plain)
            if words := whole.split():  # what parts pieces is white space here, too
                yield lang, words, [len(p.split()) for p in whole.split(b"\n")]


def _buckets(lang: str, words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, hash) of a language's words."""
    hashes = mix64(word_hashes([w.decode() for w in words]) + word_hashes([lang or " "])[0] if words else np.zeros(0, np.uint64))
    return (hashes % np.uint64(buckets)).astype(np.int64), hashes


def count_words(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """lang, word, bucket, n of all word occurrences of ``docs`` (text, lang)."""
    ship(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lang, every, _ in _by_language(part):
                counts = Counter(every)
                words = list(counts)
                made = [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(_buckets(lang, words, buckets)[0]), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(made, ["lang", "word", "bucket", "n"])

    rows = docs.select(language(F.col("lang")).alias("lang"), "text").where("text is not null")
    return rows.mapInArrow(batches, "lang string, word string, bucket long, n long").groupBy("lang", "word", "bucket").agg(F.sum("n").alias("n"))


def _ranks(weight: np.ndarray, hashes: np.ndarray, names: list[bytes], least: int) -> np.ndarray:
    """Places of a batch's words from rare to frequent, -1 for those too rare. Any two words stand alike in every batch."""
    order = np.lexsort((hashes, weight))
    if ((np.diff(weight[order]) == 0) & (hashes[order][1:] == hashes[order][:-1])).any():
        order = np.array(sorted(range(len(names)), key=lambda i: (weight[i], hashes[i], names[i])))
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    rank[weight < least] = -1
    return rank


def _fragments(lang: str, words: list[bytes], lengths: list[int], weights: np.ndarray, least: int, pivot_rows: int) -> list[pa.Array]:
    """key, at, right, fragment, n of a language's words, laid out in pieces."""
    flat = pa.array(words, pa.binary()).dictionary_encode()
    code, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()
    bucket, hashes = _buckets(lang, names, len(weights))
    weight = weights[bucket].astype(np.int64)
    n = len(code)
    r = np.concatenate([[-1, -1], _ranks(weight, hashes, names, least)[code], [-1, -1]])  # two cut places on either side
    piece = np.concatenate([[-1, -1], np.repeat(np.arange(len(lengths)), lengths), [-1, -1]])
    here = np.arange(n) + 2
    own, same = r[here], lambda k: piece[here + k] == piece[here]
    left1 = same(-1) & (r[here - 1] > own)  # a word as rare on the left would own the n-gram itself
    left = left1.astype(np.int64) + (left1 & same(-2) & (r[here - 2] > own))
    right1 = same(1) & (r[here + 1] >= own)
    right = right1.astype(np.int64) + (right1 & same(2) & (r[here + 2] >= own))
    at = np.flatnonzero((own >= 0) & (left + right > 0))
    left, right = left[at], right[at]
    padded = np.concatenate([[-1, -1], code, [-1, -1]]) + 1
    spots = np.stack([np.where((k >= -left) & (k <= right), padded[at + 2 + k], 0) for k in range(-2, 3)])
    # Equal fragments of the batch as one row; a hash sorts them, and is checked.
    named = np.concatenate([np.zeros(1, np.uint64), hashes])
    mark = np.zeros(len(at), np.uint64)
    for spot in spots:
        mark = mix64(mark + named[spot] + np.uint64(0x9E3779B97F4A7C15))
    _, first, inverse, times = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
    if (spots != spots[:, first[inverse]]).any():
        _, first, times = np.unique(spots, axis=1, return_index=True, return_counts=True)
    spots, mark, left, right = spots[:, first], mark[first], left[first], right[first]
    pivot = spots[2] - 1
    tasks = (weight[pivot] // pivot_rows + 1).astype(np.uint64)
    key = mix64(hashes[pivot] + (mark % tasks) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1) & ~np.uint64(1) | (tasks == 1).astype(np.uint64)
    texts = flat.dictionary.cast(pa.string())
    parts = [texts.take(pa.array(spot - 1, mask=spot == 0)) for spot in spots]
    return [pa.array(key.astype(np.int64)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pc.binary_join_element_wise(*parts, " ", null_handling="skip"), pa.array(times.astype(np.int64))]


def fragments(docs: DataFrame, words: DataFrame, least: int = LEAST, pivot_rows: int = PIVOT_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """lang, key, at, right, fragment, n: the fragments of ``docs`` and how many words stand before and after the pivot. ``words`` is count_words, staged; ``buckets`` numbers of it are broadcast.

    ``key`` stands for the pivot. It is odd if the pivot's fragments are all under one key; those of a
    pivot of more than ``pivot_rows`` occurrences are dealt over several even keys.
    """
    spark = docs.sparkSession
    ship(spark)
    found = words.where(F.col("n") >= least).groupBy("bucket").agg(F.max("n").alias("n")).toArrow()
    weights = np.zeros(buckets, np.int32)
    weights[found.column("bucket").to_numpy()] = np.minimum(found.column("n").to_numpy(), (1 << 31) - 1)
    shared = spark.sparkContext.broadcast(weights)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lang, every, lengths in _by_language(part):
                made = _fragments(lang, every, lengths, shared.value, least, pivot_rows)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(made[0]), pa.string()), *made], ["lang", "key", "at", "right", "fragment", "n"])

    rows = docs.select(language(F.col("lang")).alias("lang"), "text").where("text is not null")
    return rows.mapInArrow(batches, "lang string, key long, at int, right int, fragment string, n long")


def owned_phrases(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, a: n-grams of fragments that hold the pivot, ``least`` or more.

    One shuffle by the pivot's key, where counts are whole; only the phrases of a pivot that is dealt
    over several keys meet in a second.
    """
    routed = parts.repartition("lang", "key")
    at, right = F.col("at"), F.col("right")
    cut = lambda text, n: F.call_function("substring_index", text, F.lit(" "), n)
    gram = lambda start, k, ok: F.when(ok, cut(cut(F.col("fragment"), start + k), F.lit(-k)))
    pairs = gram(at - 1, 2, at >= 1), gram(at, 2, right >= 1)
    grams = F.array(*pairs, gram(at - 2, 3, at >= 2), gram(at - 1, 3, (at >= 1) & (right >= 1)), gram(at, 3, right >= 2))
    # Nulls are dropped after explode: array_compact is interpreted, and all expressions under it with it.
    listed = routed.select("lang", "key", "n", F.explode(grams).alias("phrase")).where("phrase is not null")
    mined = listed.groupBy("lang", "key", "phrase").agg(F.sum("n").alias("a"))
    whole = F.col("key").bitwiseAND(F.lit(1)) == 1
    mined = staged(mined.where(~whole | (F.col("a") >= least)), "mined")
    dealt = mined.where(~whole).groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return mined.where(whole).select("lang", "phrase", "a").unionByName(dealt)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact: in decimals of 38 digits, for counts below 10**15."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(1_000_000).cast("decimal(7,0)"), big(left) * big(right))


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, buckets: int = BUCKETS, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, count and bytes.

    A null text is empty and a null language ``und``. Columns other than text and lang are ignored; an
    empty table gives no rows.
    """
    words = staged(count_words(docs, buckets), "words")
    found = owned_phrases(fragments(docs, words, least, pivot_rows, buckets), least)
    found = staged(found.withColumn("k", F.size(F.split("phrase", " "))), "phrases")
    known = words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    pairs = found.where("k = 2").select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    w = F.split("phrase", " ")
    two = lambda i: F.array_join(F.slice(w, i, 2), " ")
    cuts = F.when(F.col("k") == 2, F.array(F.struct(F.lit(1).alias("cut"), w[0].alias("l_part"), w[1].alias("r_part")))).otherwise(
        F.array(F.struct(F.lit(1).alias("cut"), w[0].alias("l_part"), two(2).alias("r_part")), F.struct(F.lit(2).alias("cut"), two(1).alias("l_part"), w[2].alias("r_part")))
    )
    parts = known.unionByName(pairs)
    cut = found.select("lang", "phrase", "k", "a", F.inline(cuts))
    cut = cut.join(parts.toDF("lang", "l_part", "l"), ["lang", "l_part"]).join(parts.toDF("lang", "r_part", "r"), ["lang", "r_part"])
    cut = cut.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    best = cut.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = found.where("k = 3").select("lang", "a", F.explode(F.array(two(1), two(2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(RUNS)).alias("run"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "run").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
