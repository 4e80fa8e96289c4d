"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The pretrained model is a byte-context trie up to four bytes deep: counts of each byte after each
context, gathered over all training texts, with an end symbol after each text. A byte unseen after a
context costs an escape (method C: d different bytes in n occurrences escape with d / (n + d)) and is
then looked for after the context's suffix, with the bytes already ruled out left out of the counts
(symbol exclusion). Below order 0 all bytes not ruled out are equally likely.

As a context's bytes also occur after its suffix, what exclusion leaves of the suffix's counts depends
on the context alone. So the trie is sparse: one number for each seen byte and three for each context,
in sorted arrays, whatever the corpus holds, and a text's code length is a sum of lookups. It is cut into
slices by the last two bytes of the context, SLICE_GRAMS at most where one such pair allows; slices are
built one at a time, broadcast, and held one at a time in a scoring task, so neither driver nor tasks
need room for the whole trie. Every position's chain of contexts lies in one slice, and scores add up.
An adaptive model, which learns from a text while coding it, is beside it.

The base score is a smoothed unigram model of the same training texts: word counts are gathered in the
same pass. The commonest HEAD words are looked up in the scoring pass; rarer words are joined.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, ship, staged

DEPTH = 4
FOLDS = 10
#: Byte that never occurs in UTF-8; it ends a text.
END = 0xFF
#: What a text's first bytes see before them.
BEFORE = b"\n" * DEPTH
#: Grams of a slice of the trie, about 40 bytes each with their contexts and suffixes; what the driver and a scoring task hold of it at a time.
SLICE_GRAMS = 1_500_000
#: Words in the scoring pass's own dictionary.
HEAD = 1 << 16
#: Bytes and different words handled at once in a task.
CHUNK, COUNTER_WORDS = 1 << 21, 400_000
SMOOTH = 0.1


def in_training(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text leaves a remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != 0


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about CHUNK bytes together, or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + DEPTH + 1
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one byte array with BEFORE and END around each; where its own bytes are; each text's first place among them."""
    raw = np.frombuffer(b"".join(x for t in texts for x in (BEFORE, t, b"\xff")), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + DEPTH)[:-1]])
    own = np.ones(len(raw), bool)
    own[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return raw, np.flatnonzero(own), np.concatenate([[0], np.cumsum(lengths)[:-1]])


def count_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of DEPTH context bytes and a symbol, packed into 40 bits, and their counts."""
    raw, own, _ = _laid_out(texts)
    packed = np.zeros(len(own), np.int64)
    for back in range(DEPTH, -1, -1):
        packed = (packed << 8) | raw[own - back]
    return np.unique(packed, return_counts=True)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return [(keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64))]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to rows of partial counts: gram or word, and n."""

    def out(grams, words, n):
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["gram", "word", "n"])

    words: Counter = Counter()
    parts: list = []
    for batch in batches:
        texts = [t.lower() if t else b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for start, end in _chunks(texts):
            parts.append(count_grams(texts[start:end]))
            if len(parts) >= 8:
                parts = _added(parts)
            for t in texts[start:end]:
                words.update(t.split())
            if len(words) > COUNTER_WORDS:
                yield out([None] * len(words), list(words), list(words.values()))
                words.clear()
    if parts:
        keys, n = _added(parts)[0]
        yield out(keys, [None] * len(keys), n)
    if words:
        yield out([None] * len(words), list(words), list(words.values()))


@dataclass
class ByteTrie:
    """Orders 0 to DEPTH of a slice, each as sorted arrays of packed bytes and of logarithms to base 10.

    Of a gram (context and symbol): ``seen``, its count; ``plain``, its chance where scoring enters at its
    context. Of a context: ``first``, the escape where scoring enters there; ``rest``, what exclusion leaves
    of its suffix's count and kinds; ``left``, the escapes from its suffixes, summed along their chain.
    ``alike`` is the chance of each symbol that is left below order 0.
    """

    grams: list[np.ndarray]
    seen: list[np.ndarray]
    plain: list[np.ndarray]
    contexts: list[np.ndarray]
    first: list[np.ndarray]
    rest: list[np.ndarray]
    left: list[np.ndarray]
    alike: float
    pairs: np.ndarray | None = None
    quick: np.ndarray | None = None

    def prepare(self, counts: np.ndarray) -> ByteTrie:
        """Fill ``quick``: places of the longest grams by a hash; of those that fall together the commonest, others are searched."""
        bits = max(8, int(2 * len(self.grams[DEPTH])).bit_length())
        order = np.argsort(counts, kind="stable")
        self.quick = np.zeros(1 << bits, np.int32)
        self.quick[_bucket(self.grams[DEPTH][order], bits)] = order
        return self

    def longest(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.grams[DEPTH]
        if self.quick is None or not len(keys):
            return _found(keys, packed)
        at = self.quick[_bucket(packed, len(self.quick).bit_length() - 1)].astype(np.int64)
        hit = keys[at] == packed
        slow = np.flatnonzero(~hit)
        at[slow], hit[slow] = _found(keys, packed[slow])
        return at, hit

    def log10_each(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end, of those positions whose two bytes before are this slice's."""
        out = np.zeros(len(texts))
        for start, end in _chunks(texts):
            raw, own, firsts = _laid_out(texts[start:end])
            packed = np.zeros(len(own), np.int64)
            for back in range(DEPTH, -1, -1):
                packed = (packed << 8) | raw[own - back]
            if self.pairs is None:
                each = self.log10_grams(packed)
            else:
                each, mine = np.zeros(len(own)), self.pairs[(packed >> 8) & 0xFFFF]
                each[mine] = self.log10_grams(packed[mine])
            out[start:end] = np.add.reduceat(each, firsts)
        return out

    def log10_grams(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        out, todo = np.empty(len(packed)), np.arange(len(packed))
        # Of positions not found yet: their context one order up, -1 before the first known one; all escapes of their chain.
        above, chain = np.full(len(packed), -1), np.zeros(len(packed))
        for k in range(DEPTH, -1, -1):
            if not len(todo) or not len(self.contexts[k]):
                continue
            own = packed[todo] & ((1 << (8 * (k + 1))) - 1)
            at, hit = self.longest(own) if k == DEPTH else _found(self.grams[k], own)
            entered = hit & (above >= 0)
            if entered.any():  # the chain's escapes down to here, and no further
                out[todo[entered]] = chain[entered] - self.left[k + 1][above[entered]] - self.rest[k + 1][above[entered]] + self.seen[k][at[entered]]
            fresh = hit & ~entered
            out[todo[fresh]] = self.plain[k][at[fresh]]
            todo, above, chain, own = (x[~hit] for x in (todo, above, chain, own))
            place, known = _found(self.contexts[k], own >> 8)
            place = np.where(known, place, 0)
            chain = np.where(known & (above < 0), self.first[k][place] + self.left[k][place], chain)
            above = np.where(known, place, above)
        out[todo] = chain + self.alike
        return out


def _bucket(packed: np.ndarray, bits: int) -> np.ndarray:
    return ((packed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key among sorted ``keys``, and whether it is there."""
    at = np.searchsorted(keys, wanted)
    if not len(keys):
        return at, np.zeros(len(wanted), bool)
    return at, keys[np.minimum(at, len(keys) - 1)] == wanted


def build_trie(grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], pairs: np.ndarray | None = None) -> ByteTrie:
    """A slice from its packed grams of DEPTH context bytes and a symbol, sorted, with their counts.

    ``low`` has the grams of one context byte and their counts, of the whole corpus; ``pairs`` marks the
    last two bytes of this slice's contexts.
    """

    def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(keys, return_inverse=True)
        return own, np.bincount(at, n, len(own)).astype(np.int64)

    levels = [added(low[0] & 0xFF, low[1]), low]
    levels += [added(grams & ((1 << (8 * (k + 1))) - 1), counts) for k in range(2, DEPTH + 1)]
    trie = ByteTrie([g for g, _ in levels], [np.log10(n).astype(np.float32) for _, n in levels], [], [], [], [], [], -math.log10(max(1, 256 - len(levels[0][0]))), pairs)
    totals, kinds = [], []
    for k, (keys, n) in enumerate(levels):
        own, at = np.unique(keys >> 8, return_inverse=True)
        totals.append(np.bincount(at, n, len(own)).astype(np.int64))
        kinds.append(np.bincount(at, minlength=len(own)).astype(np.int64))
        whole = np.log10(totals[k] + kinds[k])
        trie.contexts.append(own)
        trie.plain.append((np.log10(n) - whole[at]).astype(np.float32))
        trie.first.append(np.log10(kinds[k]) - whole)
        if not k:
            trie.rest.append(np.zeros(len(own)))
            trie.left.append(np.zeros(len(own)))
            continue
        suffix = np.searchsorted(trie.contexts[k - 1], own & ((1 << (8 * (k - 1))) - 1))
        # What the context has seen counts no more after its suffix.
        shorter, m = levels[k - 1]
        gone = np.bincount(at, m[np.searchsorted(shorter, keys & ((1 << (8 * k)) - 1))], len(own)).astype(np.int64)
        d = kinds[k - 1][suffix] - kinds[k]
        trie.rest.append(np.log10(np.maximum(totals[k - 1][suffix] - gone + d, 1)))
        trie.left.append(np.where(d > 0, np.log10(np.maximum(d, 1)) - trie.rest[k], 0.0) + trie.left[k - 1][suffix])
    return trie.prepare(levels[DEPTH][1])


class AdaptivePPM:
    """The same model learning from the text as it codes it, one byte at a time; for single texts."""

    def __init__(self, depth: int = DEPTH) -> None:
        self.depth = depth
        self.counts: dict[bytes, Counter] = defaultdict(Counter)

    def chance(self, context: bytes, symbol: int) -> float:
        left, out = 1.0, set()
        for k in range(min(self.depth, len(context)), -1, -1):
            seen = {s: n for s, n in self.counts.get(context[len(context) - k :], {}).items() if s not in out}
            whole = sum(seen.values()) + len(seen)
            if symbol in seen:
                return left * seen[symbol] / whole
            if seen:
                left *= len(seen) / whole
                out |= set(seen)
        return left / (256 - len(out))

    def log10(self, text: bytes, learn: bool = True) -> float:
        """log10 probability of the text and its end."""
        past, total = BEFORE, 0.0
        for symbol in text + b"\xff":
            context = past[len(past) - self.depth :]
            total += math.log10(self.chance(context, symbol))
            if learn:
                for k in range(self.depth + 1):
                    self.counts[context[self.depth - k :]][symbol] += 1
            past += bytes([symbol])
        return total


@dataclass
class PretrainedModel:
    slices: list[Broadcast]
    words: DataFrame
    head: dict[bytes, int]
    tokens: int
    types: int


def slice_bounds(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Ranges of pairs, [first, after), that hold ``most`` grams at most, or one pair of more; sizes by pair, ascending."""
    out, held, start = [], 0, 0
    for pair, n in sizes:
        if held and held + n > most:
            out.append((start, pair))
            held, start = 0, pair
        held += n
    return [*out, (start, 1 << 16)]


def _slices(grams: DataFrame, most: int) -> list[Broadcast]:
    """The trie's slices, each fetched, built and broadcast before the next."""
    pair = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    sizes = sorted(tuple(r) for r in grams.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).collect())  # 65,536 at most

    def fetched(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.toArrow()
        keys, n = (got.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
        order = np.argsort(keys)
        return keys[order], n[order]

    low = fetched(grams.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n")))  # 65,536 at most
    out, bounds = [], slice_bounds(sizes, most)
    for first, after in bounds:
        pairs = np.arange(1 << 16)
        mark = None if len(bounds) == 1 else (pairs >= first) & (pairs < after)
        some = grams if mark is None else grams.where((pair >= first) & (pair < after))
        out.append(grams.sparkSession.sparkContext.broadcast(build_trie(*fetched(some), low, mark)))
    return out


def _score_all(slices: list[Broadcast], texts: list[bytes]) -> np.ndarray:
    """Sum of the slices' scores; of several, one is in memory at a time."""
    score = np.zeros(len(texts))
    for held in slices:
        score += held.value.log10_each(texts)
        if len(slices) > 1:
            held.__dict__.pop("_value", None)  # read again from the worker's file when it is wanted
    return score


def pretrain(docs: DataFrame, slice_grams: int = SLICE_GRAMS) -> PretrainedModel:
    """Learn the byte trie and the word counts from all of ``docs`` (text; null: empty)."""
    ship(docs.sparkSession)
    partial = docs.select("text").mapInArrow(_count_batches, "gram long, word binary, n long")
    partial = staged(partial, "lm-partial")
    grams = staged(partial.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams")
    slices = _slices(grams, slice_grams)
    words = staged(partial.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    discard(partial)
    found = words.agg(F.sum("n"), F.count("*")).first()
    texts = docs.count()
    head = {bytes(r["word"]): r["n"] for r in words.orderBy(F.desc("n"), "word").limit(HEAD).toLocalIterator()}
    return PretrainedModel(slices, words, head, (found[0] or 0) + texts, (found[1] or 0) + bool(texts))


def score_documents(docs: DataFrame, slice_grams: int = SLICE_GRAMS) -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    A null text counts as empty: one end token. Repeated rows and null ids are rows like any other;
    other columns are ignored. Without training texts every byte costs the same and no token is known.
    """
    spark = docs.sparkSession
    model = pretrain(docs.where(in_training(F.col("doc_id"))), slice_grams)
    texts = model.tokens - (model.words.agg(F.sum("n")).first()[0] or 0)
    whole = model.tokens + SMOOTH * (model.types + 1)
    common_words = spark.sparkContext.broadcast({w: math.log10((n + SMOOTH) / whole) for w, n in model.head.items()})
    slices = model.slices
    end = math.log10((texts + SMOOTH) / whole)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = common_words.value
        for part in parts:
            lowered = [t.lower() if t else b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            tokens, common, base, rare = [], [], [], []
            for t in lowered:
                own = t.split()
                found = [x for x in map(head.get, own) if x is not None]
                tokens.append(len(own) + 1)
                common.append(len(found) + (texts > 0))
                base.append(sum(found) + end)
                rare.append([w for w in own if w not in head] if len(found) < len(own) else [])
            columns = [part.column("_row"), part.column("doc_id"), part.column("held_out"), pa.array(tokens, pa.int64()), pa.array(common, pa.int64()), pa.array(base, pa.float64()), pa.array(_score_all(slices, lowered), pa.float64()), pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "held_out", "n_tokens", "common", "base", "score", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "text")
    kind = f"_row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, common long, base double, score double, rare array<binary>"
    scored = staged(rows.mapInArrow(batches, kind), "lm-scored")
    rare = scored.select("_row", F.explode("rare").alias("word")).join(model.words, "word", "left")
    chance = F.log10((F.coalesce("n", F.lit(0)) + SMOOTH) / F.lit(whole))
    sums = rare.groupBy("_row").agg(F.sum(chance).alias("more"), F.count("n").alias("more_known"))
    both = scored.drop("rare").join(sums, "_row", "left")
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("common") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
