"""Alignment of two tokenizers over the same bytes, and how often their ids meet in the corpus.

Tokenizer A encodes a space and the text, B the text alone, to which it adds the space itself. Where
both give back the same bytes, their token ends are byte offsets on one axis. The texts of an Arrow
batch are laid one after another on that axis, in slices of about CHARS characters: the ends of A and
of B are counted once each by bincount, an offset where both occur cuts, and differences of running
sums at the documents' bounds give each document's numbers. Between two neighbouring ends of either
kind lies the overlap of exactly one A token with one B token, so those intervals are the links.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_ROWS, ship, staged
from weftline.llm.rollups import BPE_PATTERN, VOCABULARIES
from weftline.llm.toxicity import slices

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: An id pair is a * 2**ID_BITS + b.
ID_BITS = 20


@dataclass
class Encoder:
    """``encode`` turns texts into lists of ids; ``tokens`` are the ids' bytes."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest by the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(path: str) -> Encoder:
    """A byte-level vocabulary. Where its merges make ids in their own order, as byte pairs merged by rank need, tiktoken encodes (the same ids, four times as fast)."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = _byte_letters(), model["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if all(c in letters for c in token):
            tokens[i] = bytes(letters[c] for c in token)
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if made == list(range(256, 256 + len(made))) and all(len(tokens[i]) == 1 for i in range(256)):
        import tiktoken

        known = tiktoken.Encoding(path, pat_str=BPE_PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens[: 256 + len(made)])}, special_tokens={})
        return Encoder(lambda texts: [known.encode_ordinary(t) for t in texts], tokens)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    return Encoder(lambda texts: [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)], tokens)


@lru_cache(maxsize=2)
def pieces(path: str) -> Encoder:
    """A sentence-piece vocabulary with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:-1], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in names]
    return Encoder(lambda texts: model.encode(texts, num_threads=1), tokens)


@dataclass
class Aligned:
    """Of each text: numbers of tokens, groups and links, and its groups as text; and (text, pair, times) of the links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    """Aligns lists of texts; it holds the tokens' bytes, and their ids as text with the separators of a group."""

    def __init__(self, a: Encoder, b: Encoder) -> None:
        self.a, self.b = a, b
        self.lengths = [np.array([len(t) for t in e.tokens], np.int64) for e in (a, b)]
        self.spelling = [np.frombuffer(b"".join(e.tokens), np.uint8) for e in (a, b)]
        self.starts = [np.cumsum(x) - x for x in self.lengths]
        self.names = [f"{i}{s}" for e, ends in ((a, "|,"), (b, ";,")) for s in ends for i in range(len(e.tokens))]

    def __call__(self, texts: list[str | None]) -> Aligned:
        n = len(texts)
        full = [i for i, t in enumerate(texts) if t]
        wanted = [f" {texts[i]}".encode() for i in full]
        sizes = np.array([len(w) for w in wanted], np.int64)
        tokens = [self.a.encode([f" {texts[i]}" for i in full]), self.b.encode([texts[i] for i in full])]
        flat = [np.array(list(chain.from_iterable(ids)), np.int64) for ids in tokens]
        counts = [np.array([len(ids) for ids in x], np.int64) for x in tokens]
        same = np.ones(len(full), bool)
        for k in (0, 1):
            same &= self._spelt(k, flat[k], counts[k], wanted, sizes)
        n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for count, c in zip((n_a, n_b), counts, strict=True):
            count[full] = np.where(same, c, 0)
        a, b = (ids[np.repeat(same, c)] for ids, c in zip(flat, counts, strict=True))
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        size = int(ends_a[-1]) + 1 if len(a) else 1
        at_a, at_b = np.bincount(ends_a, minlength=size), np.bincount(ends_b, minlength=size)
        cut = (at_a > 0) & (at_b > 0)
        # Documents' bounds on the byte axis: where their last A token ends.
        bounds = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
        upto = lambda marks: np.diff(np.cumsum(marks)[bounds], prepend=0)
        places = np.flatnonzero(at_a | at_b)
        link_a, link_b = (np.cumsum(x)[places] - x[places] for x in (at_a, at_b))
        pair = (a[link_a] << ID_BITS) | b[link_b]
        # Times of each pair in each text.
        order = np.lexsort((pair, of := np.searchsorted(bounds, places, side="left")))
        pair, of = pair[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(of) != 0)])) if len(pair) else np.zeros(0, np.int64)
        return Aligned(n_a, n_b, upto(cut), upto((at_a | at_b) > 0), self._groups(a, b, ends_a, ends_b, cut, n_a, n_b), of[new], pair[new], np.diff(np.concatenate([new, [len(pair)]])))

    def _spelt(self, k: int, ids: np.ndarray, count: np.ndarray, wanted: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Whether each text's tokens, joined, are its wanted bytes."""
        length = self.lengths[k][ids]
        ends = np.cumsum(length)
        bounds = np.concatenate([[0], ends])[np.cumsum(count)]
        good = np.diff(bounds, prepend=0) == sizes
        if not good.all():  # only texts of the wanted length are on the wanted bytes' axis
            pick = np.repeat(good, count)
            ids, length = ids[pick], length[pick]
            ends = np.cumsum(length)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[k][ids] - (ends - length), length)
        wrong = self.spelling[k][place] != np.frombuffer(b"".join(w for w, g in zip(wanted, good, strict=True) if g), np.uint8)
        errors = np.concatenate([[0], np.cumsum(wrong)])[np.cumsum(sizes[good])]
        good[good] = np.diff(errors, prepend=0) == 0
        return good

    def _groups(self, a, b, ends_a, ends_b, cut, n_a, n_b) -> list[str]:
        """Texts like "1,2|3;4|5,6": a group's A ids, then its B ids."""
        before = np.cumsum(cut) - cut
        group_a, group_b = before[ends_a], before[ends_b]
        # An A token stands after the B tokens of the groups before its own, a B token after the A tokens of its own, too.
        groups = int(cut.sum())
        sum_a, sum_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]) for g in (group_a, group_b))
        codes = np.empty(len(a) + len(b), np.int64)
        many_a, many_b = len(self.a.tokens), len(self.b.tokens)
        codes[np.arange(len(a)) + sum_b[group_a]] = a + np.where(cut[ends_a], 0, many_a)
        codes[np.arange(len(b)) + sum_a[group_b + 1]] = b + 2 * many_a + np.where(cut[ends_b], 0, many_b)
        stops, names = np.cumsum(n_a + n_b), self.names
        return ["".join(map(names.__getitem__, codes[stop - k : stop].tolist()))[:-1] for stop, k in zip(stops.tolist(), (n_a + n_b).tolist(), strict=True)]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(byte_level(a_path), pieces(b_path))


def alignments(docs: DataFrame, folder: str = VOCABULARIES, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, links (array of pair and times); one row per input row.

    A text that is null, empty or not given back byte for byte by both tokenizers has no tokens: zeros,
    empty groups, no links. Other columns are ignored. Texts are encoded whole.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair:long,times:int>>"
    fields = pa.struct([("pair", pa.int64()), ("times", pa.int32())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(f"{folder}/{a_file}", f"{folder}/{b_file}")
        for part in parts:
            texts = part.column("text").to_pylist()
            for some in slices(texts):
                n, got = some.stop - some.start, align(texts[some])
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(got.text, minlength=n))]), pa.int32())
                links = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(got.pair), pa.array(got.times, pa.int32())], fields=list(fields)))
                numbers = [pa.array(x, pa.int64()) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(some.start, n), *numbers, pa.array(got.groups, pa.string()), links], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return docs.select("doc_id", "text").mapInArrow(batches, made)


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, pair, n, best of rows (pair, times): how many links hold the ids, and whether none of b's pairs has more. B's vocabulary bounds what is broadcast."""
    counts = links.groupBy("pair").agg(F.sum("times").alias("n"))
    counts = counts.withColumns({"a": F.shiftright("pair", ID_BITS), "b": F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))})
    counts = staged(counts, "pair-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("_top"))
    return counts.join(F.broadcast(top), "b").select("a", "b", "pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least count from which on there are ``most`` pairs at most; 0 if all of them are."""
    if counts.limit(most + 1).count() <= most:
        return 0
    # Powers of two from the smallest on: the pairs below are joined by a shuffle, so the bound needn't be tight.
    held = {r["e"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count("*").alias("k")).collect()}
    total, at = 0, max(held) + 1
    while at - 1 in held and total + held[at - 1] <= most or at - 1 not in held:
        total, at = total + held.get(at - 1, 0), at - 1
    return 1 << at


def linked_documents(docs: DataFrame, folder: str = VOCABULARIES, a_file: str = A_FILE, b_file: str = B_FILE, head: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Ids' counts cover the corpus. The ``head`` most frequent pairs at most are broadcast, so the links of
    common words stay where they are; the rest, each pair of few links, meets its count by a shuffle.
    """
    made = alignments(docs, folder, a_file, b_file)
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    made = staged(made.withColumns({"groups_sha256": sha, "_row": F.monotonically_increasing_id()}).drop("groups"), "aligned")
    links = made.select("_row", F.inline("links"))
    counts = staged(pair_counts(links.select("pair", "times")).select("pair", "n", "best"), "pairs")
    least = _frequent(counts, head)
    hot = F.broadcast(counts.where(F.col("n") >= least))
    summed = lambda rows: rows.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    parts = summed(links.join(hot, "pair"))
    if least:
        rare = links.join(F.broadcast(counts.where(F.col("n") >= least).select("pair")), "pair", "left_anti")
        parts = parts.union(summed(rare.join(counts.where(F.col("n") < least), "pair"))).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    return made.drop("links").join(parts, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, none).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
