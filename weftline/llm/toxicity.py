"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its lower-cased words and the words' first few characters, so that an inflected
insult shares a term with its stem. A term is hashed to one of BUCKETS buckets; those whose presence
goes with the label, by a likelihood ratio over all labelled rows that teach, become the model's
inputs, with the value log2(1 + count). The machine scores

    z = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

so two terms that are harmless alone, an insult quoted and a group named, weigh together what an
additive model can't give them. A score is the logistic of z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ship
from weftline.llm.quality import held_out
from weftline.llm.wordhash import mix64, span_hashes

#: Labelled rows to learn from, those of the least hash of doc_id; the bound on what reaches the driver.
MAX_TRAIN = 20_000
THRESHOLD = 0.5
BUCKET_BITS = 20
PREFIXES = (4, 5, 6, 8)
#: Inputs of the machine at most, the least rows that hold one, and the least likelihood ratio (a chance of 1 in 120); shrinkage settles the chance ones.
INPUTS, SUPPORT, EVIDENCE = 4_096, 3, 7.0
FACTORS, STEPS, RATE, SHRINK = 8, 250, 0.05, 2e-4
#: Characters of texts that are hashed at once.
CHARS = 1 << 20

# Letters and digits of any script; from 65,536 on every character counts as one.
_INSIDE = np.array([chr(c).isalnum() for c in range(1 << 16)])


def hashed_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every occurrence of a term, row by row; a null or empty text has none."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.where(points < len(_INSIDE), _INSIDE[np.minimum(points, len(_INSIDE) - 1)], True)
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    limits = np.cumsum([len(t) + 1 for t in lowered]) if lowered else np.zeros(0, np.int64)
    rows, found = [], []
    of = np.searchsorted(limits, starts, side="right")
    for kind, length in enumerate((0, *PREFIXES)):
        have = np.flatnonzero(ends - starts >= max(length, 1))
        stop = starts[have] + length if length else ends[have]
        found.append(mix64(span_hashes(points, starts[have], stop) + np.uint64(kind)) >> np.uint64(64 - BUCKET_BITS))
        rows.append(of[have])
    return np.concatenate(rows).astype(np.int64), np.concatenate(found).astype(np.int64)


def inputs(texts: list[str | None], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, input, value) of the texts, ordered by row; ``slots`` maps a bucket to its input or -1."""
    rows, buckets = hashed_terms(texts)
    slot = slots[buckets]
    rows, slot = rows[slot >= 0], slot[slot >= 0]
    size = max(int(slots.max(initial=0)) + 1, 1)
    keys, count = np.unique(rows * size + slot, return_counts=True)
    return keys // size, keys % size, np.log2(1.0 + count)


def slices(texts: list[str | None], chars: int = CHARS) -> Iterator[slice]:
    """Runs of texts of about ``chars`` characters, a longer text alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > chars:
            yield slice(start, i)
            start, held = i, 0
        held += len(t or "") + 1
    if start < len(texts):
        yield slice(start, len(texts))


@dataclass
class FactorizationMachine:
    bias: float = 0.0
    slots: np.ndarray = field(default_factory=lambda: np.full(1 << BUCKET_BITS, -1, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((1, FACTORS)))

    def raw(self, n: int, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> np.ndarray:
        """z of ``n`` rows given as (row, input, value)."""
        z = self.bias + np.bincount(row, self.weights[col] * value, n)
        for f in range(self.factors.shape[1]):
            part = self.factors[col, f] * value
            z += 0.5 * (np.bincount(row, part, n) ** 2 - np.bincount(row, part * part, n))
        return z

    def fit(self, y: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, size: int) -> FactorizationMachine:
        """Gradient descent with moments over all rows at once. Without both classes the score is the smoothed base rate."""
        n = len(y)
        rate = (y.sum() + 1.0) / (n + 2.0)
        self.bias = float(np.log(rate / (1 - rate)))
        self.weights, self.factors = np.zeros(max(size, 1)), np.zeros((max(size, 1), FACTORS))
        if len(np.unique(y)) < 2 or not size:
            return self
        self.factors = np.random.default_rng(7).normal(0, 0.05, (size, FACTORS))
        at = np.concatenate([[self.bias], self.weights, self.factors.T.ravel()])
        first, second = np.zeros_like(at), np.zeros_like(at)
        for step in range(1, STEPS + 1):
            self.bias, self.weights, self.factors = float(at[0]), at[1 : size + 1], at[size + 1 :].reshape(FACTORS, size).T
            z, parts = self.bias + np.bincount(row, self.weights[col] * value, n), []
            for f in range(FACTORS):
                part = self.factors[col, f] * value
                total = np.bincount(row, part, n)
                z += 0.5 * (total**2 - np.bincount(row, part * part, n))
                parts.append((part, total))
            wrong = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
            pull = wrong[row] * value
            slopes = [np.bincount(col, pull * (total[row] - part), size) for part, total in parts]
            slope = np.concatenate([[wrong.sum()], np.bincount(col, pull, size), *slopes])
            slope[1:] += SHRINK * at[1:]
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            at = at - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.bias, self.weights, self.factors = float(at[0]), at[1 : size + 1].copy(), at[size + 1 :].reshape(FACTORS, size).T.copy()
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(self.raw(part.stop - part.start, *inputs(texts[part], self.slots)), -40, 40))) for part in slices(texts)]
        return np.concatenate(out) if out else np.zeros(0)


def evidence(pos: np.ndarray, held: np.ndarray, toxic: int, n: int) -> np.ndarray:
    """Likelihood ratio of "a row holds the term" and "the row is toxic" being independent: ``pos`` of ``toxic`` rows and ``held`` of all ``n`` hold it."""
    cells = [(pos, held * toxic / n), (held - pos, held * (n - toxic) / n), (toxic - pos, (n - held) * toxic / n), (n - held - toxic + pos, (n - held) * (n - toxic) / n)]
    return 2 * sum(np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(hoped, 1e-12)), 0.0) for seen, hoped in cells)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> FactorizationMachine:
    """Learn from labelled rows outside the held-out fold. Rows with a null id, text or label don't teach; an id labelled both ways doesn't either; of an id's several texts one teaches."""
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def presence(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, toxic = part.column("text").to_pylist(), part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for some in slices(texts):
                row, bucket = hashed_terms(texts[some])
                seen = np.unique(row * (1 << BUCKET_BITS) + bucket)
                bucket, y = seen % (1 << BUCKET_BITS), toxic[some][seen >> BUCKET_BITS]
                held = np.bincount(bucket, minlength=1 << BUCKET_BITS)
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (at, np.bincount(bucket, y, 1 << BUCKET_BITS)[at], held[at])], ["bucket", "pos", "held"])

    size = rows.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    counts = rows.mapInArrow(presence, "bucket long, pos long, held long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("held").alias("held"))
    found = counts.where(F.col("held") >= SUPPORT).toArrow()  # a row for each bucket at most
    bucket, pos, held = (found.column(c).to_numpy() for c in ("bucket", "pos", "held"))
    ratio = evidence(pos, held, size["toxic"], max(size["n"], 1))
    order = np.lexsort((bucket, -ratio))[:INPUTS]
    chosen = np.sort(bucket[order[ratio[order] >= EVIDENCE]])
    model = FactorizationMachine()
    model.slots[chosen] = np.arange(len(chosen), dtype=np.int32)
    slots = model.slots

    def examples(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("text").to_pylist()
            for some in slices(texts):
                n = some.stop - some.start
                row, col, value = inputs(texts[some], slots)
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
                made = [pa.ListArray.from_arrays(at, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value))]
                ids, toxic = (part.column(c).slice(some.start, n) for c in ("doc_id", "toxic"))
                yield pa.RecordBatch.from_arrays([ids, toxic.cast(pa.int32()), *made], ["doc_id", "toxic", "cols", "vals"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(examples, f"doc_id {kind}, toxic int, cols array<int>, vals array<double>")
    # One row for each labelled id, so the bound holds however often an id is repeated.
    got = made.groupBy("doc_id").agg(F.min(F.struct("cols", "vals", "toxic")).alias("row")).orderBy(F.xxhash64("doc_id"), "doc_id").select("row.*").toArrow()
    lists = got.column("cols").combine_chunks(), got.column("vals").combine_chunks()
    lengths = np.array([len(x) for x in lists[0]], dtype=np.int64)
    cols, vals = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    return model.fit(got.column("toxic").to_numpy().astype(float), np.repeat(np.arange(len(lengths)), lengths), cols.astype(np.int64), vals.astype(float), len(chosen))


def score_documents(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row. A null text scores as an empty one; other columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # a table of 2**BUCKET_BITS places and INPUTS rows of factors at most

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            score = shared.value.score(part.column("text").to_pylist())
            made = [pa.array(score, pa.float64()), pa.array(score >= threshold).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *made], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(batches, f"doc_id {kind}, held_out boolean, score double, predicted int")
