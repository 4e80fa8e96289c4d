"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shares and rates of the whole text. Each is cut into quantile bins; boosting cycles over
the features, and each step adds a shallow tree over one feature's bins to that feature's lookup
table. Then the pairs whose residual a 2 x 2 cut explains best get tables of their own, boosted alike.
A score is the logistic of an intercept and one bin lookup for each table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ship

#: Labelled rows to learn from, those of the least hash of doc_id; the bound on what reaches the driver.
MAX_TRAIN = 20_000
#: Score from which a document is kept.
THRESHOLD = 0.3
FOLDS = 5
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15

FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "pipe", "exclaim", "punct", "newline", "wide",
    "entropy", "distinct_words", "distinct_lines", "short_words", "longest_word",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#$%&*<>{}[]=+~^@\\/_",
    "pipe": b"|",
    "exclaim": b"!?",
    "punct": b".,;:",
    "newline": b"\n",
    "wide": bytes(range(128, 256)),
}


def text_features(text: str) -> list[float]:
    """FEATURES of one whole text; an empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    total, n = counts.sum(), len(words)
    share = {k: counts[np.frombuffer(v, np.uint8)].sum() / total for k, v in _CLASSES.items()}
    p = counts[counts > 0] / total
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = text.split("\n")
    return [
        np.log1p(n), lengths.mean(), share["upper"], share["digit"], share["symbol"], share["pipe"], share["exclaim"], share["punct"], share["newline"], share["wide"],
        -(p * np.log2(p)).sum(), len(set(words)) / n, len(set(lines)) / len(lines), (lengths <= 3).mean(), lengths.max(),
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([text_features(t) if t else [0.0] * len(FEATURES) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best place to cut bins of gradient sums ``g`` and curvatures ``h``: its gain, and the first bin right of it."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a tree of ``depth`` levels over one feature's bins."""
    gain, at = _cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts the first axis once and each side's second axis once."""
    best = (-1.0, np.zeros_like(g))
    for at in range(1, g.shape[0]):
        total, values = 0.0, np.empty_like(g)
        for rows in (slice(0, at), slice(at, None)):
            gs, hs = g[rows].sum(0), h[rows].sum(0)
            gain, cut = _cut(gs, hs)
            total += gain + _gain(gs.sum(), hs.sum())
            for columns in (slice(0, cut), slice(cut, None)):
                values[rows, columns] = gs[columns].sum() / (hs[columns].sum() + 1.0)
        if total > best[0]:
            best = (total, values)
    return best[0] - float(_gain(g.sum(), h.sum())), best[1]


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def _bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """``x`` (n, features), ``y`` of 0 and 1. Without both classes the score is the smoothed base rate."""
        rate = (y.sum() + 1.0) / (len(y) + 2.0)
        self.intercept = float(np.log(rate / (1 - rate)))
        quantiles = lambda bins: [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])] if len(x) else [np.zeros(0)] * x.shape[1]
        self.edges, self.pair_edges = quantiles(BINS), quantiles(PAIR_BINS)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if len(np.unique(y)) < 2:
            return self
        bins, z = self._bins(x, self.edges), np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for i, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-z))
                g, h = (np.bincount(bins[:, i], w, len(table)) for w in (y - p, p * (1 - p)))
                step = RATE * _tree(g, h)
                table += step
                z += step[bins[:, i]]
        coarse = self._bins(x, self.pair_edges)
        sizes = [len(e) + 1 for e in self.pair_edges]

        def sums(a: int, b: int) -> list[np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return [np.bincount(coarse[:, a] * sizes[b] + coarse[:, b], w, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]) for w in (y - p, p * (1 - p))]

        ranked = sorted(((_pair_tree(*sums(a, b))[0], a, b) for a in range(len(sizes)) for b in range(a) if sizes[a] > 1), reverse=True)
        self.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in ranked[:PAIRS] if gain > 0]
        for _ in range(PAIR_ROUNDS):
            for a, b, table in self.pairs:
                step = RATE * _pair_tree(*sums(a, b))[1]
                table += step
                z += step[coarse[:, a], coarse[:, b]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        bins, coarse = self._bins(x, self.edges), self._bins(x, self.pair_edges)
        for i, table in enumerate(self.tables):
            z += table[bins[:, i]]
        for a, b, table in self.pairs:
            z += table[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-z))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> AdditiveModel:
    """Learn from labelled rows outside the held-out fold. Rows with a null id, text or label don't teach; an id labelled both ways doesn't either; of an id's several texts one teaches."""
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = pa.array(list(feature_matrix(part.column("text").to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int64()), x], ["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(batches, f"doc_id {kind}, quality long, x array<double>")
    # One row for each labelled id, so the bound holds however often an id is repeated.
    got = made.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("row")).orderBy(F.xxhash64("doc_id"), "doc_id").select("row.x", "row.quality").collect()
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, np.array([r["quality"] for r in got], dtype=np.float64))


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row. A null text scores as an empty one; other columns are ignored."""
    ship(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            score = model.score(feature_matrix(part.column("text").to_pylist()))
            made = [pa.array(score, pa.float64()), pa.array(score >= threshold).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *made], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(batches, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that a model learnt from ``labels`` rejects; all columns and clean rows stay."""
    model = train(docs, labels)
    ship(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = model.score(feature_matrix(part.column("text").to_pylist())) >= threshold
            yield part.filter(pa.array(good))

    return docs.mapInArrow(batches, docs.schema)
