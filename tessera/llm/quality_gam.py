"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features in turn: on every visit a tree of
at most four leaves is fitted to the current gradients of one binned feature and added to that feature's
lookup table. Then the pairs with the largest interaction left in the residuals get two-dimensional tables
the same way. A score is the logistic function of the sum of looked-up values, taken for whole batches.

It learns from at most FIT_ROWS labelled rows (those with the smallest hash of their id, so the choice does
not depend on order); the bound is a parameter. Everything else reads all documents and whole texts. Null
and empty texts get the score of their (zero) features; texts of any length are read whole. A score equal to the threshold
is accepted; of equal gains the first cut, feature or pair is taken. A document whose id has several labels counts as its
largest label. With no labels, or one class only, every score is the smoothed share of label 1. Repeated
rows each give a row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import body, held_out

FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, PATIENCE = 300, 120, 0.08, 12
THRESHOLD = 0.7

#: Frequent short words of the languages in the tables (fixed values).
COMMON = frozenset(b"the of and to in that is was for it with as by on be are from this he she der die und das von zu ist mit den im que de la el en los las un una y le les et des du est une dans".split())
FEATURES = (
    "log_words", "mean_word", "std_word", "longest_word", "distinct_words", "top_word", "common_words", "log_lines", "mean_line", "repeated_lines", "short_lines", "ended_lines",
    "upper", "digit", "punctuation", "symbol", "space", "newline", "beyond_ascii", "entropy", "sentence_words", "capital_words", "repeated_neighbours", "no_vowel", "distinct_pairs",
)
_CLASS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in (
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("punctuation", b".,;:!?'\"()-"), ("symbol", b"|#{}<>[]\\/*_=+~^$%&@`"), ("space", b" \t"), ("newline", b"\n\r"))}
_VOWEL = np.isin(np.arange(256), np.frombuffer(b"aeiouyAEIOUY", np.uint8)) | (np.arange(256) > 127)


def features(text: bytes) -> list[float]:
    """One value for each name in FEATURES."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = len(text)
    p = bytes_[bytes_ > 0] / total
    common = sum(c for w, c in ((w, counts.get(w, 0)) for w in COMMON))
    stops = int(bytes_[46] + bytes_[33] + bytes_[63])
    again = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, n - 1)
    vowels = int(bytes_[_VOWEL].sum())
    return [
        float(np.log1p(n)), float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())), len(counts) / n, max(counts.values()) / n, common / n,
        float(np.log1p(len(lines))), float(np.log1p(line_sizes.mean())), 1 - len(set(lines)) / len(lines), float((line_sizes < 20).mean()), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        *(float(bytes_[_CLASS[k]].sum()) / total for k in ("upper", "digit", "punctuation", "symbol", "space", "newline")),
        float(bytes_[128:].sum()) / total, float(-(p * np.log2(p)).sum()), float(np.log1p(n / (1 + stops))), sum(w[:1].isupper() for w in words) / n, again / max(1, n - 1), 1 - vowels / total, pairs,
    ]


@dataclass
class Model:
    """Bin edges and lookup tables. offset: log odds where every table is zero."""

    offset: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.offset)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for i, k, _ in self.pairs for j in (i, k)}
        for i, k, table in self.pairs:
            total += table[coarse[i], coarse[k]]
        return 1 / (1 + np.exp(-total))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < 0.5) | (hr < 0.5)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a shallow tree on one histogram."""
    gain, at = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _step(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values: a cut along one axis, then one along the other on each side."""
    best: tuple[float, np.ndarray] = (-1.0, np.zeros_like(g))
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for at in range(1, len(gg)):
            out, gain = np.zeros_like(gg), 0.0
            for rows in (slice(None, at), slice(at, None)):
                a, b = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                cut = _best_cut(a, b)[1] or len(a)
                for cols in (slice(None, cut), slice(cut, None)):
                    s, t = a[cols].sum(), b[cols].sum()
                    gain += s**2 / (t + 1)
                    out[rows, cols] = _step(s, t)
            if gain > best[0]:
                best = (gain, out if axis == 0 else out.T)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting; a fifth of the rows decides when to stop."""
    model = Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if not len(y) or y.min() == y.max():
        return model
    check = np.arange(len(y)) % 5 == 4
    w = np.where(check, 0.0, 1.0)
    quantile = lambda col, n: np.unique(np.quantile(col, np.linspace(0, 1, n + 1)[1:-1]))
    model.edges = [quantile(x[:, j], BINS) for j in range(x.shape[1])]
    model.pair_edges = [quantile(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.offset)

    def loss() -> float:
        z = total[check] * (2 * y[check] - 1)
        return float(np.logaddexp(0, -z).mean())

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return (p - y) * w, p * (1 - p) * w

    def rounds(n: int, visit, state) -> None:  # noqa: ANN001
        nonlocal total
        best, kept, since = loss(), (state(), total.copy()), 0
        for _ in range(n):
            visit()
            if (now := loss()) < best - 1e-5:
                best, kept, since = now, (state(), total.copy()), 0
            elif (since := since + 1) >= PATIENCE:
                break
        saved, total = kept
        for table, old in zip(state(live=True), saved, strict=True):
            table[...] = old

    def visit_features() -> None:
        nonlocal total
        for j, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(model.tables[j])), np.bincount(b, h, len(model.tables[j])))
            model.tables[j] += step
            total = total + step[b]

    rounds(ROUNDS, visit_features, lambda live=False: model.tables if live else [t.copy() for t in model.tables])
    g, h = slopes()
    cells = lambda i, k: (coarse[i] * (len(model.pair_edges[k]) + 1) + coarse[k], (len(model.pair_edges[i]) + 1, len(model.pair_edges[k]) + 1))
    ranked = []
    for i in range(len(bins)):
        for k in range(i + 1, len(bins)):
            c, shape = cells(i, k)
            s, t = np.bincount(c, g, shape[0] * shape[1]), np.bincount(c, h, shape[0] * shape[1])
            ranked.append((float((s**2 / (t + 1)).sum()), i, k))
    model.pairs = [(i, k, np.zeros(cells(i, k)[1])) for _, i, k in sorted(ranked, reverse=True)[:PAIRS]]

    def visit_pairs() -> None:
        nonlocal total
        for i, k, table in model.pairs:
            g, h = slopes()
            c, shape = cells(i, k)
            step = RATE * _pair_tree(np.bincount(c, g, table.size).reshape(shape), np.bincount(c, h, table.size).reshape(shape))[1]
            table += step
            total = total + step.ravel()[c]

    rounds(PAIR_ROUNDS, visit_pairs, lambda live=False: [t if live else t.copy() for _, _, t in model.pairs])
    return model


def _featured(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        rows = [features(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(4, 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # bounded, so it may be sent to every task
    rows = docs.select("doc_id", body(text).alias("body")).join(F.broadcast(chosen), "doc_id").select("doc_id", "body", "quality").mapInArrow(_featured, "doc_id long, quality int, x array<double>").toPandas()
    if rows.empty:
        return Model(0.0)
    x, ids = np.array(rows["x"].tolist()), rows["doc_id"].to_numpy()
    order = np.lexsort((*x.T[::-1], ids))  # of several texts with one id the least by features, not the one read first
    order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
    x, y = x[order], (rows["quality"].to_numpy()[order] > 0).astype(float)
    order = np.random.default_rng(7).permutation(len(y))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                s = model.score(np.array([features(x.as_py()) for x in batch.column(1)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", body(text).alias("body"), held_out(4, 2).alias("held_out")).mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least the threshold, all their columns as they were."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index(text))
                s = model.score(np.array([features((x.as_py() or "").encode()) for x in texts]))
                yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(batches, docs.schema)
