"""Toxicity scores by a factorization machine over hashed terms.

A text's features are its distinct words and word stems, and the letter triples of runs too long to be words (as in
scripts without spaces), hashed to 2**20 places. The machine has a weight and ``FACTORS`` factors for each place that tells something:

* alone: a linear fit under an L1 penalty keeps those;
* in pairs: of frequent places, those whose joint rows deviate from the linear fit beyond chance, which finds an insult
  next to a group's name even where neither tells anything by itself;
* with a factor: once fitted, every other place whose rows deviate beyond chance in step with a factor, or by themselves, joins.

Nothing caps their number. How far beyond chance is chosen among ``LEVELS`` and how far weights are drawn to zero among ``PENALTIES``, by the loss on a fifth of the sample. Fitting takes a bounded sample of labelled rows on the driver; scoring maps over all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import give_back, releasing, small_batches, table

PLACES = 1 << 20
#: Labelled rows that are fitted: those of least hash of the identifier. A row is about 2 KB on the driver.
TRAIN_ROWS = 6_000
FACTORS = 4
#: Labelled rows that a place is fitted from, at least; and share of the rows that both places of a pair are screened from.
MIN_ROWS, PAIR_SHARE = 4, 0.04
#: Pairs of row and column that are summed at a time, so that fitting needs little memory.
PART = 1 << 19
#: Standard deviations above the largest that chance is expected to give among all tests; infinite leaves pairs and joins out.
LEVELS = (1.0, 5.0, float("inf"))
#: Penalties on the squares of weights, and that on those of factors.
PENALTIES, FACTOR_PENALTY = (1e-4, 1e-3), 1e-3
REJECT = 0.7
#: Besides whole words, their first so many letters are terms: inflected and compound words share them.
STEMS = (4, 5, 6)
#: Runs of more letters are also taken by their triples.
LONGEST_WORD = 16
WORD = re.compile(r"[^\W_]+")


def places_of(text: str) -> np.ndarray:
    """Sorted distinct places of a text's lower-case words, their stems and long runs' triples; none for an empty text."""
    crc, mask = zlib.crc32, PLACES - 1
    words = set(WORD.findall(text.lower()))
    terms = set(words)
    for n in STEMS:
        terms |= {w[:n] + "-" for w in words if len(w) > n}
    for w in words:
        if len(w) > LONGEST_WORD:
            terms.update([w[i : i + 3] + "~" for i in range(len(w) - 2)])
    return np.unique(np.fromiter((crc(w.encode("utf-8", "surrogatepass")) & mask for w in terms), dtype=np.int32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """places: sorted active places; weights and factors: of each; bias: of an empty text."""

    bias: float = 0.0
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def margin(self, active: np.ndarray) -> float:
        v = self.factors[active]
        pair = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return self.bias + float(self.weights[active].sum()) + pair

    def score(self, text: str) -> float:
        at = np.searchsorted(self.places, found := places_of(text))
        at_most = np.minimum(at, max(0, len(self.places) - 1))
        active = at_most[self.places[at_most] == found] if len(self.places) else at_most[:0]
        return float(_sigmoid(np.array(self.margin(active))))


class _Rows:
    """Rows of places as sparse pairs (row, col), columns numbered."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        df = np.zeros(PLACES, np.int32)
        for r in rows:
            df[r] += 1
        self.kinds = np.flatnonzero(df >= MIN_ROWS)
        self.df = df[self.kinds]
        where = np.full(PLACES, -1, np.int32)
        where[self.kinds] = np.arange(len(self.kinds), dtype=np.int32)
        cols = [c[c >= 0] for c in (where[r] for r in rows)]
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(c) for c in cols])
        self.col = np.concatenate(cols)

    def by_row(self, values: np.ndarray) -> np.ndarray:
        """Sums over each row of its columns' values, a part at a time."""
        return sum(np.bincount(self.row[i : i + PART], values[self.col[i : i + PART]], self.n) for i in range(0, len(self.col), PART)) + np.zeros(self.n)

    def by_col(self, values: np.ndarray) -> np.ndarray:
        """Sums over each column of its rows' values, a part at a time."""
        return sum(np.bincount(self.col[i : i + PART], values[self.row[i : i + PART]], len(self.kinds)) for i in range(0, len(self.col), PART)) + np.zeros(len(self.kinds))

    def only(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, col) of the columns ``kept``, numbered anew."""
        where = np.full(len(self.kinds), -1, np.int32)
        where[kept] = np.arange(len(kept), dtype=np.int32)
        inside = where[self.col] >= 0
        return self.row[inside], where[self.col[inside]]


def _sparse_linear(data: _Rows, y: np.ndarray, l1: float, rounds: int) -> tuple[float, np.ndarray]:
    """Bias and weights under an L1 penalty, by accelerated proximal gradient."""
    n, k, rate = data.n, len(data.kinds), y.mean()
    scale = np.minimum(1 / np.sqrt(data.df / n), 12.0)  # so that rare words are as easily moved as common ones, to a bound
    w = z = np.zeros(k)
    bias = bias_z = float(np.log(rate / (1 - rate)))
    step, t = 0.2, 1.0
    for _ in range(rounds):
        g = (_sigmoid(bias_z + data.by_row(scale * z)) - y) / n
        new = z - step * scale * data.by_col(g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_bias = bias_z - step * g.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, bias_z = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return bias, w * scale


def _chance(tests: int) -> float:
    """The largest deviation that so many tests are expected to give by chance."""
    return float(np.sqrt(2 * np.log(max(tests, 2))))


def _pairs(data: _Rows, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns (two to a row) whose joint rows deviate from the fit, whose residuals are ``rest``; by how much beyond chance, strongest first."""
    kept = np.flatnonzero(data.df >= max(2 * MIN_ROWS, PAIR_SHARE * data.n))
    k, edge = len(kept), 256
    row, col = data.only(kept)
    x = np.zeros((data.n, k), np.uint8)
    x[row, col] = 1
    found = [np.zeros((0, 3))]
    limit, spread = _chance(k * k // 2) + min(LEVELS), float((rest**2).mean())
    for i in range(0, k, edge):
        a = x[:, i : i + edge].astype(np.float32)
        weighted = a * rest[:, None].astype(np.float32)
        for j in range(i, k, edge):
            b = x[:, j : j + edge].astype(np.float32)
            z = (weighted.T @ b) / np.sqrt(np.maximum(a.T @ b, 1) * spread)
            at = np.argwhere(np.abs(z) > limit)
            at = at[at[:, 0] + i < at[:, 1] + j]
            found.append(np.column_stack([at[:, 0] + i, at[:, 1] + j, z[at[:, 0], at[:, 1]]]))
    pairs = np.concatenate(found)
    pairs = pairs[np.argsort(-np.abs(pairs[:, 2]), kind="stable")]
    return kept[pairs[:, :2].astype(np.int64)], np.sign(pairs[:, 2]) * (np.abs(pairs[:, 2]) - limit + min(LEVELS))


def _factors(pairs: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the pairs, and factors to begin with: alike or opposite in a pair, each column's by its strongest pair."""
    columns = np.unique(pairs)
    factors, told = np.zeros((len(columns), FACTORS)), np.zeros(len(columns), bool)
    began = 0
    for (a, b), s in zip(np.searchsorted(columns, pairs), sign):
        if told[a] and told[b]:
            continue
        if not told[a] and not told[b]:
            factors[a, began % FACTORS] = 0.3
            told[a], began = True, began + 1
        known, new = (a, b) if told[a] else (b, a)
        factors[new] = factors[known] * s
        told[new] = True
    return columns, factors


def _margins(row: np.ndarray, col: np.ndarray, n: int, params: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the margin, and the sums of factors."""
    b, w, v = params
    sums = np.stack([np.bincount(row, v[col, f], n) for f in range(FACTORS)], axis=1)
    own = np.bincount(row, (v**2).sum(axis=1)[col], n)
    return b[0] + np.bincount(row, w[col], n) + 0.5 * ((sums**2).sum(axis=1) - own), sums


def _adam(row: np.ndarray, col: np.ndarray, y: np.ndarray, counts: np.ndarray, params: list[np.ndarray], steps: int, l2: float) -> list[np.ndarray]:
    """Bias, weights and factors, fitted on from ``params`` over the rows that count, under an L2 penalty."""
    k, share = len(params[1]), counts / counts.sum()
    penalty = [0.0, l2, FACTOR_PENALTY]
    means, squares = ([np.zeros_like(p) for p in params] for _ in range(2))
    params = list(params)
    for i in range(1, steps + 1):
        margin, sums = _margins(row, col, len(y), params)
        g = (_sigmoid(margin) - y) * share
        by_row = g[row]
        dw = np.bincount(col, by_row, k)
        dv = np.stack([np.bincount(col, by_row * sums[row, f], k) for f in range(FACTORS)], axis=1) - dw[:, None] * params[2]
        for j, (p, grad) in enumerate(zip(params, (np.array([g.sum()]), dw, dv))):
            grad = grad + penalty[j] * p
            means[j] = 0.9 * means[j] + 0.1 * grad
            squares[j] = 0.999 * squares[j] + 0.001 * grad**2
            params[j] = p - 0.05 * (means[j] / (1 - 0.9**i)) / (np.sqrt(squares[j] / (1 - 0.999**i)) + 1e-8)
    return params


def fit(rows: list[np.ndarray], labels: np.ndarray, *, l1: float = 2e-3, rounds: int = 120, steps: int = 300, seed: int = 7) -> Model:
    """Fits labels (0 or 1) of rows of places. One class alone, no rows, or rows without terms give a constant score."""
    n = len(rows)
    if not n or labels.min() == labels.max() or not sum(map(len, rows)):
        rate = (float(labels.sum()) + 0.5) / (n + 1)
        return Model(bias=float(np.log(rate / (1 - rate))))
    data, y, every = _Rows(rows), labels.astype(float), np.ones(n)
    learnt = (np.arange(n) % 5 < 4).astype(float)
    bias, linear = _sparse_linear(data, y, l1, rounds)
    rest = y - _sigmoid(bias + data.by_row(linear))
    pairs, strength = _pairs(data, rest * learnt)

    def begun(level: float) -> tuple[np.ndarray, list[np.ndarray]]:
        columns, begin = _factors(pairs[np.abs(strength) > level], np.sign(strength[np.abs(strength) > level]))
        active = np.union1d(np.flatnonzero(linear), columns)
        factors = np.random.default_rng(seed).normal(0, 0.02, (len(active), FACTORS))
        factors[np.searchsorted(active, columns)] += begin
        return active, [np.array([bias]), linear[active], factors]

    losses = {}
    for level in reversed(LEVELS):
        active, params = begun(level)
        row, col = data.only(active)
        for l2 in PENALTIES:
            margin, _ = _margins(row, col, n, _adam(row, col, y, learnt, params, steps // 2, l2))
            losses[level, l2] = float((np.logaddexp(0, margin) - y * margin)[learnt == 0].sum())
    level, l2 = min(losses, key=losses.get)
    active, params = begun(level)
    row, col = data.only(active)
    params = _adam(row, col, y, every, params, steps // 2, l2)

    # What else deviates by itself or in step with a factor.
    margin, sums = _margins(row, col, n, params)
    rest = y - _sigmoid(margin)
    k, limit = len(data.kinds), _chance(len(data.kinds) * (FACTORS + 1)) + level
    z = np.zeros((k, FACTORS + 1))
    for f in range(FACTORS + 1):
        by = rest if f == FACTORS else rest * (sums[:, f] - sums[:, f].mean())
        z[:, f] = data.by_col(by) / np.sqrt(data.by_col(by**2) + 1e-9)
    joins = np.setdiff1d(np.flatnonzero(np.abs(z).max(axis=1) > limit), active)
    grown = np.union1d(active, joins)
    weights, factors = np.zeros(len(grown)), np.random.default_rng(seed).normal(0, 0.02, (len(grown), FACTORS))
    weights[np.searchsorted(grown, active)], factors[np.searchsorted(grown, active)] = params[1:]
    factors[np.searchsorted(grown, joins)] += 0.1 * np.sign(z[joins, :FACTORS]) * (np.abs(z[joins, :FACTORS]) > limit)
    b, w, v = _adam(*data.only(grown), y, every, [params[0], weights, factors], steps - steps // 2, l2)
    return Model(float(b[0]), data.kinds[grown].astype(np.int32), w, v)


def held_out(key: str = "doc_id") -> Column:
    """Whether labels of the row may not be learnt from; a null identifier may not either."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fits at most ``rows`` labelled rows outside the held-out fold. Null labels are left out; of repeated ones the largest counts."""
    chosen = (
        labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("key").isNotNull()).where(~held_out("key"))
        .groupBy("key").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(rows)
    )

    @releasing
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([places_of(t.as_py() or "").tobytes() for t in b.column(2)], pa.binary())], names=["key", "label", "places"])

    texts = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    # The chosen rows are bounded by ``rows``, so they are the side to broadcast.
    found = texts.join(F.broadcast(chosen), "key").select(F.col("key").cast("long").alias("key"), "label", "text")
    got = found.mapInArrow(features, "key bigint, label int, places binary").collect()
    got.sort(key=lambda r: (r["key"], r["places"]))
    model = fit([np.frombuffer(r["places"], np.int32) for r in got], np.array([r["label"] for r in got]))
    del got
    give_back()
    return model


def score(documents: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows key, score (0 to 1) for every row, from the text alone; null is an empty text."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    types = pa.schema([(key, pa.int64()), ("score", pa.float64())])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t.as_py() or "") for t in b.column(1)], pa.float64())], schema=types)

    return documents.select(F.col(f"`{key}`").cast("long"), f"`{text}`").mapInArrow(run, f"`{key}` bigint, score double")


def keep_clean(documents: DataFrame, model: Model, *, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows, with all their columns, whose text scores under ``reject``; null is an empty text. Narrow."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py() or "") < reject for t in b.column(at)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
