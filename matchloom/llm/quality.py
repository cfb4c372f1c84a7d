"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

A text is a vector of statistics. Cosines of random projections of the standardised
statistics approximate a Gaussian kernel between texts; a ridge regression on them
needs only the sums of their products, which every partition forms by itself and
Spark adds up. A non-decreasing step function from binned scores to labels, also
from sums per bin, turns the regression into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from matchloom.llm.common import pick, saved
from matchloom.llm.toxicity import remainder

FEATURES = 192
BANDWIDTH = 1.5
RIDGE = 1e-3
BINS = 1_000
CUT = 0.3
SEED = 7
NAMES = ("log_bytes", "log_words", "mean_word", "deviation_word", "upper", "digit", "mark", "odd_mark", "other", "space", "ends", "capitals",
         "distinct", "most_common", "same_as_before", "bare_marks", "marked_words", "lines", "same_lines", "mean_line", "long_words")


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; all finite, also for an empty one."""
    data = text.encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, w, k = max(1, len(data)), max(1, len(words)), max(1, len(lines))
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    kinds: dict[bytes, int] = {}
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    upper, digit = by[65:91].sum(), by[48:58].sum()
    mark = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    odd = by[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 124, 126]].sum()
    bare = sum(c for x, c in kinds.items() if not x.isalnum() and not any(65 <= b & 0xDF <= 90 or b > 127 or 48 <= b <= 57 for b in x))
    marked = sum(c for x, c in kinds.items() if x[-1] in b"!#$%&*|")
    capitals = sum(c for x, c in kinds.items() if x.isupper() and len(x) > 1)
    return [
        np.log1p(len(data)), np.log1p(len(words)), lengths.mean(), lengths.std(), upper / n, digit / n, mark / n, odd / n, by[128:].sum() / n,
        (by[32] + by[9:14].sum()) / n, by[[33, 46, 63]].sum() / w, capitals / w, len(kinds) / w, max(kinds.values(), default=0) / w,
        same / w, bare / w, marked / w, len(lines) / w, 1 - len(set(lines)) / k, np.log1p(len(words) / k), (lengths > 20).mean()]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def describe(texts: pa.Array) -> pa.Array:
    return pa.array([[float(v) for v in statistics(x or "")] for x in texts.to_pylist()], pa.list_(pa.float64()))


class Model:
    """Standardisation, projections, weights and calibration."""

    def __init__(self, mean, scale, features: int, bandwidth: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn = rng.standard_normal((len(mean), features)) * bandwidth / np.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.turn + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def products(model: Model):
    """Sums over a partition of the products of features, and of features and label: one row per feature."""
    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                z, y = model.features(vectors(batch.column("x"))), batch.column("label").to_numpy().astype(float)
                some = z.T @ np.concatenate([z, y[:, None]], axis=1)
                total = some if total is None else total + some
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])
    return run


def binned(model: Model):
    def run(batches):
        for batch in batches:
            at = np.minimum((model.raw(vectors(batch.column("x"))) * BINS).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label").cast(pa.float64())], names=["bin", "label"])
    return run


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit by pooling neighbours that violate the order; points to interpolate between."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight):
        pools.append([yi, wi, xi, xi])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    return (np.array([v for p in pools for v in (p[2], p[3])]), np.array([v for p in pools for v in (p[0], p[0])]))


def fit(rows: DataFrame, features: int = FEATURES, bandwidth: float = BANDWIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """The model of rows (x, label); None without rows. The driver sees sums of fixed size only."""
    at = [F.element_at("x", k + 1) for k in range(len(NAMES))]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{k}") for k, c in enumerate(at)), *(F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(at))).first()
    if not sums.n:
        return None
    mean = np.array([sums[f"m{k}"] for k in range(len(NAMES))])
    scale = np.maximum(np.array([sums[f"s{k}"] for k in range(len(NAMES))]), 1e-6)
    model = Model(mean, scale, features, bandwidth, seed)
    total = np.zeros((features + 1, features + 2))
    parts = rows.mapInArrow(products(model), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = parts.toArrow()  # (features + 1) x (features + 2) rows
    total[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("v").to_numpy()
    penalty = np.diag([ridge * sums.n / features] * features + [1e-9])
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    bins = rows.mapInArrow(binned(model), "bin long, label double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    seen = sorted((r.bin, r.n, r.y) for r in bins.collect())  # at most BINS rows
    b, n, y = (np.array(v, float) for v in zip(*seen))
    model.steps = isotonic((b + 0.5) / BINS, y / n, n)
    return model


def described(docs: DataFrame) -> DataFrame:
    return saved(pick(docs, "doc_id", "text").select("doc_id", describe("text").alias("x")), "statistics")


def score(docs: DataFrame, labels: DataFrame, held_out: int = 0, of: int = 5, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted.

    A null text is an empty one and gets the score of its statistics. Equal texts
    have equal scores; a null doc_id counts as the empty string for held_out. A
    document with several labels is good only if all say so; labels other than 0
    and 1 and null ids are left out. Without labels every score is 0.5. Columns
    other than doc_id and text (quality of the labels) are not read.
    """
    rows = described(docs)
    known = pick(labels, "doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).filter(remainder(F.col("doc_id"), of) != held_out)
    model = fit(saved(rows.join(known, "doc_id").select("x", "label"), "labelled"))

    def run(batches):
        for batch in batches:
            x = vectors(batch.column("x"))
            value = np.full(len(x), 0.5) if model is None or not len(x) else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), of) == held_out).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
