"""Quality classifier: document statistics, random Fourier features of a Gaussian kernel, ridge scores from
partition-summed normal equations, isotonic calibration.

Beside the Fourier features the ridge has a linear part, the standardised statistics themselves, so that what is linear
in them needn't be pieced together from cosines. All documents are measured; all labelled training rows take part in the sums (nothing is sampled). What leaves a task
is one matrix of fixed size. Calibration pools adjacent violators over a histogram of 2,000 score bins, so its size is
fixed too.

Defined cases: a null text counts as empty and is scored like any other; without labels of both classes every score is
the share of label 1, or 1 without any label; null labels and labels of unknown documents are ignored, each repeated
label counts; repeated rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_size, cut, partition_sum, remove, ship

FEATURES, WIDTH, RIDGE, BINS = 24, 512, 1e-3, 2000
LOW, HIGH = -1.0, 2.0  # range of the bins of raw scores
_PUNCT, _SYMBOLS, _BRACKETS = b".,;:'\"-()", b"#$%&*@^~|+=<>\\/_{}[]`", b"!?"


def statistics(text: str) -> list[float]:
    """Shares, lengths and repetitions of one text; no word list, no language."""
    data = text.encode("utf-8", "replace")
    n = max(1, len(data))
    of = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    times = Counter(words)
    most = max(times.values(), default=0)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, np.int64)
    p = of[of > 0] / n
    letters = of[65:91].sum() + of[97:123].sum() + of[128:].sum()
    repeated = len(lines) - len(set(lines))
    return [
        np.log1p(len(data)), np.log1p(len(words)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        np.log1p(len(times)) / np.log1p(m), most / m, np.log1p(most),
        of[65:91].sum() / max(1, letters), of[48:58].sum() / n, sum(of[c] for c in _PUNCT) / m, sum(of[c] for c in _SYMBOLS) / m,
        sum(of[c] for c in _BRACKETS) / m, of[ord("|")] / m, of[ord(".")] / m, of[ord(",")] / m,
        of[128:].sum() / n, letters / n, float(-(p * np.log2(p)).sum()), len(lines) / m,
        repeated / max(1, len(lines)), (lengths <= 3).mean(), (lengths == 1).mean(), np.log1p(sum(of[c] for c in _SYMBOLS)),
    ]


def measure(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the statistics of each row's whole text."""

    def run(batches):
        for s in by_size(batches, 1, rows=512):
            x = np.array([statistics(t or "") for t in s.column(1).to_pylist()], dtype=np.float64).reshape(-1)
            yield pa.RecordBatch.from_arrays([s.column(0), pa.ListArray.from_arrays(pa.array(np.arange(s.num_rows + 1, dtype=np.int32) * FEATURES), pa.array(x))], names=["id", "x"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, x array<double>")


class Model:
    """Standardisation, Fourier features, ridge weights, calibration points."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7, bandwidth: float = 0.15):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, bandwidth, (FEATURES, WIDTH))
        self.b = rng.uniform(0, 2 * np.pi, WIDTH)
        self.beta = np.zeros(1 + FEATURES + WIDTH)
        self.points = (np.array([0.0]), np.array([1.0]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Bias, linear part, and cosines whose inner products approximate the kernel."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z, np.cos(z @ self.w + self.b) * np.sqrt(2 / WIDTH)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.points), 0, 1)


def isotonic(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit of good/all by pooling adjacent violators; empty bins take no part
    and are NaN."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(all_ > 0):
        blocks.append([good[i], all_[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, a, _ = blocks.pop()
            blocks[-1][0] += g
            blocks[-1][1] += a
    out = np.full(len(all_), np.nan)
    full = np.flatnonzero(all_ > 0)
    starts = [b[2] for b in blocks]
    if len(full):
        out[full] = np.array([b[0] / b[1] for b in blocks])[np.searchsorted(starts, full, side="right") - 1]
    return out


def _matrix(b: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def fit(measured: DataFrame, labels: DataFrame, train, label: str = "quality", id_col: str = "doc_id") -> Model:
    """measured: (id, x). train: condition on `id` that admits a label to learning."""
    moments = measured.select(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(FEATURES)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(FEATURES)]).first()
    clean = np.array([0.0 if v is None else v for v in moments])
    model = Model(clean[:FEATURES], np.maximum(clean[FEATURES:], 1e-6))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("double").alias("y")).filter("id is not null and y is not null")
    rows = cut(measured.filter(train).join(known, "id").select("x", "y"))
    size = len(model.beta)

    def normal(batches):
        a, v, n = np.zeros((size, size)), np.zeros(size), np.zeros(2)
        for b in batches:
            z, y = model.lift(_matrix(b)), b.column("y").to_numpy()
            a += z.T @ z
            v += z.T @ y
            n += (len(y), y.sum())
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), v, n]).tobytes()], pa.binary())], names=["sum"])

    total = partition_sum(rows.mapInArrow(normal, "sum binary"), size * size + size + 2)
    a, v, (n, good) = total[: size * size].reshape(size, size), total[size * size : -2], total[-2:]
    if good in (0, n):
        remove(rows)
        model.points = (np.array([0.0]), np.array([good / n if n else 1.0]))
        return model
    model.beta = np.linalg.solve(a + RIDGE * n * np.diag(np.append(0, np.ones(size - 1))) + 1e-9 * n * np.eye(size), v)

    def histogram(batches):
        h = np.zeros((2, BINS))
        for b in batches:
            at = np.clip(((model.raw(_matrix(b)) - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            h += (np.bincount(at, b.column("y").to_numpy(), BINS), np.bincount(at, minlength=BINS))
        yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary())], names=["sum"])

    good_of, all_of = partition_sum(rows.mapInArrow(histogram, "sum binary"), 2 * BINS).reshape(2, BINS)
    remove(rows)
    fitted = isotonic(good_of, all_of)
    full = np.flatnonzero(all_of > 0)
    model.points = (LOW + (full + 0.5) * (HIGH - LOW) / BINS, fitted[full])
    return model


def score(measured: DataFrame, model: Model) -> DataFrame:
    """(id, score) of measured rows."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.score(_matrix(b)) if b.num_rows else np.zeros(0))], names=["id", "score"])

    return measured.mapInArrow(run, "id long, score double")


def held_out(id_: F.Column | str = "doc_id", mod: int = 4, rest: int = 2):
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % mod == rest, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """doc id, held_out, score, predicted of each row; held-out labels are not learnt from."""
    ship(docs.sparkSession)
    measured = cut(measure(docs, id_col))
    model = fit(measured, labels, ~held_out("id"), id_col=id_col)
    return score(measured, model).select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that the classifier rejects; every column and row that stays is unchanged."""
    ship(docs.sparkSession)
    measured = cut(measure(docs, id_col, text))
    model = fit(measured, labels, ~held_out("id"), id_col=id_col)
    remove(measured)
    schema, names = docs.schema, docs.columns

    def run(batches):
        for s in by_size(batches, names.index(text), rows=512):
            x = np.array([statistics(t or "") for t in s.column(names.index(text)).to_pylist()], dtype=np.float64)
            yield s.filter(pa.array(model.score(x.reshape(-1, FEATURES)) >= threshold))

    return docs.mapInArrow(run, schema)
