"""Quality classifier: a factorisation machine over hashed words, structure and length of a text."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean

#: Hashed word features; the binned statistics follow them.
WORDS = 1 << 13
BINS = 10
_UPPER = slice(0x41, 0x5B)
_LOWER = slice(0x61, 0x7B)
_DIGIT = slice(0x30, 0x3A)


class _Slots(dict):
    """Feature of each word, remembered; forgotten as a whole when there are very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = slot = zlib.crc32(word) % WORDS
        return slot


def statistics(text: str, raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure and length of a text; no source, language or identifier enters."""
    n, size = max(1, len(words)), max(1, len(raw))
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = byte[_UPPER].sum() + byte[_LOWER].sum() + byte[0x80:].sum()
    marks = size - letters - byte[_DIGIT].sum() - byte[0x20] - byte[9:14].sum()
    lines = text.split("\n")
    top = counts.most_common(1)[0][1] if counts else 0
    return [
        np.log1p(len(words)),
        np.log1p(len(lines)),
        letters / n,
        byte[_UPPER].sum() / max(1, letters),
        byte[_DIGIT].sum() / size,
        marks / n,
        (byte[0x2E] + byte[0x2C]) / n,
        byte[0x21] / n,
        byte[0x7C] / n,
        (byte[0x23] + byte[0x24] + byte[0x25] + byte[0x26] + byte[0x2A]) / n,
        (byte[0x3A] + byte[0x2F] + byte[0x40]) / n,
        (byte[0x3C] + byte[0x3E] + byte[0x7B] + byte[0x7D]) / n,
        byte[0x80:].sum() / size,
        len(counts) / n,
        top / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        np.log1p(max(map(len, words), default=0)),
    ]


N_STATS = 18
FEATURES = WORDS + N_STATS * (BINS + 1) + 1


def features(text: str | None, slots: dict) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word features with their weights (of length 1 together), and the statistics."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.lower().split()
    counts = Counter(words)
    at = np.fromiter(map(slots.__getitem__, counts), np.int32, len(counts))
    weight = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    norm = float(np.sqrt((weight * weight).sum())) or 1.0
    return at, weight / np.float32(norm), statistics(text, raw, words, counts)


@dataclass
class Model:
    """score = sigmoid(bias + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2))"""

    edges: np.ndarray  # (N_STATS, BINS) bin edges
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts' features as one sparse matrix: where each row starts, columns, values."""
        stats = np.array([p[2] for p in parts], np.float64).reshape(len(parts), N_STATS)
        bins = np.stack([np.searchsorted(self.edges[k], stats[:, k], side="right") for k in range(N_STATS)], axis=1)
        bins = (WORDS + np.arange(N_STATS) * (BINS + 1) + bins).astype(np.int32)
        value = np.full(N_STATS, 1 / np.sqrt(N_STATS), np.float32)
        at = np.concatenate([x for p, b in zip(parts, bins) for x in (b, p[0])])
        x = np.concatenate([x for p in parts for x in (value, p[1])])
        starts = np.concatenate(([0], np.cumsum([N_STATS + len(p[0]) for p in parts])[:-1]))
        return starts, at, x

    def logit(self, starts, at, x) -> np.ndarray:
        """Linear in the number of features: pairs are never formed."""
        vx = self.factors[at] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[at] * x, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def score(self, parts: list[tuple]) -> np.ndarray:
        if not parts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logit(*self.rows(parts)).astype(np.float64), -30, 30)))


def fit(parts: list[tuple], labels: np.ndarray, rank: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Mini-batch Adam on the logistic loss; without both labels the share of label 1 is every score."""
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    stats = np.array([p[2] for p in parts], np.float64).reshape(len(parts), N_STATS)
    cuts = np.linspace(0, 1, BINS + 2)[1:-1]
    edges = np.quantile(stats, cuts, axis=0).T if len(parts) else np.zeros((N_STATS, BINS))
    random = np.random.default_rng(seed)
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), random.normal(0, 0.05, (FEATURES, rank)).astype(np.float32))
    if len(labels) == 0 or labels.min() == labels.max():
        model.factors[:] = 0
        return model
    theta = np.concatenate([model.linear[:, None], model.factors], axis=1)
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        order = random.permutation(len(parts))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            model.linear, model.factors = theta[:, 0], theta[:, 1:]
            starts, at, x = model.rows([parts[i] for i in some])
            error = 1 / (1 + np.exp(-np.clip(model.logit(starts, at, x), -30, 30))) - labels[some]
            row = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(at))))
            vx = model.factors[at] * x[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            slope = np.concatenate([np.ones((len(at), 1), np.float32), sums[row] - vx], axis=1) * (error[row] * x / len(some))[:, None]
            used, place = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(place, slope[:, f], len(used)) for f in range(rank + 1)], axis=1)
            grad += decay * theta[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * grad
            second[used] = 0.99 * second[used] + 0.01 * grad * grad
            theta[used] -= rate * first[used] / (1 - 0.9**step) / (np.sqrt(second[used] / (1 - 0.99**step)) + 1e-6)
            model.bias -= rate * float(error.mean())
    model.linear, model.factors = theta[:, 0].copy(), theta[:, 1:].copy()
    return model


def held_out(doc_id):
    """Rows that never train: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, train_rows: int = 8000) -> Model:
    """Fit on at most train_rows labelled documents, a documented bound, picked by a hash of the id.

    Held-out ids and ids whose labels contradict each other are left out.  The picked ids (at most
    train_rows numbers) are broadcast; only the picked documents' features reach the driver, and of
    rows that repeat an id only the least text.  Of a table's metadata only the length of the text may
    enter a score, and the statistics have it.
    """
    picked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min("quality").alias("__low"), F.max("quality").alias("__label"))
        .where("__low = __label")
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(train_rows)
        .select("__id", "__label")
    )
    texts = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "__label").agg(F.min("text").alias("text"))

    def extract(batches):
        slots = _Slots()
        for batch in batches:
            found = [features(t, slots) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1).cast(pa.int32()),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.list_(pa.float32())),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "label", "at", "x", "stats"],
            )

    rows = texts.mapInArrow(lean(extract), "doc_id long, label int, at array<int>, x array<float>, stats array<double>")
    table = rows.toArrow().sort_by("doc_id")
    labels_of = table.column("label").to_numpy().astype(np.float32)
    lists = [[x.values.to_numpy(zero_copy_only=False) for x in table.column(c)] for c in ("at", "x", "stats")]
    return fit(list(zip(lists[0], lists[1], map(list, lists[2]))), (labels_of > 0).astype(np.float32))


def score_quality(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score of each whole text; a column of that name is replaced.

    Null text scores as empty.  Documents are neither shuffled nor collected; the model (under 1 MB,
    whatever the input) is broadcast.
    """
    kept = [f for f in docs.schema.fields if f.name != name]
    text_at = [f.name for f in kept].index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        slots = _Slots()
        for batch in batches:
            scores = []
            for k in range(0, batch.num_rows, 200):
                texts = batch.column(text_at).slice(k, 200).to_pylist()
                scores.append(shared.value.score([features(t, slots) for t in texts]))
            found = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(lean(run), schema)


def op8_factorisation_machine(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
