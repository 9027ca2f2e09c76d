"""A factorisation machine for text quality.

Inputs are hashed words, weighted by their share of the text, structure statistics of the text, each put into one of a few
bins, and metadata: named columns of the documents, numbers put into bins of equal ratio and other values hashed, a null
being a value of its own. The score is logistic: a bias, a weight for each input and low-rank pairwise interactions, summed in
linear time as half of (sum squared less sum of squares) in each factor.

The model is fitted on the driver by Adagrad on at most `max_train` labelled documents, those with the smallest hash
of their id; nothing else is bounded. Without labels of both kinds all scores are the labels' mean (0.5 without any).
Metadata are what the caller names; op9 and the pipeline take n_chars alone, for labels, language, source and id may not
be inputs there. Null texts count as empty, and empty texts have statistics too. Rows with a null label are not learnt
from; rows that are repeated are scored one by one. Rows whose ids' hashes tie are taken by id and label. An empty table
gives no rows. A column of docs with the score's name is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, texts
from .decontaminate import words_of

WORD_BITS, BINS, RANK, MAX_TRAIN, THRESHOLD = 15, 16, 8, 6000, 0.7
_UPPER, _DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,'\"-")
STATISTICS, META_SLOTS = 12, 1 << 10
METADATA = ("n_chars",)


def statistics(text: str, words: list[bytes]) -> list[float]:
    """Values from 0 to 1."""
    raw = text.encode("utf-8", "surrogatepass")
    n, w = max(len(raw), 1), max(len(words), 1)
    without = lambda chars: 1 - len(raw.translate(None, chars)) / n if raw else 0.0
    lines = text.split("\n")
    letters = sum(map(len, words))
    return [
        min(1.0, np.log1p(len(raw)) / 16), without(_MARKS), without(_UPPER), without(_DIGITS), without(b" "),
        len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, min(1.0, letters / w / 16),
        len(set(lines)) / len(lines), min(1.0, len(lines) / n * 20), without(b"|"), without(b".,"),
    ]


def meta_slot(name: str, value) -> int:
    """The place of a metadata value: numbers that differ by less than a fifth share one."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        value = f"{'-' if value < 0 else ''}{int(np.log1p(min(abs(value), 1e300)) * 5)}" if value == value else "nan"
    return zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % META_SLOTS


def inputs(text: str, word_bits: int = WORD_BITS, metadata: Iterable[tuple[str, object]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, values) of a document's inputs; never empty."""
    words = words_of(text)
    base = 1 << word_bits
    bins = [base + k * (BINS + 1) + (0 if v <= 0 else 1 + min(BINS - 1, int(np.sqrt(v) * BINS))) for k, v in enumerate(statistics(text, words))]
    bins += sorted({base + STATISTICS * (BINS + 1) + meta_slot(name, value) for name, value in metadata})
    buckets, counts = np.unique(np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) & (base - 1), return_counts=True)
    values = counts / np.sqrt(np.square(counts, dtype=np.float64).sum()) if len(counts) else np.zeros(0)
    return np.concatenate([bins, buckets]).astype(np.int64), np.concatenate([np.full(len(bins), 0.5), values])


class FactorisationMachine:
    def __init__(self, word_bits: int = WORD_BITS, rank: int = RANK, seed: int = 7) -> None:
        self.word_bits = word_bits
        size = (1 << word_bits) + STATISTICS * (BINS + 1) + META_SLOTS
        self.metadata: tuple[str, ...] = ()
        self.bias, self.weights = 0.0, np.zeros(size)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (size, rank))

    def forward(self, numbers: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factors[numbers] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(np.square(vx).sum(axis=1), starts)
        linear = np.add.reduceat(self.weights[numbers] * values, starts)
        return self.bias + linear + 0.5 * (np.square(sums).sum(axis=1) - squares), sums, vx

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(r[0]) for r in rows)])[:-1]
        z, _, _ = self.forward(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        if not len(labels) or labels.min() == labels.max():
            mean = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-3), 1 - 1e-3)
            self.bias, self.factors = float(np.log(mean / (1 - mean))), self.factors * 0
            return self
        rng = np.random.default_rng(seed)
        g_bias, g_weights, g_factors = 1e-6, np.full(len(self.weights), 1e-6), np.full(self.factors.shape, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                sizes = np.array([len(rows[j][0]) for j in part])
                numbers, values = np.concatenate([rows[j][0] for j in part]), np.concatenate([rows[j][1] for j in part])
                starts = np.cumsum(sizes) - sizes
                z, sums, vx = self.forward(numbers, values, starts)
                error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) / len(part)
                each = np.repeat(error, sizes)
                own, back = np.unique(numbers, return_inverse=True)
                d_weights = np.bincount(back, each * values, len(own)) + decay * self.weights[own]
                step = (each * values)[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                d_factors = np.stack([np.bincount(back, step[:, k], len(own)) for k in range(step.shape[1])], axis=1) + decay * self.factors[own]
                g_bias += error.sum() ** 2
                g_weights[own] += d_weights**2
                g_factors[own] += d_factors**2
                self.bias -= rate * error.sum() / np.sqrt(g_bias)
                self.weights[own] -= rate * d_weights / np.sqrt(g_weights[own])
                self.factors[own] -= rate * d_factors / np.sqrt(g_factors[own])
        return self


def remainder(key: str):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN, metadata: tuple[str, ...] = ()) -> FactorisationMachine:
    """Fit on the labelled rows whose remainder is not 2; at most max_train of them, by the hash of their id. Of rows that share id and label the least counts."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(key) != 2)).select(F.col(key).alias("__key"), F.col(label).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("__key"), "__key", "label").limit(max_train)  # at most max_train short rows: small at every input size
    joined = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(m).alias(f"m{i}") for i, m in enumerate(metadata))).join(F.broadcast(chosen), "__key").select("__key", "label", F.struct("text", *(f"m{i}" for i in range(len(metadata)))).alias("row"))
    # an id that is repeated, here or among the labels, is one row of each label: at most max_train rows reach the driver
    joined = joined.groupBy("__key", "label").agg(F.min("row").alias("row")).select("__key", "row.text", "label", *(f"row.m{i}" for i in range(len(metadata))))

    def run(batches):
        for batch in batches:
            rows = [inputs(t, metadata=zip(metadata, more, strict=True)) for t, *more in zip(*(batch.column(i).to_pylist() for i in (1, *range(3, 3 + len(metadata)))), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary())], names=["k", "label", "numbers", "values"])

    kind = docs.schema[key].dataType.simpleString()
    got = arrow_map(joined, run, f"k {kind}, label double, numbers binary, `values` binary").collect()  # max_train rows of inputs
    got.sort(key=lambda r: (zlib.crc32(str(r.k).encode()), str(r.k), r.label, bytes(r.numbers)))
    rows = [(np.frombuffer(r.numbers, np.int32).astype(np.int64), np.frombuffer(r[3], np.float32).astype(np.float64)) for r in got]
    model = FactorisationMachine().fit(rows, np.array([r.label for r in got]))
    model.metadata = tuple(metadata)
    return model


def with_scores(docs: DataFrame, model: FactorisationMachine, text: str = "text", column: str = "quality_score") -> DataFrame:
    """docs with a score from 0 to 1; one pass, no shuffle. A column of docs with that name is replaced."""
    if column in model.metadata:
        raise ValueError(f"{column} is an input of the score")
    docs = docs.drop(column)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size
    at, names = [docs.columns.index(c) for c in (text, *model.metadata)], [*docs.columns, column]

    def run(batches):
        fm = sent.value
        for batch in batches:
            scores = fm.score([inputs(t or "", fm.word_bits, zip(fm.metadata, more, strict=True)) for t, *more in zip(*(batch.column(i).to_pylist() for i in at), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{schema}, `{column}` double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), metadata=METADATA)
    scored = with_scores(texts(docs, "doc_id", *METADATA), model, column="score")
    return scored.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
