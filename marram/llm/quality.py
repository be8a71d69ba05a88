"""Quality classifier: a factorisation machine on hashed words, structure and metadata.

The score of a text with features x is sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).
The pairwise part takes linear time: it is half of the sum over factors of
(sum v_if x_i)^2 - sum (v_if x_i)^2. Features are term counts of hashed words (square roots,
scaled to length one) and, as one-hot bins, statistics of the text's structure and any numeric
metadata columns that the caller names.

The machine is fitted on the driver by Adagrad on the features of at most ``max_rows`` labelled
rows: those with the smallest hash of their id, so the choice is the same at any time and size.
That bound is the only one; every row of every table is scored, whole.

Defined cases: null and empty texts are scored by their structure and metadata alone; a null label is
not learned from; of several labels of one id the largest counts; a column score of the input is replaced; null metadata has a bin of its own; without any row of either label every score is
the constant 0.5; rows that repeat an id are each scored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.common import bounded_batches, hash_words, slices

WORD_BITS = 14
BINS = 24
#: Structure statistics, each with the value range that its bins divide evenly.
STATS = (
    ("log_bytes", 0.0, 16.0),
    ("log_words", 0.0, 13.0),
    ("log_lines", 0.0, 9.0),
    ("word_length", 0.0, 16.0),
    ("upper", 0.0, 1.0),
    ("digits", 0.0, 0.5),
    ("stops", 0.0, 0.3),
    ("symbols", 0.0, 0.5),
    ("spaces", 0.0, 0.5),
    ("high_bytes", 0.0, 0.6),
    ("distinct", 0.0, 1.0),
    ("distinct_pairs", 0.0, 1.0),
    ("repeats", 0.0, 1.0),
    ("top_word", 0.0, 0.6),
)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:?'"]] = 3
_CLASS[[ord(c) for c in "!#$%&*|@^~<>=+\\/_{}[]"]] = 4
_CLASS[[32, 9, 10, 11, 12, 13]] = 5
_CLASS[128:] = 6


def features(texts: list[bytes], metadata: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, indices, values) of the sparse feature vectors, one text after the other.

    ``metadata``: (texts, columns) of positive numbers or NaN, binned by their logarithm.
    """
    words, counts = hash_words(texts)
    ends = np.cumsum(counts)
    base = (1 << WORD_BITS) + np.arange(len(STATS)) * BINS
    low, high = (np.array([s[k] for s in STATS]) for k in (1, 2))
    sizes, indices, values = [], [], []
    for k, (text, n) in enumerate(zip(texts, counts.tolist(), strict=True)):
        own = words[ends[k] - n : ends[k]]
        size = len(text)
        kind = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=7) if size else np.zeros(7)
        if n:
            uniques, first = np.unique(own, return_counts=True)
            hashed = (uniques >> np.uint64(64 - WORD_BITS)).astype(np.int64)
            weight = np.sqrt(first)
            weight /= math.sqrt(float(n))
            pairs = len(np.unique(own[:-1] * np.uint64(3) + own[1:])) / (n - 1) if n > 1 else 1.0
            repeats = float((own[1:] == own[:-1]).mean()) if n > 1 else 0.0
            word = (len(uniques) / n, pairs, repeats, first.max() / n if n > 4 else 0.0)
        else:
            hashed, weight, word = np.zeros(0, dtype=np.int64), np.zeros(0), (1.0, 1.0, 0.0, 0.0)
        lines = text.count(b"\n") + 1
        rate = kind / max(1, size)
        stats = np.array([math.log2(1 + size), math.log2(1 + n), math.log2(lines), (size - kind[5]) / max(1, n), rate[1], rate[2], rate[3], rate[4], rate[5], rate[6], *word])
        cells = base + np.clip((stats - low) / (high - low) * (BINS - 1), 0, BINS - 1).astype(np.int64)
        if metadata is not None:
            extra = metadata[k]
            bins = np.where(np.isnan(extra), BINS - 1, np.clip(np.log2(1 + np.maximum(0, np.nan_to_num(extra))), 0, BINS - 2)).astype(np.int64)
            cells = np.concatenate([cells, base[-1] + BINS * (1 + np.arange(len(extra))) + bins])
        sizes.append(len(hashed) + len(cells))
        indices += [hashed, cells]
        values += [weight, np.full(len(cells), 0.5)]
    none = np.zeros(0)
    return np.array(sizes, dtype=np.int64), np.concatenate(indices or [none]).astype(np.int64), np.concatenate(values or [none])


@dataclass
class Machine:
    """A fitted factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, sizes: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = self.bias + np.add.reduceat(self.linear[indices] * values, starts)
        for f in range(self.factors.shape[1]):
            part = self.factors[indices, f] * values
            out += 0.5 * (np.add.reduceat(part, starts) ** 2 - np.add.reduceat(part**2, starts))
        return out

    def score(self, *sparse: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*sparse), -30, 30)))


def fit(sizes: np.ndarray, indices: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int, rank: int = 4, epochs: int = 12, batch: int = 64, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(width), rng.normal(0, 0.02, (width, rank)))
    if not len(labels) or labels.min() == labels.max():
        machine.factors[:] = 0
        return machine
    machine.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    sums = [1e-3, np.full(width, 1e-3), np.full((width, rank), 1e-3)]
    ends = np.cumsum(sizes)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            take = np.concatenate([np.arange(ends[r] - sizes[r], ends[r]) for r in rows])
            row = np.repeat(np.arange(len(rows)), sizes[rows])
            idx, val = indices[take], values[take]
            v = machine.factors[idx]
            totals = np.zeros((len(rows), rank))
            np.add.at(totals, row, v * val[:, None])
            error = (machine.score(sizes[rows], idx, val) - labels[rows]) / len(rows)
            pull = (error[row] * val)[:, None]
            slope_w, slope_v = np.zeros(width), np.zeros((width, rank))
            np.add.at(slope_w, idx, pull[:, 0])
            np.add.at(slope_v, idx, pull * (totals[row] - v * val[:, None]))
            slope_w += decay * machine.linear
            slope_v += decay * machine.factors
            slope_b = float(error.sum())
            sums[0] += slope_b**2
            sums[1] += slope_w**2
            sums[2] += slope_v**2
            machine.bias -= rate * slope_b / math.sqrt(sums[0])
            machine.linear -= rate * slope_w / np.sqrt(sums[1])
            machine.factors -= rate * slope_v / np.sqrt(sums[2])
    return machine


def _columns(batch: pa.RecordBatch, metadata: list[str]) -> tuple[list[bytes], np.ndarray | None]:
    texts = [(t or "").encode("utf-8", "replace") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
    if not metadata:
        return texts, None
    parts = [batch.column(batch.schema.get_field_index(f"_m_{k}")).to_numpy(zero_copy_only=False).astype(float) for k in range(len(metadata))]
    return texts, np.stack(parts, axis=1)


def _inputs(docs: DataFrame, metadata: list[str], *more: Column) -> DataFrame:
    return docs.select(*more, "text", *[F.col(m).cast("double").alias(f"_m_{k}") for k, m in enumerate(metadata)])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: list[str] | None = None, max_rows: int = 8192) -> Machine:
    """Fit on ``labels`` (doc_id, ``label`` 0/1), at most ``max_rows`` of them, and their texts in ``docs``."""
    bounded_batches(docs.sparkSession)
    metadata = list(metadata or [])
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_m_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows ids of a few bytes: a proven bound, so the texts need not be shuffled.
    rows = _inputs(docs.join(F.broadcast(chosen), "doc_id"), metadata, F.col("doc_id").cast("long").alias("doc_id"), F.col("_m_label").cast("double").alias("label"))

    def run(batches):
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            sizes, indices, values = features(*_columns(batch, metadata))
            cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (indices.astype(np.int32), values.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "label", "indices", "values"])

    got = rows.mapInArrow(run, "doc_id long, label double, indices array<int>, values array<float>").toArrow().combine_chunks().sort_by("doc_id")
    width = (1 << WORD_BITS) + BINS * (len(STATS) + len(metadata))
    lists = got.column("indices").combine_chunks(), got.column("values").combine_chunks()
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
    sizes = np.diff(lists[0].offsets.to_numpy()) if got.num_rows else np.zeros(0, dtype=np.int64)
    return fit(sizes.astype(np.int64), flat[0].astype(np.int64), flat[1].astype(np.float64), got.column("label").to_numpy(), width)


def score(docs: DataFrame, machine: Machine, metadata: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) for each row."""
    bounded_batches(docs.sparkSession)
    metadata = list(metadata or [])
    docs = docs.drop("score")
    kept = docs.columns
    rows = docs.select("*", *[F.col(m).cast("double").alias(f"_m_{k}") for k, m in enumerate(metadata)])

    def run(batches):
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            found = machine.score(*features(*_columns(batch, metadata)))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], pa.array(found)], names=[*kept, "score"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double")
