"""Whitening of embeddings by a tiled covariance.

Every usable vector (no null, no non-finite entry) becomes whole numbers x = floor(1024 c) + 100000, of which Spark sums
each dimension exactly. Rows are cut into row blocks and columns into column blocks: a task writes a row block's centred column
blocks, these are shuffled by row block, pairs of them (tiles of the covariance) are multiplied, and the tiles' entries are summed over
the row blocks. What is assembled on the driver is the matrix of dims x dims numbers, whatever the number of rows; its
eigenvectors, numbered by falling eigenvalue, are the components. The whitened rows' covariance, by the same tiles, says
how far it is from the identity.

All rows of one vector may be equal: blocks are cut by place, not by content. A task holds one row block of ``ROWS`` rows at
a time.

Defined cases: a null vector, an empty one and one with a null or non-finite entry are dropped; so are vectors that
have not the commonest length (of equally common ones the longest); a null or repeated id is a row like others; components
whose eigenvalue is nothing but rounding cannot be scaled and have no rows, so equal vectors alone, or an empty table,
give none; entries whose number of 1024ths is over 2^53 are refused with an error; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import bounded_batches, materialise, slices

#: Rows of a row block, columns of a column block.
ROWS, COLUMNS = 2048, 32


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the rows (vec_id, embedding) that are fitted."""
    vector = F.transform("embedding", lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    some = rows.select("vec_id", vector.alias("v")).where("v is not null and size(v) > 0").where(~F.exists("v", bad))
    top = some.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    whole = F.transform("v", lambda c: F.when(F.abs(c) * 1024 < 2.0**53, F.floor(c * 1024)).otherwise(F.raise_error(F.lit("entries of 2^43 and more cannot be whitened")).cast("long")) + 100000)
    return some.where(F.size("v") == (top.d if top else 0)).select("vec_id", whole.alias("x"))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _sums(rows: DataFrame) -> list[int]:
    """Exact sum of each dimension of ``x``."""

    def run(batches):
        total: list[int] | None = None
        for batch in slices(batches, ROWS):
            if batch.num_rows:
                x = _matrix(batch.column(0), np.int64)
                # Halves are summed apart: a sum of 2048 of them stays far below 2^63.
                part = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
                total = [a + b for a, b in zip(total, part, strict=True)] if total else part
        from decimal import Decimal

        yield pa.RecordBatch.from_arrays([pa.array(range(len(total or [])), pa.int32()), pa.array([Decimal(t) for t in total or []], pa.decimal128(38, 0))], names=["dim", "total"])

    found = rows.select("x").mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
    return [int(r.total) for r in found.orderBy("dim").collect()]  # one number a dimension


def covariance(rows: DataFrame, column: str, centre: np.ndarray, n: int) -> np.ndarray:
    """Mean of the products of the centred entries of the arrays in ``column``, of ``n`` rows, tile by tile."""
    dims, step = len(centre), COLUMNS
    sent = rows.sparkSession.sparkContext.broadcast(centre)

    def blocks(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in slices(batches, ROWS):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), np.float64) - sent.value
            own = [np.ascontiguousarray(x[:, c : c + step]).tobytes() for c in range(0, dims, step)]
            k = len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 33) + seq] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([len(x)] * k, pa.int32()), pa.array(own, pa.binary())], names=["row_block", "c", "rows", "data"]
            )
            seq += 1

    def products(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, size, a, b in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                a, b = (np.frombuffer(m, dtype=np.float64).reshape(size, -1) for m in (a, b))
                tile = a.T @ b
                held[i, j] = held[i, j] + tile if (i, j) in held else tile
        for (i, j), tile in held.items():
            p, q = np.meshgrid(np.arange(tile.shape[0]) + i * step, np.arange(tile.shape[1]) + j * step, indexing="ij")
            yield pa.RecordBatch.from_arrays([pa.array(p.ravel(), pa.int32()), pa.array(q.ravel(), pa.int32()), pa.array(tile.ravel())], names=["p", "q", "value"])

    cut = rows.select(column).mapInArrow(blocks, "row_block long, c int, rows int, data binary")
    left, right = cut.select("row_block", F.col("c").alias("i"), "rows", F.col("data").alias("a")), cut.select("row_block", F.col("c").alias("j"), F.col("data").alias("b"))
    tiles = left.join(right, "row_block").where("i <= j").select("i", "j", "rows", "a", "b").mapInArrow(products, "p int, q int, value double")
    entries = tiles.groupBy("p", "q").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((dims, dims))
    p, q = entries.column("p").to_numpy(), entries.column("q").to_numpy()
    out[p, q] = entries.column("value").to_numpy() / n
    # Blocks on the diagonal are whole; the others' mirror images are below it.
    return np.triu(out) + np.triu(out, 1).T


def whiten(rows: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for ``rows`` (vec_id, embedding), one row for each
    component up to ``components``."""
    bounded_batches(rows.sparkSession)
    spark = rows.sparkSession
    kept = materialise(usable(rows.select("vec_id", "embedding")), "whole-vectors")
    n, sums = kept.count(), None
    sums = _sums(kept) if n else []
    dims = len(sums)
    mean = np.array([s / n for s in sums])
    v = covariance(kept, "x", mean, n) if n else np.zeros((0, 0))
    values, vectors = np.linalg.eigh(v) if n else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    able = int((values[:components] > max(dims, 1) * np.finfo(float).eps * (values[:1].max() if len(values) else 1)).sum())
    scale = vectors[:, :able] / np.sqrt(values[:able]) if n else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast((n, sums, mean, scale))

    def run(batches):
        n, sums, mean, scale = sent.value
        least, most = min(sums, default=0), max(sums, default=0)
        for batch in slices(batches, ROWS):
            x = _matrix(batch.column(1), np.int64) if batch.num_rows else np.zeros((0, len(sums)), dtype=np.int64)
            edge = max(n * int(x.max()) - least, most - n * int(x.min())) if x.size else 0
            # Squares and their sum in 64 bits where they are sure to fit, else in Python's integers.
            gaps = x * n - np.array(sums, dtype=np.int64) if edge < 2**62 else x.astype(object) * n - np.array(sums, dtype=object)
            squares = (gaps if edge < int((2**62 / max(1, len(sums))) ** 0.5) else gaps.astype(object)) ** 2
            deviation = [int(s) for s in squares.sum(axis=1)]
            # One row at a time against the components: the same vector has the same digits in every block.
            white = np.einsum("rd,dk->rk", x - mean, scale) if x.size else np.zeros((0, 0))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * scale.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel()))], names=["vec_id", "deviation", "w"])

    white = materialise(kept.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, "vec_id long, deviation long, w array<double>"), "whitened")
    error = 0.0
    if able:
        means = white.select(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(able)]).first()
        error = float(np.abs(covariance(white, "w", np.array(list(means)), n) - np.eye(able)).max())
    trace = float(np.trace(v)) if n else 1.0
    explained = F.array(*[F.lit(float(e / trace)) for e in values[:able]]).cast("array<double>")
    each = white.select("vec_id", F.posexplode("w").alias("i", "whitened"), "deviation")
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
