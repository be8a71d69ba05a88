"""Near-duplicate vectors by randomised-rotation binary codes.

A vector o (unit length) is rotated at random and stored as the signs of its coordinates, packed into
bits and read as the unit vector x with entries +-1/sqrt(D), with the correction factor f = <o, x>. For a
query q, <q, x> / f estimates <q, o> without bias; the error is below eps * sqrt((1 - f^2) / (f^2 (D - 1)))
with high probability. Nor can <q, o> pass f a + sqrt(1 - f^2) sqrt(1 - a^2), a = <q, x>: o is f x
plus a rest of length sqrt(1 - f^2) at a right angle to x, and q's part in that direction is at
most sqrt(1 - a^2). The query's side is its rotated coordinates in steps of 1/127 of the largest, with
the length of what the rounding left out; that length widens the bound. A pair whose bound is under the
threshold is dropped; the others are computed again exactly, in doubles.

Codes, factors and rounded coordinates are stored once per distinct vector, and they are what is dealt to
the comparisons: D/8 + D + 24 bytes instead of 8 D. Vectors themselves go only where a pair is left to be
computed again; such pairs stay in arrays of positions, a row per comparison of two blocks.

Which vectors meet: those of one label. A plan made from the label's size picks, for the least
work, how many tables of b-bit prefixes of further rotations (sign hashes, stored as bits beside the
code) to use; b = 0 is one table of everything, larger labels get prefixes that a pair at the threshold
shares in some table but for a chance of 1e-12. ``exact=True`` compares all of a label whatever its
size. Buckets are dealt in blocks of bounded size, block against block, so a task never holds a whole
bucket. A task returns link counts per vector and a spanning forest, not pairs. Equal vectors of a
label are one class with a multiplicity before any of this.

Defined cases: a null, empty, zero or non-finite vector, or one with null components, or a null
label: n_links 0, component its own id, kept. A null id: linked with nothing, component null. Very
large and very small components are scaled by the largest of their vector first. Vectors of different
lengths never link. Rows that repeat an id count as copies of each other.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import bounded_batches, connected_components, materialise

#: Classes in a block; a task compares two blocks.
BLOCK = 2048
#: Width of the certainty band of the estimate, in its standard errors.
EPSILON = 6.0
#: Pairs in one array of positions.
CHUNK = 1 << 17


@lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number, 977]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, then by their length: no square over- or underflows."""
    x = vectors / np.abs(vectors).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def sign_bits(unit: np.ndarray, count: int) -> np.ndarray:
    """(vectors, count) signs from rotations 1, 2, ..."""
    if not count:
        return np.zeros((len(unit), 0), dtype=bool)
    dim = unit.shape[1]
    return np.concatenate([unit @ rotation(dim, 1 + i) > 0 for i in range(-(-count // dim))], axis=1)[:, :count]


def prefixes(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) sign hashes of ``bits`` bits."""
    if not bits:
        return np.zeros((len(signs), 1), dtype=np.int64)
    return (signs.reshape(len(signs), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def plan(rows: int, threshold: float, miss: float = 1e-12) -> tuple[int, int]:
    """(bits, tables) of least work for a label of ``rows`` classes."""
    same = 1 - math.acos(threshold) / math.pi
    best = None
    for bits in range(33):
        tables = 1 if not bits else math.ceil(math.log(miss) / math.log1p(-(same**bits)))
        work = tables * (rows / 2**bits + 500)
        if best is None or work < best[0]:
            best = (work, bits, tables)
    return best[1], best[2]


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes of the rotated vectors, as bits, and their correction factors."""
    turned = unit @ rotation(unit.shape[1], 0)
    return turned > 0, np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated coordinates as 8-bit steps, the size of a step, and the length of what is left out."""
    turned = unit @ rotation(unit.shape[1], 0)
    step = np.abs(turned).max(axis=1) / 127
    steps = np.rint(turned / step[:, None]).astype(np.int8)
    left = np.sqrt(((turned - steps * step[:, None]) ** 2).sum(axis=1))
    return steps, step, left


def estimate(steps: np.ndarray, step: np.ndarray, left: np.ndarray, bits: np.ndarray, factor: np.ndarray, eps: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbiased estimates of <query, o>, their lower and their upper bounds (queries x codes)."""
    dim = steps.shape[1]
    a = (steps.astype(np.float32) @ np.where(bits, 1, -1).astype(np.float32).T) * (step[:, None] / math.sqrt(dim))
    slack = left[:, None] + 1e-6
    guess = a / factor
    error = eps * np.sqrt((1 - factor**2) / (factor**2 * max(1, dim - 1))) + slack / factor
    rest = np.sqrt(np.maximum(0, 1 - factor**2))
    # The certain bound is largest in a at a = f; a is known to within the slack.
    high, low = np.minimum(1, a + slack), np.maximum(-1, a - slack)
    nearest = np.clip(factor, low, high)
    most = factor * nearest + rest * np.sqrt(np.maximum(0, 1 - nearest**2))
    far = np.clip(-factor, low, high)
    least = factor * far - rest * np.sqrt(np.maximum(0, 1 - far**2))
    return guess, np.maximum(guess - error, least), np.minimum(guess + error, most)


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of ``nodes`` positions over the pairs (a, b)."""
    root = np.arange(nodes)
    while True:
        new = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


CELL = ["label", "dim", "prefix", "table", "lo", "hi"]


def _open_pairs(threshold: float):
    """The pairs of a cell (two blocks of one bucket) that its codes leave open: positions among the cell's
    open vectors, in arrays; and these vectors, by class."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table, lo, hi = (int(v) for v in key[-3:])
        pdf = pdf.sort_values("cid", ignore_index=True)
        dim, bits, tables = int(pdf["dim"].iloc[0]), int(pdf["bits"].iloc[0]), int(pdf["tables"].iloc[0])
        unpack = lambda c, n: np.unpackbits(np.frombuffer(b"".join(pdf[c]), dtype=np.uint8).reshape(len(pdf), -1), axis=1, count=n).astype(bool)
        code, steps = unpack("code", dim), np.frombuffer(b"".join(pdf["steps"]), dtype=np.int8).reshape(len(pdf), dim)
        factor, step, left, block, cids = (pdf[c].to_numpy() for c in ("factor", "step", "rest", "block", "cid"))
        keys = prefixes(unpack("signs", bits * tables), bits, tables) if table else None
        rows, columns = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(rows), 256):
            r = rows[at : at + 256]
            i, j = np.nonzero(estimate(steps[r], step[r], left[r], code[columns], factor[columns])[2] >= threshold)
            i, j = r[i], columns[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            if table:  # a pair counts in the first table where it meets
                new = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
                i, j = i[new], j[new]
            found.append((i, j))
        a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        place = place.astype("<i4")
        chunks = [(place[k : k + CHUNK].tobytes(), place[len(a) + k : len(a) + min(k + CHUNK, len(a))].tobytes()) for k in range(0, len(a), CHUNK)]
        chunks = [(x[: len(y)], y) for x, y in chunks]
        n = len(used) + len(chunks)
        fixed = dict(zip(CELL, ([v] * n for v in key), strict=True))
        return pd.DataFrame(fixed | {"cid": pd.array([*cids[used], *[None] * len(chunks)], dtype="Int64"), "a": [*[None] * len(used), *[x for x, _ in chunks]], "b": [*[None] * len(used), *[y for _, y in chunks]]})

    return run


def _links(threshold: float):
    """The links of one cell: counts by class and a spanning forest."""

    def run(vectors: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("cid", ignore_index=True)
        x = np.array(vectors["vector"].tolist(), dtype=np.float64)
        x /= np.abs(x).max(axis=1)[:, None]
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        cids, copies = vectors["cid"].to_numpy(), vectors["copies"].to_numpy()
        counts, kept = np.zeros(len(cids), dtype=np.int64), []
        for left, right in zip(pairs["a"], pairs["b"], strict=True):
            a, b = np.frombuffer(left, dtype="<i4"), np.frombuffer(right, dtype="<i4")
            for k in range(0, len(a), 1 << 15):
                i, j = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
                hit = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
                kept.append((i[hit], j[hit]))
        a, b = (np.concatenate([p[k] for p in kept] or [np.zeros(0, dtype=np.int32)]) for k in (0, 1))
        np.add.at(counts, a, copies[b])
        np.add.at(counts, b, copies[a])
        root = forest(len(cids), a, b)
        some, tied = np.flatnonzero(counts), np.flatnonzero(root < np.arange(len(cids)))
        return pd.DataFrame({"cid": np.concatenate([cids[some], cids[root[tied]]]), "n": np.concatenate([counts[some], np.zeros(len(tied), dtype=np.int64)]), "other": pd.array([*[None] * len(some), *cids[tied]], dtype="Int64")})

    return run


def coded(classes: DataFrame) -> DataFrame:
    """``classes`` (cid, dim, vector, bits, tables, ...) with code, factor, steps, step, rest and signs instead of the vector."""
    kept = [c for c in classes.columns if c != "vector"]

    def run(batches):
        for pdf in batches:
            for (bits, tables, _), part in pdf.groupby(["bits", "tables", "dim"]):
                unit = scaled(np.array(part["vector"].tolist(), dtype=np.float64))
                code, factor = codes(unit)
                steps, step, left = rounded(unit)
                packed = [[row.tobytes() for row in np.packbits(b, axis=1)] for b in (code, sign_bits(unit, int(bits * tables)))]
                yield part[kept].assign(code=packed[0], factor=factor, steps=[row.tobytes() for row in steps], step=step, rest=left, signs=packed[1])

    ddl = ", ".join(f"`{name}` {kind}" for name, kind in classes.dtypes if name != "vector")
    return classes.mapInPandas(run, ddl + ", code binary, factor double, steps binary, step double, rest double, signs binary")


def dealt(codes_: DataFrame) -> DataFrame:
    """A row per table with the class's prefix there, read from its stored signs."""

    def run(batches):
        for pdf in batches:
            for (bits, tables), part in pdf.groupby(["bits", "tables"]):
                n = int(bits * tables)
                signs = np.unpackbits(np.frombuffer(b"".join(part["signs"]), dtype=np.uint8).reshape(len(part), -1), axis=1, count=n).astype(bool) if n else np.zeros((len(part), 0), dtype=bool)
                keys = prefixes(signs, int(bits), int(tables))
                for t in range(keys.shape[1]):
                    yield pd.DataFrame({"cid": part["cid"].to_numpy(), "table": np.full(len(part), t, dtype=np.int32), "prefix": keys[:, t]})

    return codes_.select("cid", "bits", "tables", "signs").mapInPandas(run, "cid long, table int, prefix long").join(codes_, "cid")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    bounded_batches(vectors.sparkSession)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label"))
    sound = "vec_id is not null and label is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vector, x -> x <> 0)"
    # 0.0 for -0.0, so that equal vectors are equal groups.
    able = given.where(sound).withColumn("vector", F.expr("transform(vector, x -> x + 0d)")).withColumn("dim", F.size("vector"))
    classes = able.groupBy("label", "dim", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "vec-classes")

    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"))
    grid = [] if exact else [(1 << (k // 2)) * (2 + k % 2) // 2 for k in range(96)]  # the plan depends on the size's step alone
    bits, tables = F.lit(0), F.lit(1)
    for size, b, t in sorted({(g, *plan(g, threshold)) for g in grid}):
        bits, tables = F.when(F.col("rows") >= size, b).otherwise(bits), F.when(F.col("rows") >= size, t).otherwise(tables)
    planned = classes.join(sizes.select("label", "dim", bits.alias("bits"), tables.alias("tables")), ["label", "dim"])
    stored = materialise(coded(planned.select("cid", "label", "dim", "bits", "tables", "vector")), "vec-codes")

    rows = dealt(stored)
    bucket = ["label", "dim", "table", "prefix"]
    crowded = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("blocks", F.expr(f"cast(ceil(m / {block}) as int)")).drop("m")
    placed = rows.join(crowded, bucket).withColumn("block", F.expr("cast(pmod(xxhash64(cid), blocks) as int)"))
    cells = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    kinds = dict(stored.dtypes) | {"prefix": "bigint", "table": "int", "lo": "int", "hi": "int"}
    left = cells.groupBy(*CELL).applyInPandas(_open_pairs(threshold), ", ".join(f"`{c}` {kinds[c]}" for c in CELL) + ", cid long, a binary, b binary")
    left = materialise(left, "vec-open")

    needed = left.where("cid is not null").select(*CELL, "cid").join(classes.select("cid", "copies", "vector"), "cid")
    pairs = left.where("cid is null").select(*[F.col(c).alias(f"p_{c}") for c in CELL], "a", "b")
    found = needed.groupBy(*CELL).cogroup(pairs.groupBy(*[f"p_{c}" for c in CELL])).applyInPandas(_links(threshold), "cid long, n long, other long")
    found = materialise(found, "vec-links")

    counts = found.where("other is null").groupBy("cid").agg(F.sum("n").alias("n"))
    ends = found.where("other is not null").select("cid", "other")
    names = classes.select("cid", "rep")
    ends = ends.join(names.withColumnRenamed("rep", "src"), "cid").select("other", "src").join(names.select(F.col("cid").alias("other"), F.col("rep").alias("dst")), "other").select("src", "dst")
    parts = connected_components(ends)
    of_class = classes.join(counts, "cid", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("label", "dim", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    done = able.select("vec_id", "label", "dim", "vector").join(of_class, ["label", "dim", "vector"]).select("vec_id", "n_links", "component_id")
    rest = given.where(f"not coalesce({sound}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
