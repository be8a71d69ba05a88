"""What the operators of this package share: scratch tables, text hashing, components.

Scratch tables go to the folder that the session names in ``spark.checkpoint.dir``; all
executors and the driver see that folder, so a lost executor costs a reread, not a rerun.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a task works on at once. Texts can be long, so both are kept small.
ARROW_ROWS = 256
ARROW_BYTES = 8 << 20

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is named, a local master gets
    one of this machine, which becomes that setting; a cluster has to name one that all its machines see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="marram-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/marram-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that are still lazy read them."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/marram-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and
    gives the optimiser real sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.marram_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that nothing lazy reads any more."""
    path = getattr(df, "marram_path", None)
    if path:
        _delete(df.sparkSession, path)


def bounded_batches(spark: SparkSession) -> None:
    """Lower the bytes of one Arrow batch to ARROW_BYTES where the session allows more; this holds for the whole session from then on. All operators ask for this
    same value and none raises it, so a plan made earlier runs no worse for it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """Spark's batches in parts of at most ``rows`` rows and about ``size`` bytes, so that what a step
    holds is bounded whatever the session says."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    # The worker goes on with other tasks: what Arrow holds for nobody goes back.
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- hashing in numpy


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (xor-shift-multiply rounds)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_separator = np.zeros(256, dtype=bool)
_separator[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_byte_hash = mix64((np.arange(256, dtype=_U) + _U(1)) * _U(_GOLD))
_word_hash = np.where(_separator, _U(0), _byte_hash[_lower])
_BASE = 0xD6E8FEB86659FD93
_tables = {"up": np.ones(1, dtype=_U), "down": np.ones(1, dtype=_U)}
#: Bytes hashed in one numpy step (eight bytes of hash for each); one longer text makes a longer step.
_STEP = 1 << 19


def _powers(which: str, n: int) -> np.ndarray:
    """base**i (or its inverse to that power) modulo 2**64 for i < n."""
    if len(_tables[which]) < n:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        factors = np.full(max(n, _STEP + 4096), base, dtype=_U)
        factors[0] = 1
        _tables[which] = np.cumprod(factors, dtype=_U)
    return _tables[which][:n]


def _hash_at(weights: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of the byte run that begins at each start; bytes between runs weigh nothing."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    sums = np.add.reduceat(weights * _powers("up", len(weights)), starts)
    return mix64(sums * _powers("down", len(weights))[starts] + lengths.astype(_U) * _U(_GOLD))


def _steps(texts: list[bytes]):
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > _STEP:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield group


def hash_lines(lines: list[bytes]) -> np.ndarray:
    """64-bit hash of each byte string."""
    out = []
    for group in _steps(lines):
        sizes = np.fromiter(map(len, group), dtype=np.int64, count=len(group))
        data = np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        weights = _byte_hash[data]
        weights[starts + sizes] = 0
        out.append(_hash_at(weights, starts, sizes))
    return np.concatenate(out) if out else np.zeros(0, dtype=_U)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z lowered, and the number of words of each text.

    A word is a longest run of bytes other than space and 0x09-0x0D.
    """
    hashes, counts = [np.zeros(0, dtype=_U)], [np.zeros(0, dtype=np.int64)]
    for group in _steps(texts):
        data = np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)
        edge = np.diff(np.concatenate([[True], _separator[data]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sizes = np.fromiter(map(len, group), dtype=np.int64, count=len(group)) + 1
        counts.append(np.diff(np.concatenate([[0], np.searchsorted(starts, np.cumsum(sizes))])))
        hashes.append(_hash_at(_word_hash[data], starts, ends - starts))
    return np.concatenate(hashes), np.concatenate(counts)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's k-word shingles, ascending within a text, one text
    after the other, and the size of each text's set.

    Fewer than k words make one shingle of the whole sequence; no words, an empty set.
    """
    words, counts = hash_words(texts)
    factors = [_U((_GOLD * (2 * i + 1)) & (2**64 - 1)) for i in range(k)]
    ends = np.cumsum(counts)
    full = np.zeros(max(0, len(words) - k + 1), dtype=_U)
    for i in range(k if len(full) else 0):
        full += words[i : len(full) + i] * factors[i]
    full = mix64(full)
    parts, sizes = [np.zeros(0, dtype=_U)], []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= k:
            own = np.sort(full[end - n : end - k + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            acc = _U(n)
            for i, w in enumerate(words[end - n : end]):
                acc = mix64(np.array([acc], dtype=_U) + np.array([w], dtype=_U) * factors[i])[0]
            own = np.array([acc], dtype=_U)
        else:
            own = full[:0]
        parts.append(own)
        sizes.append(len(own))
    return np.concatenate(parts), np.array(sizes, dtype=np.int64)


# ---------------------------------------------------------------- filters of bounded size

#: Bits of a filter: this many for each key, between two bounds (8 kB and 32 MB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A bit field for the long column ``a`` of ``keys``: bit (a mod size) of each key is set. Its size follows the number of keys, up
    to MOST_BITS; Spark sets the bits of a word together, and only the words come here."""
    n = keys.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_A_KEY):
        bits *= 2
    place = F.col("a").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    field = np.zeros(bits // 64, dtype=np.int64)
    field[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return field


def passes(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & _U(len(field) * 64 - 1)
    return (field.view(_U)[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``edges`` (src, dst: long); component = smallest node.

    Alternating large and small stars: each round hangs every node's larger neighbours, then
    its smaller ones, on the smallest neighbour, until all that is left are stars; that takes a number of rounds
    like the square of the logarithm of the nodes at most. Every step
    is a partial aggregation or a join that adaptive execution can split, so a hub with a third
    of all links is spread. Each round is a table in the shared folder.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    e = materialise(e, "cc")
    while True:
        near = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v")))
        new = materialise(small.distinct(), "cc")
        release(e)
        e = new
        rooted = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        inner = e.select(F.col("v").alias("u")).distinct().join(rooted, "u", "left_semi")
        if rooted.where("n > 1").limit(1).count() == 0 and inner.limit(1).count() == 0:
            roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
