"""MinHash near-duplicates by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so ``bands * rows`` values cost half as many hash evaluations. Bands of these values
choose the candidate pairs; each candidate pair is confirmed on full shingle sets.

Three things keep crowds of alike documents linear, without a cap:

* Equal sets are one set, whatever their number.
* A shingle that only one of the banded sets has is in no intersection. Without these, sets that are
  left equal and were of equal size are one *class*: its members link with the same others. A class
  that is left with too few shingles to reach the threshold with anything is out at once, so variants
  that are each a little too far from the rest of a crowd are never compared.
* In each bucket of a band the classes meet one class there, that with the fewest shingles of its own; only
  what that did not join meets the others: all but the largest component of a bucket against the classes
  of other components there. Of these pairs a join puts out those that sizes and parity sketches leave
  possible: sketches differ in no more bits than sets in elements, so what they rule out is no link.

The class pairs compared are those of one bucket that are in different components and that no bound rules
out. None is dropped. Sketches have a bit for each element or more, as their size follows the set, so that a crowd of long texts that
are each a little too far from each other is ruled out like one of short ones.

Defined cases: a null or blank text has the empty set and links with nothing; a null id is never
linked (component null, kept); rows that repeat an id are one document, which has the links of all its
texts; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.common import bounded_batches, connected_components, materialise, mix64, release, shingle_sets, slices

_U = np.uint64
_PRINT_A, _PRINT_B = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
#: Longs in the shortest parity sketch, a power of two.
WORDS = 16
SIGNATURE = "doc_id long, n_shingles long, fp_a long, fp_b long, bands array<long>"


def permutations(count: int, seed: int = 20011) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets: each pair permutes the 64-bit integers."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=_U) * _U(2) + _U(1), rng.integers(0, 2**63, count, dtype=_U)


def min_max_signatures(flat: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """(sets, 2 * count): the minima of all permuted sets, then the maxima; no set may be empty.

    A minimum and a maximum of one permutation are in different bands: a band's values are then
    independent, and of the two bands at most one more often than not fails.
    """
    a, b = permutations(count)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sizes), 2 * count), dtype=_U)
    value = np.empty_like(flat)
    for p in range(count):
        np.multiply(flat, a[p], out=value)
        np.add(value, b[p], out=value)
        out[:, p] = np.minimum.reduceat(value, starts)
        out[:, count + p] = np.maximum.reduceat(value, starts)
    return out


def estimated_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Unbiased estimate of the Jaccard similarity from two signatures: the share of equal values."""
    return float((a == b).mean())


def bands_needed(threshold: float, rows: int, miss: float = 5e-8) -> int:
    """Bands that leave a pair at the threshold without a common band no oftener than ``miss``;
    even, so that each permutation gives both its values."""
    n = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    return n + n % 2


def signatures(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """One row per document: set size, 128-bit set fingerprint, one key per band."""

    def run(batches):
        for batch in slices(batches):
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            flat, sizes = shingle_sets(texts, shingle)
            full = sizes > 0
            keys = np.zeros((len(sizes), bands), dtype=_U)
            prints = np.zeros((len(sizes), 2), dtype=_U)
            if full.any():
                some = sizes[full]
                values = min_max_signatures(flat, some, bands * rows // 2).reshape(len(some), bands, rows)
                acc = np.broadcast_to(np.arange(bands, dtype=_U) + _U(1), (len(some), bands)).copy()
                for r in range(rows):
                    acc = mix64(acc * _U(0x9E3779B97F4A7C15) + values[:, :, r])
                keys[full] = acc
                prints[full, 0] = _fingerprint(flat, some, _PRINT_A)
                prints[full, 1] = _fingerprint(flat, some, _PRINT_B)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]), pa.int32()), pa.array(keys[full].reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(prints[:, 0].copy().view(np.int64)), pa.array(prints[:, 1].copy().view(np.int64)), lists],
                names=["doc_id", "n_shingles", "fp_a", "fp_b", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNATURE)


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, fp_a and the set itself."""

    def run(batches):
        for batch in slices(batches):
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            flat, sizes = shingle_sets(texts, shingle)
            prints = np.zeros(len(sizes), dtype=_U)
            full = sizes > 0
            if full.any():
                prints[full] = _fingerprint(flat, sizes[full], _PRINT_A)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(prints.view(np.int64)), lists], names=["rep", "n", "fp_a", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, n long, fp_a long, shingles array<long>")


def _fingerprint(flat: np.ndarray, sizes: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A 64-bit sum over each set; no set may be empty."""
    return np.add.reduceat(mix64(flat ^ salt), np.concatenate([[0], np.cumsum(sizes)[:-1]]))



def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of
    ``shingle``-word shingles; a component is named by its smallest id.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = materialise(signatures(docs, shingle, rows, bands_needed(percent / 100, rows)), "sig")
    able = sig.where("n_shingles > 0 and doc_id is not null")

    # Equal sets are one set, named by the smallest id that has it.
    copies = able.groupBy("n_shingles", "fp_a", "fp_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = materialise(copies.where("copies > 1").drop("copies"), "copies")
    rows_of = sig.join(copies, ["n_shingles", "fp_a", "fp_b"], "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))

    edges = _links(docs, rows_of.where("rep = doc_id and n_shingles > 0"), shingle, percent)
    # An id with several texts: these are one document.
    several = rows_of.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("hi")).where("src < hi").drop("hi")
    edges = edges.unionByName(rows_of.select("doc_id", F.col("rep").alias("dst")).join(several, "doc_id").select("src", "dst"))

    parts = connected_components(edges)
    out = rows_of.select("doc_id", "n_shingles", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def level(size: int) -> int:
    """A set of up to 1024 elements has a sketch of 64 * WORDS bits; each level has twice as many for twice the elements."""
    return max(0, (max(size, 1) - 1).bit_length() - 10)


def parities(elements: np.ndarray, at: int) -> np.ndarray:
    """Parities of the elements that fall on each of 64 * WORDS * 2**at bits, as longs. Two sets differ in at
    least as many elements as their sketches of one level differ in bits; the halves' exclusive or is the sketch one level down."""
    bits = 64 * WORDS << at
    odd = np.bincount((elements.view(_U) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(sets: DataFrame) -> DataFrame:
    """cid, level, sketch, lower (the sketch one level down) of sets (cid, shared)."""

    def run(batches):
        for batch in slices(batches):
            levels, own, lower = [], [], []
            for part in batch.column(1):
                elements = part.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
                at = level(len(elements))
                words = parities(elements, at)
                levels.append(at)
                own.append(words)
                lower.append(words[: len(words) // 2] ^ words[len(words) // 2 :] if at else words)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64))) for x in (own, lower)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.int32()), *lists], names=["cid", "level", "sketch", "lower"])

    return sets.select("cid", "shared").mapInArrow(run, "cid long, level int, sketch array<long>, lower array<long>")


def _links(docs: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (src, dst: ids that name sets) that join all that is linked, for ``reps`` (doc_id, fp_a, bands)."""
    # Sets that share a band with another one. A set is known by the id that names it and a fingerprint.
    banded = reps.select(F.col("doc_id").alias("rep"), "fp_a", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    buckets = materialise(banded.join(crowded, "key", "left_semi"), "buckets")
    which = buckets.select("rep", "fp_a").distinct()
    texts = docs.join(which.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = materialise(_sets(texts, shingle).join(which, ["rep", "fp_a"], "left_semi").dropDuplicates(["rep", "fp_a"]), "sets")

    # What of each set other sets have as well.
    each = sets.select("rep", "fp_a", F.explode("shingles").alias("token"))
    common = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    shared = each.join(common, "token").groupBy("rep", "fp_a").agg(F.sort_array(F.collect_list("token")).alias("shared"))
    shared = shared.join(sets.select("rep", "fp_a", "n"), ["rep", "fp_a"]).withColumn("r", F.size("shared").cast("long")).where(f"100 * r >= {percent} * n")
    shared = materialise(shared.withColumn("h1", F.xxhash64("shared")).withColumn("h2", F.xxhash64(F.lit(1), "shared")), "shared")

    # Classes: what is shared and the size are the same, so all members link with the same sets.
    same = ["n", "h1", "h2"]
    classes = shared.groupBy(*same).agg(F.min(F.struct("rep", "fp_a")).alias("first"), F.count(F.lit(1)).alias("members")).withColumn("cid", F.monotonically_increasing_id())
    classes = materialise(classes.select("cid", *same, "first.rep", "first.fp_a", "members"), "classes")
    members = materialise(shared.select("rep", "fp_a", "r", *same).join(classes.select("cid", *same), same).select("rep", "fp_a", "cid", "n", "r"), "members")
    class_sets = materialise(shared.join(classes.select("cid", "rep", "fp_a"), ["rep", "fp_a"]).select("cid", "n", "shared"), "class-sets")
    at = materialise(buckets.join(members, ["rep", "fp_a"]).select("key", "cid", "n", "r").distinct(), "class-buckets")
    for table in (buckets, sets, shared):
        release(table)

    def possible(a: str, b: str) -> Column:
        """The sizes leave room for the intersection that the threshold asks for."""
        return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {percent} * ({a}.n + {b}.n) <= {100 + percent} * least({a}.r, {b}.r)")

    def near(a: str, b: str) -> Column:
        """What each has of its own, and the bits in which their sketches differ, leave the union small enough."""
        short = " + ".join(f"bit_count({a}.s{w} ^ {b}.s{w})" for w in range(WORDS))
        # Sizes that leave a link possible are at most one level apart; sketches meet on the lower one.
        x, y = f"if({a}.level > {b}.level, {a}.lower, {a}.sketch)", f"if({b}.level > {a}.level, {b}.lower, {b}.sketch)"
        long = f"aggregate(zip_with({x}, {y}, (u, v) -> bit_count(u ^ v)), 0, (s, c) -> s + c)"
        apart = f"if({a}.level = 0 and {b}.level = 0, {short}, if(abs({a}.level - {b}.level) <= 1, coalesce({long}, 0), 0))"
        return F.expr(f"{100 + percent} * ({a}.n - {a}.r + {b}.n - {b}.r + {apart}) <= {100 - percent} * ({a}.n + {b}.n)")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = class_sets.select(F.col("cid").alias("src"), F.col("n").alias("m"), F.col("shared").alias("a"))
        right = class_sets.select(F.col("cid").alias("dst"), F.col("n").alias("n"), F.col("shared").alias("b"))
        both = F.size(F.array_intersect("a", "b")).cast("long")
        return pairs.join(left, "src").join(right, "dst").where(100 * both >= percent * (F.col("m") + F.col("n") - both)).select("src", "dst")

    # First each class against that of its buckets which has least of its own, and so is near most others.
    hubs = at.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("r")).alias("own"), "cid", "n", "r")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "hub.*")
    stars = at.alias("a").join(hubs.alias("b"), "key").where("a.cid <> b.cid").where(possible("a", "b"))
    first = materialise(confirmed(stars.select(F.col("b.cid").alias("src"), F.col("a.cid").alias("dst")).distinct()), "links")
    parts = materialise(connected_components(first), "parts")

    # Then what is in a bucket and isn't joined.
    placed = at.join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    mixed = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("key")
    mixed = mixed.agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main")
    open_ = placed.join(mixed, "key")
    drawn = sketches(class_sets.join(open_.select("cid").distinct(), "cid", "left_semi"))
    # The words of the shortest are columns, which compiled code compares; longer ones stay arrays.
    columns = [F.when(F.col("level") == 0, F.col("sketch")[w]).otherwise(F.lit(0)).alias(f"s{w}") for w in range(WORDS)]
    arrays = [F.when((F.col("level") > 0) | (100 * F.col("n") >= percent * 1024), F.col(c)).alias(c) for c in ("sketch", "lower")]
    open_ = open_.join(drawn, "cid").select("key", "cid", "n", "r", "component", "main", "level", *columns, *arrays)
    open_ = materialise(open_, "open")
    pairs = open_.where("component <> main").alias("a").join(
        open_.alias("b"),
        (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & ((F.col("a.cid") < F.col("b.cid")) | (F.col("b.component") == F.col("b.main"))) & possible("a", "b") & near("a", "b"),
    )
    pairs = pairs.select(F.least("a.cid", "b.cid").alias("src"), F.greatest("a.cid", "b.cid").alias("dst")).distinct()
    links = materialise(first.unionByName(confirmed(pairs)), "links")

    # A class whose members link with each other or with another class is joined whole; of others each is alone.
    alike = classes.where("members > 1").join(members.select("cid", "r").distinct(), "cid").where(f"{percent} * 2 * n <= {100 + percent} * r").select("cid")
    joined = links.select(F.col("src").alias("cid")).union(links.select("dst")).union(alike).distinct()
    names = classes.select("cid", F.col("rep").alias("name"))
    inside = members.join(joined, "cid", "left_semi").join(names, "cid").where("rep <> name").select(F.col("name").alias("src"), F.col("rep").alias("dst"))
    across = links.join(names.select(F.col("cid").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("cid").alias("dst"), F.col("name").alias("b")), "dst")
    return inside.unionByName(across.select(F.col("a").alias("src"), F.col("b").alias("dst")))
