"""Vectors in balls: exact top-k that reads few of them, and a neighbour graph of measured recall.

Centres are fitted on a bounded sample; every vector is in the ball of its nearest centre, and a ball has a radius for
each distance. By the triangle inequality no vector of a ball is nearer to a query than the centre's distance less the radius. For
cosine the inequality is that of angles; for the dot product, which has none, the largest product in a ball is at most that of its
centre plus the query's length times the radius. So a query looks into its nearest ball first, and its k-th distance there rules balls
out; the rest is read, and the rows are those of the search through all vectors.

What the driver and each task hold are the centres and radii (at most ``MOST_BALLS``) and a portion of the queries of checked size.

Defined cases: a null vector, one of another length than the centres', and one with a null or non-finite entry is in no ball and has no
distance; a null id is a row like others; zero vectors have cosine distance 1 to all, and lie in a ball of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.ranking import top_k
from marram.plans.scratch import stored

KINDS = ("cosine", "dot", "l2-squared", "manhattan", "hamming")
#: Rows that centres are fitted on at most, balls at most, vectors of a ball as planned, rounds of fitting.
SAMPLE, MOST_BALLS, A_BALL, ROUNDS = 20_000, 1024, 128, 8
#: Bytes of query vectors sent to the executors at once.
QUERY_BYTES = 32 << 20
#: Distances are rounded to six places; bounds give way by more than that.
SLACK = 2e-6
#: Distances that a task computes at once. Ids of no row and of a row whose id is null, which comes first.
CELLS, NONE, NULL = 1 << 20, (1 << 63) - 1, -(1 << 63)
#: Blocks of vectors that are compared with each other, rows of a block at most.
SIDE, MOST = 24, 1 << 15
STORED = "vec_id long, embedding array<double>, r0 double, r1 double, r2 double, r3 double, ball int"


def pairwise(kind: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances (queries, rows) in doubles."""
    if kind in ("cosine", "dot"):
        product = q @ x.T
        if kind == "dot":
            return -product
        lengths = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        return 1 - np.divide(product, lengths, out=np.zeros_like(product), where=lengths > 0)
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        gap = x - row
        out[i] = (gap**2).sum(axis=1) if kind == "l2-squared" else np.abs(gap).sum(axis=1) if kind == "manhattan" else (gap != 0).sum(axis=1)
    return out


class Nearest:
    """The ``k`` nearest rows of each of ``n`` queries so far, by (distance, id). Of rows that are equally far only those of the smallest ids stay,
    so what a task holds does not grow with the rows that it looks at."""

    def __init__(self, n: int, k: int):
        self.k, self.distances, self.ids = k, np.full((n, k), np.inf), np.full((n, k), NONE, dtype=np.int64)

    def look(self, kind: str, which: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None) -> None:
        """Compare the queries ``which`` (rows of ``q``) with the rows ``x``, a tile at a time. A row with the id that ``own`` gives for a query is not met."""
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        step = max(1, CELLS // max(1, len(x)))
        for at in range(0, len(which) if len(x) else 0, step):
            part = which[at : at + step]
            distances = np.round(pairwise(kind, q[part], x), 6) + 0.0
            if own is not None:
                distances[own[part][:, None] == ids[None]] = np.nan
            self._add(part, distances, ids)

    def _add(self, which: np.ndarray, distances: np.ndarray, ids: np.ndarray) -> None:
        keep = min(self.k, len(ids))
        border = np.fmin(np.partition(distances, keep - 1, axis=1)[:, keep - 1], self.distances[which, -1])[:, None]
        near = distances <= border
        if (near.sum(axis=1) > keep).any():
            below = distances < border
            tie = near & ~below
            near = below | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= keep - below.sum(axis=1)[:, None]))
        i, j = np.nonzero(near)
        some, i = np.unique(i, return_inverse=True)
        rows, held = which[some], np.repeat(np.arange(len(some)), self.k)
        row, far, vec = np.concatenate([i, held]), np.concatenate([distances[some[i], j], self.distances[rows].ravel()]), np.concatenate([ids[j], self.ids[rows].ravel()])
        order = np.lexsort((vec, far, row))
        first = order[np.searchsorted(row[order], np.arange(len(some)))[:, None] + np.arange(self.k)]
        self.distances[rows], self.ids[rows] = far[first], vec[first]

    def found(self, query_ids: np.ndarray) -> pd.DataFrame:
        """query_id, vec_id, distance of what is there."""
        i, j = np.nonzero(self.ids != NONE)
        return pd.DataFrame({"query_id": query_ids[i], "vec_id": self.ids[i, j], "distance": self.distances[i, j]})


def angles(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(1 - pairwise("cosine", q, x), -1, 1))


def fit(sample: np.ndarray, balls: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of a bounded sample by Lloyd's rounds. They begin at rows drawn by their squared distance to those drawn before."""
    if not len(sample):
        return np.zeros((0, 0))
    rng = np.random.default_rng(1)
    centres = sample[:1].copy()
    gap = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < balls and gap.sum() > 0:
        centres = np.vstack([centres, sample[rng.choice(len(sample), p=gap / gap.sum())]])
        gap = np.minimum(gap, ((sample - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        nearest = nearest_ball(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(centres, axis=0)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None]


def nearest_ball(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = squared(x[at : at + 4096], centres).argmin(axis=1)
    return out


def lower_bounds(kind: str, q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """(queries, balls): no vector of the ball has a smaller distance to the query. radii: (balls, 4) for Euclid, city block, unequal entries, angle."""
    if kind == "dot":
        return -(q @ centres.T) - np.linalg.norm(q, axis=1)[:, None] * radii[None, :, 0]
    if kind == "cosine":
        # A ball with a zero vector has no bound on angles (its radius is pi): the distance 1 is above 0 all the same.
        return 1 - np.cos(np.clip(angles(q, centres) - radii[None, :, 3], 0, np.pi))
    if kind == "l2-squared":
        gap = np.sqrt(np.maximum(pairwise(kind, q, centres), 0)) - radii[None, :, 0]
        return np.maximum(gap, 0) ** 2
    return np.maximum(pairwise(kind, q, centres) - radii[None, :, 1 if kind == "manhattan" else 2], 0)


def _usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    some = vectors.where("embedding is not null and size(embedding) > 0").where(~F.exists("embedding", bad))
    return some if length is None else some.where(F.size("embedding") == length)


class VectorIndex:
    """Balls of ``vectors`` (vec_id, embedding), stored in the folder ``path``, one folder a ball."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, radii: np.ndarray, counts: np.ndarray):
        self.spark, self.path, self.centres, self.radii, self.counts = spark, path, centres, radii, counts

    @classmethod
    def build(cls, vectors: DataFrame, path: str, balls: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """Fit on at most ``sample`` rows, place all. The commonest vector length is indexed."""
        spark = vectors.sparkSession
        some = _usable(vectors.select("vec_id", "embedding"))
        sizes = some.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        n, d = (sizes.n, sizes.d) if sizes else (0, 0)
        some = _usable(vectors.select("vec_id", "embedding"), d)
        drawn = some.select("embedding").sample(min(1.0, 1.2 * sample / max(n, 1)), seed).limit(sample).toPandas()
        rows = np.array(drawn["embedding"].tolist(), dtype=np.float64).reshape(len(drawn), d)
        centres = fit(rows, balls or int(min(MOST_BALLS, max(1, n // A_BALL))))
        sent = spark.sparkContext.broadcast(centres)

        def place(batches):
            for pdf in batches:
                x = np.array(pdf["embedding"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
                ball = nearest_ball(x, sent.value) if len(x) else np.zeros(0, dtype=np.int64)
                gap = x - sent.value[ball]
                lengths = np.linalg.norm(x, axis=1) * np.linalg.norm(sent.value[ball], axis=1)
                cosine = np.divide((x * sent.value[ball]).sum(axis=1), lengths, out=np.full(len(x), -1.0), where=lengths > 0)
                pdf["r0"], pdf["r1"], pdf["r2"], pdf["r3"] = np.linalg.norm(gap, axis=1), np.abs(gap).sum(axis=1), (gap != 0).sum(axis=1).astype(float), np.arccos(np.clip(cosine, -1, 1))
                pdf["ball"] = ball.astype(np.int32)
                yield pdf[["vec_id", "embedding", "r0", "r1", "r2", "r3", "ball"]]

        placed = some.mapInPandas(place, STORED)
        # By ranges of (ball, distance): a ball of very many vectors is then split over tasks and files.
        placed.repartitionByRange("ball", "r0").write.partitionBy("ball").parquet(path)
        heads = spark.read.schema(STORED).parquet(path).groupBy("ball").agg(F.count(F.lit(1)).alias("n"), *[F.max(f"r{i}").alias(f"r{i}") for i in range(4)]).collect()  # one row a ball
        radii, counts = np.zeros((len(centres), 4)), np.zeros(len(centres), dtype=np.int64)
        for r in heads:
            radii[r.ball], counts[r.ball] = (r.r0, r.r1, r.r2, r.r3), r.n
        return cls(spark, path, centres, radii * (1 + 1e-12) + 1e-12, counts)

    def rows(self, balls: np.ndarray | None = None) -> DataFrame:
        """vec_id, embedding, ball of some balls; folders of others are not opened."""
        df = self.spark.read.schema(STORED).parquet(self.path).select("vec_id", "embedding", "ball")
        return df if balls is None else df.where(F.col("ball").isin([int(b) for b in balls]))

    def _look(self, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int, kind: str) -> DataFrame:
        """query_id, vec_id, distance: of each query (row of ``q``) each task's k best of the balls that ``wanted`` (queries, balls) marks."""
        sent = self.spark.sparkContext.broadcast((ids, q, wanted))

        def run(batches):
            ids, q, wanted = sent.value
            best = Nearest(len(q), k)
            for pdf in batches:
                for ball, group in pdf.groupby("ball"):
                    best.look(kind, np.flatnonzero(wanted[:, ball]), q, np.array(group["embedding"].tolist(), dtype=np.float64), group["vec_id"].to_numpy())
            yield best.found(ids)

        rows = self.rows(np.flatnonzero(wanted.any(axis=0))).select(F.coalesce("vec_id", F.lit(NULL)).alias("vec_id"), "embedding", "ball")
        return rows.mapInPandas(run, "query_id long, vec_id long, distance double").withColumn("vec_id", F.nullif("vec_id", F.lit(NULL)))

    def _portions(self, queries: DataFrame):
        """Queries in numpy, at most QUERY_BYTES at a time."""
        usable = _usable(queries.select("query_id", "embedding"), self.centres.shape[1] if self.centres.size else -1)
        n = usable.count()
        portions = max(1, -(-n * max(1, self.centres.shape[1]) * 8 // QUERY_BYTES))
        for part in range(portions):
            pdf = usable.where(F.pmod(F.xxhash64("query_id"), F.lit(portions)) == part).orderBy("query_id").toPandas()
            if len(pdf):
                yield pdf["query_id"].to_numpy(), np.array(pdf["embedding"].tolist(), dtype=np.float64)

    def needed(self, ids: np.ndarray, q: np.ndarray, k: int, kind: str) -> np.ndarray:
        """(queries, balls): the balls that may hold one of a query's k nearest."""
        bounds = lower_bounds(kind, q, self.centres, self.radii)
        bounds[:, self.counts == 0] = np.inf
        # First the balls of the smallest bounds that hold k vectors together.
        order = np.argsort(bounds, axis=1, kind="stable")
        before = np.cumsum(self.counts[order], axis=1) - self.counts[order]
        first = np.zeros_like(bounds, dtype=bool)
        np.put_along_axis(first, order, before < k, axis=1)
        first &= self.counts > 0
        best = top_k(self._look(ids, q, first, k, kind), k, [F.col("distance"), F.col("vec_id")], ["query_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth"))
        kth = {r.query_id: r.kth for r in best.where(F.col("n") >= k).collect()}  # one number a query of the portion
        limit = np.array([kth.get(i, np.inf) for i in ids.tolist()])
        return (bounds <= limit[:, None] + SLACK) & (self.counts > 0)

    def top(self, queries: DataFrame, k: int, kind: str = "cosine") -> DataFrame:
        """query_id, vec_id, distance, rank: the k nearest vectors of each of ``queries`` (query_id, embedding), exactly."""
        found = None
        for ids, q in self._portions(queries):
            part = self._look(ids, q, self.needed(ids, q, k, kind), k, kind)
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.spark.createDataFrame([], "query_id long, vec_id long, distance double")
        return top_k(found, k, [F.col("distance"), F.col("vec_id")], ["query_id"])

    def report(self, queries: DataFrame, k: int, kind: str = "cosine") -> dict[str, float]:
        """Share of the vectors that a query looks at on average, and of the vectors that are read at all."""
        seen, read, asked = 0, np.zeros(len(self.counts), dtype=bool), 0
        for ids, q in self._portions(queries):
            wanted = self.needed(ids, q, k, kind)
            seen, asked, read = seen + int((wanted * self.counts).sum()), asked + len(ids), read | wanted.any(axis=0)
        total = max(1, int(self.counts.sum()))
        return {"compared": seen / max(1, asked) / total, "read": int(self.counts[read].sum()) / total}


def planned_probes(index: VectorIndex, sample: DataFrame, k: int, threshold: float, target: float) -> tuple[int, float]:
    """How many balls a vector has to look into to find ``target`` of its neighbours, and the share it then finds, as measured on ``sample``
    (query_id, embedding), a bounded set whose neighbours are found exactly."""
    near = index.top(sample, k + 1, "cosine").where((F.col("query_id") != F.col("vec_id")) & (F.col("distance") <= 1 - threshold + SLACK)).where(F.col("rank") <= k + 1)
    asked = {int(i): v for ids, q in index._portions(sample) for i, v in zip(ids, q, strict=True)}
    places = []
    hits = near.join(index.rows().select("vec_id", "ball"), "vec_id").select("query_id", "ball").collect()  # k rows for each of the sample
    ranks = {i: np.argsort(np.argsort(squared(v[None], index.centres)[0], kind="stable")) for i, v in asked.items()}
    for r in hits:
        places.append(int(ranks[r.query_id][r.ball]))
    if not places:
        return 1, 1.0
    found = np.cumsum(np.bincount(places, minlength=len(index.centres))) / len(places)
    probes = int(np.searchsorted(found, target - 1e-12)) + 1
    return min(probes, len(index.centres)), float(found[min(probes, len(found)) - 1])


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, with four bytes an entry where that loses nothing."""
    with np.errstate(over="ignore"):
        half = x.astype("<f4")
    short = (half == x).all(axis=1)
    return [half[i].tobytes() if short[i] else x[i].astype("<f8").tobytes() for i in range(len(x))]


def unpacked(rows: pd.Series, d: int) -> np.ndarray:
    out, short = np.empty((len(rows), d)), (rows.map(len) == 4 * d).to_numpy(dtype=bool)
    for which, kind in ((short, "<f4"), (~short, "<f8")):
        out[which] = np.frombuffer(b"".join(rows[which]), dtype=kind).reshape(-1, d)
    return out


def chain(centres: np.ndarray) -> np.ndarray:
    """The centres' numbers in an order where near ones follow each other, each time the nearest that is left."""
    order, left = [], np.ones(len(centres), dtype=bool)
    for _ in range(len(centres)):
        gap = squared(centres[order[-1:]], centres)[0] if order else np.zeros(len(centres))
        order.append(int(np.where(left, gap, np.inf).argmin()))
        left[order[-1]] = False
    return np.array(order, dtype=np.int64)


class Deal:
    """Blocks of about equally many vectors, which follow the balls in a chain: a large ball lies in several blocks, a block holds several small balls."""

    def __init__(self, centres: np.ndarray, counts: np.ndarray, sides: int, probes: int):
        self.centres, self.counts, self.sides, self.probes = centres, np.maximum(1, counts), sides, probes
        order = chain(centres)
        self.before = np.empty(len(centres), dtype=np.int64)
        self.before[order] = np.cumsum(self.counts[order]) - self.counts[order]
        self.total = int(self.counts.sum())
        first, last = self.before * sides // self.total, (self.before + self.counts - 1) * sides // self.total
        #: (balls, blocks): where a ball lies.
        self.lies = (first[:, None] <= np.arange(sides)) & (np.arange(sides) <= last[:, None]) & (counts > 0)[:, None]

    def block(self, ball: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (self.before[ball] + salt % self.counts[ball]) * self.sides // self.total

    def wanted(self, x: np.ndarray) -> np.ndarray:
        """(rows, balls): the balls that a row looks into."""
        out = np.zeros((len(x), len(self.centres)), dtype=bool)
        for at in range(0, len(x), 1024):
            near = np.argsort(squared(x[at : at + 1024], self.centres), axis=1, kind="stable")[:, : self.probes]
            np.put_along_axis(out[at : at + 1024], near, True, axis=1)
        return out

    def goes(self, x: np.ndarray) -> np.ndarray:
        """(rows, blocks): the blocks where they lie."""
        out = np.empty((len(x), self.sides), dtype=bool)
        for at in range(0, len(x), 1024):
            out[at : at + 1024] = self.wanted(x[at : at + 1024]).astype(np.float32) @ self.lies.astype(np.float32) > 0
        return out


def neighbour_graph(index: VectorIndex, k: int = 8, threshold: float = 0.5, target: float = 0.97, sample: int = 400, block: int = 1024) -> DataFrame:
    """src, dst, score: each vector's k most similar others at or above ``threshold``, but for the share that ``target`` gives up.

    A vector looks into the balls nearest to it, as many as a bounded sample needs for the recall asked for; scores are exact cosines. Vectors lie in
    ``SIDE`` blocks of between ``block`` and ``MOST`` rows. A vector goes once to each block that holds one of its balls, however many it looks into there, and
    once to each block whose vectors look into its own. So what is shuffled grows with the vectors; work is vectors times the vectors of their balls. A task
    meets a pair of blocks at a time and keeps k rows a vector. ``search.similarity_edges`` is the exact way.
    """
    spark, d = index.spark, index.centres.shape[1] if index.centres.size else 0
    total = int(index.counts.sum())
    if not total:
        return spark.createDataFrame([], "src long, dst long, score double")
    drawn = stored(index.rows().where("vec_id is not null").select(F.col("vec_id").alias("query_id"), "embedding").sample(min(1.0, 1.5 * sample / total), 11).limit(sample), "drawn")
    probes, _ = planned_probes(index, drawn, k, threshold, target)
    sides = min(-(-total // block), max(SIDE, -(-total // MOST)))
    sent = spark.sparkContext.broadcast(Deal(index.centres, index.counts, sides, probes))
    # By what a row holds, so that each reading of it finds the same block.
    rows = index.rows().where("vec_id is not null").withColumn("salt", F.shiftrightunsigned(F.xxhash64("vec_id", "embedding"), 1))
    vectors_of = lambda pdf: np.array(pdf["embedding"].tolist(), dtype=np.float64).reshape(len(pdf), -1)

    def meet(batches):
        deal = sent.value
        met = np.zeros((sides, sides), dtype=bool)
        for pdf in batches:
            if len(pdf):
                goes, own = deal.goes(vectors_of(pdf)), deal.block(pdf["ball"].to_numpy(), pdf["salt"].to_numpy())
                for a in np.unique(own):
                    met[a] |= goes[own == a].any(axis=0)
        a, b = np.nonzero(met)
        yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32)})

    pairs = rows.mapInPandas(meet, "a int, b int").distinct().collect()  # one row a pair of blocks
    met = np.zeros((sides, sides), dtype=bool)
    met[[r.a for r in pairs], [r.b for r in pairs]] = True

    def deal_out(batches):
        deal = sent.value
        for pdf in batches:
            if not len(pdf):
                continue
            x, ball = vectors_of(pdf), pdf["ball"].to_numpy()
            goes, own, ids, vector = deal.goes(x), deal.block(ball, pdf["salt"].to_numpy()), pdf["vec_id"].to_numpy(), pd.Series(packed(x), dtype=object).to_numpy()
            for other in range(sides):
                for source, some in ((True, np.flatnonzero(goes[:, other])), (False, np.flatnonzero(met[other][own]))):
                    if len(some):
                        a, b = (own[some], np.full(len(some), other)) if source else (np.full(len(some), other), own[some])
                        yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "source": source, "ball": ball[some], "vec_id": ids[some], "vector": vector[some]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        deal, source, ids, x, ball = sent.value, pdf["source"].to_numpy(dtype=bool), pdf["vec_id"].to_numpy(), unpacked(pdf["vector"], d), pdf["ball"].to_numpy()
        best, wanted = Nearest(int(source.sum()), k), deal.wanted(x[source])
        src, a, dst, b, lies = ids[source], x[source], ids[~source], x[~source], ball[~source]
        for here in np.unique(lies):
            best.look("cosine", np.flatnonzero(wanted[:, here]), a, b[lies == here], dst[lies == here], src)
        found = best.found(src)
        scores = np.round(1 - found["distance"].to_numpy(), 6) + 0.0
        return pd.DataFrame({"src": found["query_id"], "dst": found["vec_id"], "score": scores})[scores >= threshold]

    dealt = rows.mapInPandas(deal_out, "a int, b int, source boolean, ball int, vec_id long, vector binary")
    # A pair of blocks is much work for its bytes, by which tasks would be joined otherwise.
    tasks = max(-(-len(pairs) // 4), min(len(pairs), spark.sparkContext.defaultParallelism))
    found = dealt.repartition(tasks, "a", "b").groupBy("a", "b").applyInPandas(compare, "src long, dst long, score double")
    return top_k(found, k, [F.desc("score"), F.col("dst")], ["src"]).drop("rank")
