"""Search: full text (BM25), vectors, hybrid and fused."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.ranking import top_k
from marram.functions.text import query_tokens
from marram.operators.textindex import SHORTEST, exploded, part, sized
from marram.operators.vectorindex import CELLS, MOST, NULL, QUERY_BYTES, SIDE, Nearest, pairwise
from marram.plans.scratch import stored


def rounded(x: Column | str) -> Column:
    return F.round(x, 6)


def bm25(refs: DataFrame, queries: DataFrame, text: Column | None = None) -> DataFrame:
    """query_id, reference_id, score for every document that shares a word with a query, without an index.

    One narrow scan counts words; a second explodes them. Only words of queries are stored and shuffled, and a document's
    length is a column below the explode, which would count it for each of its words otherwise. For searches that come
    again ``textindex.TextIndex`` reads a part of this.
    """
    text = text if text is not None else F.col("text")
    texts = sized(refs, text)
    total, mean = texts.agg(F.count(F.lit(1)), F.avg("length")).first()
    wanted = queries.select("query_id", F.explode(query_tokens(F.col("text"), SHORTEST)).alias("term"))
    words = exploded(texts)
    postings = words.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term", "reference_id", "length").agg(F.count(F.lit(1)).alias("tf"))
    postings = stored(postings, "postings")
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = postings.join(frequency, "term").select("term", "reference_id", part(F.col("tf"), F.col("length"), idf, mean).alias("part")).join(wanted, "term")
    return scored.groupBy("query_id", "reference_id").agg(rounded(F.sum("part")).alias("score"))


def bm25_top(refs: DataFrame, queries: DataFrame, k: int, text: Column | None = None) -> DataFrame:
    return top_k(bm25(refs, queries, text), k, [F.desc("score"), F.col("reference_id")], ["query_id"])


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, kind: str = "cosine", apart: bool = False) -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest rows of ``vectors`` (vec_id, embedding) to each
    of ``queries`` (query_id, embedding), exactly; with ``apart`` of those with another id than the query's.

    A stated query set against all rows, in blocks: query vectors go out in portions of a checked
    size, each task keeps its k best per query, and those meet in a top-k. Distances are computed a tile at a time. Vectors that are
    null or of another length than the query have no distance.
    """
    spark = vectors.sparkSession
    usable = queries.where("embedding is not null and size(embedding) > 0")
    n, width = usable.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    portions = max(1, -(-(n or 0) * (width or 1) * 8 // QUERY_BYTES))
    found = None
    for part in range(portions):
        rows = usable.where(F.pmod(F.xxhash64("query_id"), F.lit(portions)) == part).select("query_id", "embedding").orderBy("query_id").toPandas()
        blocks = {size: (g["query_id"].to_numpy(), np.array(g["embedding"].tolist(), dtype=np.float64)) for size, g in rows.groupby(rows["embedding"].map(len))} if len(rows) else {}
        sent = spark.sparkContext.broadcast(blocks)

        def run(batches, sent=sent):
            blocks = sent.value
            best = {size: Nearest(len(ids), k) for size, (ids, _) in blocks.items()}
            for pdf in batches:
                for size, group in pdf.groupby(pdf["embedding"].map(len)):
                    if size in blocks:
                        ids, q = blocks[size]
                        best[size].look(kind, np.arange(len(q)), q, np.array(group["embedding"].tolist(), dtype=np.float64), group["vec_id"].to_numpy(), ids if apart else None)
            for size, (ids, _) in blocks.items():
                yield best[size].found(ids)

        each = vectors.where("embedding is not null").select(F.coalesce("vec_id", F.lit(NULL)).alias("vec_id"), "embedding")
        part_found = each.mapInPandas(run, "query_id long, vec_id long, distance double").withColumn("vec_id", F.nullif("vec_id", F.lit(NULL)))
        found = part_found if found is None else found.unionByName(part_found)
    return top_k(found, k, [F.col("distance"), F.col("vec_id")], ["query_id"])


def edges_of(vectors: DataFrame, sources: DataFrame, threshold: float = 0.5, k: int = 8) -> DataFrame:
    """src, dst, score: the rows of similarity_edges() whose src is a reference_id of ``sources``, a stated query set, without the other rows' work."""
    ids = sources.select(F.col("reference_id").alias("vec_id")).distinct()
    asked = stored(vectors.join(ids, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding"), "edge-sources")
    near = vector_top(vectors.where("vec_id is not null"), asked, k, apart=True)
    return near.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), rounded(1 - F.col("distance")).alias("score")).where(F.col("score") >= threshold)


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, alpha: float = 0.5) -> DataFrame:
    """query_id, reference_id, score: alpha * vector + (1 - alpha) * text, each scaled to 0..1 inside
    its query (a single value counts 1); a side that lacks a document gives 0 (T3).

    vector_hits: query_id, reference_id, similarity; text_hits: query_id, reference_id, score.
    """

    def scaled(df: DataFrame, column: str, out: str) -> DataFrame:
        range_ = df.groupBy("query_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        value = F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
        return df.join(range_, "query_id").select("query_id", "reference_id", value.alias(out))

    both = scaled(vector_hits, "similarity", "v").join(scaled(text_hits, "score", "t"), ["query_id", "reference_id"], "full")
    return both.select("query_id", "reference_id", rounded(alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("t", F.lit(0.0))).alias("score"))


def fuse(hits: DataFrame, per_query_limit: int = 10) -> DataFrame:
    """query_id, reference_id, score: weighted sum over subqueries.

    hits: query_id, subquery, weight, reference_id, rank, score; without a score the rank gives
    max(0, 1 - (rank - 1) / per_query_limit). ``first_seen`` breaks ties.
    """
    by_rank = F.greatest(F.lit(0.0), 1 - (F.col("rank") - 1) / F.lit(float(per_query_limit)))
    part = F.col("weight") * F.coalesce("score", by_rank)
    return hits.groupBy("query_id", "reference_id").agg(rounded(F.sum(part)).alias("score"), F.min(F.struct("subquery", "rank")).alias("first_seen"))


def subqueries(asked: DataFrame) -> DataFrame:
    """asked (query_id, default, queries: array<struct<text,weight>>) -> query_id, subquery, text, weight (S3): blank
    queries are skipped; where none is left the default text is asked with weight 1."""
    usable = F.filter("queries", lambda q: F.trim(F.coalesce(q["text"], F.lit(""))) != "")
    given = F.transform(usable, lambda q: F.struct(F.trim(q["text"]).alias("text"), F.coalesce(q["weight"].cast("double"), F.lit(1.0)).alias("weight")))
    fallback = F.array(F.struct(F.col("default").alias("text"), F.lit(1.0).alias("weight")))
    chosen = F.when(F.size(given) > 0, given).otherwise(fallback)
    return asked.select("query_id", F.posexplode(chosen).alias("i", "q")).select("query_id", (F.col("i") + 1).alias("subquery"), "q.text", "q.weight")


def at_least(column: str, minimum: float | None) -> Column:
    """Minimum score; a null score passes."""
    return F.lit(True) if minimum is None else F.col(column).isNull() | (F.col(column) >= minimum)


def similarity_edges(vectors: DataFrame, threshold: float = 0.5, k: int = 8, group: str | None = None, block: int = 1024) -> DataFrame:
    """src, dst, score: each vector's k most similar others at or above the threshold.

    Rows are dealt at random into blocks, of a group ``SIDE`` of them where a block then has between ``block`` and ``MOST`` rows;
    every ordered pair of blocks is one group of a task, which compares them a tile at a time
    and keeps k rows per source, so no task sees more than two blocks and no pair is written that
    isn't among a block's best. A row is shuffled once for each block, so up to ``SIDE * MOST`` rows of a group what is shuffled grows
    with the rows, and not with their square.
    """
    rows = vectors.select(F.col("vec_id"), "embedding", (F.col(group) if group else F.lit(0)).alias("grp")).where("embedding is not null")
    counts = rows.groupBy("grp").agg(F.expr(f"cast(least(ceil(count(*) / {block}), greatest({SIDE}, ceil(count(*) / {MOST}))) as int)").alias("blocks"))
    dealt = rows.join(counts, "grp").withColumn("own", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)"))
    left = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("grp", F.col("own").alias("a"), F.col("other").alias("b"), F.lit(True).alias("source"), "vec_id", "embedding")
    right = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("grp", F.col("other").alias("a"), F.col("own").alias("b"), F.lit(False).alias("source"), "vec_id", "embedding")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].to_numpy(dtype=bool)
        x = np.array(pdf["embedding"].tolist(), dtype=np.float64)
        ids = pdf["vec_id"].to_numpy()
        out = [pd.DataFrame({"src": ids[:0], "dst": ids[:0], "score": np.zeros(0)})]
        if source.any() and not source.all():
            src, dst, a, b = ids[source], ids[~source], x[source], x[~source]
            keep, step = min(k, len(dst)), max(1, CELLS // len(dst))
            for at in range(0, len(src), step):
                own = src[at : at + step]
                scores = np.round(1 - pairwise("cosine", a[at : at + step], b), 6)
                scores[own[:, None] == dst[None]] = -np.inf
                border = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
                i, j = np.nonzero((scores >= border[:, None]) & (scores >= threshold))
                out.append(pd.DataFrame({"src": own[i], "dst": dst[j], "score": scores[i, j] + 0.0}))
        return pd.concat(out)

    pairs = left.unionByName(right).groupBy("grp", "a", "b").applyInPandas(run, "src long, dst long, score double")
    return top_k(pairs, k, [F.desc("score"), F.col("dst")], ["src"]).drop("rank")


def materialise_hits(hits: DataFrame, refs: DataFrame) -> DataFrame:
    """Hits with their references' columns; hits without one are dropped, ranks stay."""
    return hits.join(refs, "reference_id")
