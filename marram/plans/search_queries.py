"""Queries over vectors and full text: top-k, edges, hybrid, fusion, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions import text as X
from marram.functions import vectors as V
from marram.functions.ranking import top_k
from marram.operators import rank, search
from marram.operators.textindex import TextIndex
from marram.operators.vectorindex import neighbour_graph
from marram.plans.registry import WORDS, query
from marram.plans.scratch import scratch_path
from marram.sources.providers import overlap_scorer
from marram.sources.views import references, table, text_index, text_queries, vector_index, vector_queries, vectors

LONG = "long"
VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 50 = 0)"
DOT = "list_sum(list_transform(list_zip(qe, e), lambda p: p[1] * p[2]))"
MEASURES = {
    "cosine": f"1 - {DOT} / (sqrt(list_sum(list_transform(qe, lambda x: x * x))) * sqrt(list_sum(list_transform(e, lambda x: x * x))))",
    "dot": f"-{DOT}",
    "l2-squared": "list_sum(list_transform(list_zip(qe, e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "manhattan": "list_sum(list_transform(list_zip(qe, e), lambda p: abs(p[1] - p[2])))",
    "hamming": "list_sum(list_transform(list_zip(qe, e), lambda p: CASE WHEN p[1] <> p[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))",
}


def _top(kind: str):
    sql = f"""WITH {VECTORS}, d AS (SELECT query_id, vec_id, round({MEASURES[kind]}, 6) + 0.0 AS distance FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, vec_id, distance, rank FROM r WHERE rank <= 10"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.vector_top(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10, kind).withColumn("rank", F.col("rank").cast(LONG))

    run.__name__ = "vector_topk_" + kind.split("-")[0]
    query(sql)(run)

    def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vector_index(spark, sf_dir).top(vector_queries(spark, sf_dir), 10, kind).withColumn("rank", F.col("rank").cast(LONG))

    balls.__name__ = "vector_balls_" + kind.split("-")[0]
    query(sql)(balls)


for _kind in V.DISTANCES:
    _top(_kind)


@query(
    f"""WITH {VECTORS}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round({DOT.replace("qe", "a.e").replace("(list_zip(a.e, e)", "(list_zip(a.e, b.e)")}
 / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x)))), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM p WHERE score >= 0.2) SELECT src, dst, score FROM r WHERE r <= 8"""
)
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.similarity_edges(vectors(spark, sf_dir), threshold=0.2, k=8)


@query()
def similarity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most of these edges by looking into near balls only; a test measures its recall against them."""
    return neighbour_graph(vector_index(spark, sf_dir), k=8, threshold=0.2)


BM25 = f"""docs AS (SELECT doc_id, {WORDS} AS ws0 FROM documents), d AS (SELECT doc_id, list_filter(ws0, lambda x: length(x) >= 1) AS ws FROM docs), st AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS m FROM d),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark) WHERE length(term) >= 3),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id AS reference_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / m))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
bt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, reference_id) AS rank FROM bm)"""


@query(f"WITH {BM25} SELECT query_id, reference_id, score, rank FROM bt WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).top(text_queries(spark, sf_dir), 10).select("query_id", "reference_id", "score", F.col("rank").cast(LONG).alias("rank"))


@query(f"WITH {BM25} SELECT query_id, reference_id, score, rank FROM bt WHERE rank <= 10")
def bm25_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index that is made here in two steps: the second half of the documents is appended."""
    refs, index = references(spark, sf_dir), TextIndex(spark, scratch_path(spark, "appended-index"))
    half = F.pmod(F.xxhash64("reference_id"), F.lit(2)) == 0
    index.append(refs.where(half)).append(refs.where(~half))
    return index.top(text_queries(spark, sf_dir), 10).select("query_id", "reference_id", "score", F.col("rank").cast(LONG).alias("rank"))


PAIRED = "pq AS (SELECT item_id AS query_id, vec_id * 50 AS vid FROM (SELECT item_id, item_id % (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS vec_id FROM benchmark))"
HYBRID = f"""{BM25}, {VECTORS}, {PAIRED}, vd AS (SELECT pq.query_id, v.vec_id AS reference_id, round({MEASURES["cosine"]}, 6) + 0.0 AS distance FROM pq JOIN q ON q.query_id = pq.vid, v),
vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, reference_id) AS rank FROM vd), vh AS (SELECT query_id, reference_id, round(1 - distance, 6) AS s FROM vt WHERE rank <= 20),
vs AS (SELECT query_id, reference_id, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 1.0 END AS v FROM vh WINDOW w AS (PARTITION BY query_id)),
th AS (SELECT query_id, reference_id, score AS s FROM bt WHERE rank <= 20),
ts AS (SELECT query_id, reference_id, CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 1.0 END AS t FROM th WINDOW w AS (PARTITION BY query_id)),
hy AS (SELECT query_id, reference_id, round(0.5 * coalesce(v, 0.0) + 0.5 * coalesce(t, 0.0), 6) AS score FROM vs FULL JOIN ts USING (query_id, reference_id))"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each text query: that of the query set's row at its number, counted round."""
    rows = vector_queries(spark, sf_dir)
    n = rows.count()
    items = text_queries(spark, sf_dir).select("query_id", (F.col("query_id") % n * 50).alias("vid"))
    return items.join(rows.select(F.col("query_id").alias("vid"), "embedding"), "vid").select("query_id", "embedding")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.vector_top(vectors(spark, sf_dir), _paired(spark, sf_dir), 20).select("query_id", F.col("vec_id").alias("reference_id"), F.round(1 - F.col("distance"), 6).alias("similarity"))
    return search.hybrid(near, text_index(spark, sf_dir).top(text_queries(spark, sf_dir), 20))


@query(f"WITH {HYBRID}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, reference_id) AS rank FROM hy) SELECT query_id, reference_id, score, rank FROM r WHERE rank <= 10")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_hybrid(spark, sf_dir), 10, [F.desc("score"), F.col("reference_id")], ["query_id"]).withColumn("rank", F.col("rank").cast(LONG))


@query(
    f"""WITH {HYBRID}, hits AS (SELECT query_id, 1 AS subquery, 1.0 AS weight, reference_id, rank, score FROM bt WHERE rank <= 10
 UNION ALL SELECT query_id, 2, 0.5, reference_id, rank, NULL FROM vt WHERE rank <= 10),
f AS (SELECT query_id, reference_id, round(sum(weight * coalesce(score, greatest(0.0, 1 - (rank - 1) / 10.0))), 6) AS score FROM hits GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, reference_id) AS rank FROM f) SELECT query_id, reference_id, score::DOUBLE AS score, rank FROM r WHERE rank <= 5"""
)
def multi_query_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_index(spark, sf_dir).top(text_queries(spark, sf_dir), 10).select("query_id", F.lit(1).alias("subquery"), F.lit(1.0).alias("weight"), "reference_id", "rank", "score")
    near = search.vector_top(vectors(spark, sf_dir), _paired(spark, sf_dir), 10)
    near = near.select("query_id", F.lit(2).alias("subquery"), F.lit(0.5).alias("weight"), F.col("vec_id").alias("reference_id"), "rank", F.lit(None).cast("double").alias("score"))
    fused = search.fuse(text.unionByName(near), 10)
    return top_k(fused, 5, [F.desc("score"), F.col("reference_id")], ["query_id"]).select("query_id", "reference_id", "score", F.col("rank").cast(LONG).alias("rank"))


@query(
    f"""WITH {VECTORS}, p AS (SELECT a.vec_id AS id, a.e AS qe, b.e AS e FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT id, CASE WHEN e IS NOT NULL THEN round(1 - ({MEASURES["cosine"]}), 6) END AS cosine_similarity, CASE WHEN e IS NOT NULL THEN round(sqrt({MEASURES["l2-squared"]}), 6) END AS euclidean_distance,
 CASE WHEN e IS NULL THEN 'unavailable' ELSE 'ok' END AS status FROM p"""
)
def embedding_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.operators.evaluation import embedding_scores

    rows = vectors(spark, sf_dir)
    pairs = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b")), "id", "left")
    return embedding_scores(pairs, V.cosine(F.col("a"), F.col("b")), V.euclidean(F.col("a"), F.col("b")))


@query(f"WITH {VECTORS} SELECT vec_id, round(list_sum(list_transform(e, lambda x: abs(x))) / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS unit_l1 FROM v")
def vector_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(V.unit(F.col("embedding")), F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return vectors(spark, sf_dir).select("vec_id", F.round(total, 6).alias("unit_l1"))


ITEMS = """i AS (SELECT d.source AS query_id, d.doc_id AS idx, CASE WHEN l.quality IS NOT NULL THEN (l.quality * 100 + d.n_chars % 100)::DOUBLE END AS score, d.text FROM documents d
 LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    score = F.when(F.col("quality").isNotNull(), (F.col("quality") * 100 + F.col("n_chars") % 100).cast("double"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("source").alias("query_id"), F.col("doc_id").alias("idx"), score.alias("score"), "text")


@query(
    f"""WITH {ITEMS}, p AS (SELECT *, score IS NULL OR score >= 20 AS ok FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ok DESC, score DESC NULLS LAST, idx) AS n FROM p)
SELECT query_id, idx, score, ok AND n <= 10 AS kept, CASE WHEN ok AND n <= 10 THEN n END AS place, CASE WHEN ok AND n > 10 THEN 'field Cut by top-k.' ELSE 'field' END AS reason FROM r"""
)
def filter_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).drop("text").withColumn("kept", F.lit(True)).withColumn("reason", F.lit("field"))
    return rank.decide(items, minimum=20.0, top=10).withColumn("place", F.col("place").cast(LONG))


@query(
    f"""WITH {ITEMS}, k AS (SELECT query_id, idx, row_number() OVER (PARTITION BY query_id, regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') ORDER BY coalesce(score, '-infinity'::DOUBLE) DESC, idx) AS n FROM i)
SELECT query_id, idx, n = 1 AS kept FROM k"""
)
def dedup_normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.dedup(_items(spark, sf_dir), F.col("text")).select("query_id", "idx", "kept")


@query(
    f"""WITH b AS (SELECT item_id, text FROM benchmark), qt AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS q FROM b),
d AS (SELECT doc_id, lang, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM documents),
l AS (SELECT doc_id AS reference_id, round(1 / (1 + exp(-(len(t) / 100.0 - 2))), 6)::DOUBLE AS score FROM d) SELECT reference_id, score, score >= 0.5 AS kept FROM l"""
)
def cross_encoder_stub_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    logit = F.size(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""))) / F.lit(100.0) - 2
    scored = references(spark, sf_dir).select("reference_id", F.round(V.last_softmax(F.array(logit)), 6).alias("score"))
    return scored.withColumn("kept", F.col("score") >= 0.5)


@query(
    """WITH u AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS q FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0.0 END AS score FROM u JOIN a USING (conv_id, turn)"""
)
def provider_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer provider over conversations: the user's words found in the answer."""
    turns = table(spark, sf_dir, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return rank.score_with(users.join(answers, ["conv_id", "turn"]), overlap_scorer).select("conv_id", "turn", "score")


@query(
    f"""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter({WORDS}, lambda x: length(x) >= 3)) AS w, list_filter({WORDS}, lambda x: length(x) >= 3)[1] AS f FROM conversations)
SELECT conv_id, turn, len(w) AS n, coalesce(f, 'none') AS first_word FROM t"""
)
def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.query_tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(words).cast(LONG).alias("n"), X.first_or(words, F.lit("none")).alias("first_word"))
