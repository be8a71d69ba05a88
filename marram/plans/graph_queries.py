"""Queries over the graph and the hierarchy: build, expand, search, promote, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.ranking import positions
from marram.functions.text import query_tokens
from marram.operators import graph, hierarchy, search, tables
from marram.plans.registry import KEYWORDS, PLACED, REFS, SECTION, SEEDS, WORDS, query
from marram.plans.scratch import stored
from marram.plans.search_queries import BM25
from marram.sources.views import keyword_lists, keywords, placed, references, seeds, table, text_index, text_queries, vectors

LONG = "long"
GRAPH = f"{PLACED}, {KEYWORDS}, {SEEDS}"
LIMIT = 12


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References with positions (without their texts, which nobody has to sort), keyword edges and seeds."""
    refs = references(spark, sf_dir)
    return placed(refs.drop("text")), keywords(refs), seeds(refs)


def _similarity(spark: SparkSession, sf_dir: str, sources: DataFrame | None = None) -> DataFrame:
    """All edges, or those of some references."""
    rows = vectors(spark, sf_dir)
    return search.similarity_edges(rows, threshold=0.3, k=8) if sources is None else search.edges_of(rows, sources, threshold=0.3, k=8)


@query(
    f"""WITH {GRAPH}, s AS (SELECT guideline_id, reference_group_id, bucket FROM refs), sec AS (SELECT DISTINCT guideline_id, reference_group_id, -1 AS b, 1 AS l FROM s UNION SELECT guideline_id, reference_group_id, bucket, 2 FROM s UNION SELECT guideline_id, reference_group_id, bucket, 3 FROM s)
SELECT 'guidelines' AS kind, count(DISTINCT guideline_id) AS n FROM refs UNION ALL SELECT 'references', count(*) FROM refs UNION ALL SELECT 'sections', count(*) FROM sec
 UNION ALL SELECT 'keywords', count(DISTINCT keyword) FROM kw UNION ALL SELECT 'keyword_edges', count(*) FROM kw UNION ALL SELECT 'next_edges', (SELECT count(*) FROM refs) - (SELECT count(DISTINCT guideline_id) FROM refs)"""
)
def graph_nodes_edges_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return graph.summary(placed(refs.drop("text")), keyword_lists(refs))


@query(f"WITH {PLACED} SELECT a.guideline_id, a.reference_id AS src, b.reference_id AS dst FROM placed a JOIN placed b ON a.guideline_id = b.guideline_id AND b.pos = a.pos + 1")
def next_prev_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.next_edges(placed(references(spark, sf_dir).select("reference_id", "guideline_id", "bucket")))


NEAR = """nb AS (SELECT DISTINCT s.query_id, b.reference_id, abs(b.pos - a.pos) AS hops FROM seeds s JOIN placed a ON a.reference_id = s.reference_id
 JOIN placed b ON b.guideline_id = a.guideline_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND b.pos <> a.pos)"""


@query(f"WITH {GRAPH}, {NEAR} SELECT query_id, reference_id, hops FROM nb")
def graph_expand_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, _, start = _graph(spark, sf_dir)
    return graph.neighbors(start, refs, 2).withColumn("hops", F.col("hops").cast(LONG))


MATES = f"""m AS (SELECT reference_id, {SECTION} AS section_key FROM refs), own AS (SELECT s.query_id, m.section_key, s.reference_id FROM seeds s JOIN m USING (reference_id)),
mt AS (SELECT DISTINCT o.query_id, m.reference_id, m.section_key FROM own o JOIN m USING (section_key) WHERE m.reference_id <> o.reference_id)"""


@query(f"WITH {GRAPH}, {MATES} SELECT query_id, reference_id, section_key FROM mt")
def graph_expand_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, _, start = _graph(spark, sf_dir)
    return graph.section_mates(start, refs)


SHARED = """sz AS (SELECT reference_id, count(*) AS n FROM kw GROUP BY 1),
kp AS (SELECT s.query_id, s.reference_id AS seed_id, b.reference_id, count(*) AS shared FROM seeds s JOIN kw a ON a.reference_id = s.reference_id JOIN kw b ON b.keyword = a.keyword AND b.reference_id <> a.reference_id GROUP BY 1, 2, 3),
kr AS (SELECT kp.*, shared / least(x.n, y.n)::DOUBLE AS raw FROM kp JOIN sz x ON x.reference_id = kp.reference_id JOIN sz y ON y.reference_id = seed_id),
ks AS (SELECT query_id, seed_id, reference_id, shared, round(raw, 6) AS ratio FROM kr WHERE shared >= 2 OR (shared >= 2 AND raw >= 0.8))"""


@query(f"WITH {GRAPH}, {SHARED} SELECT query_id, seed_id, reference_id, shared, ratio FROM ks")
def graph_expand_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return graph.keyword_pairs(seeds(refs), keywords(refs), 2, 0.8)


@query(f"WITH {GRAPH}, {SHARED.replace('shared >= 2 OR (shared >= 2 AND raw >= 0.8)', 'shared >= 4 OR (shared >= 2 AND raw >= 0.4)')} SELECT query_id, seed_id, reference_id, shared, ratio FROM ks")
def graph_expand_keyword_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shared keywords, or two that are four tenths of the smaller set."""
    refs = references(spark, sf_dir)
    return graph.keyword_pairs(seeds(refs), keywords(refs), 4, 0.4)


EDGES = """ev AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
en AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM ev),
ep AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.n * b.n), 6) AS score FROM en a JOIN en b ON a.vec_id <> b.vec_id),
er AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM ep WHERE score >= 0.3), es AS (SELECT src, dst, score FROM er WHERE r <= 8),
sm AS (SELECT s.query_id, dst AS reference_id, max(score) AS score FROM seeds s JOIN es ON src = s.reference_id GROUP BY 1, 2)"""


@query(f"WITH {GRAPH}, {EDGES} SELECT query_id, reference_id, score FROM sm")
def graph_expand_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = seeds(references(spark, sf_dir))
    return graph.similar(start, _similarity(spark, sf_dir, start), 0.3)


def _ranked_sql(parts: str, limit: int, seeds_first: str) -> str:
    return f"""rs AS ({parts}), tt AS (SELECT query_id, reference_id, round(sum(score), 6) AS score, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) AS seeds, min(kind) AS k,
 array_to_string(list_sort(list(kind)), ',') AS reasons FROM rs GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {seeds_first} DESC, k, reference_id) AS rank FROM tt)
SELECT query_id, reference_id, score::DOUBLE AS score, replace(replace(replace(replace(replace(reasons, '0', 'seed'), '1', 'neighbor'), '2', 'section'), '3', 'keyword'), '4', 'similarity') AS reasons, rank FROM rk WHERE rank <= {limit}"""


def _cap(table_: str, n: int, order: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rn FROM {table_}) WHERE rn <= {n})"


EXPAND = _ranked_sql(
    """SELECT query_id, reference_id, 0 AS kind, 1.0::DOUBLE AS score FROM seeds UNION ALL SELECT query_id, reference_id, 1, greatest(0.1, 0.7 - 0.15 * hops) FROM nb
 UNION ALL SELECT query_id, reference_id, 2, 0.45 FROM mt
 UNION ALL SELECT query_id, reference_id, 3, greatest(least(1.0, 0.25 * shared), ratio) FROM ks
 UNION ALL SELECT query_id, reference_id, 4, score FROM sm""",
    LIMIT,
    "(CASE WHEN seeds > 0 THEN 1 ELSE 0 END)",
)


@query(f"WITH {GRAPH}, {NEAR}, {MATES}, {SHARED}, {EDGES}, {EXPAND}".replace("SELECT query_id, reference_id, score::DOUBLE", "SELECT query_id, reference_id, score::DOUBLE").replace(", rs AS", ", rs AS"))
def graph_expand_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, links, start = _graph(spark, sf_dir)
    out = graph.expand(start, refs, links, _similarity(spark, sf_dir, start), limit=LIMIT, depth=2, threshold=0.3)
    return out.withColumn("rank", F.col("rank").cast(LONG))


SEARCH_PARTS = f"""hits AS (SELECT query_id, reference_id, score, rank FROM bt WHERE rank <= 5),
hn AS (SELECT DISTINCT h.query_id, b.reference_id, abs(b.pos - a.pos) AS hops FROM hits h JOIN placed a ON a.reference_id = h.reference_id JOIN placed b ON b.guideline_id = a.guideline_id AND abs(b.pos - a.pos) = 1),
hm AS (SELECT reference_id, {SECTION} AS section_key FROM refs), ho AS (SELECT h.query_id, m.section_key, h.reference_id FROM hits h JOIN hm m USING (reference_id)),
ht AS (SELECT DISTINCT o.query_id, m.reference_id, m.section_key FROM ho o JOIN hm m USING (section_key) WHERE m.reference_id <> o.reference_id),
tk AS (SELECT DISTINCT item_id AS query_id, token FROM (SELECT item_id, unnest({WORDS}) AS token FROM benchmark) WHERE length(token) >= 3), tn AS (SELECT query_id, count(*) AS n2 FROM tk GROUP BY 1),
kz AS (SELECT reference_id, count(*) AS n1 FROM kw GROUP BY 1),
km AS (SELECT query_id, reference_id, count(*) AS shared FROM tk JOIN kw ON token = keyword GROUP BY 1, 2),
kk AS (SELECT km.query_id, km.reference_id, shared, round(shared / least(n1, n2)::DOUBLE, 6) AS ratio FROM km JOIN kz USING (reference_id) JOIN tn USING (query_id) WHERE shared >= 2),
hs AS (SELECT h.query_id, dst AS reference_id, max(es.score) AS score FROM hits h JOIN es ON src = h.reference_id GROUP BY 1, 2)"""
SEARCH = _ranked_sql(
    f"""SELECT x.* FROM (SELECT query_id, reference_id, 0 AS kind, score + greatest(0.0, (5 - (rank - 1)) * 0.05) AS score FROM hits UNION ALL SELECT query_id, reference_id, 1, greatest(0.1, 0.7 - 0.15 * hops) FROM hn
 UNION ALL SELECT query_id, reference_id, 2, 0.45 FROM {_cap("ht", 32, "reference_id, section_key")}
 UNION ALL SELECT query_id, reference_id, 3, greatest(least(1.0, 0.25 * shared), ratio) FROM {_cap("kk", 32, "reference_id")}
 UNION ALL SELECT query_id, reference_id, 4, score FROM {_cap("hs", 32, "score DESC, reference_id")}) x WHERE query_id IN (SELECT query_id FROM hits)""",
    8,
    "seeds",
)


@query(f"WITH {GRAPH}, {BM25}, {EDGES}, {SEARCH_PARTS}, {SEARCH}")
def graph_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text seeds for every benchmark passage, expanded over the graph."""
    refs, links, _ = _graph(spark, sf_dir)
    queries = text_queries(spark, sf_dir)
    hits = stored(text_index(spark, sf_dir).top(queries, 5), "hits")
    tokens = queries.select("query_id", F.explode(query_tokens(F.col("text"))).alias("token"))
    out = graph.search(hits, tokens, refs, links, _similarity(spark, sf_dir, hits), threshold=0.3)
    return out.withColumn("rank", F.col("rank").cast(LONG))


RANKED_SEEDS = f"{REFS}, sd AS (SELECT guideline_id AS query_id, reference_id, row_number() OVER (PARTITION BY guideline_id ORDER BY reference_id) - 1 AS seed_rank FROM refs WHERE reference_id % 50 = 0)"


def _ranked_seeds(refs: DataFrame) -> DataFrame:
    return tables.batches(seeds(refs), ["reference_id"], 10, "query_id").select("query_id", "reference_id", F.col("item_index").alias("seed_rank"))


def _hierarchy(mode: str, same: str, **options):
    sql = f"""WITH {RANKED_SEEDS}, s AS (SELECT sd.*, reference_group_id AS g, guideline_id AS d, bucket AS b FROM sd JOIN refs USING (reference_id))
SELECT s.query_id, r.reference_id, min(s.seed_rank) AS first_seed FROM s JOIN refs r ON r.reference_group_id = g AND r.guideline_id = d {same} GROUP BY 1, 2"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        refs = references(spark, sf_dir)
        return hierarchy.expand(_ranked_seeds(refs), refs, mode, **options).withColumn("first_seed", F.col("first_seed").cast(LONG))

    run.__name__ = f"hierarchy_expand_{mode}"
    query(sql)(run)


_hierarchy("direct_parent", "AND r.bucket = b")
_hierarchy("levels_up", "", levels_up=2)
_hierarchy("heading_level", "", heading_level=1)


@query(
    f"""WITH {RANKED_SEEDS}, s AS (SELECT sd.query_id, reference_id, reference_group_id AS g, guideline_id AS d, bucket AS b FROM sd JOIN refs USING (reference_id)),
z AS (SELECT reference_group_id AS g, guideline_id AS d, bucket AS b, count(*) AS size FROM refs GROUP BY 1, 2, 3), c AS (SELECT query_id, g, d, b, count(DISTINCT reference_id) AS n FROM s GROUP BY 1, 2, 3, 4),
f AS (SELECT query_id, g, d, b FROM c JOIN z USING (g, d, b) WHERE n / size::DOUBLE >= 0.2), m AS (SELECT DISTINCT query_id, reference_id FROM f JOIN refs ON g = reference_group_id AND d = guideline_id AND b = bucket)
SELECT query_id, reference_id, true AS promoted FROM m UNION ALL SELECT DISTINCT query_id, reference_id, false FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = s.query_id AND m.reference_id = s.reference_id)"""
)
def hierarchy_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return hierarchy.promote(_ranked_seeds(refs), refs, 0.2)


@query(
    f"""WITH {REFS}, p AS (SELECT reference_group_id AS g, guideline_id AS d, bucket, reference_id FROM refs), n AS (SELECT g, d, unnest([1, 2, 3]) AS l, bucket FROM p)
SELECT substr(sha1(g || '|' || d || '|1|1|' || g || CASE WHEN l > 1 THEN '|2|1.' || bucket || '|B' || bucket ELSE '' END || CASE WHEN l > 2 THEN '|3||' ELSE '' END), 1, 20) AS node, max(l)::BIGINT AS depth, count(*) AS descendants,
 max(CASE l WHEN 1 THEN '1 ' || g WHEN 2 THEN '1.' || bucket || ' B' || bucket ELSE d END) AS label FROM n GROUP BY 1"""
)
def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.nodes(references(spark, sf_dir)).select("node", F.col("depth").cast(LONG).alias("depth"), "descendants", "label")


@query(
    f"""WITH {RANKED_SEEDS}, p AS (SELECT *, row_number() OVER (PARTITION BY reference_group_id, guideline_id ORDER BY bucket, reference_id) - 1 AS pos FROM refs),
n AS (SELECT sd.query_id, b.reference_id, CASE WHEN b.pos = a.pos THEN 0 ELSE 1 END AS kind, seed_rank, b.pos - a.pos AS off FROM sd JOIN p a USING (reference_id) JOIN p b ON b.reference_group_id = a.reference_group_id AND b.guideline_id = a.guideline_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2),
f AS (SELECT query_id, reference_id, min({{'kind': kind, 'r': seed_rank, 'o': off}}) AS first FROM n GROUP BY 1, 2)
SELECT query_id, reference_id, row_number() OVER (PARTITION BY query_id ORDER BY first, reference_id) AS place FROM f"""
)
def neighborhood_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir).drop("text")
    keyed = refs.withColumn("_g", F.concat_ws("|", "reference_group_id", "guideline_id"))
    return hierarchy.neighborhood(_ranked_seeds(refs), positions(keyed, "_g", ["bucket", "reference_id"]), 2).withColumn("place", F.col("place").cast(LONG))


@query(f"WITH {GRAPH}, {NEAR} SELECT DISTINCT query_id, reference_id FROM nb WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = nb.query_id AND s.reference_id = nb.reference_id)")
def added_except_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marram.operators.rank import added

    refs, _, start = _graph(spark, sf_dir)
    return added(graph.neighbors(start, refs, 2).select("query_id", "reference_id").distinct(), start, ["query_id", "reference_id"])


@query(f"WITH {BM25} SELECT b.query_id, b.rank, b.reference_id, source AS guideline_id, n_chars FROM bt b JOIN documents ON doc_id = reference_id WHERE rank <= 3")
def hit_materialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = text_index(spark, sf_dir).top(text_queries(spark, sf_dir), 3)
    refs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("reference_id"), F.col("source").alias("guideline_id"), "n_chars")
    return search.materialise_hits(hits, refs).select("query_id", F.col("rank").cast(LONG).alias("rank"), "reference_id", "guideline_id", "n_chars")
